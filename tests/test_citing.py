"""Citations, guards, identifiers, transcripts and snippets against known values."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumix.functions import citing


def column(spark, values, c):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(c).collect()]


def cited(spark, texts):
    rows = column(spark, texts, citing.citations("x"))
    for x, found in zip(texts, rows, strict=True):
        assert [c.start for c in found] == sorted(c.start for c in found) and all(x[c.start].strip() and x[c.start : c.end].count(str(c.year)) for c in found), x
    return rows


def test_citations(spark):
    texts = ["Wie (Meier 2019) sagt; vgl. (Meier & Kurz 2019, S. 45-47).", "Das Gesetz (2019) und (Januar 2021).", "Öztürk u. a. (2020, p. 7)", "(Müller 2021, 2022)", None, "", "(Cho et al. 2011; vgl. Kim & Lee 2001)"]
    got = cited(spark, texts)
    short = [[(c.family, c.others, c.year, c.page, c.page_end, c.confidence) for c in g] for g in got]
    assert short[0] == [("Meier", "", 2019, None, None, "corroborated"), ("Meier", "& Kurz", 2019, 45, 47, "strong")]
    assert short[1] == short[4] == short[5] == []
    assert short[2] == [("Öztürk", "u. a.", 2020, 7, None, "strong")]
    assert short[3] == [("Müller", "", 2021, None, None, "weak")]
    assert [s[0] for s in short[6]] == ["Cho", "Kim"]


def test_narrative_citations(spark):
    forms = {
        "Müller (2021) belegt die These.": ("Müller", "", 2021, None, "weak"),
        "Müller (2021, S. 45) belegt die These.": ("Müller", "", 2021, 45, "strong"),
        "Müller und Schmidt (2019) belegen die These.": ("Müller", "und Schmidt", 2019, None, "strong"),
        "Müller et al. (2021) erklären das.": ("Müller", "et al.", 2021, None, "strong"),
        "Wie Müller (2021, S. 45) zeigt, ist der Effekt robust.": ("Müller", "", 2021, 45, "strong"),
        "Vgl. Schmidt 2019, S. 7 dazu.": ("Schmidt", "", 2019, 7, "strong"),
        "vgl.\n  Schmidt 2019: 7": ("Schmidt", "", 2019, 7, "strong"),
        "von Neumann (1945) schreibt:": ("von Neumann", "", 1945, None, "weak"),
    }
    for x, got in zip(forms, cited(spark, list(forms)), strict=True):
        assert [(c.family, c.others, c.year, c.page, c.confidence) for c in got] == [forms[x]], x
    prose = ["Die DSGVO (2016) trat in Kraft.", "Deutschland und Frankreich (2016) unterzeichneten den Vertrag.", "Das Gesetz (2019) sieht Ausnahmen vor.", "Im Januar (2021) zeigt sich", "Müller (2021) war dort."]
    assert cited(spark, prose) == [[]] * len(prose)


def test_secondary_citations(spark):
    texts = ["So (Schmidt, 2015, zitiert nach Müller, 2021, S. 45).", "(vgl. Roth 1990, zit. nach Beck & Lang 2004)", "(zitiert nach Müller)", "(Schmidt 2015, zitiert nach der Quelle)"]
    got = [[(c.family, c.others, c.year, c.page, c.secondary) for c in g] for g in cited(spark, texts)]
    assert got[0] == [("Schmidt", "", 2015, None, False), ("Müller", "", 2021, 45, True)]
    assert got[1] == [("Roth", "", 1990, None, False), ("Beck", "& Lang", 2004, None, True)]
    assert got[2] == [] and [g[0] for g in got[3]] == ["Schmidt"]
    assert [texts[0][c.start : c.end] for c in cited(spark, texts)[0]] == ["Schmidt, 2015", "Müller, 2021, S. 45"]


def test_citations_skip_regions(spark):
    hidden = [
        "```\n(Meier 2019, S. 1)\n```", "a `(Meier 2019, S. 1)` b", "~~~ (Meier 2019, S. 1) ~~~", "<!-- (Meier 2019, S. 1) -->", "\\cite[S. 3]{(Meier 2019)}", "\\begin{verbatim}(Meier 2019, S. 1)\\end{verbatim}",
        "Text.\n## Literaturverzeichnis\nMeier (2019, S. 1)\n", "\\section{References}\n(Meier 2019, S. 1)", "Meier `code` (2019, S. 4)", "vgl. `x` 2019",
    ]
    assert cited(spark, hidden) == [[]] * len(hidden)
    mixed = "Erst `(Roth 1990, S. 2)` und dann (\\emph{x} Meier 2019, S. 1)\n# Literatur\n(Lang 2000, S. 1)"
    assert [(c.family, mixed[c.start : c.end]) for c in cited(spark, [mixed])[0]] == [("Meier", "Meier 2019, S. 1")]


def test_guards(spark):
    rows = [("Er  sagt: alles gut.", "sagt: alles"), ("She denies it", ""), ("Das ist FALSCH, ist falsch", "x"), (None, None)]
    got = spark.createDataFrame(rows, "c string, v string").select(citing.guards("c", "v").alias("g")).collect()
    assert [tuple(r.g) for r in got] == [(True, False), (False, True), (False, True), (False, False)]


def test_context(spark):
    rows = [
        ("", "x may be", "However, no.", "a", 0.9),
        ("", "x", "It is. However, no.", "a", 0.1),
        ("", "x", "However", "However, b", None),
        ("Critics\nargue", "it may be", None, "it always is", None),
        ("Critics argue" + " and" * 30, "maybe", None, "it always may be", None),
    ]
    s = citing.context_signals("b", "v", "a", "c", F.col("s"), 0.5)
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "b string, v string, a string, c string, s double").select(s).collect()]
    assert got == [("however", None, None, False, False), (None, None, None, True, False), (None, None, None, False, True), (None, "critics argue", "may", False, False), (None, None, None, False, False)]


def test_repository(spark):
    got = column(spark, ["arXiv: 2401.00001v2 https://arxiv.org/pdf/2402.12345v1 10.1000/X). 10.1000/x", None], citing.repository_ids("x"))
    assert [tuple(g) for g in got] == [(["2402.12345", "2401.00001"], ["10.1000/x"]), ([], [])]
    files = ["title: A\ndoi: 10.1/a\npreferred-citation:\n  doi: 10.2/b\n", "title: 'B'\ndoi: 10.5281\n", "doi: [1]\n", None]
    assert [tuple(g) for g in column(spark, files, citing.citation_file("x"))] == [("10.2/b", "A"), (None, "B"), (None, None), (None, None)]


def test_transcript(spark):
    whole = "[00:12:35] I: Guten  Tag\nalle\n\n \n(01:02) B1: \n\nOhne Namen: hier\n\n\nIP_2: ja"
    got = column(spark, [whole, None, "\n\n"], citing.transcript("x"))
    assert [tuple(s) for s in got[0]] == [(1, "I", "00:12:35", "Guten Tag alle"), (2, None, "01:02", "B1:"), (3, None, None, "Ohne Namen: hier"), (4, "IP_2", None, "ja")]
    assert got[1:] == [[], []]


def test_snippets(spark):
    words = [f"w{i}" for i in range(30)]
    assert column(spark, ["a  b", "x" * 241, None], citing.snippet("x")) == ["a b", "x" * 240 + "...", ""]
    got = column(spark, [" ".join(words), "no hit", None], citing.highlight("x", ("w25", "w5"), 10))
    assert got == ["...<b>w5</b> " + " ".join(words[6:15]) + "...", "no hit", ""]


def test_drift(spark):
    q = "„ein Zitat von einiger Länge“"
    rows = [(f"Es mag sein: {q}", f"Es ist: {q}"), (f"a {q}", f"a  {q}"), (f"a {q} (Kim 1999)", f"b {q} (Lee 1999)"), ("a", f"b {q}"), (None, f"b {q}")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(citing.drifted_quotes("a", "b")).collect()]
    assert got == [["ein Zitat von einiger Länge"], [], [], [], []]


def test_densest_window(spark):
    words = [f"w{i}" for i in range(60)]
    words[5], words[30], words[33], words[50], words[52], words[54] = "a", "b,", "A", "b", "b", "b"
    got = column(spark, [" ".join(words), "a " * 20 + "b", " ".join(words[:8])], citing.highlight("x", ("a", "b"), 10))
    assert got[0] == "...<b>b,</b> w31 w32 <b>A</b> " + " ".join(words[34:40]) + "..."  # two terms go before three hits of one
    assert got[1] == "..." + " ".join(["<b>a</b>"] * 9) + " <b>b</b>"
    assert got[2] == "w0 w1 w2 w3 w4 <b>a</b> w6 w7"


def test_drift_is_told_by_the_stretch_around(spark):
    q, r = "„ein Zitat von einiger Länge“", '"another quotation, long enough"'
    far = " Und so weiter." * 40
    rows = [
        (f"Start. {q} (Kim 1999). Mitte. {r} Ende.", f"Start. {q} (Kim 1999). Mitte. {r} Schluss."),  # by r only
        (f"Start. {q}{far} {r} Ende.", f"Start!{far} {q}{far} {r} Ende."),
        (f"A {q} (Kim 1999) B", f"C {q} (Lee 1999) B"),
        (f"A {q} [@kim] B", f"C {q} [@kim] B"),
        (f"A *b* {q}", f"A b  {q}"),
        (f"{q} A {r} B", f"{r} A {q} B"),
        (f"A{far} {q} x", f"B{far} {q} x"),  # beyond the window
    ]
    got = [r_[0] for r_ in spark.createDataFrame(rows, "a string, b string").select(citing.drifted_quotes("a", "b")).collect()]
    a, b = q[1:-1], r[1:-1]
    assert got[0] == [b] and got[1] == [a] and got[2] == [] and got[3] == [a] and got[4] == [] and set(got[5]) <= {a, b} and got[6] == []
