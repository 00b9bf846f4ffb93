"""Spans: masks, offsets, sentences, and the way from normalised text back to the original, against plain versions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from vellumix.functions import spans, text
from vellumix.operators import evidence
from vellumix.operators.fuzzy import best_window, indel_ratio, window_alignment

BITS = ["a", "b", " ", "  ", "\n", "-\n", "- \n  ", "ß", "ﬁ", "ﬃ", "é", "é", "„", "“", "’", "½", "가", "각", "ẋ̣", "Ünd", "und", "Wort", "\t", "…", "A"]


def texts(rng, n, size=30):
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def column(spark, values, *cs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string").repartition(3)
    return [tuple(r)[1:] for r in sorted(df.select("i", *cs).collect(), key=lambda r: r.i)]


def test_forms_equal_the_columns(spark):
    values = texts(random.Random(1), 400)
    for x, (weak, full) in zip(values, column(spark, values, text.weak_normal("x"), text.full_normal("x")), strict=True):
        for form, want in (("weak", weak), ("full", full)):
            got = spans.FORMS[form](x)
            assert got.text == want, (x, form)
            assert len(got.text) == len(got.start) == len(got.end) and all(0 <= a < b <= len(x) for a, b in zip(got.start, got.end, strict=True))
            assert list(got.start) == sorted(got.start)


def test_spans_normalise_to_the_quote():
    """What a span of the original normalises to holds the quote, and no shorter span at its ends does."""
    rng = random.Random(2)
    for x in texts(rng, 800, 40):
        for form in ("weak", "full", "casefold"):
            whole = spans.FORMS[form](x).text
            if len(whole) < 3:
                continue
            a = rng.randrange(len(whole) - 1)
            quote = whole[a : a + rng.randint(1, 12)].strip(" -")
            if not quote:
                continue
            found = spans.locate(x, quote, form)
            assert found
            part = x[slice(*found)]
            if "-" not in part:  # whether a hyphen joins hangs on what is around
                assert quote in spans.FORMS[form](part).text, (x, quote, form)
                assert quote not in spans.FORMS[form](part[1:]).text or quote.startswith(spans.FORMS[form](part[1:]).text[:1])


def test_known_places():
    assert spans.locate("Die Maßﬂasche steht", "MASSFLASCHE", "casefold") == (4, 13)
    assert spans.locate("ein eﬃ-\ncient  method", "efficient method", "full") == (4, 21)
    assert spans.locate("x „so  ist“ y", '"so ist"', "weak") == (2, 11)
    assert spans.locate("Erstens gilt dies. Und zweitens gilt das.", "erstens gilt ... zweitens gilt", "ellipsis") == (0, 36)
    assert spans.locate("abc", "x", "full") is None and spans.locate("", "", "weak") is None
    assert spans.locate("Straße groß", "x", "fuzzy", 3, 3) == (0, 6)  # widened to whole words


def test_windows():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, n))) for n in (12, 60))
        score, at, size = window_alignment(a, b)
        if not a or len(a) >= len(b):
            assert (score, at, size) == (indel_ratio(a, b) if a and b else 0.0, 0, len(b))
            continue
        all_ = [indel_ratio(a, b[s : s + len(a)]) for s in range(len(b) - len(a) + 1)]
        assert score == pytest.approx(max(all_)) and at == all_.index(max(all_)) and size == len(a)
    assert best_window("", "abc") == (0, 0)


def test_mask_and_matches(spark):
    values = ["a `code` b ``", "no", "", None, "￿`x`"]
    got = column(spark, values, spans.mask("x", "`[^`\n]*`"), spans.matches("x", "`[^`\n]*`"), spans.between("x", "`[^`\n]*`"))
    for x, (masked, found, rest) in zip(values, got, strict=True):
        plain = (x or "").replace("￿", " ")
        assert masked == re.sub("`[^`\n]*`", lambda m: " " * len(m[0]), plain)
        assert [tuple(f) for f in found] == [(m.start(), m.end(), m[0]) for m in re.finditer("`[^`\n]*`", plain)]
        assert [plain[r.start : r.end] for r in rest] == [r.text for r in rest] == re.split("`[^`\n]*`", plain)


def plain_sentence(x, a, b):
    runs, at = [], 0
    for m in re.finditer(r"(?m)^[ \t]*(?:#{1,6}[ \t][^\n]*|(?:[-*+]|\d+[.)])[ \t][^\n]*)?(?:\n|\Z)", x):
        runs.append((at, m.start()))
        at = m.end()
    for low, high in [*runs, (at, len(x))]:
        if low <= a and b <= high:
            cuts = [m.span() for m in re.finditer(r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])", x[low:high]) if not a - low <= m.start() < b - low]
            for s, e in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), high - low], strict=True):
                if s <= a - low and b - low <= e:
                    return x[low + s : low + e].strip() or None
    return None


def test_claim_sentence(spark):
    rng = random.Random(4)
    bits = ["Ein Satz", " und mehr", ". ", "! Danach", "? ", "\n", "\n\n", "# Titel\n", "- Punkt\n", "2) zwei\n", "Q. R", "z.B. so", " "]
    rows = []
    for _ in range(600):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        a = rng.randrange(len(x))
        b = rng.randint(a + 1, min(len(x), a + 15))
        if not x[a].isspace() and not x[b - 1].isspace():
            rows.append((x, a, b))
    got = spark.createDataFrame(rows, "x string, a int, b int").select("x", "a", "b", spans.claim_sentence("x", F.col("a"), F.col("b"), 5).alias("s")).collect()
    for r in got:
        want = plain_sentence(r.x, r.a, r.b)
        assert r.s.sentence == want, (r.x, r.a, r.b)
        assert (r.s.around is None) == (want is not None)
        if want is None:
            assert r.s.around == r.x[max(0, r.a - 5) : r.b + 5].strip()
    known = "Vorher. Er sagt „Das gilt. Immer.“ laut. Danach.\n### 6.4 Titel\nNeuer „Satz hier“ folgt. Ende."
    for quote, want in (("Das gilt. Immer.", "Er sagt „Das gilt. Immer.“ laut."), ("Satz hier", "Neuer „Satz hier“ folgt."), ("6.4 Titel", None)):
        a = known.index(quote)
        row = spark.createDataFrame([(known,)], "x string").select(spans.claim_sentence("x", F.lit(a), F.lit(a + len(quote))).alias("s")).first()
        assert row.s.sentence == want


def test_verify_on_pages(spark):
    pages = [
        (1, 1, "Nothing here of interest to anyone at all."),
        (1, 2, "Then the  „eﬃcient method“ of the Maß-\nnahme is shown, twice."),
        (1, 3, 'Again the "eﬃcient method" of the Maßnahme, and more.'),
        (2, 1, " \n"), (2, 2, None),
        (4, 7, "the efficient methid of measuring"), (4, 5, "the efficient methid of measuring"), (4, 6, "unlike"),
    ]
    claims = [(1, 1, 'the "eﬃcient method" of'), (2, 1, "efficient method“ of the Maßnahme"), (3, 2, "anything"), (4, 3, "anything"), (5, 1, "  "), (6, 4, "the efficient method of measuring"), (7, 1, "quite another sentence of some length that nobody wrote"), (8, 1, None)]
    df = spark.createDataFrame(claims, "item_id long, doc_id long, quote string")
    by = {(d, p): t for d, p, t in pages}
    got = {r.item_id: r for r in evidence.verify(df, spark.createDataFrame(pages, "doc_id long, page int, text string").repartition(4)).collect()}
    assert len(got) == len(claims)
    shown = {i: (r.status, r.page, by.get((r.doc_id, r.page), "")[r.start : r.end] if r.start is not None else None) for i, r in got.items()}
    assert shown[1] == ("exact", 2, "the  „eﬃcient method“ of") and got[1].ratio == 1
    assert shown[2] == ("snapped", 2, "eﬃcient method“ of the Maß-\nnahme")
    assert shown[3][0] == shown[4][0] == "no-textlayer" and shown[5][0] == shown[7][0] == shown[8][0] == "no-match" and got[7].ratio > 0
    assert shown[6] == ("snapped", 5, "the efficient methid of measuring")


def test_wording_places(spark):
    page = "Kein Treffer.\fVorn steht die Maßﬂasche, wie ge-\nsagt, in einem  „Regal“ hinter dem Haus.\f"
    quotes = ["die Maßﬂasche", 'einem "Regal"', "wie gesagt, in", "DIE MASSFLASCHE", "Vorn steht die Maßflasche ... in einem \"Regal\" hinter dem Haus", "gesagt, in einem Regel hinter dem Hause", "nichts davon, gar nichts", "x"]
    rows = [(i, i, q, page if i < 7 else " ") for i, q in enumerate(quotes)]
    got = {r.item_id: r for r in evidence.wording(spark.createDataFrame(rows, "item_id long, doc_id long, quote string, text string")).collect()}
    assert [got[i].step for i in range(8)] == ["exact", "weak", "full", "casefold", "ellipsis", "fuzzy", "none", "no-textlayer"]
    cut = [page[got[i].start : got[i].end] for i in range(6)]
    assert cut[:4] == ["die Maßﬂasche", "einem  „Regal“", "wie ge-\nsagt, in", "die Maßﬂasche"]
    assert cut[4].startswith("Vorn steht") and cut[4].endswith("hinter dem Haus") and "Regal" in cut[5] and got[5].start > page.index("wie")
    assert {got[i].page for i in range(6)} == {2} and got[6].page is None
