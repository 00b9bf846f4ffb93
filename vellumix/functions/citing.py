"""What texts cite and how: citations in texts, guards around quotations, identifiers, transcripts, snippets; all in the JVM.

Nulls count as empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans, text

# Words that contrast, and further ones by which a chapter discloses that its source does.
CONTRAST = (
    "however", "but", "yet", "nevertheless", "nonetheless", "in contrast", "on the other hand", "allerdings", "jedoch", "aber", "dennoch", "hingegen", "gleichwohl", "demgegenüber", "einschränkend",
)
DISCLOSURE = ("relativiert", "kritisch", "im gegensatz", "einschränkung", "einschränkt")
# Words that report the position of others.
FRAMING = (
    "critics argue", "it is often claimed", "proponents claim", "opponents argue", "kritiker behaupten", "gegner behaupten", "befürworter behaupten", "vielfach wird behauptet", "es wird oft angenommen", "man könnte einwenden",
)
# Words that hedge, and words that leave no doubt.
HEDGE = (
    "may", "might", "suggests", "appears", "tends to", "könnte", "könnten", "deutet darauf hin", "deuten darauf hin", "scheint", "möglicherweise", "tendenziell", "legt nahe", "legen nahe", "dürfte", "vermutlich",
)
ABSOLUTE = ("beweist", "belegt eindeutig", "durchweg", "immer", "ausnahmslos", "generell", "zweifelsfrei", "proves", "always", "invariably")
# Words of contradiction.
NEGATION = (
    "widerspricht", "widerspruch", "bestreitet", "bestreiten", "verneint", "verneinen", "im gegensatz zu", "im gegensatz dazu", "entgegen der", "stimmt nicht", "ist falsch", "trifft nicht zu", "keineswegs",
    "contradicts", "contradiction", "disputes", "disputed", "denies", "denied", "refutes", "refuted",
)
# Capitalised words before a year that are no authors.
NO_AUTHORS = (
    "kapitel", "abschnitt", "anhang", "tabelle", "abbildung", "abb", "tab", "gleichung", "formel", "seite", "fig", "figure", "table", "chapter", "section", "appendix", "equation", "ebd", "ebenda", "ibid", "ders", "dies",
    "januar", "februar", "maerz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember", "jan", "feb", "mrz", "apr", "jun", "jul", "aug", "sep", "sept", "okt", "nov", "dez",
    "january", "february", "march", "may", "june", "july", "october", "december", "mar", "oct", "dec", "fruehjahr", "sommer", "herbst", "winter", "quartal", "stichtag",
    "stand", "fassung", "version", "ausgabe", "auflage", "jahrgang", "band", "heft", "nr", "hrsg", "zugriff", "abgerufen", "gesetz", "verordnung", "richtlinie", "verfassung", "vertrag", "abkommen",
    "beschluss", "bericht", "studie", "umfrage", "erhebung", "analyse", "strategie", "reform", "novelle", "regelung", "vorschrift", "dsgvo",
)

# Verbs that report what an author says, umlauts spelled out.
REPORTING = (
    "zeigt", "zeigen", "belegt", "belegen", "schreibt", "schreiben", "argumentiert", "argumentieren", "betont", "betonen", "konstatiert", "konstatieren", "erklaert", "erklaeren", "folgert", "folgern", "meint", "meinen",
    "kritisiert", "kritisieren", "resuemiert", "resuemieren", "sieht", "sehen", "beschreibt", "beschreiben", "analysiert", "analysieren", "untersucht", "untersuchen", "formuliert", "formulieren",
)

#: What holds no citations: code, comments, macros, and all from the heading of a list of references on.
SKIPPED = r"```[\s\S]*?```|~~~[\s\S]*?~~~|`[^`\n]*`|<!--[\s\S]*?-->|\\begin\{(verbatim|lstlisting|minted)\}[\s\S]*?\\end\{\2\}|\\[a-zA-Z@]+\*?(?:\[[^\]]*\])*\{[^{}]*\}"
REFERENCES = r"(?im)^\s*(?:#{1,6}\s*|\\(?:section|chapter|addsec)\*?\{)\s*(?:literatur(?:verzeichnis)?|quellen(?:verzeichnis)?|bibliogra(?:f|ph)\p{L}*|references|works\s+cited)\b[\s\S]*"
ONE = rf"(?:(?:{'|'.join(sorted(text.PARTICLES, key=len, reverse=True))})\s+)?\p{{Lu}}[\p{{L}}'’-]+"
NAME = f"({ONE})"
OTHERS = rf"((?:(?:\s*[,&/]\s*|\s+(?:und|and)\s+){ONE})*(?:\s+(?:et\s+al\.|u\.\s?a\.))?)"
YEAR = r"((?:1[4-9]|2[01])\d\d)[a-z]?"
PAGES = r"(?:(?:\s*[,:]?\s*(?:S\.|Seite|pp?\.)|\s*:)\s*(\d{1,4})(?:\s*[-–—]\s*(\d{1,4}))?)?"
SIGNAL = r"((?:[Vv]gl\.|[Vv]ergleiche|[Ss]iehe|[Ss]ee|[Cc]f\.|[Zz]it\.\s*nach|[Nn]ach)\s+)?"
VIA = r",\s*(?:[Zz]itiert\s+nach|[Zz]it\.\s*nach)\s+"
ENTRY = rf"{SIGNAL}{NAME}{OTHERS},?\s+{YEAR}{PAGES}"
#: "(see Name & Name 2004, S. 12", "(Name 1990, zitiert nach Name 2004", "vgl. Name 2004", and "Name et al. (2004, S. 12)"
IN_PARENTHESES, SECONDARY = rf"[(;]\s*{ENTRY}", rf"[(;]\s*{ENTRY}{VIA}{ENTRY}"
SIGNALLED = rf"(?<![\p{{L}}\p{{N}}_])((?:[Vv]gl\.|[Ss]iehe|[Ss]ee|[Cc]f\.|[Zz]it\.\s*nach)\s+){NAME}{OTHERS},?\s+{YEAR}{PAGES}"
NARRATIVE = rf"(?<![\p{{L}}\p{{N}}_]){SIGNAL}{NAME}{OTHERS}\s*\(\s*{YEAR}{PAGES}\s*\)"


#: Between the two stretches around a quotation; no character.
MARK = "\uffff"


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def flat(c: Column | str) -> Column:
    """Blanks and line ends collapsed."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def marker(c: Column | str, words: tuple[str, ...]) -> Column:
    """The first of the words that stands in a text, in lower case; else null."""
    found = F.regexp_extract(_c(c), r"(?iu)(?<!\p{L})(" + "|".join(words) + r")(?!\p{L})", 1)
    return F.lower(F.nullif(found, F.lit("")))


def guards(claim: Column | str, verbatim: Column | str) -> Column:
    """struct(attributed: the claim holds the quotation, negated: it holds a word of contradiction)."""
    quote = flat(verbatim)
    return F.struct(((quote != "") & F.contains(flat(claim), quote)).alias("attributed"), F.lower(_c(claim)).rlike("|".join(NEGATION)).alias("negated"))


def context_signals(before: Column | str, verbatim: Column | str, after: Column | str, chapter: Column | str, similarity: Column, least: float) -> Column:
    """struct(contrast, framing, hedge_loss, distant, suppressed): what hints at a quotation torn from its context.

    contrast: a word of it in the first sentence (80 characters) after; framing: in the last 80 characters before; neither if the
    chapter discloses it. hedge_loss: the source hedges, the chapter does not and has a word that leaves no doubt.
    """
    first = F.substring(F.regexp_extract(flat(after), "^[^.!?]*", 0), 1, 80)
    last = F.substring(flat(before), -80, 80)
    source = F.concat_ws(" ", _c(before), _c(verbatim), _c(after))
    open_ = marker(chapter, CONTRAST + DISCLOSURE).isNotNull()
    loss = F.when(marker(chapter, HEDGE).isNull() & marker(chapter, ABSOLUTE).isNotNull(), marker(source, HEDGE))
    distant = F.coalesce(similarity < least, F.lit(False))
    return F.struct(F.when(~open_, marker(first, CONTRAST)).alias("contrast"), F.when(~open_, marker(last, FRAMING)).alias("framing"), loss.alias("hedge_loss"), distant.alias("distant"), open_.alias("suppressed"))


def _let(x: Column, f) -> Column:
    """f of x, which is evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def citations(c: Column | str) -> Column:
    """array<struct(start, end, family, others, year, page, page_end, secondary, confidence)>: citations by author and year, in order.

    In parentheses, several of them behind semicolons; behind a signal word; and with the year alone in parentheses, if a
    page stands there or a verb of REPORTING behind it. "A 1990, zitiert nach B 2004" cites both, B as secondary. Code, macros,
    comments and the list of references are blotted out before, and nothing reaches across them; offsets are those of
    the text. A citation is strong if it names a page, a further author or a signal word, corroborated if a strong one has its
    family name in one of that name's forms, and else weak. A page that looks like a year is none.
    """

    def read(m: Column, pattern: str, first: int = 0, secondary: bool = False) -> Column:
        part = [F.regexp_extract(m["text"], pattern, first + i + 1) for i in range(6)]
        page = part[4].try_cast("int")
        page = F.when((page > 0) & ~page.between(1400, 2100), page)
        strong = page.isNotNull() | (part[0] != "") | (F.trim(part[2]) != "")
        lead = F.length(F.regexp_extract(m["text"], r"^[(;]\s*", 0))
        start = m["start"] + (F.length(F.regexp_extract(m["text"], f"^[(;]\\s*{ENTRY}{VIA}", 0)) if secondary else lead)
        end = m["end"] - (F.length(F.regexp_extract(m["text"], f"{VIA}{ENTRY}$", 0)) if pattern is SECONDARY and not secondary else 0)
        named = (part[1].alias("family"), F.trim(part[2]).alias("others"), part[3].cast("int").alias("year"), page.alias("page"), F.when(page.isNotNull(), part[5].try_cast("int")).alias("page_end"))
        return F.struct(start.alias("start"), end.alias("end"), *named, F.lit(secondary).alias("secondary"), strong.alias("strong"))

    def found(whole: Column) -> Column:
        def clean(ms: Column) -> Column:  # matches that don't reach across what is blotted out
            return F.filter(ms, lambda m: F.regexp_replace(F.substring(whole, m["start"] + 1, m["end"] - m["start"]), r"\s", " ") == F.regexp_replace(m["text"], r"\s", " "))

        def narrative(masked: Column, before: Column) -> Column:
            told = F.filter(
                spans.matches(masked, NARRATIVE),
                lambda m: (F.regexp_extract(m["text"], NARRATIVE, 5) != "") | text.fold(F.regexp_extract(F.substring(whole, m["end"] + 1, F.lit(40)), r"^\s*[:,]?\s*(\p{L}+)", 1)).isin(*REPORTING),
            )
            return F.concat(before, F.transform(clean(spans.matches(masked, SIGNALLED)), lambda m: read(m, SIGNALLED)), F.transform(clean(told), lambda m: read(m, NARRATIVE)))

        def in_parentheses(pieces: Column, before: Column) -> Column:
            own = F.transform(spans.places(pieces), lambda m: read(m, IN_PARENTHESES))
            return _let(spans.blotted(pieces), lambda masked: narrative(masked, F.concat(before, own)))

        def secondary(pieces: Column) -> Column:
            ms = spans.places(pieces)
            own = F.concat(F.transform(ms, lambda m: read(m, SECONDARY)), F.transform(ms, lambda m: read(m, SECONDARY, 6, True)))
            return _let(spans.pieces(spans.blotted(pieces), IN_PARENTHESES), lambda p: in_parentheses(p, own))

        return _let(spans.pieces(spans.mask(spans.mask(whole, REFERENCES), SKIPPED), SECONDARY), secondary)

    def judged(all_: Column) -> Column:
        known = F.flatten(F.transform(F.filter(all_, lambda x: x["strong"]), lambda x: text.family_variants(x["family"])))
        return _let(
            known,
            lambda k: F.transform(
                all_,
                lambda x: F.struct(
                    *(x[n].alias(n) for n in ("start", "end", "family", "others", "year", "page", "page_end", "secondary")),
                    F.when(x["strong"], "strong").when(F.arrays_overlap(text.family_variants(x["family"]), k), "corroborated").otherwise("weak").alias("confidence"),
                ),
            ),
        )

    named = lambda all_: F.sort_array(F.filter(all_, lambda x: ~text.fold(F.element_at(F.split(x["family"], r"\s+"), -1)).isin(*NO_AUTHORS)))
    return _let(named(_let(_c(c), found)), judged)


#: Quotations of 20 characters or more, and what marks a source: a year in parentheses, a macro, a note, a key.
QUOTED = "„[^“]{20,}“|\"[^\"]{20,}\"|«[^»]{20,}»"
SOURCE = r"\([^)]*\b(?:1[5-9]|20)\d\d[a-z]?\b[^)]*\)|\\[a-zA-Z]*cite[a-zA-Z]*\s*(?:\[[^\]]*\]\s*)*\{[^}]*\}|\[\^[^\]]+\]|\[@[^\]]+\]"


def drifted_quotes(before: Column | str, after: Column | str, window: int = 300) -> Column:
    """Quotations that an edit kept while it changed the wording around them, but not their sources.

    Kept quotations are anchors. The stretches between a quotation and its neighbours among them (or the text's ends), up to a
    window, are compared with those in the old text; emphasis and blanks do not count. Sources are those within the window.
    """
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[*_`~]", ""), r"\s+", " "))
    inner = lambda q: F.substring(q["text"], F.lit(2), F.length(q["text"]) - 2)

    def place(q: Column) -> Column:
        at = F.position(inner(q), _c(before))
        return F.struct(inner(q).alias("text"), (q["start"] + 1).alias("start"), (q["end"] - 1).alias("end"), (at - 1).alias("old"), (at - 1 + F.length(inner(q))).alias("old_end"))

    def stretches(c: Column, start: Column, end: Column, low: Column, high: Column) -> Column:
        left = plain(F.substring(c, low + 1, start - low))
        right = plain(F.substring(c, end + 1, high - end))
        return F.concat(F.substring(left, F.greatest(F.length(left) - window + 1, F.lit(1)), F.lit(window)), F.lit(MARK), F.substring(right, 1, window))

    def sources(c: Column, start: Column, end: Column) -> Column:
        low = F.greatest(start - window, F.lit(0))
        around = F.substring(c, low + 1, end + window - low)
        return F.sort_array(F.transform(F.regexp_extract_all(around, F.lit(SOURCE), F.lit(0)), plain))

    def judged(new: Column, old: Column, kept: Column) -> Column:
        def drifts(q: Column, i: Column) -> Column:
            prior, later = F.get(kept, i - 1), F.get(kept, i + 1)
            now = stretches(new, q["start"], q["end"], F.coalesce(prior["end"], F.lit(0)), F.coalesce(later["start"], F.length(new)))
            was_low = F.when(prior["old_end"] <= q["old"], prior["old_end"])
            was_high = F.when(later["old"] >= q["old_end"], later["old"])
            was = stretches(old, q["old"], q["old_end"], F.coalesce(was_low, F.lit(0)), F.coalesce(was_high, F.length(old)))
            return (now != was) & (sources(new, q["start"], q["end"]) == sources(old, q["old"], q["old_end"]))

        marked = F.transform(kept, lambda q, i: F.struct(q["text"].alias("text"), drifts(q, i).alias("drifts")))
        return F.array_distinct(F.transform(F.filter(marked, lambda q: q["drifts"]), lambda q: q["text"]))

    kept = F.transform(F.filter(spans.matches(after, QUOTED), lambda q: F.contains(_c(before), inner(q))), place)
    return _let(kept, lambda k: judged(_c(after), _c(before), k))


def repository_ids(c: Column | str) -> Column:
    """struct(arxiv, dois): those in a text, each once, in order; arXiv ids of addresses first. DOIs are alike whatever their case."""
    by_url = F.regexp_extract_all(_c(c), F.lit(r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"), F.lit(1))
    by_prefix = F.regexp_extract_all(_c(c), F.lit(r"(?i)arxiv:\s*(\d{4}\.\d{4,5})"), F.lit(1))
    found = F.transform(F.regexp_extract_all(_c(c), F.lit(r"(?i)\b(10\.\d{4,9}/[^\s\])\"'<>]+)"), F.lit(1)), lambda d: F.lower(F.regexp_replace(d, "[).,;”’]+$", "")))
    return F.struct(F.array_distinct(F.concat(by_url, by_prefix)).alias("arxiv"), F.array_distinct(found).alias("dois"))


def citation_file(c: Column | str) -> Column:
    """struct(doi, title) of a repository's citation file: the preferred citation's, else the file's own; numbers are neither."""
    preferred = F.regexp_extract(_c(c), r"(?m)^preferred-citation:[ \t]*\n((?:[ \t]+[^\n]*(?:\n|$))*)", 1)

    def field(name: str) -> Column:
        def of(block: Column, indent: str) -> Column:
            raw = F.trim(F.regexp_extract(block, rf"(?m)^{indent}{name}:[ \t]*([^\n]*)$", 1))
            plain = F.trim(F.regexp_replace(raw, "^([\"'])(.*)\\1$", "$2"))
            return F.when((plain != "") & ~raw.rlike(r"^(?:[-+]?[\d.]+|true|false|null|~|[\[{].*)$"), plain)

        return F.coalesce(of(preferred, "[ \t]{1,4}"), of(_c(c), "")).alias(name)

    return F.struct(field("doi"), field("title"))


def transcript(c: Column | str) -> Column:
    """array<struct(seq, speaker, timecode, text)>: blocks between blank lines, from 1 on; a time in brackets and a short name with
    a colon at a block's start are fields, blanks are collapsed, and blocks without other text count for nothing."""
    blocks = F.filter(F.transform(F.split(_c(c), r"\n\s*\n"), flat), lambda b: b != "")
    time, name = r"^[\[(](\d{1,2}:\d{2}(?::\d{2})?)[\])]\s*", r"^([A-Za-z][A-Za-z0-9_-]{0,11}):\s+"

    def read(b: Column) -> Column:
        rest = F.regexp_replace(b, time, "")
        return F.struct(F.nullif(F.regexp_extract(rest, name, 1), F.lit("")).alias("speaker"), F.nullif(F.regexp_extract(b, time, 1), F.lit("")).alias("timecode"), F.regexp_replace(rest, name, "").alias("text"))

    spoken = F.filter(F.transform(blocks, read), lambda s: s["text"] != "")
    return F.transform(spoken, lambda s, i: F.struct((i + 1).cast("long").alias("seq"), s["speaker"].alias("speaker"), s["timecode"].alias("timecode"), s["text"].alias("text")))


def snippet(c: Column | str, most: int = 240) -> Column:
    """The start of a text, blanks collapsed, with an ellipsis if it is cut."""
    whole = flat(c)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, most)), F.lit("...")))


def highlight(c: Column | str, terms: tuple[str, ...], window: int = 10) -> Column:
    """The densest window of tokens: that with the most distinct terms, then the most hits, then the first; it starts at a hit (or is
    the last full window of the text). Every hit is in bold, with ellipses where the text is cut; without a hit the text's
    first window."""
    tokens = F.filter(F.split(_c(c), r"\s+"), lambda t: t != "")

    def word(t: Column) -> Column:
        return F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_]", "")

    def shown(words: Column) -> Column:
        def best(hits: Column) -> Column:
            def score(h: Column) -> Column:
                start = F.greatest(F.lit(1), F.least(h["i"], F.size(words) - window + 1))
                inside = F.filter(hits, lambda x: (x["i"] >= start) & (x["i"] < start + window))
                return F.struct(F.size(F.array_distinct(F.transform(inside, lambda x: x["w"]))).alias("terms"), F.size(inside).alias("hits"), (-start).alias("start"))

            return F.coalesce(-F.array_max(F.transform(hits, score))["start"], F.lit(1))

        hits = F.filter(F.transform(words, lambda t, i: F.struct((i + 1).alias("i"), word(t).alias("w"))), lambda x: x["w"].isin(*terms))

        def cut(start: Column) -> Column:
            text_ = F.array_join(F.transform(F.slice(words, start, window), lambda t: F.when(word(t).isin(*terms), F.concat(F.lit("<b>"), t, F.lit("</b>"))).otherwise(t)), " ")
            return F.concat(F.when(start > 1, "...").otherwise(""), text_, F.when(start + window <= F.size(words), "...").otherwise(""))

        return _let(_let(hits, best), cut)

    return _let(tokens, shown)
