"""Text functions over columns; all but ``nfkc`` run in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Prefixes of DOIs, in the order they are tried.
DOI_PREFIXES = ("https://dx.doi.org/", "http://dx.doi.org/", "https://doi.org/", "http://doi.org/", "dx.doi.org/", "doi.org/", "urn:doi:", "doi:")
# Function words that carry no topic.
STOPWORDS = (
    "aber", "auch", "auf", "aus", "bei", "dem", "den", "der", "des", "die", "das", "dass", "ein", "eine", "einem", "einen", "einer", "eines", "für", "fuer", "hat", "ist", "mit", "nach",
    "nicht", "oder", "sich", "sind", "und", "von", "vom", "vor", "wie", "wird", "werden", "zum", "zur", "über", "ueber", "and", "are", "for", "the", "this", "was", "were", "with",
)
# Particles of family names.
PARTICLES = ("von", "van", "de", "del", "della", "di", "du", "da", "le", "la", "ten", "ter")
# Umlauts and ligatures as written without them.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "ø": "oe", "å": "aa"}
# Typographic quotation marks and their plain forms.
QUOTES = ("“”„«»‘’‚´`", "\"\"\"\"\"'''''")
CHARS_PER_TOKEN = 2.5


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower case for A-Z only."""
    return F.translate(_c(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_plain(c: Column | str, part: str) -> Column:
    """Substring test, blind to the case of A-Z; wildcards have no meaning."""
    return ascii_lower(c).contains("".join(x.lower() if x.isascii() else x for x in part))


def normalize_doi(c: Column | str) -> Column:
    """Lower-cased DOI without its first matching prefix and without punctuation at its end; empty is null."""
    prefix = "^(" + "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES) + ")"
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(c))), prefix, ""), "[.,;]+$", "")
    return F.nullif(plain, F.lit(""))


def arxiv_id(doi: Column | str, direct: Column | str | None = None) -> Column:
    """arXiv id, given directly or by its DOI (normalized)."""
    by_doi = F.nullif(F.regexp_extract(_c(doi), r"^10\.48550/arxiv\.(.+)$", 1), F.lit(""))
    return by_doi if direct is None else F.coalesce(F.nullif(F.lower(F.trim(_c(direct))), F.lit("")), by_doi)


def pmid(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(url), r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", 1), F.lit(""))


def openalex_id(url: Column | str) -> Column:
    return F.upper(F.nullif(F.regexp_extract(_c(url), r"(?i)openalex\.org/(w\d+)", 1), F.lit("")))


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of a-z, 0-9 and German letters."""
    return F.filter(F.split(F.lower(_c(c)), "[^a-z0-9äöüß]+"), lambda t: t != "")


def words(c: Column | str, least: int = 3, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case runs of letters, without stop words and short ones."""
    found = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(\p{L}+)"))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*stopwords))


def safe_filename(c: Column | str, most: int = 80) -> Column:
    plain = F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, r"[\s_]+", "_"), "^_+|_+$", ""), 1, most)


def fold(c: Column | str) -> Column:
    """Umlauts spelled out, letters only."""
    out = F.lower(F.trim(_c(c)))
    for a, b in UMLAUTS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "[^a-z]", "")


ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"


def strip_accents(c: Column | str) -> Column:
    """Letters of Latin-1 without their accents, other characters dropped."""
    plain = "".join(unicodedata.normalize("NFD", x)[0] for x in ACCENTS)
    return F.regexp_replace(F.translate(F.lower(F.trim(_c(c))), ACCENTS, plain), "[^a-z]", "")


def family_variants(c: Column | str) -> Column:
    """Forms under which a family name may be met: umlauts folded or accents stripped, with and without particles."""
    lowered = F.lower(F.trim(_c(c)))
    bare = F.regexp_replace(lowered, "^((" + "|".join(PARTICLES) + r")\s+)+(?=\S)", "")
    return F.array_distinct(F.filter(F.array(fold(lowered), strip_accents(lowered), fold(bare), strip_accents(bare)), lambda x: x != ""))


def weak_normal(c: Column | str) -> Column:
    """Plain quotation marks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(_c(c), *QUOTES), r"\s+", " "))


# Words before which a hyphen at a line's end is a real one.
FUNCTION_WORDS = (
    "und", "oder", "bzw", "sowie", "wie", "als", "aber", "doch", "sondern", "noch", "entweder", "da", "weil", "obwohl", "wenn", "falls", "solange", "bis", "nachdem", "bevor", "kaum", "ehe", "damit", "sodass", "weshalb",
    "um", "zu", "statt", "anstatt",
)
MARK = "\uffff"  # no character


def join_hyphens(c: Column | str) -> Column:
    """Words split by a hyphen at a line's end, joined, if the rest is in lower case and no function word; else the hyphen
    stays, with a blank. Two line ends are a paragraph's."""
    marked = F.regexp_replace(_c(c), r"(\p{L})-[ \t]*\n(?!\n)[ \t]*(\p{L}+)", f"$1{MARK}$2")
    joined = F.regexp_replace(marked, MARK + r"(?=\p{Ll})(?!(?iu:" + "|".join(FUNCTION_WORDS) + r")(?!\p{L}))", "")
    return F.replace(joined, F.lit(MARK), F.lit("- "))


def nfkc(c: Column | str) -> Column:
    """Unicode normalization, for which the JVM side has no function."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(run, StringType())(_c(c))


def casefold(c: Column | str) -> Column:
    """Without case. (lower after upper would do for ß too, but the optimizer drops upper there.)"""
    return F.replace(F.lower(_c(c)), F.lit("ß"), F.lit("ss"))


def full_normal(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(join_hyphens(F.translate(nfkc(_c(c)), *QUOTES)), r"\s+", " "))


def approx_tokens(c: Column | str) -> Column:
    """max(words, characters of words / 2.5, rounded up)."""
    parts = F.filter(F.split(_c(c), r"\s+"), lambda t: t != "")
    chars = F.aggregate(parts, F.lit(0), lambda a, t: a + F.length(t))
    return F.greatest(F.size(parts).cast("long"), F.ceil(chars / CHARS_PER_TOKEN).cast("long"))


def named_authors(authors: Column | str) -> Column:
    """One name, two joined by "und", or the first "et al."; null without any."""
    names = F.filter(F.transform(_c(authors), lambda a: F.trim(a)), lambda a: a != "")
    first = F.get(names, F.lit(0))
    return F.when(F.size(names) == 1, first).when(F.size(names) == 2, F.concat(first, F.lit(" und "), F.get(names, F.lit(1)))).when(F.size(names) > 2, F.concat(first, F.lit(" et al.")))


def context_sentence(section: Column, page: Column, page_end: Column, chunk: Column, title: Column, authors: Column, year: Column, reserve: int = 60) -> Column:
    """A German sentence that says where a chunk comes from: title, authors and year of its source as far as known, then section,
    pages and number.

    A title is cut by words so that the sentence, with places for the pages, has at most reserve tokens (``approx_tokens``); its
    first word stays at least, of a title of one word its first character. A year alone is left out.
    """
    name = F.nullif(F.trim(title), F.lit(""))
    by = F.concat(F.lit("von "), named_authors(authors))
    when = F.concat(F.lit("("), year.cast("string"), F.lit(")"))

    def lead(t: Column) -> Column:
        return F.concat(F.lit("aus "), F.concat_ws(" ", F.concat(F.lit('"'), t, F.lit('"')), by, when))

    def sentence(of: Column, place: Column) -> Column:
        return F.concat(F.lit("Dieser Abschnitt stammt "), of, F.lit(', Abschnitt "'), section, F.lit('" ('), place, F.lit(")."))

    fits = lambda t: approx_tokens(sentence(lead(t), F.lit("Seite ???-???, Chunk 0"))) <= reserve
    words_ = F.split(name, r"\s+")
    cut = lambda k: F.concat(F.array_join(F.slice(words_, 1, k), " "), F.lit("..."))
    most = F.least(F.size(words_) - 1, F.lit(reserve))  # a word is a token at least
    kept = F.get(F.filter(F.when(most >= 1, F.sequence(most, F.lit(1))), lambda k: fits(cut(k))), F.lit(0))
    short = F.when(fits(name), name).when(~name.contains(" "), F.concat(F.substring(name, 1, 1), F.lit("..."))).otherwise(cut(F.coalesce(kept, F.lit(1))))
    place = F.concat(F.lit("Seite "), page.cast("string"), F.lit("-"), page_end.cast("string"), F.lit(", Chunk "), chunk.cast("string"))
    plain = F.concat(F.lit('Dieser Abschnitt stammt aus "'), section, F.lit('" ('), place, F.lit(")."))
    return F.when(name.isNotNull(), sentence(lead(short), place)).when(by.isNotNull(), sentence(F.concat_ws(" ", by, when), place)).otherwise(plain)


def is_heading(c: Column | str) -> Column:
    """A short line of up to seven capitalised words, perhaps numbered."""
    return (F.length(_c(c)) <= 80) & _c(c).rlike(r"^(?:\d+(?:\.\d+)*\.?\s+)?[A-ZÄÖÜ][\p{L}\p{N}_\-]*(?:\s+[A-ZÄÖÜ][\p{L}\p{N}_\-]*){0,6}$")


def sanitize_query(c: Column | str) -> Column:
    """Search terms of a query: words but no operators."""
    return F.filter(F.regexp_extract_all(_c(c), F.lit(r"([\p{L}\p{N}_]+)")), lambda t: ~F.upper(t).isin("AND", "OR", "NOT", "NEAR"))


def normalize_number(c: Column | str) -> Column:
    """Canonical decimal form of a number in any common notation, up to 38 digits; else null."""
    t = F.trim(F.regexp_replace(F.trim(_c(c)), "%$", ""))
    t = F.regexp_replace(F.translate(t, "−‐‑", "---"), "[\\s   '’]", "")
    sign = F.when(t.startswith("-"), "-").otherwise("")
    t = F.regexp_replace(t, "^[+-]", "")
    last_comma = F.length(t) - F.instr(F.reverse(t), ",")
    last_dot = F.length(t) - F.instr(F.reverse(t), ".")
    both = t.contains(",") & t.contains(".")
    mixed = F.when(last_comma > last_dot, F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")).otherwise(F.replace(t, F.lit(","), F.lit("")))
    grouped = t.rlike(r"^\d{0,3}(,\d{3}){2,}$") | t.rlike(r"^\d{0,3}(\.\d{3}){2,}$")
    t = F.when(both, mixed).when(grouped, F.regexp_replace(t, "[.,]", "")).otherwise(F.translate(t, ",", "."))
    whole, part = F.ltrim(F.regexp_extract(t, r"^(\d*)", 1), F.lit("0")), F.rtrim(F.regexp_extract(t, r"\.(\d*)$", 1), F.lit("0"))
    plain = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    good = t.rlike(r"^(\d+(\.\d*)?|\.\d+)$")
    return F.when(good, F.when(plain == "0", "0").otherwise(F.concat(sign, plain)))


def isbn13(c: Column | str) -> Column:
    """ISBN-13 of an ISBN-10 or ISBN-13, hyphens and blanks dropped; else null."""
    plain = F.upper(F.regexp_replace(_c(c), r"[\s-]", ""))
    stem = F.when(plain.rlike(r"^\d{9}[\dX]$"), F.concat(F.lit("978"), F.substring(plain, 1, 9)))
    total = sum((F.substring(stem, i, 1).cast("int") * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    made = F.concat(stem, F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))
    return F.when(plain.rlike(r"^\d{13}$"), plain).otherwise(made)


def title_case_given(c: Column | str) -> Column:
    """Whether the part after a comma looks like given names: up to three words, the later ones capitalised or connectors."""
    parts = F.filter(F.split(F.trim(_c(c)), r"\s+"), lambda t: t != "")
    bare = F.transform(F.slice(parts, 2, 3), lambda t: F.regexp_replace(t, "^[.,]+|[.,]+$", ""))
    return (F.size(parts) <= 3) & F.forall(bare, lambda t: (t == "") | F.lower(t).isin(*CONNECTORS) | t.rlike(r"^\p{Lu}"))


# Words that tell an organisation from a person.
ORGANISATIONS = (
    "universität", "university", "universitaet", "institut", "institute", "fakultät", "fakultaet", "faculty", "hochschule", "college", "akademie", "academy", "ministerium", "ministry", "behörde", "behoerde", "agency", "amt",
    "bundesamt", "landesamt", "kommission", "commission", "committee", "ausschuss", "council", "gmbh", "kgaa", "e.v.", "inc.", "ltd.", "llc", "corp.", "corporation", "foundation", "stiftung", "verband", "association",
    "gesellschaft", "society", "bank", "zentrum", "center", "centre", "department", "abteilung", "büro", "buero", "office", "bureau", "verwaltung", "administration", "organisation", "organization", "vereinigung", "kammer",
    "chamber", "senat", "senate", "parlament", "parliament", "regierung", "government", "nations", "school of", "press", "verlag", "consortium", "konsortium", "network", "netzwerk",
)
# Words in lower case that stand within names of persons.
CONNECTORS = ("van", "von", "der", "den", "de", "di", "la", "le", "do", "dos", "da", "bin", "ibn", "al")


def is_organisation(c: Column) -> Column:
    """Whether a part of a name holds a word of an organisation, or is one acronym of two to six capitals."""
    words = "|".join(w.replace(".", r"\.") for w in ORGANISATIONS)
    return F.lower(c).rlike(r"(?U)\b(?:" + words + r")\b") | F.replace(c, F.lit("."), F.lit("")).rlike(r"^\p{Lu}{2,6}$")


def parse_author(c: Column | str) -> Column:
    """struct(family, given, literal, parsed) of "Family, Given"; organisations and implausible ones stay literal."""
    raw = F.trim(_c(c))
    family, given = F.trim(F.regexp_extract(raw, r"^([^,]*),", 1)), F.trim(F.regexp_extract(raw, r"^[^,]*,(.*)$", 1))
    ok = raw.contains(",") & (family != "") & ~is_organisation(family) & ((given == "") | (~is_organisation(given) & title_case_given(given)))
    return F.struct(F.when(ok, family).alias("family"), F.when(ok, F.nullif(given, F.lit(""))).alias("given"), F.when(~ok, raw).alias("literal"), ok.alias("parsed"))


# Commands that cite, and words for figures and tables with their kind.
CITATION_COMMANDS = ("cite", "citep", "citet", "parencite", "footcite")
FIGURE_WORDS = {"abb": "figure", "abbildung": "figure", "fig": "figure", "figure": "figure", "tab": "table", "tabelle": "table"}


def find_dois(c: Column | str) -> Column:
    """The DOIs in a text, normalized, without punctuation at their end."""
    found = F.regexp_extract_all(_c(c), F.lit(r"(?i)\b(10\.\d{4,9}/[^\s\])\"'<>?#%]+)"), F.lit(1))
    return F.transform(found, lambda x: normalize_doi(F.regexp_replace(x, "[).,;”’]+$", "")))


def find_arxiv_ids(c: Column | str) -> Column:
    """The arXiv ids in addresses, without their versions; or the text itself if it is one."""
    by_url = F.regexp_extract_all(_c(c), F.lit(r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"), F.lit(1))
    bare = F.regexp_extract(F.trim(_c(c)), r"^(\d{4}\.\d{4,5})(?:v\d+)?$", 1)
    return F.when(F.size(by_url) > 0, by_url).when(bare != "", F.array(bare)).otherwise(by_url)


def find_references(c: Column | str) -> Column:
    """References to figures and tables as "kind number"."""
    word = r"(?i)\b(Abb|Abbildung|Fig|Figure|Tab|Tabelle)\.?\s*(\d+(?:\.\d+)?)"
    kinds = F.create_map(*(F.lit(x) for pair in FIGURE_WORDS.items() for x in pair))
    both = F.arrays_zip(F.regexp_extract_all(_c(c), F.lit(word), F.lit(1)).alias("w"), F.regexp_extract_all(_c(c), F.lit(word), F.lit(2)).alias("n"))
    return F.transform(both, lambda x: F.concat_ws(" ", F.try_element_at(kinds, F.lower(x["w"])), x["n"]))


def find_citation_keys(c: Column | str) -> Column:
    """The keys of citing commands, each once."""
    groups = F.regexp_extract_all(_c(c), F.lit(r"\\(?:" + "|".join(CITATION_COMMANDS) + r")\*?(?:\[[^\[\]]*\])*\{([^{}]+)\}"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.trim(x)), lambda k: k != ""))


def sentences(c: Column | str) -> Column:
    """Sentences of a text: cut after . ! ? before blanks, but not after common abbreviations."""
    cut = r"(?<=[.!?])(?<!\b(?:z\.B|u\.a|d\.h|bzw|vgl|Abb|Tab|Nr|Dr|Prof|et al|e\.g|i\.e|Fig|No)\.)\s+"
    return F.filter(F.transform(F.split(_c(c), cut), lambda x: F.trim(x)), lambda t: t != "")
