"""Intervals of texts: where patterns match, what they leave, sentences with offsets, and the way back from normalised text.

Spans are struct(start, end): code points, from 0 on, end exclusive. Patterns run in the JVM. Only the way back from a
normalised text needs a Python kernel (Unicode normalization has no JVM function here); it sees the rows that were
found, not those that are searched. Nulls count as empty texts.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: Stands around matches; no character.
MARK = "￿"


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def pieces(c: Column | str, pattern: str) -> Column:
    """array<string>: what lies before, within, between and behind the matches of a pattern, matches at odd places."""
    marked = F.regexp_replace(F.translate(_c(c), MARK, " "), f"({pattern})", f"{MARK}$1{MARK}")
    return F.split(marked, MARK, -1)


def blotted(parts: Column) -> Column:
    """The text of pieces, with as many blanks for each match, so that offsets stay what they are."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")


def mask(c: Column | str, pattern: str) -> Column:
    """The text with its matches blotted out."""
    return blotted(pieces(c, pattern))


def places(parts: Column) -> Column:
    """array<struct(start, end, text)> of the pieces at odd places."""
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), (~s["odd"]).alias("odd"), F.when(s["odd"], F.array_append(s["out"], F.struct(s["at"].alias("start"), (s["at"] + F.length(p)).alias("end"), p.alias("text")))).otherwise(s["out"]).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))
    return F.aggregate(parts, zero, step, lambda s: s["out"])


def matches(c: Column | str, pattern: str) -> Column:
    """array<struct(start, end, text)>: the matches of a pattern, in order."""
    return places(pieces(c, pattern))


def between(c: Column | str, pattern: str) -> Column:
    """array<struct(start, end, text)>: what the matches leave, in order, empty stretches too."""
    return places(F.concat(F.array(F.lit("")), pieces(c, pattern)))


def within(spans: Column, start: Column, end: Column) -> Column:
    """The first span that holds start to end whole; null if none does."""
    return F.get(F.filter(spans, lambda s: (s["start"] <= start) & (end <= s["end"])), F.lit(0))


#: Lines that end a block: headings, list items, blank ones.
STRUCTURE = r"(?m)^[ \t]*(?:#{1,6}[ \t][^\n]*|(?:[-*+]|\d+[.)])[ \t][^\n]*)?(?:\n|\z)"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])"


def claim_sentence(c: Column | str, start: Column, end: Column, window: int = 200) -> Column:
    """struct(sentence, around): the sentence that holds a span whole, and without one (sentence null) a window around it.

    Headings, list items and blank lines end a sentence; what ends one within the span does not. The span must start and
    end with something else than blanks.
    """
    block = within(between(c, STRUCTURE), start, end)
    low, high = start - block["start"], end - block["start"]
    inside = F.substring(block["text"], low + 1, high - low)
    before, behind = F.substring(block["text"], F.lit(1), low), F.substring(block["text"], high + 1, F.length(block["text"]))
    # the end of a sentence may lie at the span's edge: the characters next to it are seen, the span itself is one word
    head = F.element_at(F.split(F.concat(before, F.substring(inside, 1, 1)), SENTENCE_END, -1), -1)
    tail = F.element_at(F.split(F.concat(F.substring(inside, -1, 1), behind), SENTENCE_END, -1), 1)
    whole = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), inside, F.substring(tail, F.lit(2), F.length(tail)))
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    sentence = trim(whole)
    sentence = F.when(high > low, F.nullif(sentence, F.lit("")))
    around = trim(F.substring(_c(c), F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)) + (end - start) + window))
    return F.struct(sentence.alias("sentence"), F.when(sentence.isNull(), around).alias("around"))


# the way back from normalised text

QUOTES = str.maketrans(*text.QUOTES)
HYPHEN = re.compile(r"([^\W\d_])(-[ \t]*\n(?!\n)[ \t]*)([^\W\d_]+)")
NO_JOIN = re.compile(rf"(?!(?i:{'|'.join(text.FUNCTION_WORDS)})(?![^\W\d_]))")


class Mapped:
    """A text, and for each of its characters the start and end in the original."""

    def __init__(self, value: str) -> None:
        self.text, self.start, self.end = value, range(len(value)), range(1, len(value) + 1)

    def rebuilt(self, parts: list[tuple[str, int, int]]) -> Mapped:
        """Parts (new text, first and last character + 1 that it stands for) in order."""
        start, end = [], []
        for new, a, b in parts:
            if len(new) == b - a:
                start += self.start[a:b]
                end += self.end[a:b]
            else:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
        self.text, self.start, self.end = "".join(p[0] for p in parts), start, end
        return self

    def nfkc(self) -> Mapped:
        """Characters that normalise together stand for all of their original."""
        if unicodedata.normalize("NFKC", self.text) == self.text:
            return self
        parts: list[tuple[str, int, int]] = []
        for i, ch in enumerate(self.text):
            start, new = i, ch if ch.isascii() else unicodedata.normalize("NFKC", ch)
            while parts and not ch.isascii() and ((start == i and unicodedata.combining(ch)) or unicodedata.normalize("NFKC", self.text[parts[-1][1] : i + 1]) != parts[-1][0] + new):
                start = parts.pop()[1]
                new = unicodedata.normalize("NFKC", self.text[start : i + 1])
            parts.append((new, start, i + 1))
        return self.rebuilt(parts)

    def joined(self) -> Mapped:
        """As ``text.join_hyphens``."""
        parts, at = [], 0
        for m in HYPHEN.finditer(self.text):
            lower = m[3][0].islower() and NO_JOIN.match(self.text, m.start(3))
            parts += [(self.text[at : m.start(2)], at, m.start(2)), ("" if lower else "- ", m.start(2), m.end(2))]
            at = m.end(2)
        return self.rebuilt([*parts, (self.text[at:], at, len(self.text))]) if parts else self

    def blanks(self) -> Mapped:
        """Blanks collapsed, none at the ends."""
        parts, at = [], 0
        for m in re.finditer(r"(?a:\s)+", self.text):
            parts += [(self.text[at : m.start()], at, m.start()), (" " if m.start() and m.end() < len(self.text) else "", m.start(), m.end())]
            at = m.end()
        return self.rebuilt([*parts, (self.text[at:], at, len(self.text))]) if parts else self

    def weak(self) -> Mapped:
        self.text = self.text.translate(QUOTES)
        return self.blanks()

    def full(self) -> Mapped:
        self.nfkc()
        self.text = self.text.translate(QUOTES)
        return self.joined().blanks()

    def folded(self) -> Mapped:
        """As ``text.casefold``, each character on its own."""
        parts = [(ch.lower().replace("ß", "ss"), i, i + 1) for i, ch in enumerate(self.text)]
        return self.rebuilt(parts) if any(len(p[0]) != 1 for p in parts) else self._same("".join(p[0] for p in parts))

    def _same(self, value: str) -> Mapped:
        self.text = value
        return self

    def original(self, at: int, size: int) -> tuple[int, int]:
        """The span of the original that size characters from at on stand for."""
        return self.start[at], self.end[at + size - 1]


#: Normal forms by name.
FORMS = {"exact": lambda t: Mapped(t), "weak": lambda t: Mapped(t).weak(), "full": lambda t: Mapped(t).full(), "casefold": lambda t: Mapped(t).full().folded()}
ELLIPSIS = re.compile(r"\s*(?:\.\.\.|…|\[\.\.\.\])\s*")
WORD = re.compile(r"\w")


def _whole_words(value: str, a: int, b: int) -> tuple[int, int]:
    while 0 < a < len(value) and WORD.match(value[a]) and WORD.match(value[a - 1]):
        a -= 1
    while 0 < b < len(value) and WORD.match(value[b]) and WORD.match(value[b - 1]):
        b += 1
    return a, b


def locate(value: str, quote: str, step: str, at: int | None = None, size: int | None = None) -> tuple[int, int] | None:
    """The span of a text in which a quote was found: at a place of the form's text that is known, else where it first
    occurs in that form; an ellipsis from the first of its fragments to the last, a fuzzy hit in whole words."""
    form = FORMS.get(step, FORMS["casefold"])(value)
    if at is not None:
        if not size or at + size > len(form.text):
            return None
        a, b = form.original(at, size)
        return _whole_words(value, a, b) if step == "fuzzy" else (a, b)
    wanted = FORMS.get(step, FORMS["casefold"])(quote).text
    parts = [x.strip() for x in ELLIPSIS.split(wanted) if x.strip()] if step == "ellipsis" else [wanted]
    first = end = None
    for x in parts:
        found = form.text.find(x, end or 0) if x else -1
        if found < 0:
            return None
        first, end = found if first is None else first, found + len(x)
    return None if first is None else form.original(first, end - first)


def located(value: Column, quote: Column, step: Column, at: Column, size: Column) -> Column:
    """struct(start, end) of ``locate``; null where nothing is found."""

    def run(v: pd.Series, q: pd.Series, s: pd.Series, a: pd.Series, n: pd.Series) -> pd.DataFrame:
        known = [(None, None) if pd.isna(x) else (int(x), int(y)) for x, y in zip(a, n, strict=True)]
        found = [locate(x or "", y or "", z, *k) if z else None for x, y, z, k in zip(v, q, s, known, strict=True)]
        return pd.DataFrame({k: pd.array([None if f is None else f[i] for f in found], "Int32") for i, k in enumerate(("start", "end"))})

    return F.pandas_udf(run, "start int, end int")(value, quote, step, at, size)


def page_of(c: Column | str, start: Column, page_break: str = "\f") -> Column:
    """The page on which an offset lies, from 1 on, where pages end with a break."""
    before = F.substring(_c(c), F.lit(1), start)
    return (F.length(before) - F.length(F.replace(before, F.lit(page_break), F.lit("")))) / len(page_break) + 1
