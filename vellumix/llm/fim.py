"""Fill-in-the-middle: a text is cut into units, two of whose ends part it into prefix, middle and suffix.

Method. The units are the isolated matches of a Split pre-tokenizer (tokenizers library, nothing trained), which gives
each unit's offsets in code points. The length of the offset array is n; two hashed numbers modulo n + 1 are ranks in
it, and the offsets at these ranks cut the text into three slices. Slices are taken, joined with marks in the order of
the form, and put back together by column expressions.

Long texts go through the pre-tokenizer in blocks of about ``BLOCK`` code points that end behind ``boundary``, a
character behind which the pattern surely begins anew, so that no more than a block's offsets are Python objects at once. A pattern without such a character takes
``boundary=None``, and whole texts.

Defined cases: a null text is empty; an empty text, one that holds a mark, and one that the rate leaves out stay as they
are (form plain); a null doc_id is hashed as an empty string; bytes that are not UTF-8 are restored like others; repeated rows give a row each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import prepare, read, text_or_empty, texts

#: Units of the query: lines with their end.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a long text that are pre-tokenized at once.
BLOCK = 1 << 18


def unit_ends(split, text: str, boundary: str | None = "\n", block: int = BLOCK) -> np.ndarray:
    """The end of each unit of a text, in code points."""
    out, at = [], 0
    while at < len(text):
        stop = len(text)
        if boundary is not None and at + block < len(text):
            stop = text.find(boundary, at + block) + 1 or len(text)
        part = text[at:stop] if at or stop < len(text) else text
        out.append(np.array([end for _, (_, end) in split.pre_tokenize_str(part)], np.int64) + at)
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _number(seed: int, group: int) -> Column:
    """One of the 8-digit groups of the hash of seed and doc_id, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def cut_points(docs: DataFrame, pattern: str = LINES, seed: int = 7, text: str = "text", boundary: str | None = "\n", block: int = BLOCK) -> DataFrame:
    """doc_id, text, n (units), prefix_end, middle_end (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(pattern), "isolated")
        for batch in batches:
            n, low, high = [], [], []
            for x, h1, h2 in zip(texts(batch, "text"), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ends = np.concatenate([[0], unit_ends(split, x.decode("utf-8", "replace"), boundary, block)])
                n.append(len(ends) - 1)
                ranks = sorted((h1 % len(ends), h2 % len(ends)))
                low.append(int(ends[ranks[0]]))
                high.append(int(ends[ranks[1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (n, low, high))], ["doc_id", "text", "n", "prefix_end", "middle_end"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.select("doc_id", "text", _number(seed, 0).alias("h1"), _number(seed, 1).alias("h2")).mapInArrow(run, "doc_id long, text string, n long, prefix_end long, middle_end long")


def transform(docs: DataFrame, pattern: str = LINES, seed: int = 7, rate: int = 100, spm_rate: int = 50, text: str = "text", boundary: str | None = "\n") -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix, middle, suffix (null if plain), output. Of a hundred texts rate are
    transformed, and of those spm_rate have the suffix first."""
    prepare(docs.sparkSession)
    cut = cut_points(docs, pattern, seed, text, boundary)
    plain = (F.col("text") == "") | F.col("text").rlike("|".join((PREFIX, SUFFIX, MIDDLE))) | (_number(seed, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_number(seed, 3) % 100 < spm_rate, "spm").otherwise("psm")
    slice_of = lambda a, b: F.when(~plain, F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    low, high = F.col("prefix_end"), F.col("middle_end")
    parts = cut.select("doc_id", "text", "n", form.alias("form"), slice_of(F.lit(0), low).alias("prefix"), slice_of(low, high).alias("middle"), slice_of(high, F.char_length("text")).alias("suffix"))
    p, s, m = F.concat(F.lit(PREFIX), "prefix"), F.concat(F.lit(SUFFIX), "suffix"), F.concat(F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("text"))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. No text that is transformed holds a mark, and a mark can't begin within
    another one, so an output that is not plain has exactly three: four parts, the first empty, the last the middle."""
    part = F.split(F.col(output), "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2])).when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(read(prepare(spark), sf_dir, "documents")).select("*", restore().alias("restored"))
    return rows.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l, sha256('7:' || doc_id) AS x FROM documents),
h AS (SELECT *, len(l) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM u),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a+1:b], ''), '') AS m, coalesce(array_to_string(l[b+1:n], ''), '') AS q FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m WHEN 'spm' THEN '<S>' || q || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
sha256(t) AS restored_sha256 FROM s
"""
