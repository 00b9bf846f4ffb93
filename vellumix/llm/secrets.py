"""Secret scans over an incremental ledger of blobs; DataFrame functions only.

Method. Every version of every text is addressed by its SHA-256. The ledger has one row per blob and rule version that
has been scanned, with the spans found. A scan takes the distinct blobs, left-joins what the ledger knows of each, runs
only the rule versions that are missing, and returns the new ledger rows; findings are joined back to all paths
(doc_ids) by the blob's address. Copies collapse in the map-side half of the aggregate by address. Only blobs with spans
are joined back: they are looked up where at most ``LOOKUP`` of them are there, so that no paths move; else adaptive
execution may split the join where one blob has very many paths, and empty texts, which have no spans, stay out of it.

Spans are those of successive leftmost matches. SQL's regular expressions return no positions, so the text is split by
the pattern: the lengths of the pieces between matches and of the matches themselves add up to the positions, in code
points.

Defined cases: null and empty texts are the empty blob, without findings; rows repeated with one doc_id give one row
each; a null doc_id is a path like others; matches may touch or overlap across kinds and are all reported; an empty
table gives no rows; further columns are ignored by ``findings`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import prepare, read, stored, text_or_empty



@dataclass(frozen=True)
class Rule:
    """gate: a cheaper pattern that is found wherever pattern's kept matches are; least: characters of the group."""

    kind: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 1


#: Rule versions, oldest first. A version never changes once it is in a ledger; new rules are a new version.
VERSIONS: dict[str, tuple[Rule, ...]] = {
    "base-1": (
        Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)(?:passw|secret|token|api_?key)""", 2, 12),
        Rule("access", r"AKIA[A-Z0-9]+", "AKIA", 0, 18),
        Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", "[0-9a-f]{16}"),  # runs of 16 and more: what is left of all runs
    ),
    "more-1": (
        Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY"),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
        Rule("pat", r"(?:ghp|gho|ghs|glpat|xox[abp])[_-][A-Za-z0-9_-]{20,}", "(?:gh[pos]|glpat|xox[abp])[_-]"),
    ),
}
BASE = ("assign", "access", "hex")
KINDS = tuple(r.kind for rules in VERSIONS.values() for r in rules)
SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


#: Blobs with spans that may be broadcast, and pieces of a text whose positions are added up at once.
LOOKUP, BLOCK = 100_000, 64


def _literal(pattern: str) -> bool:
    return pattern.replace(" ", "").isalnum()


def rule_spans(text: Column, rule: Rule) -> Column:
    """The spans of a rule in a text as an array of (start, ord, kind, end)."""
    pattern = F.lit(rule.pattern)
    whole, groups = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    rows = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), groups.alias("value"))
    empty = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(rule.kind)).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end")).cast("struct<start:int,ord:int,kind:string,end:int>"))
        return F.struct(end.alias("at"), F.when(x["good"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def of_block(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])

    def of_blocks(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + x["hit"]))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        starts = F.aggregate(sizes, none, lambda acc, s: F.struct((acc["at"] + s).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
        return F.flatten(F.zip_with(blocks, starts, of_block))

    lengths = F.transform(rows, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"), (F.length(x["value"]) >= rule.least).alias("good")))
    # in blocks, as an array that grows by one is copied each time; every step sees the last one's result as a variable
    blocks = _with(lengths, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, BLOCK)))
    spans = _with(blocks, of_blocks)
    gate = text.contains(rule.gate) if _literal(rule.gate) else text.rlike(rule.gate)
    return F.when(gate, spans).otherwise(empty)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """blob (SHA-256), text: the distinct texts."""
    rows = docs.select(text_or_empty(text).alias("text"))
    return rows.groupBy(F.sha2("text", 256).alias("blob")).agg(F.first("text").alias("text"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, versions: dict[str, tuple[Rule, ...]] = VERSIONS, text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule_version, spans): one per blob of docs and rule version that ledger hasn't."""
    todo = blobs(docs, text)
    every = F.array(*map(F.lit, versions))
    if ledger is None:
        todo = todo.withColumn("todo", every)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    found = [F.when(F.array_contains("todo", v), F.struct(F.lit(v).alias("rule_version"), F.concat(*(rule_spans(F.col("text"), r) for r in rules)).alias("spans"))) for v, rules in versions.items()]
    return todo.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")).select("blob", "r.rule_version", "r.spans")


def findings(docs: DataFrame, ledger: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, blob and its spans (by start, then kind) for every row of docs."""
    paths = docs.select(*keep, text_or_empty(text).alias("__text"))
    rows = _found(paths.withColumn("blob", F.sha2("__text", 256)).drop("__text"), ledger)
    return rows.select(*keep, "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _found(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """paths with their blob's spans, or null."""
    found = ledger.where(F.size("spans") > 0).groupBy(F.col("blob").alias("__blob")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    if found.limit(LOOKUP + 1).count() <= LOOKUP:
        return paths.join(F.broadcast(found), F.col("blob") == F.col("__blob"), "left").drop("__blob")
    nothing = hashlib.sha256(b"").hexdigest()
    key = F.when(F.col("blob") != nothing, F.col("blob")).otherwise(F.concat(F.lit("-"), F.rand(0).cast("string")))  # meets nothing, anywhere
    return paths.withColumn("__key", key).join(found, F.col("__key") == F.col("__blob"), "left").drop("__key", "__blob")


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, a count per base kind, base_sha256, spans and n_spans from rows of findings."""
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select(F.col("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").alias("n_spans"))


def redacted(text: Column, spans: Column, mark: Callable[[Column], Column] | None = None) -> Column:
    """The text with each span, overlapping ones as one, replaced by a mark that names its kind."""
    mark = mark or (lambda s: F.concat(F.lit("[secret:"), s["kind"], F.lit("]")))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark(s)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(new).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """docs with the secrets in text replaced; n_chars, if there, is counted anew. Columns as they were; a null text stays."""
    prepare(docs.sparkSession)
    new = stored(scan(docs, ledger), "secret-ledger")
    own = docs.select(F.struct(*docs.columns).alias("d"), F.sha2(text_or_empty(), 256).alias("blob"))  # a struct, lest names clash
    none = F.col("spans").isNull()
    text = F.when(none, F.col("d.text")).otherwise(redacted(F.col("d.text"), F.col("spans")))
    new_columns = {"text": text}
    if "n_chars" in docs.columns:
        new_columns["n_chars"] = F.when(none, F.col("d.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return _found(own, new if ledger is None else ledger.unionByName(new)).select(*(new_columns.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan: the ledger is empty, so all blobs and rule versions are unseen; it is stored, then joined back."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    ledger = stored(scan(docs), "secret-ledger")
    return digest(findings(docs, ledger))


def _sql() -> str:
    """The same in DuckDB, kind by kind."""
    parts = []
    for n, rule in enumerate(r for rules in VERSIONS.values() for r in rules):
        pattern = rule.pattern.replace("(?<![0-9a-f])", "").replace("'", "''")
        parts.append(
            f"SELECT doc_id, i, {n} AS ord, '{rule.kind}' AS kind, length(g[i]) >= {rule.least} AS good, "
            f"coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, length(m[i]) AS n "
            f"FROM (SELECT doc_id, p, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, "
            f"regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g FROM d))"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), hits AS (" + " UNION ALL ".join(parts) + "), "
        "f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        "string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, ord) AS spans, "
        "string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, count(*) AS n FROM hits WHERE good GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
        "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0)::INT AS n_spans FROM d LEFT JOIN f USING (doc_id)"
    )


ORACLE_SQL = _sql()
