"""Compares a query with its DuckDB twin as the driver does: schema, row count and values, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb
import pyarrow as pa

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return [plain(y) for y in x.values()]
    return x


def rows(t: pa.Table) -> tuple[list[str], list[str]]:
    names = sorted(t.column_names)
    columns = [t.column(n).to_pylist() for n in names]
    return names, sorted(repr([plain(x) for x in r]) for r in zip(*columns, strict=True))


def compare(spark, con: duckdb.DuckDBPyConnection, sf_dir: str, run, sql: str) -> str | None:
    """What differs, or None."""
    got, want = run(spark, sf_dir).toArrow(), con.execute(sql).to_arrow_table()
    (gn, gr), (wn, wr) = rows(got), rows(want)
    if gn != wn:
        return f"columns {gn} and {wn}"
    if len(gr) != len(wr):
        return f"{len(gr)} and {len(wr)} rows; only here {[x for x in gr[:2000] if x not in set(wr)][:2]}, only there {[x for x in wr[:2000] if x not in set(gr)][:2]}"
    if gr != wr:
        a, b = next((a, b) for a, b in zip(gr, wr, strict=True) if a != b)
        return f"{sum(a != b for a, b in zip(gr, wr, strict=True))} rows differ, as {a[:300]} and {b[:300]}"
    kinds = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in gn if str(got.schema.field(n).type).replace("large_", "") != str(want.schema.field(n).type).replace("large_", "") and "list" not in str(got.schema.field(n).type)]
    return f"types {kinds}" if kinds else None
