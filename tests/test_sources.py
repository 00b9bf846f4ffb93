"""Files, connectors and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vellumix.sources import connectors, files
from vellumix.streaming import ledgers

RESPONSES = {
    "crossref": json.dumps({"message": {"items": [{"DOI": "10.1/A", "title": ["T"], "author": [{"given": "Ann", "family": "Lee"}], "issued": {"date-parts": [[2020, 1]]}, "container-title": ["J"], "is-referenced-by-count": 7, "URL": "u"}]}}),
    "openalex": json.dumps({"results": [{"id": "https://openalex.org/W1", "doi": "10.1/b", "display_name": "T", "authorships": [{"author": {"display_name": "Ann Lee"}}], "publication_year": 2021, "cited_by_count": 3, "fwci": 1.5, "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "open_access": {"oa_url": "o"}, "is_retracted": True}]}),
    "semantic_scholar": json.dumps({"data": [{"title": "T", "year": 2019, "externalIds": {"DOI": "10.1/c"}, "authors": [{"name": "A"}], "openAccessPdf": {"url": "p"}, "publicationTypes": ["Study", "JournalArticle"]}]}),
    "base": json.dumps({"response": {"docs": [{"dcdoi": ["10.1/d"], "dctitle": "T", "dccreator": ["Lee, Ann"], "dcyear": "2018", "dclink": "l", "dcoa": 1}]}}),
    "econbiz": json.dumps({"hits": {"hits": [{"_source": {"title": "T", "creator": ["Lee, Ann"], "date": "c2017"}}]}}),
    "dblp": json.dumps({"result": {"hits": {"hit": [{"info": {"title": "T.", "year": "2016", "doi": "10.1/f", "authors": {"author": [{"text": "Ann Lee"}]}}}]}}}),
    "arxiv": '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>T</title><published>2015-02-01</published><author><name>Ann</name></author><author><name>Bo</name></author><summary> s\n t </summary></entry></feed>',
    "econstor": '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><record><metadata><oai_dc:dc xmlns:oai_dc="x" xmlns:dc="y"><dc:title>T</dc:title><dc:creator>Lee, Ann</dc:creator><dc:date>2014</dc:date><dc:identifier>http://hdl.handle.net/1</dc:identifier></oai_dc:dc></metadata></record></OAI-PMH>',
}


def test_connectors(spark):
    df = spark.createDataFrame([*RESPONSES.items(), ("crossref", "not json"), ("unknown", "{}")], "module string, body string")
    got = {r.source_module: r for r in connectors.normalize(df).collect()}
    assert set(got) == set(RESPONSES) and {r.title for r in got.values()} == {"T"}
    assert {m: r.year for m, r in got.items()} == {"crossref": 2020, "openalex": 2021, "semantic_scholar": 2019, "base": 2018, "econbiz": 2017, "dblp": 2016, "arxiv": 2015, "econstor": 2014}
    assert got["openalex"].abstract == "hello world hello" and got["openalex"].is_retracted and got["arxiv"].authors == ["Ann", "Bo"] and got["arxiv"].abstract == "s t"
    assert got["crossref"].authors == ["Ann Lee"] and got["crossref"].doi == "10.1/A" and got["econstor"].url == "http://hdl.handle.net/1"


def test_data_source(spark):
    spark.dataSource.register(connectors.SavedResponses)
    rows = spark.read.format("saved_responses").option("module", "dblp").option("body1", RESPONSES["dblp"]).option("body2", "{}").load().collect()
    assert [r.module for r in rows] == ["dblp", "dblp"] and rows[0].body == RESPONSES["dblp"]


def test_dataset(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿id, score\n1, 2.5 \n2,NA\n3,-99\n4,abc\n", encoding="utf-8")
    df = files.typed(files.read_dataset(spark, str(tmp_path / "x.csv"), ["id", "score"]), {"score": "metric"})
    assert [(r.id, r.score) for r in df.collect()] == [("1", 2.5), ("2", None), ("3", None), ("4", None)]


def test_profile(spark, tmp_path):
    (tmp_path / "p").write_text("half_life: 8\nquality: often\nunknown: 3\n")
    assert files.profile(spark, str(tmp_path / "p"), {"half_life": 5.0, "quality": 0.2}) == {"half_life": 8.0, "quality": 0.2}
    assert files.profile(spark, None, {"a": 1.0}) == {"a": 1.0}


def test_first_wins_and_repeats(spark, tmp_path):
    table = ledgers.Table(spark, str(tmp_path / "t"))
    merge = ledgers.first_wins(["k"], "ord")
    for part in ([(1, 0, "a"), (1, 1, "b")], [(1, 2, "c"), (2, 3, "d")]):
        spark.createDataFrame(part, "k long, ord long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # the second run finds nothing new
            ledgers.merge_stream(ledgers.stream(spark, str(tmp_path / "in")), table, merge, str(tmp_path / "c")).awaitTermination()
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, "a"), (2, "d")]


def test_superseding(spark):
    merge = ledgers.superseding(["k"], "h", "ord")
    rows = lambda *r: spark.createDataFrame(r, "k long, ord long, h string")
    one = merge(None, rows((1, 0, "x"), (1, 1, "x")))
    two = merge(one, rows((1, 2, "x"), (1, 3, "y")))
    assert [(r.ord, r.h) for r in one.collect()] == [(0, "x")] and [(r.ord, r.h) for r in two.collect()] == [(3, "y")]


def test_every():
    called = []

    class Batch:
        def __init__(self, n):
            self.n = n

        def count(self):
            return self.n

    before = [0]
    step = ledgers.every(10, lambda batch, n: called.append(n), lambda: before[0])
    for n, size in enumerate((4, 4, 4, 25, 1)):
        step(Batch(size), n)
        before[0] += size
    assert called == [2, 3]


def test_tables_and_sections(spark):
    df = spark.createDataFrame([(1, "<h1>A</h1><p>x</p><p>y <b>z</b></p><h2>B</h2><p>w</p><table><tr><th>a</th><td>b</td></tr></table>")], "k long, html string")
    assert [(r.title, r.paragraph) for r in files.sections(df, "k", "html").orderBy("pos").collect()] == [("A", "x"), ("A", "y z"), ("B", "w")]
    assert [(r.row, r["col"], r.value) for r in files.tables(df, "k", "html").collect()] == [(0, 0, "a"), (0, 1, "b")]
    empty = files.state_fields(spark.createDataFrame([(1, "no front matter")], "k long, t string"), "k", "t")
    assert empty.where(F.col("field") != "").count() == 0


def test_missing_columns(spark):
    with pytest.raises(Exception):  # noqa: B017
        files.read_dataset(spark, "/nonexistent", ["a"]).collect()


def test_model_rounds(spark, tmp_path):
    """Rounds over two deliveries with state in between, against a plain version; no project waits for another."""
    import random

    import numpy as np

    from vellumix.streaming import ledgers, rounds

    rng = random.Random(8)
    rows = [(p, i, rng.random() < 0.4, [rng.randrange(16) for _ in range(rng.randint(0, 6))]) for p, n in (("a", 23), ("b", 7), ("c", 10)) for i in range(1, n + 1)]
    schema = "p string, place long, hit boolean, t array<int>"
    base = str(tmp_path)
    for part in ([r for r in rows if r[1] <= 8], [r for r in rows if r[1] > 8]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(f"{base}/in")
        q = rounds.model_rounds(ledgers.stream(spark, f"{base}/in", None), "p", "place", "hit", "t", 5, 16)
        q.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    models = spark.read.parquet(f"{base}/out")
    got = {(r.p, r.round): (r.labels, r.w) for r in models.collect()}
    want = {}
    for p in "abc":
        own = [r for r in rows if r[0] == p]
        for k in range(1, len(own) // 5 + 1):
            counts = np.zeros((2, 16))
            for _, _, hit, t in own[: 5 * k]:
                np.add.at(counts[int(hit)], t, 1)
            both = {r[2] for r in own[: 5 * k]} == {True, False}
            want[p, k] = (5 * k, rounds.log_odds(counts).tolist() if both else [0.0] * 16)
    assert set(got) == set(want) and len(want) == 7
    for k, (n, w) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], w)
    texts = spark.createDataFrame([(p, 100 * ord(p) + i, i, t) for p, i, _, t in rows], "p string, k long, place long, t array<int>")
    line = {}
    for r in rounds.next_in_line(models, texts, "p", "k", "t", "place", 3).orderBy("rank").collect():
        line.setdefault((r.p, r.round), []).append(r.k)
    for (p, k), (n, w) in want.items():
        rest = sorted(((-round(sum(w[x] for x in t), 6), 100 * ord(p) + i) for q, i, _, t in rows if q == p and i > n))
        assert line.get((p, k), []) == [x for _, x in rest[:3]]


def test_next_in_line_goes_by_blocks(spark):
    """Models in blocks and texts in batches give what every pair gives: ties by key, equal texts, texts without label, tokens or project."""
    import random

    from vellumix.streaming import rounds

    rng = random.Random(3)
    models = [(p, r, 5 * r, [rng.choice([-0.5, 0.25, 1.0, 1e-7]) for _ in range(8)]) for p, n in (("a", 7), ("b", 2), ("d", 1)) for r in range(1, n + 1)]
    texts = [(p, rng.choice([None, rng.randint(1, 40)]), rng.choice([None, [], [1, 1, 7], [rng.randrange(8) for _ in range(rng.randint(1, 5))]])) for p in "abc" for _ in range(40)]
    texts = [(p, 1000 - i, place, t) for i, (p, place, t) in enumerate(texts)]
    made = spark.createDataFrame(models, "p string, round long, labels long, w array<double>").repartition(3)
    given = spark.createDataFrame(texts, "p string, k long, place long, t array<int>").repartition(3)
    got = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = rounds.next_in_line(made, given, "p", "k", "t", "place", 6, block=3).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in rows:
        got.setdefault((r.p, r.round), []).append((r.k, r.score))
    want = {}
    for p, r, n, w in models:
        left = [(k, None if t is None else round(sum(w[x] for x in t), 6)) for q, k, place, t in texts if q == p and (place is None or place > n)]
        want[p, r] = sorted(left, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:6]
    assert got == {at: rows for at, rows in want.items() if rows} and ("d", 1) not in got


def test_profiles_and_page_texts(spark):
    texts = ["a: 1\na: x\n b: -2.5 # c", None, "a: 1.5\na: 2", "ab: 3"]
    got = {r.k: (r.a, r.b) for r in files.profiles(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", {"a": 9.0, "b": 8.0}).collect()}
    assert got == {0: (1.0, -2.5), 1: (9.0, 8.0), 2: (2.0, 8.0), 3: (9.0, 8.0)}
    pages = ["<p>A <b>b</b>\n c</p><script>x < 1</script><style>\n.a{}</style><!-- <p>no</p> -->", "<img/>", None]
    got = {r.k: (r.text, r.n_chars, r.n_words, r.readable) for r in files.page_texts(spark.createDataFrame(list(enumerate(pages)), "k int, h string"), "k", "h").collect()}
    assert got == {0: ("A b c", 5, 3, True), 1: ("", 0, 0, False), 2: ("", 0, 0, False)}
