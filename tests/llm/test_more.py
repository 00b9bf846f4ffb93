"""Ball-tree clustering, fill-in-the-middle and the streaming byte-level BPE against brute force, the library and odd input."""

from __future__ import annotations

import hashlib
import random
import string

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_llm import brute_spans, documents, none, odd, removed  # noqa: F401
from tokenizers import Regex, Tokenizer, pre_tokenizers

from vellumix.llm import _anchors, balls, bpe_stream, fim, suffix

# suffix-array dedup


def test_contexts_with_colliding_hashes_are_told_apart(spark, monkeypatch):
    """Texts that differ, though every polynomial hash of theirs is made to be the same: only what repeats is removed."""
    monkeypatch.setattr(_anchors, "VALUES", np.full(256, 12_345, np.uint64))
    rng = random.Random(3)
    tail = "".join(rng.choice(string.ascii_letters) for _ in range(100))
    heads = ["".join(rng.choice(string.ascii_letters) for _ in range(68)) for _ in range(3)]
    rows = [(i, h + tail) for i, h in enumerate(heads)] + [(9, heads[0] + tail), (10, heads[1] + "-" + tail[1:])]
    raw = [(t or "").encode() for _, t in rows]
    assert len({tuple(_anchors.kmer_hashes(np.frombuffer(x, np.uint8)).tolist()) for x in raw}) == 1
    batches = [_anchors.anchors([x]) for x in raw]
    assert len({b[4].tobytes() for b in batches[:3]}) == 3 and batches[0][4].tobytes() == batches[3][4].tobytes()
    ids = [i for i, _ in rows]
    contexts, starts = [raw[0], raw[1]], np.zeros(2, np.int64)
    flags = suffix.repeated_starts(contexts, np.array([0, 1]), starts)
    assert flags.tolist() == [False] * 69 + [False] * 68 + [True]
    monkeypatch.undo()
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == {i: v for i, v in brute_spans(rows).items() if i in ids}


# clustering


def plain_rounds(points, k, rounds, centroids):
    for _ in range(rounds + 1):
        d = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        last = centroids
        centroids = np.array([[int(s) // (own == c).sum() for s in points[own == c].sum(axis=0)] if (own == c).any() else centroids[c].tolist() for c in range(k)])
    return own, d.min(axis=1), last


def vectors(rng, n, dim, scale):
    middles = rng.normal(0, 8 * scale, (7, dim))
    out = middles[rng.integers(0, 7, n)] + rng.normal(0, scale, (n, dim))
    out[: n // 3] = out[0]  # one vector holds a third of all rows
    out[n // 3 : n // 2] = np.round(out[n // 3 : n // 2])
    return out.astype(np.float32)


@pytest.mark.parametrize(("scale", "dim"), [(0.1, 8), (3.0, 4), (9000.0, 5), (0.0, 3)])
def test_rounds(spark, scale, dim):
    rng = np.random.default_rng(3)
    data = vectors(rng, 700, dim, scale)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(5)
    found, centroids = balls.cluster(docs, dim, 9, 3)
    points = np.floor(256 * data.astype(np.float64)).astype(np.int64)
    first = balls.first_centroids(balls.kept_vectors(docs, dim), 9)
    own, d, last = plain_rounds(points, 9, 3, first)
    got = {r.vec_id: (r.cluster, r.distance) for r in found.collect()}
    assert got == {i: (own[i], d[i]) for i in range(len(data))}
    assert centroids.tolist() == last.tolist()


def test_balls_are_given_whole_and_leaves_exactly():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-20, 20, (300, 6)), 5000 + rng.integers(-20, 20, (300, 6)), np.full((200, 6), 2500)])
    centroids = np.array([[0] * 6, [5000] * 6, [0] * 6, [1, -1, 0, 0, 0, 0], [2500] * 6])
    tree = balls.Tree(*balls.tree_row(list(range(len(points))), points)[1:])
    whole, owner, rows, nearest = balls.descend(tree, centroids)
    covered = np.concatenate([rows, *(np.arange(*tree.nodes[i, :2]) for i in whole)])
    assert sorted(covered) == list(range(len(points)))
    assert {1, 4} <= set(owner) and 2 not in owner and 2 not in nearest and 0 < len(rows) <= 320
    for i, c in zip(whole, owner, strict=True):
        a, b, _ = tree.nodes[i]
        assert (balls.distances(tree.points[a:b], centroids).argmin(axis=1) == c).all() and (tree.points[a:b].sum(axis=0) == tree.sums[i]).all()
    assert (balls.distances(tree.points[rows], centroids).argmin(axis=1) == nearest).all()


def test_cluster_odd(spark):
    ok = [0.5, -0.25, 1.0]
    rows = [(1, ok), (1, ok), (None, ok), (2, None), (3, [0.5, None, 1.0]), (4, [0.5, float("nan"), 1.0]), (5, [float("inf"), 0.0, 0.0]), (6, [0.1, 0.2]), (7, [-0.001, 0.0, 0.0])]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, cluster int")
    found, centroids = balls.cluster(docs, 3, 4, 2)
    got = sorted((r.vec_id or -1, r.cluster, r.distance) for r in found.collect())
    assert [g[0] for g in got] == [-1, 1, 1, 7] and all(g[2] == 0 for g in got) and len(centroids) == 4
    assert [-1, 0, 0] in centroids.tolist() and len({g[1] for g in got if g[0] != 7}) == 1
    empty, none_at_all = balls.cluster(docs.limit(0), 3, 4, 2)
    assert empty.count() == 0 and len(none_at_all) == 0
    large = spark.createDataFrame([(1, [1e9, 0.0, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        balls.cluster(large, 3, 4, 2)


# fill-in-the-middle


def test_unit_ends():
    split = pre_tokenizers.Split(Regex(fim.LINES), "isolated")
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab\n\n\ré中\U0001f600 ") for _ in range(rng.randint(0, 80)))
        lines = [x for x in text.split("\n")]
        want = np.cumsum([len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] else [])).tolist()
        for block in (1, 7, 1000):
            assert fim.unit_ends(split, text, "\n", block).tolist() == want
    words = pre_tokenizers.Split(Regex(r"\w+"), "isolated")
    assert fim.unit_ends(words, "ab, c", None).tolist() == [2, 4, 5]


def test_fim(spark, odd, none):
    marks = [(i, t) for i, t in enumerate(["a<P>b\nc", "<S>", "x<M", "<\n<\n<", "P>\n<\nS>\n", "\n\n\n", "é\n中\U0001f600\n", "<P\n>\n"] * 8)]
    for docs in (odd, spark.createDataFrame(marks, "doc_id long, text string")):
        rows = fim.transform(docs).withColumn("restored", fim.restore())
        got = rows.collect()
        assert sorted(r.restored for r in got) == sorted(r.text or "" for r in docs.collect())
        for r in got:
            assert (r.form == "plain") == (r.restored == "" or any(m in r.restored for m in ("<P>", "<S>", "<M>")))
            if r.form != "plain":
                assert r.prefix + r.middle + r.suffix == r.restored
                assert r.output == (f"<P>{r.prefix}<S>{r.suffix}<M>{r.middle}" if r.form == "psm" else f"<S>{r.suffix}<P>{r.prefix}<M>{r.middle}")
                assert all(not x or x.endswith("\n") for x in (r.prefix, r.middle) if not r.restored.endswith(x))
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.transform(none).count() == 0
    part = fim.transform(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a\nb\n").alias("text")), rate=30, spm_rate=20).groupBy("form").count().collect()
    share = {r["form"]: r["count"] / 3000 for r in part}
    assert abs(share["plain"] - 0.7) < 0.04 and abs(share["spm"] - 0.06) < 0.02


def test_fim_long(spark):
    text = "line of text\n" * 60_000 + "x" * 500_000
    r = fim.transform(spark.createDataFrame([(5, text)], "doc_id long, text string")).withColumn("restored", fim.restore()).first()
    assert r.n == 60_001 and r.restored == text


# streaming byte-level BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_stream.default())


@pytest.fixture
def own():
    with open(bpe_stream.default(), "rb") as f:
        return bpe_stream.Codec(f.read())


def ids_of(own, text, chunk):
    return np.frombuffer(bpe_stream.encode_text(own, text, chunk), "<i4").tolist()


def test_stream_like_the_library(own, library, monkeypatch):
    rng = random.Random(4)
    bits = ["a", "e", "s", "t", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'r", "1", "23", "é", "ß", "中", " ", "\U0001f600", "<|endoftext|>", "<|end", "!", "...", "the", "٣", "͸", "\xa0", "\x85", "\x1c", "՘", "࢏"]
    monkeypatch.setattr(bpe_stream, "LONG", 16)
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.3:
            text += rng.choice(["a", "ab", " ", "\n", "!?", "12", "é", " \n"]) * rng.randint(20, 300) + rng.choice(["", "x", " ", "'s"])
        want = library.encode(text, add_special_tokens=False).ids
        for chunk in (5, 64, 1 << 16):
            assert ids_of(own, text, chunk) == want, (text, chunk)
        assert bpe_stream.decode_ids(own, np.array(want, "<i4").tobytes(), 3) == library.decode(want, skip_special_tokens=False)


def test_lookahead_is_enough(own, library, monkeypatch):
    """Long pre-tokens, among them chains of pieces whose merges move boundaries far back."""
    monkeypatch.setattr(bpe_stream, "LONG", 32)
    assert own.vocabulary.lookahead == 129
    rng = random.Random(6)
    chain = ["neighbourhood", "s", "g", "ap", "ache", "v", "ill", "ac", "ons", "on", "en", "f", "if", "act", "ing", "ed", "ay", "an", "ne", "ys"]
    for _ in range(150):
        letters = rng.choice([string.ascii_lowercase, "etaoins", "aab", "sgapchevilonf", chain, chain[:6], "=-", "*#"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(300, 2500)))
        assert ids_of(own, text, rng.randint(40, 900)) == library.encode(text, add_special_tokens=False).ids
    way, held = bpe_stream.Transducer(own.vocabulary), 0
    for _ in range(2000):
        way.push(b"neighbourhoodsgapache"[: rng.randint(1, 21)])
        held = max(held, len(way.held))
    assert held < own.vocabulary.window


def test_small_lookahead():
    """Every continuation of every string over a small alphabet leaves what lies behind the lookahead as it is; one byte less does not do."""
    merges = [(b"a", b"b"), (b"b", b"b"), (b"ab", b"a"), (b"c", b"ab"), (b"bb", b"c"), (b"c", b"a")]
    need = bpe_stream.sufficient_lookahead(merges)

    def ends(text):
        ids = [text[i : i + 1] for i in range(len(text))]
        for a, b in merges:
            i = 0
            while i + 1 < len(ids):
                if ids[i] == a and ids[i + 1] == b:
                    ids[i : i + 2] = [a + b]
                i += 1
        return set(np.cumsum([len(x) for x in ids]).tolist())

    rng = random.Random(8)
    farthest = 0
    for _ in range(40_000):
        start = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        one, other = ends(start), ends(start + bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))))
        differ = [p for p in range(1, len(start) + 1) if (p in one) != (p in other)]
        if differ:
            farthest = max(farthest, len(start) - differ[0])
    assert farthest < need <= farthest + 3
    for bad in ([(b"ab", b"c")], [(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"a", b"bc")]):
        with pytest.raises(ValueError, match="merge"):
            bpe_stream.sufficient_lookahead(bad)


def test_decoding_machine(own, library):
    rng = random.Random(9)
    for _ in range(1500):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 30))]
        assert bpe_stream.decode_ids(own, np.array(ids, "<i4").tobytes(), rng.randint(1, 9)) == library.decode(ids, skip_special_tokens=False)
    assert bpe_stream.decode_ids(own, np.array([64, 99_999, 65], "<i4").tobytes()) == "ab"


def test_stream_query(spark, documents, library):
    got = {r.doc_id: r for r in bpe_stream.op13_bpe_stream(spark, SMALL).collect()}
    assert len(got) == len(documents)
    for doc, text in documents:
        ids = library.encode(text, add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        assert [got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256] == [len(ids), *digests]


def test_stream_operator(odd, none, library):
    path = bpe_stream.default()
    encoded = bpe_stream.encode(odd, path)
    rows = bpe_stream.decode(encoded, path).collect()
    assert sorted(r.decoded for r in rows) == sorted(r.text or "" for r in odd.collect())
    assert all(r.ids == library.encode(r.decoded, add_special_tokens=False).ids for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, bpe_stream.round_trip(odd, path).collect()))
    assert bpe_stream.round_trip(none, path).count() == 0
