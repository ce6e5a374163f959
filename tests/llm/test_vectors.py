"""Exact duplicates, clusters and hard negatives against plain versions, with every odd row."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import exact_dedup as xd
from tideline.llm import hard_negatives as hn
from tideline.llm import kmeans as km

VECTORS = "vec_id long, embedding array<float>, label int, row long, digest string, n long, key double, cluster int"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_duplicates(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(fold(text), []).append(doc)
    out = []
    for text, docs in groups.items():
        keep = max((d for d in docs if d is not None), default=None)
        stays = [d == keep for d in docs]
        first = stays.index(True)
        out += [(d, keep, len(docs), i == first, hashlib.sha256(text.encode()).hexdigest()) for i, d in enumerate(docs)]
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3])
def test_exact_duplicates(spark, nasty, batches):
    twins = nasty.unionByName(nasty.where("doc_id % 2 = 0").withColumn("text", F.upper("text"))).unionByName(nasty.where("doc_id < 10"))
    got = [tuple(r) for r in xd.exact_duplicates(twins, batches).collect()]
    assert sorted(got, key=str) == plain_duplicates([(r.doc_id, r.text) for r in twins.collect()])


def test_exact_duplicates_of_nothing_and_of_long_texts(spark, nothing):
    assert xd.exact_duplicates(nothing).count() == 0 and xd.keep_last(nothing).count() == 0
    long = "Ab İé" * 400_000
    rows = [(1, long), (2, long.replace("A", "a")), (3, long + "."), (4, long.replace("é", "É"))]
    got = {r.doc_id: r.keep_id for r in xd.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4}  # only A-Z are folded


def test_hot_texts_are_spread(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "The same").otherwise(F.concat(F.lit("text "), (F.col("id") % 7_000).cast("string"))).alias("text"))
    out = xd.exact_duplicates(docs)
    row = out.where("group_size = 10000").agg(F.count("*").alias("n"), F.max("keep_id").alias("top"), F.sum(F.col("kept").cast("int")).alias("kept")).first()
    assert tuple(row) == (10_000, 29_997, 1)
    assert out.count() == 30_000 and out.where("kept").count() == out.select("text_sha256").distinct().count() == xd.keep_last(docs).count()


def test_an_index_is_kept_and_a_batch_counts_once(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    batch = lambda rows: xd.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    xd.DigestIndex(spark, root, 4).add(batch([(1, "a"), (2, "A"), (3, "b")]), "one")
    again = xd.DigestIndex(spark, root, 16)  # found as it was made
    assert again.buckets == 4 and again.known().count() == 2
    second = batch([(9, "a"), (4, "c"), (None, "c")])
    again.add(second, "two")
    again.add(second, "two")  # an attempt made again
    plan = again.groups()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    got = {(r.keep_id, r.keep_batch, r.n) for r in xd.DigestIndex(spark, root).groups().collect()}
    assert got == {(9, "two", 3), (3, "one", 1), (4, "two", 2)}


def test_the_index_is_not_shuffled_for_a_batch(spark, tmp_path):
    index = xd.DigestIndex(spark, f"file://{tmp_path}/plan", 4)
    rows = xd.digests(spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    index.add(rows, "one")
    fresh = rows.groupBy("digest").count().repartition(4, "digest").join(index.known("two").select("digest").hint("merge"), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # of the batch alone


def vectors(n=60, dim=64, seed=3):
    """Vectors, some equal, with every row that takes no part, an own size, repeated rows and ids without value."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) / 8
    rows = [(int(i), [float(np.float32(v)) for v in base[i]], int(i % 4)) for i in range(n)]
    rows += [(100 * i, rows[i][1], i % 3) for i in range(5)]  # copies under other ids
    rows += [rows[7], rows[7]]
    bad = list(rows[0][1])
    rows += [(900, None, 1), (901, rows[1][1], None), (902, [*bad[:-1], None], 1), (903, [*bad[:-1], math.nan], 1), (904, [*bad[:-1], math.inf], 2), (None, rows[2][1], 2), (None, rows[2][1], 3), (None, None, None)]
    rows += [(905, [], 1), (906, rows[3][1][:10], 2), (1000, [*rows[4][1], 0.5], 1)]
    return [(*r, 1, "d", 2, 0.5, 9) for r in rows]


def kept_vectors(rows, scale, dim=None):
    return [(r[0], [math.floor(scale * v) for v in r[1]], r[2]) for r in rows if r[1] is not None and (dim is None or len(r[1]) == dim) and all(v is not None and math.isfinite(v) for v in r[1])]


def plain_clusters(rows, k=8, rounds=10):
    kept = kept_vectors(rows, 1024, 64)
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [r[1] for r in sorted(kept, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, x, _ in kept:
            own.setdefault(near(x)[1], []).append(x)
        centroids = [[sum(v) // len(own[j]) for v in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(centroids)]
    out = [(i, *near(x)) for i, x, _ in kept]
    sums = {}
    for _, d, j in out:
        sums[j] = sums.get(j, 0) + d
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, j, fits(d), fits(sums[j]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in out), key=str)


@pytest.mark.parametrize("times", [1.0, 2.0**14, 2.0**18, 2.0**60])
def test_clusters(spark, times):
    """The larger the numbers, the wider the integers: float64, 64 bits, Python's."""
    rows = [(r[0], r[1] if r[1] is None else [None if v is None else v * times for v in r[1]], *r[2:]) for r in vectors()]
    got = [tuple(r) for r in km.cluster(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()]
    assert sorted(got, key=str) == plain_clusters(rows)


def test_clusters_of_few_and_of_none(spark):
    none = spark.createDataFrame([], VECTORS)
    assert km.cluster(none).count() == 0 and hn.hard_negatives(none).count() == 0
    few = [r for r in vectors() if r[0] in (1, 2, 3)]
    assert sorted((tuple(r) for r in km.cluster(spark.createDataFrame(few, VECTORS)).collect()), key=str) == plain_clusters(few)


def test_distances_are_exact_beyond_float64():
    rng = random.Random(1)
    for bits in (20, 26, 40):
        x = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(64)] for _ in range(20)]
        c = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(64)] for _ in range(3)]
        want = [[sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert [[int(v) for v in r] for r in km.distances(np.array(x, float), c)] == want


def plain_negatives(rows):
    kept = [(i, x, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, x, lab in kept_vectors([r for r in rows if r[2] is not None], 256)]
    order = lambda p: (-p[1], p[0] is None, p[0] or 0)
    out = []
    for at, (i, x, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        score = [(o[0], sum(a * b for a, b in zip(x, o[1], strict=False)), o[2]) for n, o in enumerate(kept) if n != at]
        for pos, ps, _ in sorted((s for s in score if s[2] == label), key=order)[:5]:
            near = sorted((s for s in score if s[2] != label and 80 * ps <= 100 * s[1] <= 100 * ps), key=order)[:5]
            out += [(i, pos, rank + 1, neg, ps, ns) for rank, (neg, ns, _) in enumerate(near)]
    return sorted(out, key=str)


@pytest.mark.parametrize("times", [1.0, 2.0**12, 2.0**20])
def test_hard_negatives(spark, times):
    rows = [(r[0], r[1] if r[1] is None else [None if v is None else v * times for v in r[1]], *r[2:]) for r in vectors()]
    got = sorted((tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()), key=str)
    assert got == plain_negatives(rows) and len(got) > 20


def test_hard_negatives_by_many_annuli(spark, monkeypatch):
    """A sample too small to tell radii: later annuli and the whole table are read; and most rows are one vector."""
    monkeypatch.setattr(hn, "SAMPLE", 7)
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "ANCHORS", 2)
    monkeypatch.setattr(hn, "LANE", 3)
    rows = vectors(300, 6, 5)
    rows += [(2_000 + i, rows[0][1], i % 2, *rows[0][3:]) for i in range(150)]
    got = sorted((tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()), key=str)
    assert got == plain_negatives(rows)


def test_a_vector_too_large_takes_no_part(spark):
    rows = [r for r in vectors() if r[1] is not None]
    huge = [(950, [1e30] * 64, 1, *rows[0][3:]), (300, [3e38] * 64, 2, *rows[0][3:])]
    got = sorted((tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows + huge, VECTORS)).collect()), key=str)
    assert got == plain_negatives(rows)


def test_products_are_exact_at_every_width():
    rng = np.random.default_rng(2)
    for bits in (4, 20, 26):
        a, b = (rng.integers(-(1 << bits), 1 << bits, (5, 48)).astype(np.int32) for _ in range(2))
        assert (hn.products(a, b).astype(np.int64) == a.astype(np.int64) @ b.astype(np.int64).T).all()
