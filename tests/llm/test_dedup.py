import re
from collections import Counter

import numpy as np
import pytest

from tideline.llm import near_dedup as nd
from tideline.sources.components import connected_components


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def brute(rows, k, part, whole):
    rows = [(i, shingles(t, k)) for i, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in rows if i is not None and s]
    for n, (i, s) in enumerate(known):
        for j, t in known[:n]:
            if whole * len(s & t) >= part * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return Counter((i, len(s), None if i is None else root(i)) for i, s in rows)


@pytest.mark.parametrize(("k", "part"), [(3, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(nasty, k, part):
    got = nd.near_duplicates(nasty, k, part, 100).collect()
    want = brute([(r.doc_id, r.text) for r in nasty.collect()], k, part, 100)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_empty(nothing):
    assert nd.near_duplicates(nothing).count() == 0
    assert nd.keep_first(nothing).columns == nothing.columns


def test_keep_first_keeps_columns_and_one_document_of_a_group(nasty):
    kept = nd.keep_first(nasty)
    assert kept.columns == nasty.columns
    groups = {r.doc_id: r.component_id for r in nd.near_duplicates(nasty).collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {g if g is not None else None for g in groups.values()} | {None}


def test_families_and_buckets_over_block_bounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):  # near copies of one text, each with its own change
        w = list(base)
        for at in rng.integers(0, 200, 2):
            w[at] = f"x{i}_{at}"
        rows.append((i + 1, " ".join(w)))
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "FAMILY_BLOCK", 16)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85, 100)


def test_texts_of_one_id_and_very_long_repeats(spark):
    rng = np.random.default_rng(4)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 5000, 100)) for _ in range(3))
    near = lambda t: t + " more"
    thue = "".join("ae"[i.bit_count() % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ae", "ea"))
    rows = [(5, a), (5, b), (3, near(a)), (7, near(b)), (9, c), (9, c), (20, thue), (21, other), (22, f"{thue} x y z"), (23, f"{other} x y z")]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85, 100)
    assert {r.component_id for r in got if r.doc_id in (3, 5, 7)} == {3}


def test_ten_thousand_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(10_000).selectExpr("id % 10 as doc_id").crossJoin(spark.createDataFrame([(text,)], "text string"))
    got = nd.near_duplicates(rows, 3, 85, 100)
    assert got.count() == 10_000 and got.where("component_id <> 0 or n_shingles <> 58").isEmpty()


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows, wanted = [], Counter()
    for i in range(300):
        base = [f"w{x}" for x in rng.integers(0, 50_000, 200)]
        changed = list(base)
        for at in rng.choice(200, rng.integers(1, 9), replace=False):
            changed[at] = "new"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(changed))]
        s, t = shingles(rows[-2][1], 3), shingles(rows[-1][1], 3)
        similar = len(s & t) / len(s | t)
        if similar >= 0.85:
            wanted[round(similar, 2)] += 1
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(300)) == sum(wanted.values()) > 50 and min(wanted) < 0.87


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    k = 256
    a = rng.integers(1, 1 << 62, (k, 1), dtype=np.uint64)
    for same in (0.95, 0.85, 0.7):
        b = a.copy()
        change = int(k * (1 - same))
        b[:change] = rng.integers(1, 1 << 62, (change, 1), dtype=np.uint64)
        z = np.bitwise_count(nd.odd_sketches(a, 1024) ^ nd.odd_sketches(b, 1024)).sum()
        assert abs(nd.estimate(np.array([z]), k, 1024)[0] - same) < 0.06


def test_sketch_limit_lets_the_threshold_through():
    assert nd.bands_for(0.85) == 24
    assert (1 - 0.85**nd.ROWS) ** nd.bands_for(0.85) <= nd.MISS
    assert nd.sketch_limit(0.85, 120) < nd.BITS // 2


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame([*chain, *star, *chain[:5], (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(1000, 1050), 1000)}
    assert connected_components(edges.where("a < 0")).count() == 0
