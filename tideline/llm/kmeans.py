"""Centroid clustering of integer vectors: Lloyd's rounds by matrix products, sums combined in a tree.

Vectors are packed into blocks of rows.  A task expands the distances of a
block as |x|^2 - 2 x.c + |c|^2, one float64 matrix product for all centroids.
Every number in it is a whole one, so the product is exact while the largest
possible magnitude stays below 2^53; a block beyond that bound is done in
64-bit integers while those hold it, then in Python's integers.  Each task
returns one sum and count a cluster; ``RDD.treeAggregate`` combines them, so
the driver sees as many numbers as the centroids have, whatever the input.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

CLUSTERS, ROUNDS, SCALE, DIM, SEED = 8, 10, 1024, 64, 3
#: Vectors in a block.
BLOCK = 4096
#: Whole numbers below are exact in float64, and in 64-bit integers.
FLOAT_EXACT, INT_EXACT = 1 << 53, 1 << 63


def usable(vector: Column, dim: int) -> Column:
    """True where there are ``dim`` components, none null or non-finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~F.exists(vector, bad), F.lit(False))


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of float64 components: float64 while whole numbers are exact there, else Python's integers."""
    if len(x) == 0 or np.abs(x).max() * scale < FLOAT_EXACT:
        return np.floor(x * scale)
    whole = np.abs(x) >= 2.0**52  # has no fraction, so that scaling it is exact
    return np.array([int(v) * scale if w else math.floor(v * scale) for v, w in zip(x.ravel().tolist(), whole.ravel(), strict=True)], object).reshape(x.shape)


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of whole vectors to whole centroids."""
    top = int(np.abs(x).max()) if x.size else 0
    far = max((abs(v) for c in centroids for v in c), default=0)
    bound = x.shape[1] * (top + far) ** 2  # no sum in the expansion is larger
    kind = np.float64 if bound < FLOAT_EXACT else np.int64 if bound < INT_EXACT else object
    a, c = x.astype(kind) if kind is not object else _whole(x), np.array(centroids, object).astype(kind)
    return (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]


def _whole(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ``ids`` (nulls apart) and raw components, from rows ``vec_id, vector``."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = np.asarray(part.column(1).flatten(), np.float64)
            ids = part.column(0)
            known = np.asarray(ids.is_valid(), np.uint8)
            data = [np.asarray(ids.fill_null(0), np.int64).tobytes(), known.tobytes(), x.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], names=["ids", "known", "data"])


def _blocks(batch: pa.RecordBatch, dim: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for ids, known, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
        valid = np.frombuffer(known, np.uint8) == 1
        yield pa.array(np.frombuffer(ids, np.int64), mask=~valid), scaled(np.frombuffer(data, np.float64).reshape(-1, dim), scale)


def _sums(centroids: list[list[int]], dim: int, scale: int):  # noqa: ANN202
    """One row of each task: count, summed vector and summed distance of each cluster, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = nothing(len(centroids), dim)
        for batch in batches:
            for _, x in _blocks(batch, dim, scale):
                d = distances(x, centroids)
                near = d.argmin(1)
                for k in np.unique(near):
                    own = x[near == k]
                    exact = own.dtype != object and BLOCK * int(np.abs(own).max(initial=0)) < FLOAT_EXACT
                    vector = own.sum(0) if exact else _whole(own).sum(0)
                    add(total, [(int(k), len(own), [int(v) for v in vector], sum(int(v) for v in d[near == k, k]))])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    return run


def nothing(k: int, dim: int) -> list[list]:
    return [[0, [0] * dim, 0] for _ in range(k)]


def add(total: list[list], rows: list[tuple]) -> list[list]:
    for k, n, vector, spread in rows:
        t = total[k]
        t[0] += n
        t[1] = [a + b for a, b in zip(t[1], vector, strict=True)]
        t[2] += spread
    return total


def merge(a: list[list], b: list[list]) -> list[list]:
    return add(a, [(k, *t) for k, t in enumerate(b)])


def cluster_sums(blocks: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[list]:
    """Count, sum and summed squared distance of each cluster, over all blocks."""
    parts = blocks.mapInArrow(_sums(centroids, dim, scale), "sums binary").rdd
    return parts.treeAggregate(nothing(len(centroids), dim), lambda t, row: merge(t, pickle.loads(row.sums)), merge, depth=3)


def _fits(v: int) -> int | None:
    return v if v < INT_EXACT else None


def _label(centroids: list[list[int]], dim: int, scale: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _blocks(batch, dim, scale):
                d = distances(x, centroids)
                near = d.argmin(1)
                least = [_fits(int(v)) for v in d[np.arange(len(near)), near]]
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(least, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the least SHA-256 of ``seed:vec_id``; those without ``vec_id`` come last, equal hashes by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()
    return [[int(v) for v in scaled(np.array([r.vector], np.float64), scale)[0]] for r in rows]


def cluster(
    embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable row of ``embeddings`` (vec_id, embedding).

    A component x counts as floor(scale * x).  Rows with a null vector, with
    another number of components, or with a null or non-finite one take no
    part.  Every other row counts, also one repeated or without ``vec_id``
    (never among the first centroids while others are there).  Equally near
    centroids: the smaller number.  With fewer than ``k`` rows there are as
    many centroids as rows; an empty table gives an empty result.  A distance
    or inertia beyond a long is null; other columns are not read.
    """
    vector = F.col("embedding").cast("array<double>")
    vectors = embeddings.where(usable(F.col("embedding"), dim)).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    blocks = written(vectors.mapInArrow(_pack, "ids binary, known binary, data binary"))  # read once for each round
    centroids = first_centroids(vectors, k, scale, seed)
    for _ in range(rounds):
        sums = cluster_sums(blocks, centroids, dim, scale)
        centroids = [[v // n for v in total] if n else old for (n, total, _), old in zip(sums, centroids, strict=True)]
    spread = [s for _, _, s in cluster_sums(blocks, centroids, dim, scale)]
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.lit(values) if values else F.array().cast(f"array<{kind}>"), F.col("cluster")).cast(kind)
    inertia = F.array(*(F.lit(_fits(s)).cast("long") for s in spread)) if spread else F.array().cast("array<long>")
    return blocks.mapInArrow(_label(centroids, dim, scale), "vec_id long, cluster int, distance long").select(
        "vec_id", "cluster", "distance", F.get(inertia, F.col("cluster")).alias("cluster_inertia"),
        F.lit(_fits(sum(spread))).cast("long").alias("inertia"), of(text, "string").alias("centroid_sha256"),
    )


def oracle_sql(k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED) -> str:
    """The same in SQL, whole numbers only; a step for each round."""
    near = f"""select row, vec_id, x, arg_min(c, d * {k} + c) as c, min(d) as d from (select v.row, v.vec_id, v.x, z.c,
        list_sum(list_transform(list_zip(v.x, z.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v, {{centroids}} z) group by row, vec_id, x"""
    steps = [
        f"""v as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda e: cast(floor({scale} * cast(e as double)) as bigint)) as x from embeddings
            where len(embedding) = {dim} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)""",
        f"c0 as materialized (select cast(row_number() over (order by h) - 1 as integer) as c, x from (select sha256('{seed}:' || vec_id) as h, x from v order by h limit {k}))",
    ]
    for i in range(rounds):
        steps.append(f"a{i} as materialized ({near.format(centroids=f'c{i}')})")
        steps.append(
            f"""s{i} as materialized (select c, list(q order by pos) as x from (select c, pos, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) as q
            from (select c, unnest(x) as e, unnest(range(1, {dim + 1})) as pos from a{i}) group by c, pos) group by c)"""
        )
        steps.append(f"c{i + 1} as materialized (select o.c, coalesce(s.x, o.x) as x from c{i} o left join s{i} s on s.c = o.c)")
    steps.append(f"a as materialized ({near.format(centroids=f'c{rounds}')})")
    return f"""with {", ".join(steps)} select vec_id, a.c as "cluster", cast(d as bigint) as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
        sha256(array_to_string(z.x, ',')) as centroid_sha256 from a join c{rounds} z on z.c = a.c"""
