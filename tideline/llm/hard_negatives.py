"""Hard negatives by one-dimensional distance keys.

The largest inner product is the smallest distance once every vector x gets
one more component, sqrt(M^2 - |x|^2) with M the largest norm, and every query
a zero: d^2 = |q|^2 + M^2 - 2 q.x.  Augmented vectors go to their nearest
pivot, and the table is stored in blocks sorted by (pivot, distance to it).  A
query at distance d from a pivot has every vector within r of it at keys
between d - r and d + r there, so a search reads key intervals, from an inner
radius outwards: the scores of an annulus are [low, high] for whole numbers.
A search ends when the annuli read so far hold k answers, as all that is left
is further away than the last of them, or when its own limit is reached.

Anchors are packed into blocks too.  A pair of blocks whose keys meet is one
matrix product, exact in float32 or float64 as long as the norms say so, else
in 64-bit integers.  Blocks of the index are shuffled once a round and never
copied; nothing of the table is on the driver but pivots and a sample of fixed
size, which only decide how much is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

ANCHOR_EVERY, POSITIVES, NEGATIVES, SCALE = 100, 5, 5, 256
#: Per cent of the positive's score that a negative's has at least and at most.
LOW_SHARE, HIGH_SHARE = 80, 100
#: Pivots, and vectors of the bounded sample from which pivots and the first radii come.
PIVOTS, SAMPLE, SAMPLE_BYTES = 32, 2_000, 1 << 24
#: Vectors in a block of the index, bytes of its components, and anchors in a block of them.
BLOCK, BLOCK_BYTES, ANCHORS = 1_024, 1 << 20, 256
#: Blocks of a pivot that meet anchors in one task, about.
LANE = 1_024
#: Squared norms from here on don't fit the scores of a long; such vectors take no part.
NORM_LIMIT = 1 << 61
#: Scores that stand for no limit.
LEAST, MOST = -(1 << 62), 1 << 62


def finite(vector: Column) -> Column:
    """True where there is a vector without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _quantise(scale: int):  # noqa: ANN202
    """``vec_id, label, q, size, norm`` of ``vec_id, label, vector``: whole components as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            x = np.floor(scale * np.asarray(vectors.flatten(), np.float64))
            off = np.concatenate([[0], np.cumsum(np.asarray(vectors.value_lengths(), np.int64))])
            norm = np.array([np.dot(x[a:b], x[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)])
            fits = np.flatnonzero(norm < NORM_LIMIT)
            q = [x[off[i] : off[i + 1]].astype(np.int32) for i in fits]
            exact = [int((v.astype(np.int64) ** 2).sum()) for v in q]
            some = pa.array(fits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(some), batch.column(1).take(some), _binary(q), pa.array([len(v) for v in q], pa.int32()), pa.array(exact, pa.int64())],
                names=["vec_id", "label", "q", "size", "norm"],
            )

    return run


def _of_size(q: pa.Array, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each size."""
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(q.take(pa.array(at)).to_pylist()), np.int32).reshape(len(at), int(n)).astype(np.float64)


class Space:
    """Pivots and sample: what every task knows of the table, of fixed size."""

    def __init__(self, sample: list, top: int):
        self.top = top
        self.dim = max((len(r.q) // 4 for r in sample), default=0)
        self.q = np.zeros((len(sample), self.dim))
        for i, r in enumerate(sample):
            v = np.frombuffer(r.q, np.int32)
            self.q[i, : len(v)] = v
        self.row, self.label = np.array([r.row for r in sample], np.int64), np.array([r.label for r in sample], np.int64)
        whole = np.concatenate([self.q, np.sqrt(np.maximum(0, top - (self.q**2).sum(1)))[:, None]], 1)
        self.pivots = _pivots(whole) if len(sample) else np.zeros((1, self.dim + 1))
        self.slack = 1e-6 * (np.sqrt(top) + 1)  # far over the error of a distance in float64

    def to_pivots(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Distances of augmented vectors to all pivots; components that one side lacks are zero."""
        n = min(x.shape[1], self.dim)
        p = self.pivots[:, :-1]
        squared = (x**2).sum(1)[:, None] - 2 * (x[:, :n] @ p[:, :n].T) + (p**2).sum(1)[None, :] + (extra[:, None] - self.pivots[None, :, -1]) ** 2
        return np.sqrt(np.maximum(0, squared))


def _pivots(x: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Centres of the sample: the farthest from those before to start with, then a few rounds of means."""
    near = np.linalg.norm(x - x[0], axis=1)
    chosen = [0]
    while len(chosen) < min(PIVOTS, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
    out = x[chosen].copy()
    for _ in range(rounds):
        own = ((x**2).sum(1)[:, None] - 2 * x @ out.T + (out**2).sum(1)[None, :]).argmin(1)
        for k in np.unique(own):
            out[k] = x[own == k].mean(0)
    return out


def _keyed(space: Space):  # noqa: ANN202
    """Rows with their pivot and the distance to it, both of the augmented vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, norm = (np.asarray(batch.column(c)) for c in (4, 5))
            pivot, key = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, x in _of_size(batch.column(3), size):
                d = space.to_pivots(x, np.sqrt(np.maximum(0, space.top - norm[at])))
                pivot[at] = d.argmin(1)
                key[at] = d[np.arange(len(at)), pivot[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(key)], names=[*batch.schema.names, "pivot", "key"])

    return run


def _cuts(limit: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where blocks begin in rows that are sorted: at every change, and after ``limit`` rows."""
    n = len(limit)
    change = np.ones(n, bool)
    if n:
        change[1:] = np.any([s[1:] != s[:-1] for s in same], axis=0)
    start = np.flatnonzero(change)
    place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    return np.flatnonzero(place % limit == 0) if n else start


_INDEX = "block long, pivot int, lo double, hi double, size int, rows binary, ids binary, known binary, labels binary, width int, data binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive rows of one size and pivot; inside a block rows go by ``vec_id``, those without it last."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        row, size, pivot, key = (np.asarray(batch.column(c)) for c in (0, 4, 6, 7))
        known = np.asarray(batch.column(1).is_valid())
        ids, labels = np.asarray(batch.column(1).fill_null(0)), np.asarray(batch.column(2))
        starts = _cuts(np.clip(BLOCK_BYTES // (4 * np.maximum(size, 1)), 1, BLOCK), size, pivot)
        out: list[tuple] = []
        for a, b in zip(starts, np.append(starts[1:], len(row)), strict=True):
            order = a + np.lexsort((ids[a:b], ~known[a:b]))
            x = np.frombuffer(b"".join(batch.column(3).take(pa.array(order)).to_pylist()), np.int32)
            narrow = np.abs(x.astype(np.int64)).max(initial=0) < 1 << 15
            data = x.astype(np.int16 if narrow else np.int32)
            out.append(
                (number, int(pivot[a]), key[a:b].min(), key[a:b].max(), int(size[a]), row[order].tobytes(), ids[order].tobytes(), known[order].tobytes(), labels[order].astype(np.int32).tobytes(), data.itemsize, data.tobytes())
            )
            number += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_schema(_INDEX))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in text.split(", "))])


def _anchored(space: Space):  # noqa: ANN202
    """Anchors with the distances to all pivots, and the positives' steps: the best and the k-th best of the sample, then all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size, labels = (np.asarray(batch.column(c)) for c in (0, 4, 2))
            near, far, steps = np.zeros(batch.num_rows, np.int32), [b""] * batch.num_rows, [[LEAST]] * batch.num_rows
            for at, x in _of_size(batch.column(3), size):
                d = space.to_pivots(x, np.zeros(len(at)))
                near[at] = d.argmin(1)
                n = min(x.shape[1], space.dim)
                score = np.rint(x[:, :n] @ space.q[:, :n].T)
                for k, i in enumerate(at):
                    far[i] = d[k].tobytes()
                    like = np.sort(score[k][(space.label == labels[i]) & (space.row != row[i])])[::-1]
                    steps[i] = _steps(like, POSITIVES, LEAST)
            home = [float(np.frombuffer(f, float).min()) for f in far]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near), pa.array(home, pa.float64()), pa.array(far, pa.binary()), pa.array(steps, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "home", "home_key", "far", "steps"],
            )

    return run


def _steps(scores: np.ndarray, k: int, last: int) -> list[int]:
    """Lower ends of the annuli: the best score of the sample, its k-th best, the last one allowed; less 1, as large scores are rounded."""
    seen = [int(scores[i]) - 1 - (abs(int(scores[i])) >> 50) for i in (0, k - 1) if i < len(scores)]
    return [*(s for s in seen if s > last), last]


def _ranged(space: Space, k: int):  # noqa: ANN202
    """Requests ``row, req, q, size, label, low, high`` with their steps within [low, high], from the sample's scores of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, label, low, high = (np.asarray(batch.column(c)) for c in (3, 4, 5, 6))
            steps: list[list[int]] = [[]] * batch.num_rows
            for at, x in _of_size(batch.column(2), size):
                n = min(x.shape[1], space.dim)
                score = np.rint(x[:, :n] @ space.q[:, :n].T)
                for j, i in enumerate(at):
                    s = score[j][(space.label != label[i]) & (score[j] <= high[i])]
                    steps[i] = _steps(np.sort(s)[::-1], k, int(low[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(6), pa.array(steps, pa.list_(pa.int64()))], names=["row", "req", "high", "steps"])

    return run


_PACKED = "ablock long, size int, rows binary, labels binary, data binary, whose binary, req binary, low binary, high binary, pivots binary, start binary, stop binary"


def _pack(space: Space):  # noqa: ANN202
    """Blocks of anchors with their requests of this round, and the keys they need of each pivot.

    From rows ``row, label, q, size, norm, far, requests`` with requests of ``req, low, high``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            row, label, size, norm = (np.asarray(batch.column(c)) for c in (0, 1, 3, 4))
            asked = batch.column(6).to_pylist()
            starts = _cuts(np.clip(BLOCK_BYTES // (4 * np.maximum(size, 1)), 1, ANCHORS), size)
            out: list[tuple] = []
            for a, b in zip(starts, np.append(starts[1:], len(row)), strict=True):
                flat = [(i, r["req"], r["low"], r["high"]) for i in range(b - a) for r in asked[a + i]]
                whose, req, low, high = (np.array(c, np.int64) for c in zip(*flat, strict=True))
                far = np.frombuffer(b"".join(batch.column(5).slice(a, b - a).to_pylist())).reshape(b - a, -1)[whose]
                reach = norm[a:b][whose].astype(float) + space.top
                outer = np.where(low <= LEAST, np.inf, np.sqrt(np.maximum(0, reach - 2.0 * low)))[:, None] + space.slack
                inner = np.where(high >= MOST, 0, np.sqrt(np.maximum(0, reach - 2.0 * high)))[:, None] - space.slack
                start, stop = np.maximum(far - outer, inner - far).min(0) - space.slack, (far + outer).max(0) + space.slack
                out.append(
                    (number, int(size[a]), row[a:b].tobytes(), label[a:b].astype(np.int32).tobytes(), b"".join(batch.column(2).slice(a, b - a).to_pylist()),
                     whose.tobytes(), req.tobytes(), low.tobytes(), high.tobytes(), np.arange(far.shape[1], dtype=np.int64).tobytes(), start.tobytes(), stop.tobytes())
                )
                number += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_schema(_PACKED))

    return run


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of anchors and pivot: the keys it needs."""
    for batch in batches:
        for block, pivots, start, stop in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            p = np.frombuffer(pivots, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), block)), pa.array(p.astype(np.int32)), pa.array(np.frombuffer(start, float)), pa.array(np.frombuffer(stop, float))],
                names=["ablock", "pivot", "start", "stop"],
            )


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors: partial sums are never larger than the product of the norms."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    top = [(v.astype(np.float64) ** 2).sum(1).max(initial=0) for v in (a, b)]
    bound = np.sqrt(top[0]) * np.sqrt(top[1]) * (1 + 1e-9)
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def best_of(score: np.ndarray, fits: np.ndarray, whose: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each request its first ``k`` columns that fit, scores in [low, high], by score from the top, then by column: requests, columns, scores."""
    n = score.shape[0]
    least, most = np.full(n, MOST, np.int64), np.full(n, LEAST, np.int64)
    np.minimum.at(least, whose, low)
    np.maximum.at(most, whose, high)
    kind = score.dtype
    wanted = fits & (score >= least.astype(kind)[:, None]) & (score <= most.astype(kind)[:, None])
    at, column = np.nonzero(wanted)
    found = score[at, column].astype(np.int64)
    order = np.lexsort((column, -found, at))
    at, column, found = at[order], column[order], found[order]
    edge = np.searchsorted(at, np.arange(n + 1))
    req, place = [], []
    for r in range(len(whose)):
        a, b = edge[whose[r]], edge[whose[r] + 1]
        falling = -found[a:b]
        first, last = np.searchsorted(falling, -high[r], "left"), np.searchsorted(falling, -low[r], "right")
        got = np.arange(a + first, a + min(last, first + k))
        req.append(np.full(len(got), r))
        place.append(got)
    place = np.concatenate(place) if place else np.zeros(0, np.int64)
    return np.concatenate(req) if req else place, column[place], found[place]


def _scan(same: bool, k: int):  # noqa: ANN202
    """The best answers within each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            of = lambda name, i, kind: np.frombuffer(c[name][i].as_buffer(), kind)  # noqa: B023, E731
            for i in range(batch.num_rows):
                n, m = c["a_size"][i].as_py(), c["size"][i].as_py()
                rows, b_rows = of("a_rows", i, np.int64), of("rows", i, np.int64)
                a = of("a_data", i, np.int32).reshape(len(rows), n)
                b = of("data", i, np.int16 if c["width"][i].as_py() == 2 else np.int32).reshape(len(b_rows), m)
                alike = of("a_labels", i, np.int32)[:, None] == of("labels", i, np.int32)[None, :]
                fits = alike & (rows[:, None] != b_rows[None, :]) if same else ~alike
                whose = of("a_whose", i, np.int64)
                r, column, score = best_of(products(a, b), fits, whose, of("a_low", i, np.int64), of("a_high", i, np.int64), k)
                known = of("known", i, bool)[column]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[whose[r]]), pa.array(of("a_req", i, np.int64)[r]), pa.array(score), pa.array(of("ids", i, np.int64)[column], mask=~known)], names=["row", "req", "score", "id"]
                )

    return run


class Index:
    """The table's vectors in blocks sorted by (pivot, distance)."""

    def __init__(self, rows: DataFrame):
        """``rows``: ``row, vec_id, label, q, size, norm``, kept."""
        top, widest, n = rows.agg(F.max("norm"), F.max("size"), F.count("*")).first()
        some = max(1, min(SAMPLE, SAMPLE_BYTES // (4 * max(widest or 1, 1))))
        self.space = Space(rows.orderBy(F.xxhash64("row"), "row").limit(some).collect(), top or 0)
        keyed = rows.mapInArrow(_keyed(self.space), "row long, vec_id long, label int, q binary, size int, norm long, pivot int, key double")
        # equal vectors have one key: the hash lets ranges part them
        place = ["size", "pivot", "key", F.xxhash64("row")]
        parts = max(1, n // (4 * BLOCK))
        self.blocks = written(keyed.repartitionByRange(parts, *place).sortWithinPartitions(*place).mapInArrow(_blocks, _INDEX))
        self.keys = self.blocks.select("block", "pivot", "lo", "hi")
        self.lanes = max(1, self.keys.count() // LANE)

    def search(self, anchors: DataFrame, requests: DataFrame, k: int, same: bool) -> DataFrame:
        """``row, req, score, id, place``: the first ``k`` answers of every request, by annuli from its ``high`` down to the last of its ``steps``.

        ``requests``: ``row, req, high, steps``; ``anchors`` (with ``far``) are theirs.  Answers have the anchor's own label
        (``same``) and are no anchor's own row, or another label.
        """
        active = written(requests)
        found: DataFrame | None = None
        step, left = 0, active.count()
        while left:
            low = F.element_at("steps", F.least(F.lit(step + 1), F.size("steps")))
            high = F.when(F.lit(step == 0), F.col("high")).otherwise(F.element_at("steps", F.least(F.lit(max(step, 1)), F.size("steps"))) - 1)
            asked = active.groupBy("row").agg(F.collect_list(F.struct("req", low.alias("low"), high.alias("high"))).alias("requests"))  # at most as many as positives
            ready = anchors.join(asked.hint("shuffle_hash"), "row").repartitionByRange(max(1, left // (4 * ANCHORS)), "size", "home", "home_key").sortWithinPartitions("size", "home", "home_key")
            packed = written(ready.select("row", "label", "q", "size", "norm", "far", "requests").mapInArrow(_pack(self.space), _PACKED))
            hits = written(self._first(self._scan(packed, k, same), k))
            found = hits if found is None else found.unionByName(hits)
            counts = found.groupBy("row", "req").agg(F.count("*").alias("n"))
            step += 1
            more = active.join(counts, ["row", "req"], "left").where((F.size("steps") > step) & (F.coalesce("n", F.lit(0)) < k)).select(*active.columns)
            active = written(more)
            left = active.count()
        if found is None:
            return requests.select("row", "req", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("place")).where("false")
        return self._first(found, k)

    def _scan(self, packed: DataFrame, k: int, same: bool) -> DataFrame:
        lane = F.explode(F.sequence(F.lit(0), F.lit(self.lanes - 1)))
        wanted = packed.select("ablock", "pivots", "start", "stop").mapInArrow(_intervals, "ablock long, pivot int, start double, stop double").withColumn("lane", lane)
        keys = self.keys.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(self.lanes)).cast("int"))
        pairs = keys.join(wanted, ["pivot", "lane"]).where("hi >= start and lo <= stop").select("ablock", "block")
        mine = packed.select("ablock", *(F.col(c).alias(f"a_{c}") for c in ("size", "rows", "labels", "data", "whose", "req", "low", "high")))
        met = pairs.join(mine, "ablock").join(self.blocks.select("block", "size", "rows", "ids", "known", "labels", "width", "data").hint("merge"), "block")
        return met.drop("ablock", "block").mapInArrow(_scan(same, k), "row long, req long, score long, id long")

    @staticmethod
    def _first(hits: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("row", "req").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return hits.drop("place").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


Label = Callable[[Column, Column], Column]


def relabelled(vec_id: Column, label: Column) -> Column:
    """The query's labels: every seventh moves on by one."""
    return F.when(F.coalesce(vec_id % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)


def hard_negatives(embeddings: DataFrame, anchor_every: int = ANCHOR_EVERY, label: Label = relabelled, low: int = LOW_SHARE, high: int = HIGH_SHARE, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor and positive of ``embeddings`` (vec_id, label, embedding).

    A component x counts as floor(scale * x); a score is the inner product,
    higher first, ties by the smaller ``vec_id``, a null one last.  Anchors are
    rows whose ``vec_id`` is divisible by ``anchor_every``; positives the first
    other rows of their label; negatives the first rows of other labels whose
    score is ``low`` to ``high`` per cent of the positive's.  Rows without
    label or vector, or with a null or non-finite component, take no part, nor
    those whose squared norm is 2^61 or more.  Components that the shorter of
    two vectors lacks count as zero.  Every row counts for itself, so repeated
    rows are each other's positives, and a repeated anchor has its rows twice.
    Other columns are not read; an empty table gives an empty result.
    """
    vec_id, own = F.col("vec_id").cast("long"), F.col("label").cast("int")
    plain = embeddings.where(own.isNotNull() & finite(F.col("embedding"))).select(vec_id.alias("vec_id"), label(vec_id, own).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    quantised = plain.mapInArrow(_quantise(scale), "vec_id long, label int, q binary, size int, norm long")
    rows = written(quantised.select(F.monotonically_increasing_id().alias("row"), "*"))
    index = Index(rows)
    columns = "row long, vec_id long, label int, q binary, size int, norm long, home int, home_key double, far binary, steps array<long>"
    anchors = written(rows.where(F.col("vec_id") % anchor_every == 0).mapInArrow(_anchored(index.space), columns))
    wanted = anchors.select("row", F.lit(0).cast("long").alias("req"), F.lit(MOST).alias("high"), "steps")
    positives = written(index.search(anchors, wanted, POSITIVES, same=True).select("row", F.col("place").cast("long").alias("req"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))
    score = F.col("positive_score")
    whole = lambda share, up: F.floor((score * share + (99 if up else 0)) / F.lit(100).cast("decimal(38,0)")).cast("long")
    ranges = positives.select("row", "req", whole(F.lit(low).cast("decimal(38,0)"), True).alias("low"), whole(F.lit(high).cast("decimal(38,0)"), False).alias("high")).where("low <= high")
    asked = anchors.select("row", "q", "size", "label").join(ranges, "row").select("row", "req", "q", "size", "label", "low", "high")
    negatives = index.search(anchors, asked.mapInArrow(_ranged(index.space, NEGATIVES), "row long, req long, high long, steps array<long>"), NEGATIVES, same=False)
    return (
        negatives.join(positives, ["row", "req"])
        .join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


#: Over all rows of a table of this size SQL compares every anchor with every row.
ORACLE_SQL = f"""
with v as materialized (select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda e: floor({SCALE} * cast(e as double))) as q from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as materialized (select a.row, a.vec_id as anchor_id, a.label as own, b.row as other, b.vec_id, b.label, cast(list_dot_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id % {ANCHOR_EVERY} = 0 and a.row <> b.row),
p as materialized (select row, anchor_id, own, other, vec_id as positive_id, score as positive_score from s where label = own qualify row_number() over (partition by row order by score desc, vec_id) <= {POSITIVES})
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.row = p.row and s.label <> p.own and {LOW_SHARE} * p.positive_score <= 100 * s.score and 100 * s.score <= {HIGH_SHARE} * p.positive_score
window w as (partition by p.row, p.other order by s.score desc, s.vec_id) qualify row_number() over w <= {NEGATIVES}"""
