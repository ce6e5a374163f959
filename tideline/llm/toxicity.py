"""Toxicity from confirmed toxic examples and unlabelled text.

A linear model over hashed byte n-grams is trained with the non-negative
positive-unlabelled risk: the share of toxic text among the unlabelled is
taken out of the negative part of the risk by the class prior, and where that
part turns negative for a batch its gradient is reversed.  The class prior and
the score of 0.5 are estimated from toxic and unlabelled texts too; no text
labelled clean is used.  The gradient steps take a bounded sample
(``POSITIVES`` and ``UNLABELLED`` documents), n-gram counts all documents
outside the held-out fold, and scoring takes every whole text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .store import shuffle_partitions, written

#: Byte lengths of the n-grams, over lower-cased text with one space for each gap.
LENGTHS = (6, 7, 8, 9, 10)
#: Buckets of the n-gram hash.
BUCKETS = 1 << 22
_SHIFT = np.uint64(64 - 22)
#: Bytes of text that are taken at once, which bounds a worker's memory.
_CHUNK = 1 << 17
#: Bounds of the training sample, in documents.
POSITIVES = 3000
UNLABELLED = 9000
#: Most buckets the model weighs, and how much commoner and in how many toxic texts each must be.
FEATURES = 1500
#: Buckets drawn by the sample for each one that is chosen by the counts over all texts.
DRAWN = 4
LIFT = 2.0
LEAST, LEAST_SHARE = 4, 0.004
#: A bucket's value in a text is the logarithm of one more than its count, up to this count.
MOST_COUNT = 15
#: Folds of crc32(doc_id); the first is held out.
FOLDS = 5
SAMPLE_PARTITIONS = 8
#: Slices in which counts are summed up.
SLICES = 64
#: Class prior of the first training; the next ones estimate it.
FIRST_PRIOR = 0.2


@dataclass
class Model:
    buckets: np.ndarray  # the chosen ones, ascending
    weight: np.ndarray  # of each
    bias: float
    scale: float  # calibration: the score is sigmoid(scale * raw + shift)
    shift: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _grams(buf: np.ndarray, off: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket * 16 + capped count) pairs, by row; with ``chosen``, of those buckets only."""
    n = len(off) - 1
    low = vec.LOWER[buf]
    space = (low < 0x80) & ~(((low >= 0x61) & (low <= 0x7A)) | ((low >= 0x30) & (low <= 0x39)))
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[off[:-1][off[:-1] < len(low)]] = True
    at = np.flatnonzero(keep)
    row = np.searchsorted(off, at, "right") - 1
    text = np.where(space[at], np.uint8(0x20), low[at])
    # a space before and after every text, so that its first word looks like any other
    starts = np.searchsorted(row, np.arange(n))
    ends = np.searchsorted(row, np.arange(n), "right")
    text = np.insert(text, np.concatenate([starts, ends]), 0x20)
    row = np.insert(row, np.concatenate([starts, ends]), np.concatenate([np.arange(n), np.arange(n)]))
    order = np.argsort(row, kind="stable")
    text, row = text[order], row[order]
    base = vec.SYMBOL[text]
    rows, buckets = [], []
    h = base
    for length in range(2, max(LENGTHS) + 1):
        m = len(text) - length + 1
        if m <= 0:
            break
        h = h[:m] * vec.U64(0x9E3779B97F4A7C15)
        h += base[length - 1 :]
        if length not in LENGTHS:
            continue
        bucket = (vec.mix(h + vec.U64(length)) >> _SHIFT).astype(np.int32)
        ok = row[:m] == row[length - 1 :]
        if chosen is not None:
            ok &= chosen[bucket]
        at = np.flatnonzero(ok)
        rows.append(row[at])
        buckets.append(bucket[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate(rows) * BUCKETS
    key += np.concatenate(buckets)
    del rows, buckets, h
    pair, count = np.unique(key, return_counts=True)
    return pair // BUCKETS, pair % BUCKETS * (MOST_COUNT + 1) + np.minimum(count, MOST_COUNT)


def _sliced(total: np.ndarray) -> pa.RecordBatch:
    """Counts cut into slices of equal length, so that each can be summed up in a task of its own."""
    parts = np.concatenate([total, np.zeros(-len(total) % SLICES, total.dtype)]).reshape(SLICES, -1)
    some = np.flatnonzero(parts.any(axis=1))
    data = [pa.compress(parts[k].astype(np.int64).tobytes(), codec="zstd", asbytes=True) for k in some.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], names=["slice", "counts"])


def _frequencies(among: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In how many texts of the partition each bucket is, of all or of those ``among``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS if among is None else len(among), np.int32)
        wanted = None
        if among is not None:
            wanted = np.zeros(BUCKETS, bool)
            wanted[among] = True
        for batch in batches:
            buf, off, _ = vec.column(batch.column(0))
            for i, j in vec.chunks(off, _CHUNK):
                bucket = _grams(buf[off[i] : off[j]], off[i : j + 1] - off[i], wanted)[1] // (MOST_COUNT + 1)
                np.add.at(total, bucket if among is None else np.searchsorted(among, bucket), 1)
        yield _sliced(total)

    return run


def _sum_slices(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    length = -(-size // SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(pa.decompress(data, 8 * length, codec="zstd", asbytes=True), np.int64)
                total[k] = total[k] + part if k in total else part
        for k, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["slice", "counts"])

    return run


def text_counts(texts: DataFrame, among: np.ndarray | None = None) -> np.ndarray:
    """In how many texts of ``texts`` (its first column) each bucket is: as many numbers at any size of the input."""
    size = BUCKETS if among is None else len(among)
    out = np.zeros((SLICES, -(-size // SLICES)), np.int64)
    parts = texts.mapInArrow(_frequencies(among), "slice int, counts binary")
    for k, data in parts.repartition(min(SLICES, shuffle_partitions(texts.sparkSession)), "slice").mapInArrow(_sum_slices(size), "slice int, counts binary").collect():
        out[k] = np.frombuffer(pa.decompress(data, 8 * out.shape[1], codec="zstd", asbytes=True), np.int64)
    return out.ravel()[:size]


def _features(chosen: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(BUCKETS, bool)
        wanted[chosen] = True
        for batch in batches:
            buf, off, _ = vec.column(batch.column(0))
            for i, j in vec.chunks(off, _CHUNK):
                row, coded = _grams(buf[off[i] : off[j]], off[i : j + 1] - off[i], wanted)
                at = np.zeros(j - i + 1, np.int32)
                np.cumsum(np.bincount(row, minlength=j - i) * 4, out=at[1:])
                data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(coded.astype(np.int32).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), data], names=["kind", "features"])

    return run


def _value(coded: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + coded % (MOST_COUNT + 1))


def _sparse(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, feature numbers and values; the rows hold chosen buckets only."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    coded = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return row, np.searchsorted(chosen, coded // (MOST_COUNT + 1)), _value(coded)


def choose(toxic: DataFrame, n_p: int, others: DataFrame, n_o: int, every: DataFrame, n_u: int, features: int = FEATURES) -> np.ndarray:
    """The buckets in toxic texts ``LIFT`` times as often as in unlabelled ones, those of the highest likelihood ratio.

    ``toxic`` and ``others`` are the texts of the sample, ``every`` all texts
    that may be read in training.  ``DRAWN`` times as many buckets as wanted
    are drawn by the sample, so that the pass over all texts counts few; its
    counts decide.
    """
    none = np.zeros(0, np.int64)
    if not n_p or not n_o:
        return none

    def best(p: np.ndarray, u: np.ndarray, n: int, lift: float, most: int) -> np.ndarray:
        keep = np.flatnonzero(p / n_p >= lift * u / n)
        p, u = p[keep].astype(float), u[keep].astype(float)
        share = (p + u) / (n_p + n)
        gain = p * np.log(p / (n_p * share)) + np.where(u > 0, u * np.log(np.maximum(u, 1) / (n * share)), 0)
        return np.sort(keep[np.argsort(-gain, kind="stable")[:most]])

    p = text_counts(toxic)
    among = np.flatnonzero(p >= max(LEAST, math.ceil(LEAST_SHARE * n_p)))
    if len(among):
        among = among[best(p[among], text_counts(others, among), n_o, LIFT * 0.75, DRAWN * features)]
    if not len(among):
        return none
    return among[best(p[among], text_counts(every, among), n_u, LIFT, features)].astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, chosen: np.ndarray, *, epochs: int = 30, batch: int = 512, rate: float = 0.02, decay: float = 1e-4, beta: float = 0.0, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights of the chosen buckets and bias that minimise the non-negative risk with the sigmoid loss."""
    if not len(chosen) or not positive or not unlabelled:
        return np.zeros(len(chosen)), -1.0
    data = []
    for rows in (positive, unlabelled):
        row, feature, value = _sparse(rows, chosen)
        data.append((np.searchsorted(row, np.arange(len(rows) + 1)), feature, value))
    w, b = np.zeros(len(chosen)), -1.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    rng = np.random.Generator(np.random.PCG64(seed))
    step = 0
    rounds = max(1, -(-len(unlabelled) // batch))

    def forward(which: int, pick: np.ndarray) -> tuple[np.ndarray, ...]:
        bounds, feature, value = data[which]
        size = bounds[pick + 1] - bounds[pick]
        flat = np.repeat(bounds[pick], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row = np.repeat(np.arange(len(pick)), size)
        f, x = feature[flat], value[flat]
        return np.bincount(row, w[f] * x, len(pick)) + b, row, f, x

    for _ in range(epochs):
        order_p, order_u = (rng.permutation(len(x)) for x in (positive, unlabelled))
        for k in range(rounds):
            step += 1
            pick_p = order_p[np.arange(k * batch, k * batch + batch) % len(order_p)][: max(1, min(batch, len(order_p)))]
            pick_u = order_u[k * batch : (k + 1) * batch]
            g_p, row_p, f_p, x_p = forward(0, pick_p)
            g_u, row_u, f_u, x_u = forward(1, pick_u)
            s_p, s_u = _sigmoid(g_p), _sigmoid(g_u)
            # loss of "positive" is 1 - s, of "negative" is s
            negative = s_u.mean() - prior * s_p.mean()
            d_p, d_u = s_p * (1 - s_p) / len(s_p), s_u * (1 - s_u) / len(s_u)
            if negative >= -beta:
                grad_p, grad_u = -2 * prior * d_p, d_u
            else:
                grad_p, grad_u = prior * d_p, -d_u
            grad = np.zeros(len(chosen) + 1)
            grad[:-1] = np.bincount(f_p, grad_p[row_p] * x_p, len(chosen)) + np.bincount(f_u, grad_u[row_u] * x_u, len(chosen)) + decay * w
            grad[-1] = grad_p.sum() + grad_u.sum()
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w = np.maximum(w - move[:-1], 0)  # all chosen buckets speak for toxicity
            b -= move[-1]
    return w, float(b)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.5) -> float:
    """Share of toxic texts among the unlabelled: the least ratio of the shares beyond a raw score, of scores that ``least`` of the toxic texts reach."""
    if not len(positive) or not len(unlabelled):
        return 0.1
    at = np.unique(positive[positive <= np.quantile(positive, 1 - least)])
    p = 1 - np.searchsorted(np.sort(positive), at, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at, "left") / len(unlabelled)
    return float(np.clip((u / p).min(initial=1.0), 0.005, 0.9))


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of the score: 0.5 lies in the middle of the widest gap where the estimated error is least.

    The error is that of the positive-unlabelled risk: missed toxic texts by
    the class prior, and unlabelled ones beyond the score, less those that the
    prior explains, but not below zero.  The scale puts the middle of either
    side at least two logits from 0.5.
    """
    if not len(positive) or not len(unlabelled):
        return 1.0, 0.0
    x = np.sort(np.concatenate([positive, unlabelled]))
    edges = np.unique(x)
    bounded = np.concatenate([[edges[0] - 1.0], edges, [edges[-1] + 1.0]])
    # texts at or beyond each edge
    p = 1 - np.searchsorted(np.sort(positive), np.append(edges, np.inf), "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), np.append(edges, np.inf), "left") / len(unlabelled)
    error = prior * (1 - p) + np.maximum(0, u - prior * p)
    best = np.flatnonzero(error <= error.min() + prior * 0.01)
    k = best[np.argmax(bounded[best + 1] - bounded[best])]
    at = (bounded[k] + bounded[k + 1]) / 2
    below = unlabelled[unlabelled < at]
    reach = max(min(np.median(positive) - at, at - np.median(below) if len(below) else np.inf), 1e-3)
    return float(2 / reach), float(-2 / reach * at)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train on at most ``positives`` confirmed toxic and ``unlabelled`` other documents.

    Of the labels only the toxic ones outside the held-out fold are read.
    Which documents are taken depends on a hash of ``doc_id`` alone; a
    ``doc_id`` is taken once, with the least of its texts, however often it
    stands in ``docs``.  N-grams are chosen by counts over all documents
    outside the held-out fold.
    """
    order = F.xxhash64("doc_id")
    readable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), "text")
    toxic = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    taken = toxic.select(F.col("doc_id").cast("long")).distinct().orderBy(order).limit(positives).select("doc_id", F.lit(1).alias("kind"))
    others = readable.select("doc_id").distinct().orderBy(order).limit(unlabelled).select("doc_id", F.lit(0).alias("kind"))
    # positives + unlabelled rows at most, so the broadcast is bounded
    sample = F.broadcast(taken.unionByName(others))
    texts = written(readable.join(sample, "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text")).select("text", "kind").repartition(SAMPLE_PARTITIONS))
    size = {r[0]: r[1] for r in texts.groupBy("kind").count().collect()}
    chosen = choose(texts.where("kind = 1").select("text"), size.get(1, 0), texts.where("kind = 0").select("text"), size.get(0, 0), readable.select("text"), readable.count())
    by_kind: dict[int, list[np.ndarray]] = {0: [], 1: []}
    # of each text at most its chosen buckets, so what comes here is bounded too
    rows = texts.mapInArrow(_features(chosen), "kind int, features binary").collect()
    for kind, data in sorted(rows, key=lambda r: (r[0], bytes(r[1]))):
        by_kind[kind].append(np.frombuffer(data, np.int32).astype(np.int64))
    # a quarter of either side is left out of a first training: the class prior and 0.5 come from what was not learnt
    apart = {k: x[::4] for k, x in by_kind.items()}
    kept = {k: [x for i, x in enumerate(v) if i % 4] for k, v in by_kind.items()}

    def raw_of(weight: np.ndarray, bias: float, k: int) -> np.ndarray:
        return np.array([raw_score(chosen, weight, x) + bias for x in apart[k]])

    prior = FIRST_PRIOR
    for _ in range(2):
        weight, bias = train_nnpu(kept[1], kept[0], prior, chosen)
        raw_p, raw_u = raw_of(weight, bias, 1), raw_of(weight, bias, 0)
        prior = class_prior(raw_p, raw_u)
    scale, shift = calibrate(raw_p, raw_u, prior)
    weight, bias = train_nnpu(by_kind[1], by_kind[0], prior, chosen)
    return Model(chosen, weight, bias, scale, shift)


def raw_score(chosen: np.ndarray, weight: np.ndarray, coded: np.ndarray) -> float:
    return float((weight[np.searchsorted(chosen, coded // (MOST_COUNT + 1))] * _value(coded)).sum())


def scorer(model: Model) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the score of each text of a buffer with offsets."""
    some = model.buckets[model.weight > 0]
    values = model.weight[model.weight > 0]
    table: list[np.ndarray] = []

    def run(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not table:
            table.append(np.zeros(BUCKETS, bool))
            table[0][some] = True
        row, coded = _grams(buf, off, table[0])
        raw = np.bincount(row, values[np.searchsorted(some, coded // (MOST_COUNT + 1))] * _value(coded), len(off) - 1) + model.bias
        return _sigmoid(model.scale * raw + model.shift)

    return run


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    scores = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = vec.column(batch.column(1))
            for i, j in vec.chunks(off, _CHUNK):
                score = scores(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                ids = [(str(x).encode() if x is not None else None) for x in batch.column(0).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([x is not None and zlib.crc32(x) % FOLDS == 0 for x in ids], pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score of every whole text of ``docs`` (``doc_id``, ``text``; others play no part).

    A null text scores as an empty one; a null ``doc_id`` is never held out;
    repeated rows are scored each; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` outside the held-out fold, score all of ``docs``."""
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that are not predicted toxic."""
    scores = scorer(fit(docs, labels))
    return vec.keep_rows(docs, lambda buf, off: scores(buf, off) < 0.5)
