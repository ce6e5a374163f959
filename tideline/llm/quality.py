"""Quality rules: fixed counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams are counted, one over every
document (raw) and one over the documents labelled good (trusted target).  A
document's verdict is the mean log ratio of its n-grams against a fixed
threshold; nothing is sampled, and the same text gets the same verdict
wherever it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

#: Buckets of the n-gram hash.
BUCKETS = 1 << 16
#: Longest n-gram.
MAX_N = 2
#: Added to each bucket's count, as a share of the mean count.
SMOOTHING = 0.05
#: Documents whose mean log ratio is below are rejected.
THRESHOLD = -0.3

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: 0 white space, 1 letters, digits and all beyond ASCII, 2 other ASCII.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[0x80:] = 1
_CLASS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")] = 1
_CLASS[vec.IS_SPACE] = 0

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts named in ``BASE`` for each text."""
    n = len(off) - 1
    w = vec.words(buf, off)
    points = vec.code_points(buf)
    hasher = vec.Hasher(buf)
    h = hasher.of(w.start, w.end)
    out = {"n_words": w.per_row(n)}
    out["word_chars"] = np.bincount(w.row, points[w.end] - points[w.start], n).astype(np.int64)
    symbols = np.flatnonzero(_SYMBOLS[buf])
    out["n_symbols"] = np.bincount(np.searchsorted(off, symbols, "right") - 1, minlength=n)

    line = vec.lines(buf, off)
    filled = np.zeros(len(buf) + 1, np.int64)
    filled[1:] = np.cumsum(~vec.IS_SPACE[buf])
    has_word = filled[line.end] > filled[line.start]
    start, end, row = line.start[has_word], line.end[has_word], line.row[has_word]
    key = hasher.of(start, end)
    order = np.lexsort((key, row))
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][1:][same], minlength=n)

    g, at = vec.ngrams(h, w.row, 3)
    key = vec.mix(g + vec.mix(w.row[at].astype(np.uint64) + vec.U64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h) + 2, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(w.row[covered[: len(h)]], minlength=n)
    return out


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def hashed_ngrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- to ``MAX_N``-grams of lower-cased tokens, and the rows they are in.

    Tokens are runs of letters and digits, and runs of other signs.
    """
    low = vec.LOWER[buf]
    kind = _CLASS[low]
    if len(kind) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(kind) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[off[:-1]] = True
    edge = np.flatnonzero(new)
    start, end = edge[:-1], edge[1:]
    token = kind[start] > 0
    start, end = start[token], end[token]
    row = np.searchsorted(off, start, "right") - 1
    h = vec.Hasher(low).of(start, end)
    grams, rows = [h], [row]
    for n in range(2, MAX_N + 1):
        g, at = vec.ngrams(h, row, n)
        grams.append(g)
        rows.append(row[at])
    return (np.concatenate(grams) % vec.U64(BUCKETS)).astype(np.int64), np.concatenate(rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        buf, off, _ = vec.column(batch.column(0))
        for i, j in vec.chunks(off):
            bucket, _ = hashed_ngrams(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            total += np.bincount(bucket, minlength=BUCKETS)
    some = np.flatnonzero(total)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def ngram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all texts by bucket: ``BUCKETS`` numbers, whatever the size of the input."""
    out = np.zeros(BUCKETS, np.int64)
    rows = texts.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    for bucket, n in rows:
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target over raw probability for each bucket; zero without a target."""
    if target.sum() == 0 or raw.sum() == 0:
        return np.zeros(len(raw))
    raw_p = raw / raw.sum()
    target_p = target / target.sum()
    floor = smoothing / len(raw)
    return np.log((target_p + floor) / (raw_p + floor))


def mean_log_ratio(buf: np.ndarray, off: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean weight of each text's n-grams; 0 for a text without any."""
    n = len(off) - 1
    bucket, row = hashed_ngrams(buf, off)
    return np.bincount(row, weight[bucket], n) / np.maximum(np.bincount(row, minlength=n), 1)


def _score(weight: np.ndarray, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = vec.column(batch.column(1))
            for i, j in vec.chunks(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                base = base_counts(part, o)
                score = mean_log_ratio(part, o, weight)
                failed = base_failed(base)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(base[c].astype(np.int64)) for c in BASE), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                    names=["doc_id", *BASE, "base_failed", "kept", "score"],
                )

    return run


def quality_weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of each bucket, from all of ``docs`` and those with ``quality`` 1 in ``labels``."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    trusted = docs.select("doc_id", "text").join(good.hint("shuffle_hash"), F.col("doc_id") == F.col("good_id"), "left_semi")
    return log_ratio(ngram_counts(trusted), ngram_counts(docs))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, verdict and score of every row of ``docs`` (``doc_id``, ``text``; others play no part).

    Nulls: a null text is an empty one (``n_words`` 0, so ``base_failed``); a
    null ``doc_id`` is judged but never trusted; labels with null columns
    count for nothing.  Without a trusted document every ratio is 0 and only
    the base rules decide.  Repeated rows are judged each.
    """
    weight = quality_weights(docs, labels)
    return docs.select("doc_id", "text").mapInArrow(
        _score(weight, threshold), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, that :func:`judge` keeps."""
    weight = quality_weights(docs, labels)
    return vec.keep_rows(docs, lambda buf, off: ~base_failed(base_counts(buf, off)) & (mean_log_ratio(buf, off, weight) >= threshold))
