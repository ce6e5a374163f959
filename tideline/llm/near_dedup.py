"""MinHash near-duplicate groups, candidates verified by odd sketches.

Plan
----
1. One pass over the texts makes for each document the size and a 128-bit hash
   of its shingle set, band keys of its MinHash samples, and an odd sketch:
   the samples folded into a parity bitmap, so that the population count of
   the XOR of two bitmaps tells how many samples differ.
2. Documents with equal sets become one representative (combined before the
   shuffle), so groups of exact copies of any size cost nothing later.
3. Representatives that share a band key are a bucket.  Those of a bucket
   whose sketches are near are candidates; what returns is a spanning forest,
   never the pairs.
4. The trees are *families*.  Only for their members the full shingle sets are
   made, and all links inside a family are decided on full sets.
5. Components of the confirmed forest are the groups.

A large bucket or family is dealt to blocks by a hash of the member.  First
every member is compared with the group's leader, which visits all blocks.
Members linked to the leader are in one group already and need no comparison
with each other, so only the rest visit all blocks.  A group of alike members
costs its size; only members unlike the leader cost their number times it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.sources.components import connected_components

from . import vec
from .store import written

#: MinHash rows a band has.
ROWS = 5
#: Chance to miss a pair that is exactly as similar as the threshold.
MISS = 1e-6
#: Bits of an odd sketch.
BITS = 256
#: Members of a block of a bucket, and of a family, on average.
BLOCK = 512
FAMILY_BLOCK = 128

#: Visitors compared at once, which bounds a worker's memory.
VISITORS = 64

#: Pairs of near ones: positions in the first list and in the second, or both in the first where there is no second.
Compare = Callable[[list[np.ndarray], list[np.ndarray] | None], tuple[np.ndarray, np.ndarray]]

_RANDOM = np.random.Generator(np.random.PCG64(77_003)).integers(1, 1 << 63, (2, 1024), dtype=np.uint64) | vec.U64(1)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(threshold, 0.999) ** rows)))


def sketch_limit(threshold: float, samples: int, bits: int = BITS) -> int:
    """Largest XOR count that a pair of at least this similarity shows, but for five standard deviations."""
    differ = samples * (1 - threshold)
    high = differ + 5 * math.sqrt(samples * threshold * (1 - threshold))
    mean = bits / 2 * (1 - math.exp(-4 * high / bits))
    return math.ceil(mean + 1.5 * math.sqrt(mean))


def estimate(differing_bits: np.ndarray, samples: int, bits: int = BITS) -> np.ndarray:
    """Similarity that a XOR count stands for."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * differing_bits / bits, 1e-9))


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each row, and how many each row has.

    ``A-Z`` are lower-cased; a text with fewer than ``k`` words has its whole
    sequence as one shingle, one without words none.
    """
    n = len(off) - 1
    low = vec.LOWER[buf]
    w = vec.words(low, off)
    h = vec.Hasher(low).of(w.start, w.end)
    g, at = vec.ngrams(h, w.row, k)
    row = w.row[at]
    count = w.per_row(n)
    for size in range(1, k):
        few = np.flatnonzero(count == size)
        if len(few):
            pick = np.isin(w.row, few)
            g1, at1 = vec.ngrams(h[pick], w.row[pick], size)
            g = np.concatenate([g, vec.mix(g1 + vec.U64(size))])
            row = np.concatenate([row, w.row[pick][at1]])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[new], row[new]
    return g, np.bincount(row, minlength=n)


def set_hashes(g: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set, from sums over its shingles."""
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    m = vec.mix(g)
    total = np.zeros(len(g) + 1, np.uint64)
    out = np.zeros((2, len(count)), np.uint64)
    for x in range(2):
        np.cumsum(m if x == 0 else vec.mix(m + vec.U64(11)), out=total[1:])
        out[x] = total[first[1:]] - total[first[:-1]]
    return out


def signatures(g: np.ndarray, count: np.ndarray, samples: int) -> np.ndarray:
    """MinHash values, one row for each sample, of the rows with a shingle."""
    first = np.zeros(len(count), np.int64)
    np.cumsum(count[:-1], out=first[1:])
    first = first[count > 0]
    out = np.empty((samples, len(first)), np.uint64)
    if len(first):
        for i in range(samples):
            out[i] = np.minimum.reduceat((g ^ _RANDOM[0, i]) * _RANDOM[1, i], first)
    return out


def odd_sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps, ``bits / 64`` words for each document, of its (sample number, value) pairs."""
    k, n = samples.shape
    out = np.zeros((n, bits // 64), np.uint64)
    at = np.arange(n)
    for i in range(k):
        bit = (vec.mix(samples[i] + vec.U64(i * 2 + 1)) % vec.U64(bits)).astype(np.int64)
        out[at, bit >> 6] ^= vec.U64(1) << (bit & 63).astype(np.uint64)
    return out


def _sign(k: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = vec.column(batch.column(1))
            for i, j in vec.chunks(off):
                o = off[i : j + 1] - off[i]
                g, count = shingle_sets(buf[off[i] : off[j]], o, k)
                has = np.flatnonzero(count > 0)
                hashes = set_hashes(g, count)
                sig = signatures(g, count, bands * rows)
                keys = np.zeros((len(has), bands), np.uint64)
                for b in range(bands):
                    key = np.full(len(has), b + 1, np.uint64)
                    for r in range(rows):
                        key = vec.mix(key * vec.U64(3) + sig[b * rows + r])
                    keys[:, b] = key
                sketch = odd_sketches(sig)
                ends = np.zeros(len(count) + 1, np.int32)
                np.cumsum((count > 0) * bands, out=ends[1:])
                size = BITS // 8
                at = np.zeros(len(count) + 1, np.int32)
                np.cumsum((count > 0) * size, out=at[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(count.astype(np.int64)),
                        pa.array(vec.signed(hashes[0])),
                        pa.array(vec.signed(hashes[1])),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(vec.signed(keys.ravel()))),
                        pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(sketch.tobytes())]),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"],
                )

    return run


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by its first ``keys`` columns, batches that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [np.asarray(batch.column(c)) for c in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        if held and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in range(keys)):
            if len(cuts) == 0:
                held.append(batch)
                continue
            first = int(cuts[0])
            yield pa.Table.from_batches([*held, batch.slice(0, first)]).combine_chunks().to_batches()[0]
            batch, cuts = batch.slice(first), cuts[1:] - first
        elif held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = []
        if len(cuts):
            yield batch.slice(0, int(cuts[-1]))
            batch = batch.slice(int(cuts[-1]))
        held = [batch]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bounds(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal rows."""
    n = len(columns[0])
    change = np.ones(n, bool)
    change[1:] = False
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(change)
    return start, np.append(start[1:], n)


class _Forest:
    """Union-find over any integers that tells whether an edge joins two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _near_sketches(limit: int) -> Compare:
    def run(first: list[np.ndarray], second: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        a = np.stack(first)
        b = a if second is None else np.stack(second)
        left, right = [], []
        for i in range(len(a)):
            low = i + 1 if second is None else 0
            near = np.flatnonzero(np.bitwise_count(b[low:] ^ a[i]).sum(axis=1) <= limit) + low
            left.append(np.full(len(near), i))
            right.append(near)
        return np.concatenate(left), np.concatenate(right)

    return run


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Full sets of texts, of those whose set is the one that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = vec.column(batch.column(0))
            want = np.stack([np.asarray(batch.column(c)) for c in (1, 2)])
            for i, j in vec.chunks(off):
                g, count = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                right = (vec.signed(set_hashes(g, count)) == want[:, i:j]).all(axis=0)
                at = np.zeros(j - i + 1, np.int32)
                np.cumsum(count * 8, out=at[1:])
                sets = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(g.tobytes())])
                columns = [*(batch.column(c).slice(i, j - i) for c in range(3, 7)), sets]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "n", "lead", "id", "known"]).filter(pa.array(right))

    return run


def common(sets: list[np.ndarray], split: int | None) -> np.ndarray:
    """Sizes of intersections: of all pairs of the sets, or of those before ``split`` with those after."""
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seen = np.bincount(where, minlength=len(every))
    keep = seen[where] > 1  # what one set has alone is in no intersection
    compact = np.cumsum(seen > 1) - 1
    row, where = row[keep], compact[where[keep]]
    size = int(compact[-1]) + 1 if len(compact) else 0
    first = len(sets) if split is None else split
    out = np.zeros((first, len(sets) - (split or 0)), np.int64)
    step = max(1, (1 << 23) // max(1, len(sets)))
    for low in range(0, size, step):
        part = (where >= low) & (where < low + step)
        m = np.zeros((len(sets), min(step, size - low)), np.float32)
        m[row[part], where[part] - low] = 1
        out += (m[:first] @ m[split or 0 :].T).astype(np.int64)
    return out


def _near_sets(part: int, whole: int) -> Compare:
    def run(first: list[np.ndarray], second: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        sets = first + (second or [])
        inter = common(sets, None if second is None else len(first))
        size = np.array([len(x) for x in sets], np.int64)
        union = size[: len(first)][:, None] + size[len(first) if second is not None else 0 :][None, :] - inter
        linked = (whole * inter >= part * union) & (union > 0)
        return np.nonzero(np.triu(linked, 1) if second is None else linked)

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int, bool], np.ndarray, list[np.ndarray]]]:
    """Of rows sorted by group, block and role: (group, block, role, one block), members and what is known of them."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        group, block, role, single, ids = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(5))
        buf, off, _ = vec.column(batch.column(5))
        start, end = _bounds(group, block, role)
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            key = (int(group[s]), int(block[s]), int(role[s]), bool(single[s]))
            yield key, ids[s:e], [np.frombuffer(buf[off[x] : off[x + 1]].tobytes(), np.uint64) for x in range(s, e)]


def _compare(near: Compare, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of residents with each other (of a group of one block) or with their visitors, who come after them.

    With ``every`` all links with visitors are told; else, as of residents, a spanning forest of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()  # over the whole partition: a forest has fewer edges than members
        at: tuple[int, int, bool] | None = None
        home: np.ndarray = np.zeros(0, np.int64)
        known: list[np.ndarray] = []

        def found(group: int, a: np.ndarray, b: np.ndarray, told: bool) -> Iterator[pa.RecordBatch]:
            keep = [x != y and (forest.join(x, y) or told) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            if any(keep):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(keep), group)), pa.array(a[keep]), pa.array(b[keep])], names=["group", "a", "b"])

        def finish() -> Iterator[pa.RecordBatch]:
            if at is not None and at[2] and len(known) > 1:
                i, j = near(known, None)
                yield from found(at[0], home[i], home[j], False)

        for (group, block, role, single), ids, values in _segments(batches):
            if at != (group, block, single):
                yield from finish()
                at, home, known = (group, block, single), ids[:0], []
            if role == 0:
                home, known = np.concatenate([home, ids]), known + values
            elif known:
                for low in range(0, len(values), VISITORS):
                    i, j = near(values[low : low + VISITORS], known)
                    yield from found(group, ids[low:][i], home[j], every)
        yield from finish()

    return run


_ROW = ["group", "block", "role", "single", "id", "known"]
_EDGE = "group long, a long, b long"


def links(members: DataFrame, block: int, near: Compare) -> DataFrame:
    """Edges ``a, b`` whose components are those of all links inside the groups.

    ``members`` is ``group, n`` (its size), ``lead`` (its least id), ``id`` and
    ``known`` (what ``near`` compares), kept by the caller.
    """

    def compared(rows: DataFrame, every: bool) -> DataFrame:
        dealt = rows.select(*_ROW).repartition("group", "block").sortWithinPartitions("group", "block", "role")
        return written(dealt.mapInArrow(_compare(near, every), _EDGE))

    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks).cast("int"), "role": F.lit(0), "single": blocks == 1})
    large = placed.where(~F.col("single"))
    everywhere = lambda df: df.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "role": F.lit(1)})
    edges = compared(placed.unionByName(everywhere(large.where("id = lead"))), True)
    beside = edges.select("group", F.col("b").alias("id"))  # in groups of several blocks a is the leader
    rest = large.where("id <> lead").join(beside, ["group", "id"], "left_anti")
    return edges.unionByName(compared(large.unionByName(everywhere(rest)), False)).select("a", "b").distinct()


def _same_document(some: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges between the representatives of the texts that stand under one ``doc_id``."""
    text = F.struct("n_shingles", "h1", "h2")
    several = some.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("doc_id")
    own = written(some.join(several, "doc_id").select("doc_id", "n_shingles", "h1", "h2").distinct().join(reps, ["n_shingles", "h1", "h2"]).select("doc_id", "id"))
    return own.join(own.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b").where("a <> b")


def near_duplicates(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """Groups of documents whose sets of ``k``-word shingles are similar.

    ``docs`` has ``doc_id`` and ``text``; other columns play no part.  Two
    documents are linked where ``whole * intersection >= part * union`` of
    their sets (``A-Z`` lower-cased, words ``[^\\x20\\x09-\\x0D]+``; a shorter
    text is one shingle).  Returns for every row ``doc_id``, ``n_shingles``,
    ``component_id`` (smallest ``doc_id`` reachable) and ``kept``
    (``doc_id = component_id``).

    Nulls: a null text is an empty one and linked with nothing, as is a text
    without words; a row whose ``doc_id`` is null is returned with itself as
    (null) component, is kept, and links nothing.  Repeated rows keep one
    result each; a ``doc_id`` with several texts is one document that any of
    them links; an empty table gives an empty result.
    """
    threshold = part / whole
    bands = bands_for(threshold)
    signed = written(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _sign(k, bands, ROWS), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"
        )
    )
    some = signed.where("n_shingles > 0 and doc_id is not null")
    reps = written(
        some.groupBy("n_shingles", "h1", "h2")
        .agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    keys = reps.select(F.explode("bands").alias("group"), "id")
    sizes = keys.groupBy("group").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1")
    members = written(keys.join(sizes, "group").join(reps.select("id", F.col("sketch").alias("known")), "id"))
    families = connected_components(links(members, BLOCK, _near_sketches(sketch_limit(threshold, bands * ROWS))))

    family_sizes = families.groupBy("component").agg(F.count("*").alias("n"))
    placed = families.join(family_sizes, "component").select(F.col("component").alias("group"), "n", F.col("component").alias("lead"), F.col("node").alias("id"))
    asked = placed.join(reps.select("id", "doc", "h1", "h2"), "id")
    sets = (
        docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
        .join(asked.hint("shuffle_hash"), "doc")
        .select("text", "h1", "h2", "group", "n", "lead", "id")
        .mapInArrow(_sets(k), "group long, n long, lead long, id long, known binary")
        .dropDuplicates(["id"])  # of repeated rows one
    )
    edges = links(written(sets), FAMILY_BLOCK, _near_sets(part, whole)).unionByName(_same_document(some, reps))
    groups = written(connected_components(edges))
    first = groups.join(reps.select(F.col("id").alias("node"), "doc"), "node").groupBy("component").agg(F.min("doc").alias("component_id"))
    found = (
        reps.select("n_shingles", "h1", "h2", "id", "doc")
        .join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
        .join(first, "component", "left")
        .select("n_shingles", "h1", "h2", F.coalesce("component_id", "doc").alias("component_id"))
    )
    with_set = some.select("doc_id", "n_shingles", "h1", "h2").join(found, ["n_shingles", "h1", "h2"])
    without = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        with_set.select("doc_id", "n_shingles", "component_id")
        .unionByName(without)
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_first(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The rows of ``docs``, with all columns, whose document is the first of its group.

    Rows without ``doc_id`` stay; rows of one ``doc_id`` stay or go together.
    An empty table gives an empty result.
    """
    kept = near_duplicates(docs, k, part, whole).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.where("doc_id is not null").join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("__kept_id"), "left_semi").unionByName(docs.where("doc_id is null"))
