"""Secret scan: fixed patterns, and a character convolutional network on all candidates.

Candidates are the finds of the fixed patterns and every run of at least
``CANDIDATE_LEAST`` secret characters that they don't cover wholly.  A small
convolutional network in numpy reads each candidate with its context on both
sides; a long candidate is read whole, in overlapping windows, and counts as
its likeliest one.  The network is trained on labelled findings: windows made by
rule from a seed (public shapes of credentials, and the look-alikes that
scanners stumble over), and all distinct windows of the scanned texts (finds
of the patterns, and runs they don't touch).  Three quarters of these, dealt
to shards by their hash, are learnt by a copy of the network a shard, and the
copies are averaged; the others are counted by score, all of them, for the
threshold, the highest that keeps the wanted recall.  Finds of the patterns stay whatever the network says; the network adds
other candidates as kind ``model``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .store import written as stored

# Fixed patterns of the contract, on bytes: ASCII letters only are folded.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Least bytes of a candidate.
CANDIDATE_LEAST = 12
#: Bytes of a candidate, and of the context on either side, that the network reads at once, and how far windows of a long candidate are apart.
BODY, SIDE, STEP = 48, 24, 24
#: Windows of either label that :func:`table_findings` shows; the network is trained on all.
MOST_LABELLED = 2000
#: Windows that a shard learns, on average, passes over the shards, and Adam's rate there.
SHARD_WINDOWS, PASSES, SHARD_RATE = 1 << 15, 6, 0.01
#: Parts of one that averaged weights are rounded to, so that the order of summing does not matter, and that scores are counted by.
WEIGHT_STEPS, SCORE_STEPS = 1 << 24, 64
WIDTH = BODY + 2 * SIDE
#: Share of labelled secrets that the threshold must keep.
RECALL = 0.98

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def _alphabet() -> np.ndarray:
    """Class of each byte for the network: single letters and signs, digits together by half, the rest by kind."""
    table = np.full(256, 1, np.int64)
    for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
        table[c] = 2 + i
    for i, c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        table[c] = 28 + i
    for i, c in enumerate(b"0123456789"):
        table[c] = 54 + i
    for i, c in enumerate(b"+/_.=-:\"' ,;()[]{}<>@#$%&*!?|\\\n"):
        table[c] = 64 + i
    return table


_CODE = _alphabet()
_CODES = 64 + 32 + 1


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray  # filter length, embedding, filters
    conv_bias: np.ndarray
    out: np.ndarray
    bias: float
    threshold: float = 0.5
    temperature: float = 1.0
    #: On findings from the scanned texts that were not trained on; not a number where there were none.
    recall: float = float("nan")
    precision: float = float("nan")


def _windows(data: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Codes of context, candidate and context, each at a fixed place; 0 where there is nothing.

    Candidates are ``start`` to ``end`` of the bytes ``data``, in texts from ``low`` to ``high``.
    """
    if not len(data) or not len(start):
        return np.zeros((len(start), WIDTH), np.int64)
    coded = _CODE[data]
    take = lambda at, ok: np.where(ok, coded[np.clip(at, 0, len(data) - 1)], 0)
    left = start[:, None] + np.arange(-SIDE, 0)
    body = start[:, None] + np.arange(BODY)
    right = end[:, None] + np.arange(SIDE)
    return np.concatenate([take(left, left >= low[:, None]), take(body, body < end[:, None]), take(right, right < high[:, None])], axis=1)


def _slide(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of at most ``BODY`` bytes that cover the candidates: which, start and end."""
    n = np.maximum(1, -(-(end - start - BODY) // STEP) + 1)
    which = np.repeat(np.arange(len(start)), n)
    at = start[which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return which, at, np.minimum(at + BODY, end[which])


def candidate_probability(net: Network, data: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of candidates of any length, that of their likeliest window."""
    out = np.zeros(len(start))
    which, a, b = _slide(start, end)
    for i in range(0, len(which), 4096):
        w = which[i : i + 4096]
        np.maximum.at(out, w, probability(net, _windows(data, a[i : i + 4096], b[i : i + 4096], low[w], high[w])))
    return out


def _window(text: bytes, start: int, end: int) -> np.ndarray:
    one = lambda x: np.array([x], np.int64)
    return _windows(np.frombuffer(text, np.uint8), one(start), one(min(end, start + BODY)), one(0), one(len(text)))[0]


def _parts(net: Network, codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """What the filters say, without bias, as filter, window, place (places of a window side by side), and the bounds of the three parts."""
    length, size, filters = net.conv.shape
    steps = codes.shape[1] - length + 1
    x = np.take(np.ascontiguousarray(net.embed.T), codes, axis=1)
    columns = np.empty((length, size, len(codes), steps))
    for k in range(length):
        columns[k] = x[:, :, k : k + steps]
    hidden = (np.ascontiguousarray(net.conv.reshape(-1, filters).T) @ columns.reshape(length * size, -1)).reshape(filters, len(codes), steps)
    cuts = [0, SIDE, SIDE + BODY - length + 1, steps]
    return hidden, list(zip(cuts, cuts[1:], strict=False))


def _pooled(net: Network, top: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.maximum(t.T + net.conv_bias, 0) for t in top], 1)


def _features(net: Network, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of each filter over the places of each of the three parts, and its place."""
    hidden, parts = _parts(net, codes)
    which = [hidden[:, :, a:b].argmax(2) + a for a, b in parts]
    return _pooled(net, [np.take_along_axis(hidden, w[:, :, None], 2)[:, :, 0] for w in which]), np.stack([w.T for w in which], 1)


def _logit(net: Network, codes: np.ndarray) -> np.ndarray:
    hidden, parts = _parts(net, codes)
    return _pooled(net, [hidden[:, :, a:b].max(2) for a, b in parts]) @ net.out + net.bias


def probability(net: Network, codes: np.ndarray) -> np.ndarray:
    if not len(codes):
        return np.zeros(0)
    z = np.concatenate([_logit(net, codes[i : i + 512]) for i in range(0, len(codes), 512)])
    return 1 / (1 + np.exp(-np.clip(z / net.temperature, -40, 40)))


def made_findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of ``n`` findings made by rule: half credentials, half look-alikes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = [a + b + c for a in "bdfglmnprstv" for b in "aeiou" for c in ("", "n", "r", "s", "t")]

    def some(letters: str, low: int, high: int) -> str:
        return "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(low, high + 1))))

    def word() -> str:
        return "".join(syllables[i] for i in rng.integers(0, len(syllables), int(rng.integers(1, 5))))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def pick(*x: str) -> str:
        return x[int(rng.integers(0, len(x)))]

    codes, labels = [], []
    for i in range(n):
        secret = i % 2 == 0
        before, after = prose(4) + " ", " " + prose(4)
        if secret:
            shape = int(rng.integers(0, 7))
            if shape == 0:
                body = some(digits + "abcdef", 24, 64)
            elif shape == 1:
                body = some(lower + upper + digits + "+/", 20, 60) + pick("", "=", "==")
            elif shape == 2:
                body = "AKIA" + some(upper + digits, 16, 16)
            elif shape == 3:
                body = pick("ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "npm_") + some(lower + upper + digits, 24, 40)
            elif shape == 4:
                body = some(lower + upper + digits + "_-", 20, 44)
            elif shape == 5:
                body = "eyJ" + some(lower + upper + digits + "_-", 30, 60)
            else:
                body = some(lower + upper + digits, 16, 40)
            if rng.random() < 0.7:
                before += pick("password", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth", "Bearer", "PRIVATE_KEY") + pick(" = \"", "=", ": ", ":\"", " ", "='")
                after = pick('"', "'", "", ";", ",") + after
        else:
            shape = int(rng.integers(0, 10))
            if shape == 0:
                body = "-".join(some(digits + "abcdef", k, k) for k in (8, 4, 4, 4, 12))
                before += pick("id ", "uuid=", "request ", "trace: ")
            elif shape == 1:
                body = pick("2023", "2024", "1999") + "-" + some(digits, 2, 2) + "-" + word() + "-" + word() + "-" + word()
            elif shape == 2:
                body = "/".join(word() for _ in range(4)) + "/" + some(digits, 1, 4)
                before += pick("http://www.example.com/", "/usr/", "https://")
            elif shape == 3:
                body = "_".join(word() for _ in range(4)) + "_" + some(digits, 1, 3)
            elif shape == 4:
                body = "".join(w.capitalize() for w in prose(4).split()) + some(digits, 1, 3)
            elif shape == 5:
                body = some(digits, 10, 16) + pick("px", "kg", "USD", "ms", "th")
            elif shape == 6:
                body = word() + "-" + word() + some(digits, 1, 3) + "-" + word() + "-" + word()
                after = "@mail." + word() + ".com" + after
            elif shape == 7:
                body = (word() * 6)[:24] + some(digits, 1, 1)
            elif shape == 8:
                body = "v" + some(digits, 1, 2) + "-" + word() + "-build-" + some(digits, 2, 5)
            else:
                body = "-" * 12 + word() + some(digits, 1, 2) + "=" * 8
            if len(body) < CANDIDATE_LEAST:
                body += word() + word() + word()
        raw = (before + body + after).encode()
        codes.append(_window(raw, len(before), len(before) + len(body)))
        labels.append(float(secret))
    return np.array(codes), np.array(labels)


#: Trained parts of a network.
NAMES = ("embed", "conv", "conv_bias", "out", "bias")


def _fit(net: Network, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rng: np.random.Generator, epochs: int, rate: float) -> None:
    """Train ``net`` by Adam."""
    length, _, filters = net.conv.shape
    first = {k: np.zeros_like(np.asarray(getattr(net, k), float)) for k in NAMES}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for i in range(0, len(order), 128):
            batch = order[i : i + 128]
            x, y = codes[batch], labels[batch]
            pooled, which = _features(net, x)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -40, 40)))
            d = (p - y) * weights[batch] / len(batch)
            d_pool = ((d[:, None] * net.out) * (pooled > 0)).reshape(len(batch), 3, filters)
            # sums by place in the filter, code and filter: both gradients are products of them
            seen = x[np.arange(len(batch))[:, None, None], which + np.arange(length)[:, None, None, None]]
            at = (np.arange(length)[:, None, None, None] * _CODES + seen) * filters + np.arange(filters)
            sums = np.bincount(at.ravel(), np.broadcast_to(d_pool, at.shape).ravel(), length * _CODES * filters).reshape(length, _CODES, filters)
            g_embed = np.matmul(sums, net.conv.transpose(0, 2, 1)).sum(0)
            g_embed[0] = 0
            grads = {"embed": g_embed, "conv": np.matmul(net.embed.T, sums), "conv_bias": d_pool.sum((0, 1)), "out": pooled.T @ d, "bias": d.sum()}
            step += 1
            for k in NAMES:
                g = np.asarray(grads[k], float)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - move)
    net.bias = float(net.bias)


def train(
    table: tuple[np.ndarray, np.ndarray] | None = None, n: int = 6000, seed: int = 5, epochs: int = 12, size: int = 8, filters: int = 24, length: int = 5, rate: float = 0.01, recall: float = RECALL
) -> Network:
    """Fit the network by Adam on three quarters of the findings (``n`` made ones, and those of ``table``) and calibrate on the rest."""
    codes, labels = made_findings(n, seed)
    made = n
    if table is not None and len(table[0]):
        codes, labels = np.concatenate([codes, table[0]]), np.concatenate([labels, table[1]])
        n = len(codes)
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    order = rng.permutation(n)
    fit, held = order[: n * 3 // 4], order[n * 3 // 4 :]
    net = Network(
        rng.normal(0, 0.3, (_CODES, size)), rng.normal(0, 0.3 / np.sqrt(length), (length, size, filters)), np.zeros(filters), rng.normal(0, 0.2, 3 * filters), 0.0
    )
    net.embed[0] = 0
    _fit(net, codes[fit], labels[fit], np.ones(len(fit)), rng, epochs, rate)
    z, y = _logit(net, codes[held]), labels[held]
    scales = np.geomspace(0.25, 8, 41)
    losses = [np.mean(np.logaddexp(0, -np.where(y > 0, z, -z) / t)) for t in scales]
    net.temperature = float(scales[int(np.argmin(losses))])
    p = probability(net, codes[held])
    # the highest threshold that keeps the wanted share of secrets, of those made and of those of the table
    own = held >= made
    for part in (~own, own):
        if (y[part] > 0).any():
            found = float(np.quantile(p[part & (y > 0)], 1 - recall, method="lower"))
            net.threshold = found if part is not own else min(net.threshold, found)
    hit = p >= net.threshold
    if (own & (y > 0)).any():
        net.recall = float(hit[own & (y > 0)].mean())
        net.precision = float((y[own & hit] > 0).mean())
    return net


def _flat(net: Network) -> np.ndarray:
    return np.concatenate([np.asarray(getattr(net, k), float).ravel() for k in NAMES])


def _from_flat(net: Network, flat: np.ndarray) -> Network:
    out, at = replace(net), 0
    for k in NAMES:
        old = np.asarray(getattr(net, k), float)
        setattr(out, k, flat[at : at + old.size].reshape(old.shape) if old.shape else float(flat[at]))
        at += old.size
    return out


def _learn(net: Network, weight: float, seed: int, made: tuple[np.ndarray, np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """What a shard makes of the network: its weights times the windows it saw; ``made`` findings are learnt too, not to be forgotten."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("at", "ascending"), ("codes", "ascending"), ("label", "ascending")])
        codes = np.frombuffer(b"".join(shard.column("codes").to_pylist()), np.uint8).reshape(-1, WIDTH)
        label = np.asarray(shard.column("label"), float)
        own = _from_flat(net, _flat(net).copy())
        rng = np.random.Generator(np.random.PCG64([seed, shard.column("shard")[0].as_py()]))
        _fit(own, np.concatenate([codes, made[0]]), np.concatenate([label, made[1]]), np.concatenate([np.where(label > 0, weight, 1 / weight), np.ones(len(made[1]))]), rng, 1, SHARD_RATE)
        total = np.rint(_flat(own) * WEIGHT_STEPS).astype(np.int64) * len(codes)
        return pa.table({"place": pa.array(np.arange(len(total), dtype=np.int32)), "total": pa.array(total)})

    return run


def _score_counts(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows by label and score, in parts of ``SCORE_STEPS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDTH)
            for i in range(0, len(codes), 512):
                z = np.floor(np.clip(_logit(net, codes[i : i + 512].astype(np.int64)), -40, 40) * SCORE_STEPS).astype(int)
                counts.update(zip(batch.column(0).slice(i, 512).to_pylist(), z.tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["label", "score", "n"])

    return run


def network_for(docs: DataFrame, seed: int = 5, recall: float = RECALL) -> Network:
    """The network trained on findings made by rule and on all those of ``docs``; the driver gets sums of weights and counts of scores only."""
    net = train(seed=seed, recall=recall)
    found = stored(docs.select("text").mapInArrow(_all_findings, "label int, at long, codes binary").distinct())
    held = F.pmod(F.xxhash64("codes"), F.lit(4)) == 0
    sizes = {r.label: r.n for r in found.where(~held).groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if n:
        # both labels weigh alike, and together as their geometric mean
        weight = max(1.0, (sizes.get(0, 0) / max(1, sizes.get(1, 0))) ** 0.5)
        codes, labels = made_findings(6000, 5)  # made once, not in each shard
        made = codes.astype(np.uint8), labels
        dealt = found.where(~held).withColumn("shard", F.pmod(F.xxhash64("codes", "label"), F.lit(max(1, n // SHARD_WINDOWS))))
        for k in range(PASSES):
            sums = dealt.groupBy("shard").applyInArrow(_learn(net, weight, seed + 2 + k, made), "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
            flat = np.zeros(len(sums))
            flat[[r.place for r in sums]] = [r.total / n / WEIGHT_STEPS for r in sums]
            net = _from_flat(net, flat)
    rows = found.where(held).select("label", "codes").mapInArrow(_score_counts(net), "label int, score int, n long").groupBy("label", "score").agg(F.sum("n").alias("n")).collect()
    table = np.array([(r.label, r.score, r.n) for r in rows], np.int64).reshape(-1, 3)
    return _calibrated(net, table, seed, recall)


def _calibrated(net: Network, table: np.ndarray, seed: int, recall: float) -> Network:
    """Temperature and threshold from ``label, score, n`` of the held windows of the texts, and from others made by rule."""
    codes, labels = made_findings(2000, seed + 1000)
    made = np.stack([labels.astype(np.int64), np.floor(np.clip(_logit(net, codes), -40, 40) * SCORE_STEPS).astype(np.int64), np.ones(len(codes), np.int64)], 1)
    # every label of either source counts alike
    parts = [p[p[:, 0] == label] for p in (made, table) for label in (0, 1)]
    scales = np.geomspace(0.25, 8, 41)
    loss = lambda p, t: (np.logaddexp(0, -np.where(p[:, 0] > 0, 1, -1) * (p[:, 1] + 0.5) / SCORE_STEPS / t) * p[:, 2]).sum() / p[:, 2].sum()
    net.temperature = float(scales[int(np.argmin([sum(loss(p, t) for p in parts if len(p)) for t in scales]))])
    cuts = []
    for p in (parts[1], parts[3]):
        if len(p):
            p = p[np.argsort(-p[:, 1])]
            kept = np.cumsum(p[:, 2])
            cuts.append(int(p[np.searchsorted(kept, recall * kept[-1] - 1e-9), 1]))
    cut = min(cuts)
    net.threshold = float(1 / (1 + np.exp(-cut / SCORE_STEPS / net.temperature)))
    if len(parts[3]):
        hit = [p[p[:, 1] >= cut, 2].sum() for p in parts[2:]]
        net.recall, net.precision = float(hit[1] / parts[3][:, 2].sum()), float(hit[1] / max(1, sum(hit)))
    return net


def base_spans(text: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in bytes; ``hex_runs`` are the text's long enough ones."""
    out = []
    if b"=" in text or b":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(a, b, 2) for a, b in hex_runs]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


@dataclass
class _Places:
    """Finds of the patterns and candidates of a chunk of texts, in bytes of the chunk."""

    base: np.ndarray  # start, end, kind, row
    free: np.ndarray  # start, end, row


def _places(buf: np.ndarray, off: np.ndarray) -> _Places:
    n = len(off) - 1
    hexes = vec.runs(_HEX[buf], off)
    long = hexes.end - hexes.start >= HEX_LEAST
    has = np.zeros(n, bool)
    has[hexes.row[long]] = True
    signs = np.flatnonzero((buf == 0x3D) | (buf == 0x3A))
    has[np.searchsorted(off, signs, "right") - 1] = True
    data = buf.tobytes()
    akia = data.find(b"AKIA")
    while akia >= 0:
        has[np.searchsorted(off, akia, "right") - 1] = True
        akia = data.find(b"AKIA", akia + 1)
    hex_by: dict[int, list[tuple[int, int]]] = {}
    for r, s, e in zip(hexes.row[long].tolist(), hexes.start[long].tolist(), hexes.end[long].tolist(), strict=True):
        hex_by.setdefault(r, []).append((s - int(off[r]), e - int(off[r])))
    base = [(int(off[r]) + s, int(off[r]) + e, k, r) for r in np.flatnonzero(has).tolist() for s, e, k in base_spans(data[off[r] : off[r + 1]], hex_by.get(r, []))]
    table = np.array(base, np.int64).reshape(-1, 4)
    # bytes that some find covers
    step = np.zeros(len(buf) + 1, np.int64)
    np.add.at(step, table[:, 0], 1)
    np.add.at(step, table[:, 1], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    wide = vec.runs(_RUN[buf], off)
    pick = wide.end - wide.start >= CANDIDATE_LEAST
    a, b, row = wide.start[pick], wide.end[pick], wide.row[pick]
    beside = covered[b] - covered[a] < b - a
    return _Places(table, np.stack([a[beside], b[beside], row[beside]], 1))


def _all_findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of finds of the patterns (label 1) and of runs that none touches (0), with a hash; of a chunk of texts each once."""
    for batch in batches:
        buf, off, _ = vec.column(batch.column(0))
        for i, j in vec.chunks(off):
            part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            places = _places(part, o)
            touched = np.zeros(len(part) + 1, np.int64)
            np.add.at(touched, places.base[:, 0], 1)
            np.add.at(touched, places.base[:, 1], -1)
            inside = np.concatenate([[0], np.cumsum(np.cumsum(touched[:-1]) > 0)])
            free = places.free[inside[places.free[:, 1]] == inside[places.free[:, 0]]]
            for label, (start, end, row) in enumerate(((free[:, 0], free[:, 1], free[:, 2]), (places.base[:, 0], places.base[:, 1], places.base[:, 3]))):
                which, a, b = _slide(start, end)
                found: set[bytes] = set()
                for k in range(0, len(which), 4096):
                    w = which[k : k + 4096]
                    codes = _windows(part, a[k : k + 4096], b[k : k + 4096], o[row[w]], o[row[w] + 1]).astype(np.uint8)
                    found.update(c.tobytes() for c in codes)
                some = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.int32()), pa.array([zlib.crc32(c) << 31 | zlib.adler32(c) >> 1 for c in some], pa.int64()), pa.array(some, pa.binary())], names=["label", "at", "codes"])


def table_findings(docs: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """To look at, not to learn from: windows of the texts of ``docs`` and their labels, at most ``most`` of each: finds of the patterns are secrets, runs that none touches are not."""
    found = docs.select("text").mapInArrow(_all_findings, "label int, at long, codes binary")
    codes: list[bytes] = []
    labels: list[float] = []
    for label in range(2):
        for row in found.where(F.col("label") == label).select("at", "codes").distinct().orderBy("at", "codes").limit(most).collect():
            codes.append(bytes(row.codes))
            labels.append(float(label))
    return np.frombuffer(b"".join(codes), np.uint8).reshape(-1, WIDTH).astype(np.int64), np.array(labels)


def _scan(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = vec.column(batch.column(1))
            for i, j in vec.chunks(off):
                yield _scan_chunk(net, batch.column(0).slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i])

    return run


def _scan_chunk(net: Network, ids: pa.Array, buf: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    n = len(off) - 1
    places = _places(buf, off)
    start = np.concatenate([places.base[:, 0], places.free[:, 0]])
    end = np.concatenate([places.base[:, 1], places.free[:, 1]])
    kind = np.concatenate([places.base[:, 2], np.full(len(places.free), 3)])
    row = np.concatenate([places.base[:, 3], places.free[:, 2]])
    p = candidate_probability(net, buf, start, end, off[row], off[row + 1])
    keep = np.flatnonzero((kind < 3) | (p >= net.threshold))
    keep = keep[np.lexsort((end[keep], kind[keep], start[keep], row[keep]))]
    row = row[keep]
    points = vec.code_points(buf)
    base = points[off[row]]
    bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array([KINDS[k] for k in kind[keep].tolist()], pa.string()), pa.array(points[start[keep]] - base), pa.array(points[end[keep]] - base), pa.array(p[keep])],
        names=["kind", "start", "end", "probability"],
    )
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(bounds), spans)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points, probability) of every whole text.

    Without ``net`` a network is trained, on ``docs`` too.  Spans are ordered
    by start, then kind; a span of kind ``model`` is a whole candidate and may
    overlap one of a pattern.  A null text is an empty one and has none; rows
    are independent, so null or repeated ``doc_id`` and other columns play no
    part; an empty table gives an empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan(net or network_for(docs)), "doc_id long, spans array<struct<kind string, start long, end long, probability double>>")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the spans as text, from what :func:`find_secrets` returns."""
    base = F.filter("spans", lambda s: s["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with what the spans cover replaced by ``[SECRET]``; overlapping spans are one."""
    out, at = [], 0
    end_of_last = -1
    for start, end in sorted(spans):
        if start < end_of_last:
            end_of_last = max(end_of_last, end)
            at = max(at, end)
            continue
        out += [text[at:start], "[SECRET]"]
        at = end_of_last = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``docs`` with all columns, every found span of ``text`` replaced, and ``n_chars`` (where there is one) counted anew.

    A null text stays null; repeated rows are redacted each; an empty table
    gives an empty result.
    """
    net = net or network_for(docs)
    at = docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, valid = vec.column(batch.column(at))
            for i, j in vec.chunks(off):
                part = batch.slice(i, j - i)
                found = _scan_chunk(net, part.column(at), buf[off[i] : off[j]], off[i : j + 1] - off[i]).column(1).to_pylist()
                if any(found):
                    texts = part.column(at).to_pylist()
                    texts = [redact(t, [(s["start"], s["end"]) for s in spans]) if spans else t for t, spans in zip(texts, found, strict=True)]
                    columns = list(part.columns)
                    columns[at] = pa.array(texts, columns[at].type)
                    if count_at >= 0:
                        counts = part.column(count_at).to_pylist()
                        columns[count_at] = pa.array([len(t) if spans else n for t, n, spans in zip(texts, counts, found, strict=True)], columns[count_at].type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(run, docs.schema)
