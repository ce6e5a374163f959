"""BPE with forced boundaries, for a word-end vocabulary, on whole batches.

The normalised text is cut where no token can span: at the bounds of
pre-tokens, and inside them between two bytes that are never neighbours in any
token of the vocabulary.  What lies between two cuts (a fragment) is encoded by
itself; the ids of a text are those of its fragments one after the other.
Fragments recur far more than words do, so a batch looks its fragments up by
hash and runs the merges once for all new ones together.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import vec

#: Slots of the table of fragments at first; it doubles when it is half full.
_SLOTS = 1 << 18
#: Characters that are taken at once; a bound of memory for very long texts, without effect on results.
PIECE = 1 << 20
#: Fragments a worker remembers before it starts anew, at all and with their strings; bounds of memory, without effect on results.
MOST_KNOWN, MOST_TEXTS = 1_000_000, 200_000
_NONE = np.int64(1) << np.int64(62)


@functools.cache
def _classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    table = np.full(0x110000, 3, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x40000)])
    table[:0x40000][kinds == "L"] = 1
    table[:0x40000][kinds == "N"] = 2
    for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = 0
    return table


@functools.cache
def _byte_classes() -> bytes:
    """Classes of the ASCII characters, as a table for ``bytes.translate``."""
    return _classes()[:0x80].tobytes() + bytes(0x80)


#: Masks of the first 0 to 8 bytes of a word of eight.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of short spans, eight bytes at a time; of long ones, by their bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    h = vec.mix((eight[start] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * vec.U64(0x9E3779B97F4A7C15))
    more, k = np.flatnonzero((size > 8) & (size < vec.LONG)), 8
    while len(more):
        h[more] = vec.mix(h[more] * vec.U64(3) + (eight[start[more] + k] & _FIRST_BYTES[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    long = np.flatnonzero(size >= vec.LONG)
    if len(long):
        view = memoryview(data)
        h[long] = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], np.uint64)
    return h


def _byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class _Result:
    ids: np.ndarray  # of all fragments in a row
    first: np.ndarray  # bounds of each text's ids


class ForcedBoundaryBPE:
    """Encoder and decoder of a ``tokenizers`` BPE file whose tokens end words with a suffix.

    It reproduces NFC, ``\\s+`` to one space, lower case, the split at
    contractions, letters, single numbers and other signs, byte-level letters,
    merges by rank, and special tokens found in the raw text.  Decoding joins
    the tokens' strings with spaces, as a file without decoder does.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.byte_id = np.zeros((2, 256), np.int64)
        for letter, b in letters.items():
            self.byte_id[0, b] = vocab[letter]
            self.byte_id[1, b] = vocab[letter + self.suffix]
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            body = token.removesuffix(self.suffix) if token != self.suffix else token
            data = [letters[c] for c in body]
            self.inside[data[:-1], data[1:]] = True
        self._forced = ~self.inside.ravel()  # by the two bytes as one number
        pairs = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append((vocab[a] * size + vocab[b], rank, vocab[a + b]))
        self._size = size
        self._fill(pairs)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        # fragments seen: an open-addressed table from their hash, which is never 0, to their number
        self._slot_key = np.zeros(_SLOTS, np.uint64)
        self._slot_code = np.zeros(_SLOTS, np.int32)
        self._flat = np.zeros(1 << 16, np.int32)
        self._bounds = np.zeros(1 << 12, np.int64)
        self._n = 0
        for i in self.specials.values():  # a special token is a fragment of its own
            self._append(np.array([i], np.int32), np.array([1]))
        self._special_code = {content: k for k, content in enumerate(self.specials)}
        self.id_text: list[str] = [str(self._flat[k]) for k in range(self._n)]
        self.token_text: list[str] = [self.tokens[self._flat[k]] for k in range(self._n)]

    def _fill(self, pairs: list[tuple[int, int, int]]) -> None:
        """Open-addressed table of merges."""
        bits = 19
        self._merge_mask = (1 << bits) - 1
        self._merge_key = np.full(1 << bits, -1, np.int64)
        self._merge_rank = np.zeros(1 << bits, np.int64)
        self._merge_to = np.zeros(1 << bits, np.int64)
        probes = 1
        slots = (vec.mix(np.array([p[0] for p in pairs], np.uint64)) & vec.U64(self._merge_mask)).astype(np.int64).tolist()
        taken = self._merge_key.tolist()
        for (key, rank, to), slot in zip(pairs, slots, strict=True):
            n = 1
            while taken[slot] >= 0:
                if taken[slot] == key:
                    break
                slot = (slot + 1) & self._merge_mask
                n += 1
            if taken[slot] == key:
                continue
            taken[slot] = key
            self._merge_rank[slot], self._merge_to[slot] = rank, to
            probes = max(probes, n)
        self._merge_key[:] = taken
        self._probes = probes

    def _merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging neighbours; a very large rank where there is none."""
        key = a * self._size + b
        slot = (vec.mix(key.astype(np.uint64)) & vec.U64(self._merge_mask)).astype(np.int64)
        rank, to = np.full(len(key), _NONE), np.zeros(len(key), np.int64)
        left = np.arange(len(key))
        for _ in range(self._probes):
            found = self._merge_key[slot[left]]
            hit = found == key[left]
            rank[left[hit]], to[left[hit]] = self._merge_rank[slot[left[hit]]], self._merge_to[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & self._merge_mask
        return rank, to

    def _append(self, flat: np.ndarray, size: np.ndarray) -> None:
        total, n = int(size.sum()), len(size)
        used = int(self._bounds[self._n])
        while used + total > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while self._n + n + 1 > len(self._bounds):
            self._bounds = np.concatenate([self._bounds, np.zeros_like(self._bounds)])
        self._flat[used : used + total] = flat
        self._bounds[self._n + 1 : self._n + n + 1] = used + np.cumsum(size)
        self._n += n

    def _encode_fragments(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many fragments at once: in every round each takes its leftmost merge of least rank."""
        size = end - start
        flat = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        symbol = self.byte_id[0, data[flat]]
        tail = np.cumsum(size) - 1
        symbol[tail[last]] = self.byte_id[1, data[end[last] - 1]]
        owner = np.repeat(np.arange(len(size)), size)
        done_symbol, done_owner = [], []
        rank, to = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)  # of each symbol with the next one
        fresh = np.flatnonzero(owner[1:] == owner[:-1])
        while len(symbol):
            rank[fresh], to[fresh] = self._merge(symbol[fresh], symbol[fresh + 1])
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            first = np.flatnonzero(new)
            order = np.where(rank < _NONE, (rank << np.int64(32)) + np.arange(len(symbol)), _NONE)
            best = np.minimum.reduceat(order, first)
            merging = best < _NONE
            live = np.repeat(merging, np.diff(np.append(first, len(symbol))))
            done_symbol.append(symbol[~live])
            done_owner.append(owner[~live])
            where = best[merging] & np.int64(0xFFFFFFFF)
            symbol[where] = to[where]
            rank[where] = _NONE
            live[where + 1] = False
            at = np.cumsum(live)[where] - 1  # where the merged ones are now
            symbol, owner, rank, to = symbol[live], owner[live], rank[live], to[live]
            before, after = at[at > 0] - 1, at[at + 1 < len(symbol)]
            fresh = np.concatenate([before[owner[before] == owner[before + 1]], after[owner[after] == owner[after + 1]]])
        symbols, owners = np.concatenate(done_symbol), np.concatenate(done_owner)
        order = np.argsort(owners, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(owners, minlength=len(size))

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the fragments with these hashes, -1 for new ones."""
        slot = (key >> vec.U64(65 - len(self._slot_key).bit_length())).astype(np.int64)
        found = self._slot_key[slot]
        code = np.where(found == key, self._slot_code[slot], -1).astype(np.int64)
        left = np.flatnonzero((found != key) & (found != 0))
        while len(left):
            at = slot[left] = (slot[left] + 1) & (len(self._slot_key) - 1)
            found = self._slot_key[at]
            hit = found == key[left]
            code[left[hit]] = self._slot_code[at[hit]]
            left = left[~hit & (found != 0)]
        return code

    def _put(self, key: np.ndarray, code: np.ndarray) -> None:
        """Distinct new hashes with their numbers."""
        n = len(self._slot_key)
        while 2 * self._n > n:
            n *= 2
        if n > len(self._slot_key):
            old = np.flatnonzero(self._slot_key)
            key, code = np.concatenate([self._slot_key[old], key]), np.concatenate([self._slot_code[old], code])
            self._slot_key, self._slot_code = np.zeros(n, np.uint64), np.zeros(n, np.int32)
        slot = (key >> vec.U64(65 - n.bit_length())).astype(np.int64)
        while len(key):
            free = self._slot_key[slot] == 0
            self._slot_key[slot[free]] = key[free]
            put = self._slot_key[slot] == key
            self._slot_code[slot[put]] = code[put]
            key, code, slot = key[~put], code[~put], (slot[~put] + 1) & (n - 1)

    def _codes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Number of each fragment; new ones are encoded and remembered."""
        key = vec.mix(_span_hashes(data, start, end) * vec.U64(2) + last.astype(np.uint64)) | vec.U64(1)
        code = self._find(key)
        miss = np.flatnonzero(code < 0)
        if len(miss):
            new, at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            pick = miss[at]
            number = np.arange(self._n, self._n + len(new))
            self._append(*self._encode_fragments(data, start[pick], end[pick], last[pick]))
            self._put(new, number)
            code[miss] = number[back]
        return code

    def _reset(self) -> None:
        keep = len(self.specials)
        self._slot_key, self._slot_code = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self._n = keep
        del self.id_text[keep:], self.token_text[keep:]

    def _texts(self) -> None:
        """Strings of the fragments that have none yet."""
        done = len(self.id_text)
        if done < self._n:
            low, high = int(self._bounds[done]), int(self._bounds[self._n])
            ids = self._flat[low:high].tolist()
            cuts = (self._bounds[done : self._n + 1] - low).tolist()
            tokens = self.tokens
            self.id_text += [" ".join(map(str, ids[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            self.token_text += [" ".join([tokens[i] for i in ids[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def fragments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Fragment numbers of all texts in a row, and the bounds of each text's."""
        if self._n > MOST_KNOWN or len(self.id_text) > MOST_TEXTS:
            self._reset()
        codes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        group: list[str] = []
        of: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if group:
                got, part = self._group(group)
                codes.append(got)
                owners.append(np.array(of, np.int64)[part])
            group.clear()
            of.clear()
            held = 0

        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                if piece in self._special_code:
                    flush()
                    codes.append(np.array([self._special_code[piece]], np.int64))
                    owners.append(np.array([i], np.int64))
                    continue
                group.append(piece)
                of.append(i)
                held += len(piece)
                if held >= PIECE:
                    flush()
        flush()
        none = np.zeros(0, np.int64)
        text_of = np.concatenate([none, *owners])
        return np.concatenate([none, *codes]), np.searchsorted(text_of, np.arange(len(texts) + 1))

    def _pieces(self, text: str) -> Iterator[str]:
        """A text cut at its special tokens, which stand for themselves, and long stretches cut at spaces."""
        found = self._special is not None and "<|" in text
        for part in self._special.split(text) if found else [text]:
            at = 0
            while len(part) - at > PIECE:
                cut = part.find(" ", at + PIECE)
                if cut < 0:
                    break
                yield part[at:cut]
                at = cut
            yield part[at:] if at else part

    def _group(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Fragment numbers of some parts in a row, and the part each is of."""
        parts = [p.replace("\n", " ") for p in parts]
        wide = [k for k, p in enumerate(parts) if not p.isascii()]
        for k in wide:
            parts[k] = unicodedata.normalize("NFC", parts[k]).replace("Σ", "σ")  # no final form: letters are lowered one by one
        parts = [p.lower() for p in parts]
        raw = b"\n".join([p.encode("utf-8") for p in parts])
        if not raw:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._cut("".join([parts[k] for k in wide]), raw)

    def _cut(self, wide: str, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Fragments of ``raw``, of which ``wide`` has all characters beyond ASCII in their order."""
        data = np.frombuffer(raw, np.uint8)
        lead = (data & 0xC0) != 0x80
        kind_of = np.frombuffer(raw.translate(_byte_classes()), np.uint8)
        if wide:
            points = np.frombuffer(wide.encode("utf-32-le"), np.uint32)
            points = points[points >= 0x80]
            kind_of = kind_of.copy()
            kind_of[data >= 0x80] = np.repeat(_classes()[points], 2 + (points >= 0x800) + (points >= 0x10000))  # of every byte, its letter's
        new = np.ones(len(data), bool)
        new[1:] = (kind_of[1:] != kind_of[:-1]) | ((kind_of[1:] == 2) & lead[1:])
        quote = np.flatnonzero((data[:-1] == 0x27) & new[:-1]) if len(data) > 1 else np.zeros(0, np.int64)
        if len(quote):
            follow = np.concatenate([data, np.zeros(3, np.uint8)])
            a, b = follow[quote + 1], follow[quote + 2]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
            for which, length in ((two, 3), (one & ~two, 2)):
                at = quote[which]
                new[at + 1] = False
                stop = at + length
                new[stop[stop < len(data)]] = True
        space = kind_of == 0
        edge = new.copy()
        edge[1:] |= self._forced[data[:-1].astype(np.uint16) << 8 | data[1:]]
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(data))
        word = ~space[start]
        start, end = start[word], end[word]
        last = np.ones(len(start), bool)
        inner = end < len(data)
        last[inner] = new[end[inner]]
        breaks = np.flatnonzero(data == 0x0A)
        return self._codes(data, start, end, last), np.searchsorted(breaks, start)

    def encode(self, texts: list[str]) -> _Result:
        """Ids of all texts in a row, with their bounds."""
        codes, first = self.fragments(texts)
        low = self._bounds[codes]
        size = self._bounds[codes + 1] - low
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self._flat[np.repeat(low - total[:-1], size) + np.arange(total[-1])]
        return _Result(ids, total[first])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


@functools.lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    """The encoder of a file, once for each Python worker."""
    return ForcedBoundaryBPE(path)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def _strings(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            _, off, _ = vec.column(batch.column(1))
            for i, j in vec.chunks(off):
                codes, first = bpe.fragments(texts_of(batch.column(1).slice(i, j - i)))
                bpe._texts()
                size = np.zeros(len(codes) + 1, np.int64)
                np.cumsum(bpe._bounds[codes + 1] - bpe._bounds[codes], out=size[1:])
                n = size[first[1:]] - size[first[:-1]]
                numbers, tokens, codes = bpe.id_text, bpe.token_text, codes.tolist()
                cuts = first.tolist()
                ids = [" ".join([numbers[c] for c in codes[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
                decoded = [" ".join([tokens[c] for c in codes[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (decimal, one space between) and ``decoded`` of every whole text.

    ``path`` is the tokenizer file on every machine.  A null text is an empty
    one: no ids and an empty string.  Rows are independent, so null or repeated
    ``doc_id`` play no part, nor do other columns; an empty table gives an
    empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(_strings(path), "doc_id long, n_tokens long, ids string, decoded string")
