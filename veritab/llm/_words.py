"""Words, shingles and character n-grams of whole Arrow batches, as numpy arrays.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters;
A-Z and the capitals of Latin-1 are lower-cased. Everything works on the UTF-8
bytes of many texts at once, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PRIME = U64(0x100000001B3)
GOLDEN = U64(0x9E3779B97F4A7C15)

_LETTER = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _LETTER[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the n + 1 offsets of the texts. Null: empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, n_bytes: int = 2 << 20, n_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``n_bytes`` of text, so that memory
    depends on that and on the longest single text only."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + n_bytes, side="right"))
            to = min(max(to, at + 1), at + n_rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """``start``, ``end`` (in ``data``), ``doc`` and ``hash`` of each word; ``first`` has the n + 1 offsets of the documents' words."""

    data: np.ndarray
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def lower(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    if len(data) > 1:
        second = data[1:]
        low[1:][(data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return low


def words(texts: pa.Array) -> Words:
    raw, offsets = text_bytes(texts)
    data = lower(raw)
    inside = _LETTER[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    before[edges], after[edges - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets)
    return Words(data, raw, start, end, doc, hash_runs(data, start, end), first)


def runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices start[i] .. start[i] + size[i] - 1 for all i, one after another, and their places within i."""
    at = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(at, size)
    return np.repeat(start, size) + place, place


_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME ** i and its inverse modulo 2 ** 64, for i < n at least; kept, as all batches need the same."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((PRIME, U64(pow(int(PRIME), -1, 1 << 64)))):
            table = np.full(n, base, U64)
            table[0] = 1
            _POWERS[k] = np.cumprod(table)
    return _POWERS[0], _POWERS[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * PRIME ** i: with them any range of bytes has its polynomial hash at once."""
    total = np.zeros(len(data) + 1, U64)
    value = data.astype(U64)
    value += U64(1)
    value *= powers(len(data) + 1)[0][: len(data)]
    np.cumsum(value, out=total[1:])
    return total


def hash_ranges(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(len(total))[1][start] ^ ((end - start).astype(U64) * GOLDEN))


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    return hash_ranges(prefix_hash(data), start, end)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, hash) of all runs of ``n`` words; a document of fewer words has one run of all of them, one without words has none."""
    at = np.arange(max(len(w.hash) - n + 1, 0))
    at = at[w.doc[at] == w.doc[at + n - 1]] if len(at) else at
    value = w.hash[at] if len(at) else np.zeros(0, U64)
    for j in range(1, n):
        value = mix(value * GOLDEN + w.hash[at + j])
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        begin = w.first[:-1][short]
        few = w.hash[begin]
        for j in range(1, n - 1):
            more = w.counts[short] > j
            few[more] = mix(few[more] * GOLDEN + w.hash[begin[more] + j])
        at, value = np.concatenate([at, begin]), np.concatenate([value, few])
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
    return at, w.doc[at], value


def sequence_digest(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each document's word sequence; 0 without words."""
    out = []
    for seed in (U64(0x51_7C_C1_B7_27_22_0A_95), U64(0x2545F4914F6CDD1D)):
        total = np.zeros(len(w.counts), U64)
        if len(w.hash):
            place = np.arange(len(w.hash)) - w.first[:-1][w.doc]
            value = mix(w.hash ^ seed) * mix((place.astype(U64) + U64(1)) * seed | U64(1))
            full = np.flatnonzero(w.counts)
            total[full] = mix(np.add.reduceat(value, w.first[:-1][full]) ^ seed)
        out.append(total)
    return out[0], out[1]


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """An example of each distinct word, and for each word which of them it is."""
    _, example, which = np.unique(w.hash, return_index=True, return_inverse=True)
    return example, which


def char_ngrams(data: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the character (byte) n-grams of ``<word>``."""
    size = end - start + 2
    at = np.cumsum(size) - size
    framed = np.empty(int(size.sum()), np.uint8)
    framed[at], framed[at + size - 1] = 60, 62
    index, place = runs(start, end - start)
    framed[np.repeat(at + 1, end - start) + place] = data[index]
    owner, value = [], []
    for n in sizes:
        count = np.maximum(size - n + 1, 0)
        where, _ = runs(at, count)
        h = np.full(len(where), U64(n), U64)
        for j in range(n):
            h = h * PRIME + framed[where + j].astype(U64) + U64(1)
        owner.append(np.repeat(np.arange(len(start)), count))
        value.append(mix(h))
    return np.concatenate(owner), np.concatenate(value)
