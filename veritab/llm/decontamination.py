"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a benchmark item
still matches where someone changed its figures or persons. Windows of five
template tokens are joined by hash; along each alignment of a document with an
item, each value in the item's placeholders stands for its most frequent counterpart
in the document, as it does when one and the same question was given other
parameters. A window with another counterpart does not count, unless it is verbatim.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._runtime import materialise
from veritab.llm._words import GOLDEN, U64, Words, hash_runs, mix, pieces, words
from veritab.llm.minhash import row_key

#: Units that count as such after a number, and number words.
UNITS = """kg g mg t lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yd l ml cl litre litres liter liters
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
dollar dollars euro euros cent cents usd eur gbp percent degrees km2 m2 m3 kmh mph w kw v a hz khz mhz ghz""".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()

# Of the filter that documents' windows pass first: it grows with the benchmark, so that one other window in 64 passes at most, up to 128 MB;
# beyond 16 million windows more pass, and the join by hash, which is exact at any size, drops them.
LEAST_BITS, BITS_EACH, MOST_BITS = 1 << 22, 64, 1 << 30
WINDOWS = "key string, id long, place int, length int, hash long, slots array<long>"
_NUM, _NAME, _UNIT = (mix(np.array([x], U64))[0] for x in (11, 12, 13))


def _hashes(listed: list[str]) -> np.ndarray:
    w = words(pa.array(listed))
    return np.sort(hash_runs(w.data, w.start, w.end))


def template(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(canonical token, slot value, whether a name) of each word; the value is 0 where the word stands for itself.

    A number is a word that begins with a digit, or a number word; a unit is a listed
    unit right after a number; a name is a capitalised word in the middle of a sentence.
    """
    token, slot = w.hash.copy(), np.zeros(len(w.hash), U64)
    if not len(token):
        return token, slot, np.zeros(0, bool)
    first = w.raw[w.start]
    number = (first >= 48) & (first <= 57) | np.isin(w.hash, _hashes(NUMBERS))
    after = np.zeros(len(token), bool)
    after[1:] = number[:-1] & (w.doc[1:] == w.doc[:-1])
    unit = after & np.isin(w.hash, _hashes(UNITS))
    second = w.raw[np.minimum(w.start + 1, len(w.raw) - 1)]
    capital = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    before = np.full(len(w.raw) + 2, 46, np.uint8)
    before[2:] = w.raw
    inner = (before[w.start + 1] == 32) & ((before[w.start] >= 48) & (before[w.start] != 58) & (before[w.start] != 63) | (before[w.start] == 44))
    inner[w.first[:-1][w.counts > 0]] = False
    name = capital & inner & ~number & ~unit
    for kind, mark in ((number, _NUM), (unit, _UNIT), (name, _NAME)):
        slot[kind], token[kind] = w.hash[kind], mark
    return token, slot, name


def windows(w: Words, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, hash, slot values) of the windows of ``length`` template tokens that have at least one plain word.

    Twice: with names as plain words, and, for windows that hold a name, with
    placeholders for them. So a copy still matches where other punctuation around
    it makes its capitals look like names.
    """
    token, slot, name = template(w)
    every = np.arange(max(len(token) - length + 1, 0))
    every = every[w.doc[every] == w.doc[every + length - 1]] if len(every) else every
    for named in (False, True):
        if not named:
            word, held, at = np.where(name, w.hash, token), np.where(name, U64(0), slot), every
        else:
            word, held, seen = token, slot, np.concatenate([[0], np.cumsum(name)])
            at = every[seen[every + length] > seen[every]]
        value, plain = np.full(len(at), U64(length), U64), np.zeros(len(at), bool)
        for j in range(length):
            value = mix(value * GOLDEN + word[at + j])
            plain |= held[at + j] == 0
        yield at[plain], value[plain], held


def _rows(piece: pa.RecordBatch, w: Words, at: np.ndarray, value: np.ndarray, slot: np.ndarray, length: int) -> pa.RecordBatch:
    doc = pa.array(w.doc[at])
    slots = slot[at[:, None] + np.arange(length)] if len(at) else np.zeros((0, length), U64)
    return pa.RecordBatch.from_arrays(
        [
            piece.column(0).take(doc),
            piece.column(1).take(doc),
            pa.array(at - w.first[w.doc[at]], pa.int32()),
            pa.array(np.full(len(at), length), pa.int32()),
            pa.array(value.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * length, pa.int32()), pa.array(slots.ravel().view(np.int64))),
        ],
        names=["key", "id", "place", "length", "hash", "slots"],
    )


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """The windows of each item: ``n`` tokens long, or as long as an item of fewer tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            w = words(piece.column(2))
            size = np.minimum(w.counts, n)
            for length in np.unique(size[size > 0]):
                for at, value, slot in windows(w, int(length)):
                    own = size[w.doc[at]] == length
                    yield _rows(piece, w, at[own], value[own], slot, int(length))

    rows = benchmark.select(F.lit("").alias("key"), F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, WINDOWS)


def window_filter(items: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """A bit for each bucket of the hashes of the benchmark's windows: a power of two of buckets, BITS_EACH for each window, but ``most`` at most.

    Spark sets the bits, in words of 64; the driver gets one row of two numbers for each
    word in use, so at most ``most`` / 64 of them. Its size never depends on the documents.
    """
    hashes = items.select("hash").distinct()
    size = min(most, max(LEAST_BITS, 1 << (BITS_EACH * max(1, hashes.count()) - 1).bit_length()))
    bucket = F.col("hash").bitwiseAND(F.lit(size - 1))
    words_ = hashes.groupBy(F.shiftright(bucket, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words_["word"].to_numpy()] = words_["bits"].to_numpy()
    return bits.view(np.uint8)


def document_windows(docs: DataFrame, id_col: str, text_col: str, wanted: np.ndarray, lengths: list[int]) -> DataFrame:
    """The documents' windows that pass the filter ``wanted`` (a bit per hash bucket)."""
    size = U64(len(wanted) * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            w = words(piece.column(2))
            for length in lengths:
                for at, value, slot in windows(w, length):
                    bucket = (value % size).astype(np.int64)
                    found = (wanted[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1
                    yield _rows(piece, w, at[found], value[found], slot, length)

    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, WINDOWS)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The pairs of a document and an item of which it holds at least ``threshold``:
    row_key, doc_id, item_id, n_windows (of the item), n_matched (of them, in the document), coverage.

    Windows whose placeholders conflict with the rest of their alignment do not count,
    unless they are verbatim; different values may have the same counterpart. Null and empty
    texts, and items of placeholders only, match nothing; an item of fewer than ``n``
    tokens is one window. Repeated rows (same id and text) give one pair. Items
    with the same id count as one. Other columns are ignored.
    """
    items = materialise(benchmark_windows(benchmark, item_col, item_text, n).select(F.col("id").alias("item_id"), F.col("place").alias("item_place"), "length", "hash", F.col("slots").alias("item_slots")))
    sizes = items.groupBy("item_id").agg(F.count_distinct("item_place").alias("n_windows"))
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    found = materialise(document_windows(docs, id_col, text_col, window_filter(items), lengths))
    pairs = F.filter(
        F.transform(F.arrays_zip("item_slots", "slots"), lambda p, j: F.struct((F.col("item_place") + j).alias("at"), p["item_slots"].alias("a"), p["slots"].alias("b"))), lambda p: p["a"] != 0
    )
    alignment = ["key", "item_id", "offset"]
    aligned = found.join(items, ["hash", "length"]).select("key", "id", "item_id", (F.col("place") - F.col("item_place")).alias("offset"), "item_place", pairs.alias("pairs"))
    aligned = materialise(aligned)
    slots = aligned.select(*alignment, F.explode("pairs").alias("p")).select(*alignment, "p.at", "p.a", "p.b").distinct()
    counted = slots.groupBy(*alignment, "a", "b").agg(F.count("*").alias("n"))
    ranked = counted.groupBy(*alignment, "a").agg(F.array_sort(F.collect_list(F.struct("n", (F.col("a") == F.col("b")).alias("verbatim"), "b"))).alias("all")).where(F.size("all") > 1)
    others = ranked.select(*alignment, "a", F.explode(F.slice("all", 1, F.size("all") - 1)).alias("o"))
    conflicts = others.groupBy(*alignment).agg(F.collect_set(F.xxhash64("a", "o.b")).alias("conflicts"))
    conflicts = conflicts.select(*[F.col(c).alias(f"_{c}") for c in alignment], "conflicts")
    aligned = aligned.join(conflicts, (F.col("key") == F.col("_key")) & F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("offset") == F.col("_offset")), "left")
    verbatim = F.forall("pairs", lambda p: p["a"] == p["b"])
    agrees = F.col("conflicts").isNull() | ~F.arrays_overlap(F.transform("pairs", lambda p: F.xxhash64(p["a"], p["b"])), "conflicts")
    return (
        aligned.where(verbatim | agrees)
        .groupBy("key", "id", "item_id")
        .agg(F.count_distinct("item_place").alias("n_matched"))
        .join(sizes.withColumnRenamed("item_id", "same_item"), F.col("item_id").eqNullSafe(F.col("same_item")))
        .where(F.col("n_matched") >= threshold * F.col("n_windows"))
        .select(F.col("key").alias("row_key"), F.col("id").alias("doc_id"), "item_id", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    bad = materialise(contaminated(docs, benchmark, id_col, text_col).select(F.col("row_key").alias("_key")).distinct())
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_key(id_col, text_col).alias("_key"))
    return packed.join(bad, "_key", "left_anti").select("_row.*")
