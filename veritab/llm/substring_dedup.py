"""Substring deduplication by distributed prefix doubling.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts earlier.
Positions are ranked by the strings that start there: equal ranks, equal strings.

Ranking every byte of a corpus would shuffle many times its size, so positions are
retired before: of all strings of ``GRAM`` bytes in a string of ``LENGTH`` bytes, the
one with the smallest hash is its anchor; equal strings have equal anchors at equal
places, and a string whose anchor is unique in the corpus is unique. Neighbouring starts
with one anchor are one row. Of anchors whose whole surroundings are equal, all but the
first are copies throughout. Anchors still in doubt are held against each other by longer
strings to their left and right, and what is unique then is retired too.

The positions that are left are ranked by prefix doubling. Their first ranks are those of
strings of ``FIRST`` bytes, at p, p + FIRST, and so on; in each round Spark sorts the pairs
(rank at p, rank at p + width), gives each pair that occurs more than once its place in
that order as the new rank, retires the positions of all other pairs, and doubles the
width, until it is ``LENGTH``: all but the first position of each pair are later copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm._runtime import materialise
from veritab.llm._words import U64, hash_ranges, mix, pieces, prefix_hash, runs, text_bytes

LENGTH, GRAM, FIRST = 100, 48, 25
WINDOW = LENGTH - GRAM + 1
REACH = WINDOW // 2  # a string of LENGTH bytes has this much more than its anchor's gram on one side at least
PLACE = U64((1 << 30) - 1)

ANCHORS = "rank long, spread long, around long, doc_id long, row_key long, at long, copy boolean"
NAMES = [c.split()[0] for c in ANCHORS.split(", ")]
SPANS = "doc_id long, row_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    cells = padded.reshape(-1, width)
    to_here = np.minimum.accumulate(cells, axis=1).ravel()
    from_here = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_here[: n - width + 1], to_here[width - 1 : n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray):
    """(first start, last start, anchor, document, rank, hash of the surroundings) of each run of starts of whole strings with one anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.view(U64), none.view(U64)
    total = prefix_hash(data)
    n = len(data) - GRAM + 1
    gram = np.arange(n)
    value = hash_ranges(total, gram, gram + GRAM)
    best = (sliding_min((value & ~PLACE) | gram.astype(U64), WINDOW) & PLACE).astype(np.int64)
    inside = np.ones(len(best) + 1, bool)
    inside[-1] = False
    size = np.diff(offsets)
    tail, _ = runs(np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), np.minimum(size, LENGTH - 1))
    inside[tail[tail < len(best)]] = False
    same = np.zeros(len(best), bool)
    same[1:] = (best[1:] == best[:-1]) & inside[: len(best) - 1]
    lo = np.flatnonzero(inside[:-1] & ~same)
    ends = np.ones(len(best), bool)
    ends[:-1] = ~(same[1:] & inside[1:-1])
    hi = np.flatnonzero(inside[:-1] & ends)
    around = mix(hash_ranges(total, lo, hi + LENGTH) + (best[lo] - lo).astype(U64))
    return lo, hi, best[lo], np.searchsorted(offsets, lo, side="right") - 1, value[best[lo]], around


def anchors(docs: DataFrame) -> DataFrame:
    """Anchors of all texts. ``at`` packs the first start, how far from it the anchor is, and how many more starts there are
    (the last two in six bits each).

    What has equal surroundings earlier in the same batch is a ``copy`` already, and gets a
    rank of its own. Where a batch has an anchor in several surroundings, its rows are in
    doubt already: they are spread by their surroundings, and two markers (``at`` -1) tell
    the others of that rank. So no (rank, spread) has more than a few rows a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            data, offsets = text_bytes(piece.column(2))
            lo, hi, anchor, doc, rank, around = anchor_runs(data, offsets)
            if not len(lo):
                continue
            ids, keys = piece.column(0).take(pa.array(doc)), piece.column(1).take(pa.array(doc))
            number = np.nan_to_num(piece.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False))
            place = np.empty(piece.num_rows, np.int64)
            by_id = np.lexsort((piece.column(1).to_numpy(), number))
            new = np.ones(len(by_id), bool)
            new[1:] = (number[by_id][1:] != number[by_id][:-1]) | (piece.column(1).to_numpy()[by_id][1:] != piece.column(1).to_numpy()[by_id][:-1])
            place[by_id] = np.cumsum(new)
            at = lo - offsets[doc]
            order = np.lexsort((at, place[doc], around, rank))
            first = np.ones(len(order), bool)
            first[1:] = (rank[order][1:] != rank[order][:-1]) | (around[order][1:] != around[order][:-1])
            leader = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            again = ~first & (place[doc][order] == place[doc][order][leader]) & (at[order] == at[order][leader])  # a repeated row
            copy, drop = np.zeros(len(order), bool), np.zeros(len(order), bool)
            copy[order], drop[order] = ~first & ~again, again
            own = mix(keys.to_numpy().view(U64) ^ at.astype(U64) * U64(0x9E3779B97F4A7C15))
            by_rank = rank[order]
            edge = np.flatnonzero(np.append(True, by_rank[1:] != by_rank[:-1]))
            last = np.append(edge[1:], len(order)) - 1
            several = around[order][edge] != around[order][last]  # sorted: the first and the last surroundings of each rank
            spread = np.zeros(len(order), U64)
            spread[order] = np.where(np.repeat(several, last - edge + 1), around[order], U64(0))
            rank, around, spread = np.where(copy, own, rank), around, np.where(copy, U64(0), spread)
            columns = [pa.array(x.view(np.int64)) for x in (rank, spread, around)]
            columns += [ids, keys, pa.array((at << 12) | ((anchor - lo) << 6) | (hi - lo)), pa.array(copy)]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES).filter(pa.array(~drop))
            if several.any():
                mark = np.concatenate([order[edge[several]], order[last[several]]])
                n = len(mark)
                columns = [pa.array(by_rank[np.concatenate([edge[several], last[several]])].view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(around[mark].view(np.int64))]
                columns += [pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, -1)), pa.array(np.zeros(n, bool))]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return docs.mapInArrow(run, ANCHORS)


def doubtful_spans(docs: DataFrame, doubt: DataFrame) -> DataFrame:
    """For each anchor in doubt: its bytes from the first start to the end of the last string, and the ranks of the gram
    with REACH more bytes to its left and right (null: the text does not reach so far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            data, offsets = text_bytes(piece.column(2))
            total, at = prefix_hash(data), piece.column(3)
            flat = at.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(piece.num_rows), np.diff(at.offsets.to_numpy()))
            lo = offsets[:-1][doc] + (flat >> 12)
            anchor, end = lo + (flat >> 6 & 63), lo + (flat & 63) + LENGTH
            left, right = anchor - REACH, anchor + GRAM + REACH
            no_left, no_right = left < offsets[:-1][doc], right > offsets[1:][doc]
            to_left = hash_ranges(total, np.where(no_left, anchor, left), anchor + GRAM).view(np.int64)
            to_right = hash_ranges(total, anchor, np.where(no_right, anchor, right)).view(np.int64)
            spans = pa.array([data[x:y].tobytes() for x, y in zip(lo, end, strict=True)], pa.binary())
            who = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(who), piece.column(1).take(who), pa.array(flat), pa.array(to_left, mask=no_left), pa.array(to_right, mask=no_right), spans],
                names=["doc_id", "row_key", "at", "left", "right", "bytes"],
            )

    by_doc = doubt.groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("at"))
    return joined(docs, by_doc, "inner").mapInArrow(run, "doc_id long, row_key long, at long, left long, right long, bytes binary")


def doubtful_positions(spans: DataFrame) -> DataFrame:
    """(pos, r0, r1, ...): for each start still in doubt, its number (the span's, and its place in the span) and the ranks of
    the strings of FIRST bytes at p, p + FIRST, ..."""
    names = [f"r{i}" for i in range(LENGTH // FIRST)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                piece = batch.slice(i, 5000)
                span, at, on_left, on_right = (piece.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                held = piece.column(4).cast(pa.large_binary())
                offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
                data = np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets[:-1] - offsets[0]
                _, place = runs(np.zeros(len(at), np.int64), (at & 63) + 1)
                who = np.repeat(np.arange(len(at)), (at & 63) + 1)
                before = (at >> 6 & 63)[who] - place
                keep = (on_left[who] & (before >= REACH)) | (on_right[who] & (before <= LENGTH - GRAM - REACH))
                who, place = who[keep], place[keep]
                total, begin = prefix_hash(data), offsets[who] + place
                ranks = [pa.array(hash_ranges(total, begin + k, begin + k + FIRST).view(np.int64)) for k in range(0, LENGTH, FIRST)]
                yield pa.RecordBatch.from_arrays([pa.array(span[who] * 64 + place), *ranks], names=["pos", *names])

    shared = lambda side: spans.where(f"{side} is not null").groupBy(side).agg(F.count("*").alias(f"n_{side}")).where(f"n_{side} > 1")
    both = spans.join(shared("left"), "left", "left").join(shared("right"), "right", "left")
    both = both.select("span", "at", F.col("n_left").isNotNull().alias("on_left"), F.col("n_right").isNotNull().alias("on_right"), "bytes")
    return both.where("on_left or on_right").mapInArrow(run, "pos long, " + ", ".join(f"{n} long" for n in names))


def joined(docs: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    d, b = docs.alias("d"), by_doc.alias("b")
    same = (F.col("d.row_key") == F.col("b.row_key")) & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
    return d.join(b, same, how).select("d.doc_id", "d.row_key", "d.text", "b.at")


def reranked(positions: DataFrame, one: str, two: str, rank: str) -> DataFrame:
    """``positions`` with the pair of two ranks replaced by its place among all sorted pairs; those of a unique pair are retired."""
    pairs = positions.groupBy(one, two).agg(F.count("*").alias("_n")).where("_n > 1").select(one, two)
    ranks = pairs.orderBy(one, two).withColumn(rank, F.monotonically_increasing_id())  # grows along the sort
    return positions.join(ranks, [one, two]).drop(one, two)


def later_copies(positions: DataFrame, first: int = FIRST, length: int = LENGTH) -> DataFrame:
    """(pos) of the positions whose string of ``length`` bytes starts earlier, by prefix doubling on the ranks r0, r1, ... of ``first`` bytes."""
    width, names = first, [c for c in positions.columns if c != "pos"]
    while 2 * width < length:
        width, doubled = 2 * width, []
        for i in range(0, len(names), 2):
            doubled.append(f"w{width}_{i // 2}")
            positions = materialise(reranked(positions, names[i], names[i + 1], doubled[-1]))
        names = doubled
    earliest = positions.groupBy(*names).agg(F.min("pos").alias("earliest"), F.count("*").alias("_n")).where("_n > 1").select(*names, "earliest")
    return positions.join(earliest, names).where("pos > earliest").select("pos")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Earlier means a smaller id (null first), or the same document and an earlier
    start; of rows with the same id, texts are ordered by a hash of theirs, and a
    repeated row is later than itself. Null texts are empty; texts below LENGTH bytes
    stay whole. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    class_ = Window.partitionBy("rank", "spread", "around", "marker").orderBy("doc_id", "row_key", "at")
    rank_ = Window.partitionBy("rank", "spread")
    found = anchors(rows).withColumn("marker", F.col("at") < 0).repartition("rank", "spread")
    found = found.withColumn("n", F.rank().over(class_)).withColumn("several", (F.col("spread") != 0) | (F.min("around").over(rank_) != F.max("around").over(rank_)))
    known = materialise(found.where("not marker").select("doc_id", "row_key", "at", (F.col("copy") | (F.col("n") > 1)).alias("copy"), "several").where("copy or several").drop("several"))
    # numbered in order of documents and places, so that an earlier position has a smaller number
    doubt = doubtful_spans(rows, known.where("not copy")).dropDuplicates(["doc_id", "row_key", "at"]).orderBy("doc_id", "row_key", "at")
    doubt = materialise(doubt.withColumn("span", F.monotonically_increasing_id()))
    later = materialise(later_copies(doubtful_positions(doubt)))
    later = later.select(F.shiftright("pos", 6).alias("span"), F.col("pos").bitwiseAND(F.lit(63)).alias("place"))
    more = later.join(doubt.select("span", "doc_id", "row_key", "at"), "span").select("doc_id", "row_key", (F.shiftright("at", 12) + F.col("place")).alias("p"))
    spans = known.where("copy").select("doc_id", "row_key", "at").unionByName(more.select("doc_id", "row_key", (F.col("p") * 4096).alias("at")))
    by_doc = spans.groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            data, offsets = text_bytes(piece.column(2))
            found = []
            for i, at in enumerate(piece.column(3)):
                text = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                if at.is_valid:
                    at = at.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, at >> 12, 1)
                    np.add.at(edge, (at >> 12) + (at & 63) + LENGTH, -1)
                gone = np.cumsum(edge)[:-1] > 0
                found.append((len(text), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            n, removed, runs_, digest = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(digest)], names=["doc_id", "row_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = joined(rows, by_doc, "left").mapInArrow(run, SPANS)
    again = (F.row_number().over(Window.partitionBy("doc_id", "row_key").orderBy("n_bytes")) > 1) & (F.col("n_bytes") >= LENGTH)
    return done.withColumn("again", again).select(
        "doc_id",
        "n_bytes",
        F.when(F.col("again"), F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(F.col("again"), F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(F.col("again"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
