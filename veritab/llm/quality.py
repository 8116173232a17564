"""Quality by importance resampling.

Two bag-of-n-grams models over hashed words and word pairs: one of the target
(texts that labels mark as good), one of all raw text. A document's log importance
weight is the log ratio of its probabilities under them; a seeded Gumbel variable
is added, and the documents with the highest sums are a sample without
replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm._runtime import materialise
from veritab.llm._words import GOLDEN, U64, mix, pieces, words

LEAST = 10_000
TASKS_A_CORE = 4  # that count n-grams: each sends a row for each bucket it has seen, so their number is that of the cluster's cores, not of the input's files


def ngram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, bucket) of each word and each pair of neighbouring words."""
    w = words(texts)
    same = w.doc[1:] == w.doc[:-1]
    pair = mix(w.hash[:-1][same] * GOLDEN + w.hash[1:][same]) if len(w.hash) else w.hash
    doc = np.concatenate([w.doc, w.doc[1:][same]])
    return doc, (np.concatenate([w.hash, pair]) % U64(buckets)).astype(np.int64), len(texts)


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many n-grams of the texts fall in each bucket.

    Each task adds up its whole partition, so at most ``buckets`` rows a task are shuffled,
    and there are at most TASKS_A_CORE tasks for each core of the cluster.
    """
    tasks = TASKS_A_CORE * texts.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for piece in pieces(batches, "text"):
            n += np.bincount(ngram_buckets(piece.column(0), buckets)[1], minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])

    return texts.select("text").coalesce(tasks).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, buckets: int) -> np.ndarray:
    """The share of each bucket, with one n-gram added to each: a table of ``buckets`` numbers."""
    rows, n = counts.toPandas(), np.ones(buckets)
    n[rows["bucket"].to_numpy(np.int64)] += rows["n"].to_numpy(np.int64)
    return n / n.sum()


def with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` (a long) is among ``ids``, by a join with bitmaps of them."""
    group, place = F.bitmap_bucket_number("id"), F.bitmap_bit_position("id")
    bits = materialise(ids.where("id is not null").groupBy(group.alias("_group")).agg(F.bitmap_construct_agg(place).alias("_bits")))
    byte = F.conv(F.hex(F.substr("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftleft(1, cast(bitmap_bit_position(id) & 7 as int))").bitwiseAND(byte) != 0
    return rows.withColumn("_group", group).join(bits, "_group").where(is_set).drop("_group", "_bits")


def bucket_number(rows: int) -> int:
    """LEAST buckets, or as many as grow with the square root of the number of documents, so that a larger corpus is told apart
    by more of them, and the tables still fit each task: 22,000 for 50,000 documents, 22 million for 5e10."""
    return max(LEAST, int(np.ceil(100 * np.sqrt(rows))))


def gumbel(id_col: str, seed: int):
    """A seeded standard Gumbel variable for each id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 11)
    return -F.log(-F.log((bits + F.lit(0.5)) * F.lit(2.0**-53)))


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                        share: float = 0.5, seed: int = 23, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_ngrams, log_weight, gumbel_key, selected.

    The highest ``share`` of all rows by key (log weight plus Gumbel variable; ties by
    id, then by row) is selected: exactly ceil(share * rows). Null and empty texts
    have no n-grams and log weight 0. A document is good if any of its labels is 1;
    without good documents all log weights are those of an even target. Other
    columns are ignored; an empty table gives an empty result. ``buckets``: by default
    ``bucket_number`` of the documents. Raw counts need no join; those of the target join
    texts with bitmaps of the good ids, a row of 4 KB for 32,768 ids in a row, which Spark
    broadcasts while their table is small (as it is written, so its size is known).
    """
    buckets = buckets or bucket_number(docs.count())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    target = with_ids(texts, labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id")))
    ratio = np.log(probabilities(bucket_counts(target, buckets), buckets)) - np.log(probabilities(bucket_counts(texts, buckets), buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            doc, bucket, n = ngram_buckets(piece.column(3), buckets)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:3], pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, ratio[bucket], n))],
                names=["doc_id", "rid", "gumbel", "n_ngrams", "log_weight"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), gumbel(id_col, seed).alias("gumbel"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, rid long, gumbel double, n_ngrams long, log_weight double")
    scored = materialise(scored.withColumn("gumbel_key", F.col("log_weight") + F.col("gumbel")).drop("gumbel"))
    return select_top(scored, "gumbel_key", share).drop("rid")


def select_top(rows: DataFrame, key: str, share: float, cells: int = 4096, few: int = 100_000) -> DataFrame:
    """``rows`` with ``selected``: whether among the highest ``share`` by (key, doc_id, rid); a null id is below all others.

    The range of the keys is cut into cells, and the cell in which the border lies again,
    until it holds ``few`` rows or a single key; then the ids of that key are cut likewise, and
    at last the row numbers, which differ. So never more than ``few`` rows are put in order in one task.
    """
    total = rows.count()
    if not total:
        return rows.withColumn("selected", F.lit(True))
    left, above, inside, n = int(np.ceil(share * total)), F.lit(False), F.lit(True), total
    for c in (key, "doc_id", "rid"):
        if n <= few:
            break
        here, low, high = rows.where(inside).agg(F.count(c), F.min(c), F.max(c)).first()
        if left > here:
            above, inside, left, n = above | (inside & F.col(c).isNotNull()), inside & F.col(c).isNull(), left - here, n - here
            continue
        inside, n = inside & F.col(c).isNotNull(), here
        value = F.col(c) if isinstance(low, float) else F.col(c).cast("decimal(20,0)")  # so that the distance of two longs is no overflow
        while n > few and low < high:
            cell = F.least(F.floor((value - F.lit(low)) / F.lit((high - low) / cells)), F.lit(cells - 1)).cast("int")
            counts = rows.where(inside).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).orderBy(F.desc("cell")).collect()
            for found in counts:
                n, low, high = found.n, found.low, found.high
                if n >= left:
                    break
                left -= n
            above, inside = above | (inside & (F.col(c) > high)), inside & F.col(c).between(low, high)
    order = [F.desc(key), F.desc_nulls_last("doc_id"), F.desc("rid")]
    border = rows.where(inside).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    last = border.where(F.col("_n") == left).select(F.struct(key, "doc_id", "rid").alias("last")).first()
    if last is None:
        return rows.withColumn("selected", above)
    k, i, r = last.last
    tie = (F.col("doc_id") > i) | (F.col("doc_id").eqNullSafe(F.lit(i)) & (F.col("rid") >= r)) if i is not None else F.col("doc_id").isNotNull() | (F.col("rid") >= r)
    return rows.withColumn("selected", above | (inside & ((F.col(key) > k) | ((F.col(key) == k) & F.coalesce(tie, F.lit(False))))))
