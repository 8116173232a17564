"""Extractions that arrive as files, kept up to date in a table; and usage by windows of time.

What a batch holds is a folder of its own (a delta). After some batches the deltas are
folded into a snapshot, which is divided by document: only the parts whose documents came
are written again. Reading takes the snapshot and the few deltas after it, however
many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import IntegerType, LongType, StructType

from veritab.operators.checks import latest
from veritab.schemas import PAGE_EXTRACTIONS
from veritab.sources.extractions import bijections, grids, ingest_counts, page_status, parsed, units

Report = Callable[[dict], None]
#: What is kept of arriving pages, and what names a row of it.
KINDS = {"units": (units, ["doc_id", "page", "id"]), "bijections": (bijections, ["doc_id", "page", "id"]), "grids": (grids, ["doc_id", "page", "id"]), "pages": (page_status, ["doc_id", "page"])}
BUCKETS = 64  # parts of a snapshot
LOG = "generation long, upto long, buckets array<int>"


def arriving_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages (doc_id, page, json) with the time their file was written."""
    return spark.readStream.schema(PAGE_EXTRACTIONS).json(path).select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def last_of_each(batch: DataFrame) -> DataFrame:
    """Of a page that came several times, the one written last (of one time, the largest text)."""
    return batch.groupBy("doc_id", "page").agg(F.max_by("json", F.struct("arrived", "json")).alias("json"))


class Progress(StreamingQueryListener):
    """Tells ``report`` what a stream does: {"phase": started, arrived, stored, folded, done or failed, ...}."""

    def __init__(self, report: Report) -> None:
        self.report = report

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.report({"phase": "started"})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get("arrived")
        self.report({"phase": "arrived", "batch": p.batchId, "rows": p.numInputRows, "pages": seen["pages"] if seen else None, "bytes": seen["bytes"] if seen else None})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.report({"phase": "failed", "error": event.exception} if event.exception else {"phase": "done"})


def bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(""))), F.lit(BUCKETS)).cast("int")


def read_or_none(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame | None:
    """A table, or none where nothing has been written yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return None
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def committed(spark: SparkSession, table: str) -> tuple[int, int, dict[int, list[int]]]:
    """(last generation, last batch in the snapshot, generation -> the buckets that it has the last word on)."""
    log = read_or_none(spark, f"{table}/log", LOG)
    rows = sorted(log.collect(), key=lambda r: r.generation) if log is not None else []
    of_bucket = {b: r.generation for r in rows for b in r.buckets}
    by_generation: dict[int, list[int]] = {}
    for b, g in of_bucket.items():
        by_generation.setdefault(g, []).append(b)
    return (rows[-1].generation, rows[-1].upto, by_generation) if rows else (0, -1, {})


def stored(spark: SparkSession, table: str, kind: str, buckets: Column | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The snapshot's rows (in some buckets, or all), and those of the deltas after it."""
    _, upto, generations = committed(spark, table)
    deltas = read_or_none(spark, f"{table}/deltas/{kind}")
    snapshot = None
    if generations and deltas is not None:  # a snapshot without any row has no file that would tell its columns
        columns = StructType([f for f in deltas.schema.fields if f.name != "batch"]).add("generation", LongType()).add("bucket", IntegerType())
        snapshot = read_or_none(spark, f"{table}/snapshot/{kind}", columns)
    if snapshot is not None:
        valid = F.lit(False)
        for g, own in generations.items():
            valid = valid | ((F.col("generation") == g) & F.col("bucket").isin(own))
        snapshot = snapshot.where(valid if buckets is None else valid & buckets).drop("generation", "bucket")
    return snapshot, None if deltas is None else deltas.where(F.col("batch") > upto).drop("batch")


def both(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return b if a is None else a if b is None else a.unionByName(b)


def last_words(rows: DataFrame, pages: DataFrame, kind: str) -> DataFrame:
    """Of a page that came again only what it held last, and of each name one row."""
    last = pages.groupBy("doc_id", "page").agg(F.max("write_seq").alias("write_seq"))
    return latest(rows.join(last, ["doc_id", "page", "write_seq"], "left_semi"), KINDS[kind][1], "write_seq")


def compact(spark: SparkSession, table: str) -> dict | None:
    """Folds the deltas into the snapshot; (what was done, or none if there is nothing to fold).

    Parts of documents that did not come stay as they are. The new generation counts from its row
    in the log on; what an interrupted run has left is written over. Deltas and generations that nothing
    reads any more go.
    """
    generation, upto, _ = committed(spark, table)
    pages = read_or_none(spark, f"{table}/deltas/pages")
    new = pages.where(F.col("batch") > upto).agg(F.max("batch").alias("last"), F.collect_set(bucket(F.col("doc_id"))).alias("buckets")).first() if pages is not None else None
    if new is None or new.last is None:
        return None
    touched = sorted(new.buckets)
    in_touched = F.col("bucket").isin(touched)
    of_pages = both(*stored(spark, table, "pages", in_touched))
    for kind in KINDS:
        rows = both(*stored(spark, table, kind, in_touched))
        if rows is not None:
            rows = last_words(rows, of_pages, kind).withColumn("bucket", bucket(F.col("doc_id")))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/snapshot/{kind}/generation={generation + 1}")
    spark.createDataFrame([(generation + 1, int(new.last), touched)], LOG).coalesce(1).write.mode("append").parquet(f"{table}/log")
    clear(spark, table)
    return {"generation": generation + 1, "upto": int(new.last), "buckets": len(touched)}


def clear(spark: SparkSession, table: str) -> None:
    """Deletes the deltas in the snapshot but the last one, and generations without a last word but the one before the last: what a running reader may still hold."""
    generation, upto, valid = committed(spark, table)
    old = [f"{table}/snapshot/{kind}/generation={g}" for kind in KINDS for g in range(1, generation - 1) if g not in valid]
    for kind in KINDS:
        deltas = read_or_none(spark, f"{table}/deltas/{kind}")
        if deltas is not None:
            old += [f"{table}/deltas/{kind}/batch={r.batch}" for r in deltas.where(F.col("batch") < upto).select("batch").distinct().collect()]
    for path in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def follow(spark: SparkSession, source: str, table: str, checkpoint: str, report: Report | None = None, compact_every: int = 8) -> StreamingQuery:
    """Writes what arriving pages hold to ``table``, batch by batch, and folds ``compact_every`` batches into the snapshot. ``current`` reads the last writes.

    A batch that runs again writes the same folder over. ``report`` hears of phases and counts.
    """
    if report is not None:
        spark.streams.addListener(Progress(report))

    def write(batch: DataFrame, number: int) -> None:
        pages = parsed(last_of_each(batch)).persist()  # parsed once for all kinds
        try:
            counts = {}
            for kind, (make, _) in KINDS.items():
                seen = Observation()
                rows = make(pages).withColumn("write_seq", F.lit(number).cast("long")).observe(seen, F.count(F.lit(1)).alias("n"))
                rows.write.mode("overwrite").parquet(f"{table}/deltas/{kind}/batch={number}")
                counts[kind] = seen.get["n"]
        finally:
            pages.unpersist()
        if report is not None:
            report({"phase": "stored", "batch": number, **counts})
        if number - committed(spark, table)[1] >= compact_every:
            done = compact(spark, table)
            if report is not None and done:
                report({"phase": "folded", "batch": number, **done})

    pages = arriving_pages(spark, source).observe("arrived", F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.octet_length("json")), F.lit(0)).alias("bytes"))
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, kind: str = "units", documents: Iterable[str] | None = None) -> DataFrame:
    """The last written row of each unit, mapping, table or page; of a page that came again, only what it held last.

    Of some ``documents`` only their parts of the snapshot are read.
    """
    wanted = None if documents is None else list(documents)
    in_buckets = None if wanted is None else F.col("bucket").isin([bucket(F.lit(d)) for d in wanted]) if wanted else F.lit(False)
    parts = {k: both(*stored(spark, table, k, in_buckets)) for k in {kind, "pages"}}
    if wanted is not None:
        parts = {k: rows.where(F.col("doc_id").isin(wanted)) if wanted else rows.where("false") for k, rows in parts.items()}
    return last_words(parts[kind], parts["pages"], kind)


def ingested(spark: SparkSession, table: str) -> DataFrame:
    """What has been ingested of each document."""
    return ingest_counts(current(spark, table, "pages"), **{kind: current(spark, table, kind) for kind in ("units", "bijections", "grids")})


def usage_by_window(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each type per window of time (batch or stream); events later than ``late`` are left out of a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")
