"""Arriving pages: late and repeated ones, snapshots and deltas, phases and counts."""

import json

import pytest
from pyspark.sql import functions as F

from veritab.streaming import ingest


def page(doc, number, **units):
    facts = [{"id": k, "value": v, "origin": [0, 0]} for k, v in units.items()]
    return {"doc_id": doc, "page": number, "json": json.dumps({"units": facts})}


class Feed:
    """A stream whose batches are given one by one."""

    def __init__(self, spark, folder, **options):
        self.spark, self.source, self.table, self.folder, self.options, self.n = spark, folder / "in", str(folder / "out"), folder, options, 0
        self.source.mkdir()

    def batch(self, *pages):
        (self.source / f"{self.n:04}.json").write_text("".join(json.dumps(p) + "\n" for p in pages))
        self.n += 1
        ingest.follow(self.spark, str(self.source), self.table, str(self.folder / "checkpoint"), **self.options).awaitTermination()

    def units(self, **more):
        return {(r.doc_id, r.page, r.id): r.value_num for r in ingest.current(self.spark, self.table, **more).collect()}


def test_late_and_repeated_pages(spark, tmp_path):
    feed = Feed(spark, tmp_path, compact_every=2)
    want = {}
    for k in range(3):
        feed.batch(page("d", 0, u=float(k), **{f"only{k}": 1.0}), page(f"e{k}", 0, v=1.0))
        want = {w: x for w, x in want.items() if w[:2] != ("d", 0)} | {("d", 0, "u"): float(k), ("d", 0, f"only{k}"): 1.0, (f"e{k}", 0, "v"): 1.0}
        assert feed.units() == want
    feed.batch(page("e0", 1, w=7.0), page("d", 0))  # a late page, and one that is empty now
    want = {w: x for w, x in want.items() if w[:2] != ("d", 0)} | {("e0", 1, "w"): 7.0}
    assert feed.units() == want and feed.units(documents=["e0"]) == {("e0", 0, "v"): 1.0, ("e0", 1, "w"): 7.0} and feed.units(documents=[]) == {}
    generation, upto, valid = ingest.committed(spark, feed.table)
    assert generation == 2 and upto == 3 and sorted(b for own in valid.values() for b in own) == sorted({r.b for r in spark.createDataFrame([(x,) for x in ["d", *[f"e{k}" for k in range(3)]]], "d string").select(ingest.bucket(F.col("d")).alias("b")).collect()})
    pages = {(r.doc_id, r.page) for r in ingest.current(spark, feed.table, "pages").collect()}
    assert pages == {("d", 0), ("e0", 1), *((f"e{k}", 0) for k in range(3))}


def test_reading_does_not_grow_with_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, compact_every=2)
    read = []
    for k in range(4):
        feed.batch(page("d", 0, u=float(k)))
        files = {f for part in ingest.stored(spark, feed.table, "units") if part is not None for f in part.inputFiles() if f"batch={k}" in f or "generation" in f}
        deltas = [r.batch for r in spark.read.parquet(f"{feed.table}/deltas/units").select("batch").distinct().collect()]
        read.append((len(files), len(deltas)))
    assert max(f for f, _ in read) <= 4 and max(d for _, d in read) <= 3
    assert feed.units() == {("d", 0, "u"): 3.0}


def test_compaction_survives_an_interrupted_run(spark, tmp_path):
    feed = Feed(spark, tmp_path, compact_every=100)
    feed.batch(page("d", 0, u=1.0))
    feed.batch(page("d", 0, u=2.0))
    spark.range(3).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{feed.table}/snapshot/units/generation=1")  # left by a run that did not get to its log
    assert feed.units() == {("d", 0, "u"): 2.0}
    assert ingest.compact(spark, feed.table) == {"generation": 1, "upto": 1, "buckets": 1}
    assert feed.units() == {("d", 0, "u"): 2.0} and ingest.compact(spark, feed.table) is None


def test_a_page_twice_in_a_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.batch(page("d", 0, u=1.0, x=1.0), page("d", 0, u=3.0), page("d", 0, u=2.0))
    assert feed.units() == {("d", 0, "u"): 3.0}


def test_phases_and_counts(spark, tmp_path):
    heard = []
    feed = Feed(spark, tmp_path, report=heard.append, compact_every=2)
    before = list(heard)
    feed.batch(page("d", 0, u=1.0, v=2.0), {"doc_id": "d", "page": 1, "json": "no json"})
    feed.batch(page("e", 0, u=1.0))
    for listener in list(getattr(spark.streams, "_listeners", [])):
        spark.streams.removeListener(listener)
    phases = [x["phase"] for x in heard[len(before) :]]
    stored = [x for x in heard if x["phase"] == "stored"]
    assert [(x["batch"], x["units"], x["pages"]) for x in stored] == [(0, 2, 2), (1, 1, 1)]
    assert phases.count("folded") == 1 and "started" in phases
    arrived = {x["batch"]: x for x in heard if x["phase"] == "arrived" and x["rows"]}
    assert (arrived[0]["rows"], arrived[0]["pages"]) == (2, 2) and arrived[0]["bytes"] > 10


@pytest.mark.parametrize("kind", sorted(ingest.KINDS))
def test_a_batch_is_parsed_once(spark, kind):
    rows = ingest.parsed(spark.createDataFrame([("d", 0, '{"units": []}')], "doc_id string, page int, json string"))
    assert ingest.parsed(rows) is rows
    ingest.KINDS[kind][0](rows).collect()
