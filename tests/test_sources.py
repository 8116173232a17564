"""Pages of files, extraction with a ledger, pages of rows, the audit log, and patterns by day."""

import datetime
import json
import zlib

import pytest
from pyspark.sql import functions as F

from veritab.operators import learn, store
from veritab.schemas import CORRECTIONS
from veritab.sources import ledger
from veritab.sources.pages import PdfPages


def pdf(texts, packed=True, broken=()):
    """A small file with a page for each text."""
    parts = [b"%PDF-1.5", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(texts))) + b"] >> endobj"]
    for i, text in reversed(list(enumerate(texts))):  # the tree has the order, not the file
        data = b"BT /F1 12 Tf (" + text.encode("latin-1").replace(b"(", rb"\(").replace(b")", rb"\)") + b") Tj T* <4f4b> Tj ET"
        data = zlib.compress(data) if packed else data
        data = b"xx" + data[5:] if i in broken else data
        parts.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj" % (10 + 2 * i, 11 + 2 * i))
        parts.append(b"%d 0 obj << /Length %d%s >>\nstream\n" % (11 + 2 * i, len(data), b" /Filter /FlateDecode" if packed else b"") + data + b"\nendstream endobj")
    return b"\n".join(parts) + b"\n%%EOF"


def test_pages_of_files(spark, tmp_path):
    spark.dataSource.register(PdfPages)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(pdf([f"page {k} (max 3.3 V) é" for k in range(7)], broken=(4,)))
    (tmp_path / "sub/b.PDF").write_bytes(pdf(["one"], packed=False))
    (tmp_path / "long.pdf").write_bytes(pdf(["x"] * 9))
    (tmp_path / "bad.pdf").write_bytes(b"text")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    rows = spark.read.format("pdf_pages").option("max_pages", 8).option("pages_per_task", 3).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3 + 1 + 1 + 1  # ranges of a.pdf, and each other file
    got = {(r.path.rsplit("/", 1)[1], r.page): r for r in rows.collect()}
    assert [got["a.pdf", k].text for k in range(7)] == [None if k == 4 else f"page {k} (max 3.3 V) é\nOK" for k in range(7)]
    assert got["a.pdf", 4].failed and got["a.pdf", 4].error and got["a.pdf", 4].pages == 7
    assert got["b.PDF", 0].text == "one\nOK"
    assert got["long.pdf", None].error == "9 pages, at most 8 are read" and got["bad.pdf", None].error == "not a PDF" and len(got) == 10


def extractors():
    """Page 1 answers at its third attempt, page 2 only to the other extractor, page 3 never. (Made here, as the workers cannot import this file.)"""

    def answer(row):
        if row.page == 1 and row.attempt < 3 or row.page in (2, 3):
            return ValueError(f"429 at {row.attempt}")
        more = [{"id": "extra", "value": 9, "label": "only once", "origin": [0.9, 0.9]}] if row.prompt == "recall" else []
        return json.dumps({"units": [{"id": "u", "value": 3.3, "label": "VCC", "unit_of_measure": "V", "origin": [0.1, 0.1]}, *more]})

    def first(batch):
        return [answer(r) for r in batch.itertuples()]

    def other(batch):
        if (batch["page"] == 3).any():
            raise RuntimeError("the whole batch fails")
        return ["{}"] * len(batch)

    return [first, other]


def test_extraction_with_a_ledger(spark, tmp_path):
    path, waited = str(tmp_path / "ledger"), []
    pages = spark.createDataFrame([("d", k) for k in range(4)], "doc_id string, page int").repartition(4)
    twice = pages.where("page < 2")
    log = ledger.extract_all(pages, extractors(), path, twice, attempts=4, sleep=None)
    got = {(r.page, r.prompt): (r.attempts, r.done, r.last_error) for r in ledger.attempts_of(log).collect()}
    assert got == {
        (0, "precision"): (1, True, None), (0, "recall"): (1, True, None), (1, "precision"): (3, True, "429 at 2"), (1, "recall"): (3, True, "429 at 2"),
        (2, "precision"): (5, True, "429 at 4"), (3, "precision"): (8, False, "the whole batch fails"),
    }
    rows = log.count()
    again = ledger.extract_all(pages, extractors(), path, twice, attempts=4, sleep=waited.append)
    assert again.count() == rows and waited == []  # what is done or given up is not tried again
    merged, agreement = ledger.dual_units(log)
    assert sorted((r.page, r.id, r.side) for r in merged.collect()) == [(0, "extra", "b"), (0, "u", "both"), (1, "extra", "b"), (1, "u", "both")]
    assert {r.page: r.agreement for r in agreement.collect()} == {0: pytest.approx(0.5), 1: pytest.approx(0.5)}


def test_a_run_is_resumed_after_its_time(spark, tmp_path):
    path, waited = str(tmp_path / "ledger"), []
    spark.createDataFrame([("d", 0, "precision", 1, "{}", None), ("d", 1, "precision", 2, None, "429")], ledger.ROW).withColumn("at", F.current_timestamp()).write.parquet(path)
    pages = spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, page int")
    log = ledger.extract_all(pages, extractors()[:1], path, sleep=waited.append)
    assert {(r.page, r.attempts, r.done) for r in ledger.attempts_of(log).collect()} == {(0, 1, True), (1, 3, True)}
    assert len(waited) == 1 and 4 < waited[0] <= 16  # the second failure waits for 16 seconds


def test_pages_of_rows(spark):
    rows = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("k"), F.col("id").alias("v"))
    keys = sorted(i * 7919 % 300_007 for i in range(300_000))
    pages = store.Pages(rows.repartition(3), ["k", "v"])
    assert [r.k for r in pages.page(2, 2 * 100_000).collect()] == keys[200_000:200_002]
    assert [r.k for r in pages.page(5, 299_998).collect()] == keys[299_998:] and pages.page(5, 300_000).count() == 0
    last = pages.page(1, 149_999).first()
    assert [r.k for r in pages.after((last.k, last.v), 70_000).collect()] == keys[150_000:220_000]
    assert [r.k for r in pages.after((-1, 0), 3).collect()] == keys[:3]
    plan = pages.page(2, 200_000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan and len(pages.ranges) > 1
    none = store.Pages(rows.where("false"), ["k", "v"])
    assert none.page(5).count() == 0 and none.after((1, 1), 5).count() == 0


def test_audit_append(spark, tmp_path):
    path = str(tmp_path / "audit")
    for action in ("query", "upload", "query"):
        store.append_audit(spark.createDataFrame([("d", action, "me", '{"a": 1}')], "doc_id string, action string, actor string, details_json string"), path)
    got = spark.read.parquet(path).orderBy("created_at").collect()
    assert [r.action for r in got] == ["query", "upload", "query"] and len({r.id for r in got}) == 3


def test_patterns_of_days_equal_those_of_all(spark):
    at = lambda k: datetime.datetime(2024, 1, 1 + k % 5)
    rows = [(i, f"d{i % 7}", "u", ["unit", "grid"][i % 2], "correct" if i % 9 else "confirm", ["1 mV", "10 V", "therml", "0 x"][i % 4], ["1 V", "1 V", "thermal", "x"][i % 4], "me", None, at(i)) for i in range(60)]
    log = spark.createDataFrame(rows, CORRECTIONS)
    whole = {tuple(map(str, r)) for r in learn.patterns(log).collect()}
    days = [learn.daily(log.where(F.dayofmonth("created_at") == d)) for d in (3, 1, 5, 2, 4)]
    state = days[0]
    for one in days[1:]:
        state = one.unionByName(state)
    assert {tuple(map(str, r)) for r in learn.merged(state).collect()} == whole and len(whole) >= 5
    assert {tuple(map(str, r)) for r in learn.merged(days[0].where("false")).collect()} == set()
