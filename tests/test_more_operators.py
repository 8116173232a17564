"""Sources, store operations, consensus and proofs that no query covers."""

import datetime
import json

import facts as fx
import pytest
from pyspark.sql import functions as F

from veritab.operators import compare, consensus, learn, rules, store
from veritab.operators.checks import checkable, unit_normalisation
from veritab.schemas import CORRECTIONS
from veritab.sources import corpus, exports, extractions


def test_uploads(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"text", "c.txt": b"%PDF-"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.rejected for r in extractions.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": None, "b.pdf": "not a PDF", "c.txt": "suffix"}


def test_page_kinds_and_hints(spark):
    kinds = "pinout_table electrical_specs absolute_max_ratings timing_characteristics package_info block_diagram text_description other".split()
    assert sorted(extractions.PAGE_TYPES) == sorted(kinds)
    texts = ["Absolute Maximum Ratings", "Pin Configuration", "Package Outline", "Ordering Information", "nothing", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", extractions.page_type(F.col("t")).alias("kind"))
    got = rows.withColumn("hint", extractions.hint(F.col("kind"))).orderBy("i").collect()
    assert [r.kind for r in got] == ["absolute_max_ratings", "pinout_table", "package_info", "text_description", "other", "other"]
    assert got[1].hint and not got[4].hint


def test_canonical(spark):
    rows = fx.units(spark).limit(3).withColumn("page", F.when(F.col("fact_ord") == 1, -1).otherwise(F.col("page"))).withColumn("id", F.when(F.col("fact_ord") == 2, " ").otherwise(F.col("id")))
    good, bad = extractions.canonical(rows)
    assert good.count() == 1 and bad.count() == 2


def test_migrate_and_populate(spark, tmp_path):
    fx.units(spark).write.parquet(str(tmp_path / "old/units"))
    assert [(r.table, r.n) for r in store.migrate(spark, ["units"], str(tmp_path / "old"), str(tmp_path / "new")).collect()] == [("units", 30)]
    at = lambda d: datetime.datetime(2024, 1, d)
    schema = "content_hash string, mpn string, chip_name string, datasheet_url string, canonical_data string, created_at timestamp"
    old = spark.createDataFrame([("h1", "m1", "c", None, "{}", at(1)), ("h2", "m2", "c", None, "{}", at(1))], schema)
    new = spark.createDataFrame([("h2", "m2", "d", None, "{}", at(2)), ("h2", "m2", "e", None, "{}", at(3))], schema)
    assert {r.content_hash: r.chip_name for r in store.populate(old, new).collect()} == {"h1": "c", "h2": "e"}
    assert corpus.listing(old).count() == 2


def test_projects(spark):
    links = spark.createDataFrame([("p", "a"), ("p", "b")], "project_id string, doc_id string")
    more = store.link(links, spark.createDataFrame([("p", "b"), ("q", "b"), ("q", "b"), ("q", "gone")], links.schema), ["project_id", "doc_id"])
    assert sorted(map(tuple, more.collect())) == [("p", "a"), ("p", "b"), ("q", "b"), ("q", "gone")]
    projects = spark.createDataFrame([("p", "P", "me"), ("q", "Q", "you"), ("r", "R", None)], "project_id string, name string, owner_uid string")
    assert {r.project_id: r.doc_count for r in store.project_counts(projects, more).collect()} == {"p": 2, "q": 2, "r": 0}
    assert [r.project_id for r in store.project_counts(projects, more, "me").collect()] == ["p"]
    documents = spark.createDataFrame([("a", "a.pdf"), ("b", "b.pdf")], "doc_id string, filename string")
    assert [r.filename for r in store.project_documents(more, documents, "q").collect()] == ["b.pdf"]
    assert store.unlink(more, spark.createDataFrame([("q",)], "project_id string"), ["project_id"]).count() == 2
    assert sorted(r.project_id for r in store.owned(projects, "me").collect()) == ["p", "r"]


def test_object_counts_are_of_distinct_ids(spark):
    u = fx.units(spark)
    got = store.object_counts(u.select("doc_id").distinct(), units=u.unionByName(u.limit(5)), bijections=fx.bijections(spark)).first()
    assert (got.n_units, got.n_bijections) == (30, 1)


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x, y"), (2, None)], "a int, b string")
    exports.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).schema(rows.schema).csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == [(1, "x, y"), (2, None)]
    exports.write_json(rows, str(tmp_path / "json"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "json")).count() == 2
    chips = {"chips": [{"chip": "C1", "manufacturer": "M", "questions": [{"id": "q1", "question": "What?", "expected_answer": "5 V", "source_page": 3}, {"id": "q2", "question": "How?", "expected_answer": "x"}]}]}
    (tmp_path / "set.json").write_text(json.dumps(chips))
    assert sorted((r.chip, r.id, r.source_page) for r in exports.question_sets(spark, str(tmp_path / "set.json")).collect()) == [("C1", "q1", 3), ("C1", "q2", None)]
    compared = spark.createDataFrame([("v", "d1", 0, 1.5, "V", True), ("v", "d2", 1, 2.5, "V", False)], "parameter string, doc_id string, doc_ord int, value double, unit string, is_best boolean")
    assert [r["value"] for r in json.loads(compare.to_json(compared).first().json)["rows"]] == [1.5, 2.5]


def test_patterns_figures(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, f"d{i % 3}", "u", "unit", "correct", f"{i + 1} mV", f"{i + 1} V", "x", None, at) for i in range(6)] + [(20 + i, "d9", "v", "grid", "correct", "3 mA", "3 A", "x", None, at) for i in range(3)]
    log = spark.createDataFrame(rows, CORRECTIONS)
    found = learn.patterns(log)
    one = found.where("category = 'unit_confusion' and original_pattern = 'mv'").first()
    assert (one.occurrences, one.n_docs, one.doc_ids, one.canonical_types, one.auto_correctable, one.reliable) == (6, 3, ["d0", "d1", "d2"], ["unit"], True, True)
    stats = {r.category: (r.n_patterns, r.n_corrections, r.n_auto, r.n_reliable) for r in learn.pattern_stats(found).collect()}
    assert stats["unit_confusion"] == (2, 9, 1, 2) and stats[None][0] == found.count()
    assert learn.top_patterns(found, 1).first().occurrences == 6
    values = spark.createDataFrame([("7 mV", "unit"), ("7 mV", "grid"), ("7 mA", "grid")], "value string, canonical_type string")
    assert sorted((r.value, r.canonical_type, r.suggestion) for r in learn.suggest(values, found).collect()) == [("7 mA", "grid", None), ("7 mV", "grid", None), ("7 mV", "unit", "7 v")]
    assert [tuple(r) for r in learn.review_queue(log).collect()] == [("u", "unit"), ("v", "grid")]
    assert learn.review_queue(log, "d9").count() == 1


@pytest.mark.parametrize(("x", "text"), [(450.0, "450"), (0.7, "0.7"), (1 / 3, "0.333333"), (1234.56789, "1234.57"), (0.00001234567, "1.23457e-05"), (2345678.5, "2.34568e+06"), (-2.25, "-2.25"), (1e7, "10000000")])
def test_plain_number(spark, x, text):
    assert spark.range(1).select(learn.plain_number(F.lit(x)).alias("t")).first().t == text


def test_unit_normalisation_is_exact(spark):
    """Against decimal arithmetic: which products in doubles are off."""
    from decimal import Decimal

    values = [0.1 * k for k in range(1, 60)] + [3.3, 4200.0, 1.005, 5000.5]
    u = spark.createDataFrame([fx.unit(i, (f"u{i}", "VCC", v, "mV", "", 0.1, 0.1, 0)) for i, v in enumerate(values)], fx.UNITS)
    got = sorted(r.value_a for r in unit_normalisation(checkable(u)).collect())
    # values of more than six places after the point (sums of tenths) are not judged
    short = [v for v in values if Decimal(repr(v)) == round(Decimal(repr(v)), 6)]
    assert got == sorted(v for v in short if float(Decimal(repr(v)) * Decimal("0.001")) != v * 0.001) and got


def test_consensus_of_mappings_and_tables(spark):
    b, g = fx.bijections(spark), fx.grids(spark)
    other = b.withColumn("page", F.lit(7)).unionByName(b)
    assert sorted(r.page for r in consensus.merged_others(b, other).collect()) == [0, 7]
    none = consensus.consensus(fx.units(spark, []), fx.units(spark, []))
    assert consensus.agreement(none, (b, g), (b, g.where("false"))).first().agreement == 0.5


def test_proof_of_every_value(spark):
    ask = lambda i, x: (i, "d1", x)
    asked = ["What is the supply voltage range?", "What are the logic threshold levels?", "What is the maximum voltage?", "What is pin 5?", "how close is abs max"]
    q = spark.createDataFrame([ask(i, x) for i, x in enumerate(asked)], "q_id long, doc_id string, question string")
    box = (0.0, 0.1, 0.2, 0.3)
    got = {r.q_id: r for r in rules.dispatch(q, fx.units(spark, bbox=box), fx.bijections(spark), fx.grids(spark)).collect()}
    ids = {i: [p.source_id for p in r.proof] for i, r in got.items()}
    assert ids == {0: ["u_vcc_min", "u_vmax"], 1: ["u_vcc", "u_vmax", "u_vth_l", "u_vth_h"], 2: ["u_vmax"], 3: ["pinout"], 4: ["u_vcc", "u_vmax"]}
    assert all(tuple(p.bbox) == box for p in got[1].proof) and (got[0].proof[1].x, got[0].proof[1].y, got[0].proof[1].page) == (0.2, 0.1, 0)


def test_own_rules(spark):
    """A rule of the user's own comes before the listed ones."""

    def plan(asked, facts):
        rows = asked.select("q_id", "doc_id").join(facts, "doc_id").where("id = 'u_weight'")
        return rules.single(rows).select("q_id", *rules.ANSWER)

    q = spark.createDataFrame([(1, "d1", "What is the maximum voltage?")], "q_id long, doc_id string, question string")
    r = rules.dispatch(q, fx.units(spark), fx.bijections(spark), fx.grids(spark), extra={10: ("own", lambda q: F.contains(q, F.lit("maximum")), plan)}).first()
    assert (r.priority, r.source_id) == (10, "u_weight")


def test_many_documents_answer_as_one_does(spark):
    """Dispatch over several documents at once, against each alone."""
    u = fx.units(spark)
    docs = [u.withColumns({"doc_id": F.lit(f"d{k}"), "value_num": F.col("value_num") + k}).where(f"fact_ord % {k + 2} <> 0") for k in range(3)]
    b, g = [fx.bijections(spark).withColumn("doc_id", F.lit(f"d{k}")) for k in range(2)], [fx.grids(spark).withColumn("doc_id", F.lit("d2"))]
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    asked = [(100 * k + i, f"d{k}", x) for k in range(3) for i, x in enumerate(list(fx.ANSWERS)[::3])]
    q = spark.createDataFrame(asked, "q_id long, doc_id string, question string")
    every = {r.q_id: r for r in rules.dispatch(q, union(docs), union(b), union(g)).collect()}
    for k in range(3):
        for r in rules.dispatch(q.where(f"doc_id = 'd{k}'"), docs[k], union(b), union(g)).collect():
            assert r == every[r.q_id]
