import datetime
import json

import facts as fx
import pytest
from pyspark.sql import functions as F

from veritab.functions import intent
from veritab.functions.text import measurements, number
from veritab.functions.units import base_unit, base_value
from veritab.operators import checks, compare, consensus, derived, learn, metrics, multipage, store
from veritab.operators.confidence import canonical_quality, overall, tier
from veritab.schemas import CONDITIONAL_UNITS, CORRECTIONS, GRIDS, RANGES
from veritab.sources import corpus, exports, extractions


def facts(spark, rows, doc="d1", start=0):
    return spark.createDataFrame([fx.unit(start + i, (f"{doc}u{i}", label, value, unit, context, 0.1, 0.1, 0), doc=doc) for i, (label, value, unit, context) in enumerate(rows)], fx.UNITS)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_functions(spark):
    lit = F.lit
    r = one(spark, number(lit("5f")), number(lit(" 1e3 ")), number(lit("x")), base_value(lit(250.0), lit("mA")), base_unit(lit("Ω")), base_unit(lit("furlongs")), measurements("voltage", lit("3.3V to 5 volts, 10mV")))
    assert r[:6] == (None, 1000.0, None, 0.25, "Ohm", None)
    assert [(m.value, m.unit) for m in r[6]] == [(3.3, "V"), (5.0, "V"), (10.0, "mV")]
    asked = ["What is the weather?", "What is pin 5?", "How many pins?", "What is the thermal resistance?", "maximum voltage", "How to design a voltage divider?"]
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select(intent.classify(F.col("q")).alias("i")).collect()
    assert [x.i for x in rows] == ["out_of_scope", "pin_lookup", "package_query", "thermal_query", "voltage_spec", "general_question"]


def test_confidence(spark):
    yes, no, half = F.lit(True), F.lit(False), F.lit(0.5)
    r = one(spark, canonical_quality(yes, yes, yes, yes, yes), canonical_quality(yes, no, no, no, no), overall(half, half, half), tier(F.lit(0.85)), tier(F.lit(0.5)), tier(F.lit(0.49)))
    assert tuple(r) == (1.0, 0.3, 0.5, "verified", "review", "refused")


def test_derivations(spark):
    u = facts(spark, [("VCC", 3.3, "V", "supply voltage"), ("VCC abs", 6.0, "V", "absolute maximum voltage"), ("θJA", 45.0, "°C/W", "thermal resistance"), ("PD", 200.0, "mW", "power dissipation"),
                      ("Tj max", 125.0, "°C", "maximum junction temperature"), ("ICC", 100.0, "mA", "supply current"), ("IO1", 20.0, "mA", "output current"), ("IO2", 15.0, "mA", "output current")])
    r = derived.derivations(u).first()
    assert (round(r.power.value, 6), r.thermal.value, r.thermal.second, round(r.margin.value, 6), round(r.margin.second, 6)) == (330.0, 34.0, 91.0, 45.0, 2.7)
    assert (r.budget.value, r.budget.second, r.thermal.score, r.margin.score) == (65.0, 35.0, 0.68, 0.715)


def test_checks(spark):
    u = facts(spark, [("VCC", 5.5, "V", "maximum voltage"), ("VCC", 5000.0, "mV", "maximum voltage"), ("VCC", 5500.0, "mV", "maximum voltage"), ("I", 1.0, "A", "maximum current"), ("P", 1.0, "W", "maximum power"),
                      ("θJA", 100.0, "°C/W", "thermal"), ("Tj", 100.0, "°C", "maximum junction temperature")])
    r = spark.createDataFrame([("r1", "A", 5.0, None, 3.0, "V", None, None, None, None, "d1", 0, None, 0), ("r2", "B", 1.0, 2.0, 3.0, "V", None, None, None, None, "d1", 0, None, 1)], RANGES)
    got = [(x.check_type, x.severity) for x in checks.run_checks(u, r).where("check_type <> 'unit_normalization'").collect()]
    assert sorted(got) == [("contradiction", "error"), ("power_constraint", "warning"), ("range_consistency", "error"), ("thermal_viability", "error")]
    cond = spark.createDataFrame([("c", "vdo", 2.0, "V", "t", "25", None, "dropout", None, None, "d2", 0, None, 0), ("c", "vin min", 4.0, "V", "t", "25", None, "", None, None, "d2", 0, None, 1), ("c", "vout", 3.0, "V", "t", "25", None, "", None, None, "d2", 0, None, 2)], CONDITIONAL_UNITS)
    assert [x.check_type for x in checks.dropout_margin(checks.checkable(u.where("false"), cond)).collect()] == ["dropout_margin"]


def test_compare(spark):
    u = facts(spark, [("VCC max", 5.5, "V", "absolute maximum voltage"), ("θJA", 45.0, "°C/W", "")]).unionByName(facts(spark, [("VCC max", 6.0, "V", "absolute maximum voltage"), ("θJA", 30.0, "°C/W", "")], "d2"))
    docs = spark.createDataFrame([("d1", 0), ("d2", 1), ("d3", 2)], "doc_id string, doc_ord int")
    got = compare.compare(u, docs)
    best = {r.parameter: (r.doc_id, r.value) for r in got.where("is_best").collect()}
    assert best["max_voltage"] == ("d1", 5.5) and best["thermal_resistance"] == ("d2", 30.0)
    assert got.where("parameter = 'max_voltage' and doc_id = 'd3' and value is null").count() == 1
    assert {r.parameter: r.d3 for r in compare.matrix(got, ["d1", "d2", "d3"]).collect()}["max_voltage"] == "N/A"


def test_patterns(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, "d", "u", "unit", "correct", f"{i + 1} mV", f"{i + 1} V", "x", None, at) for i in range(5)] + [(10 + i, "d", "u", "unit", "correct", f"{10 * (i + 1)} V", f"{i + 1} V", "x", None, at) for i in range(6)]
    rows += [(30 + i, "d", "u", "unit", "confirm", "1", "1", "x", None, at) for i in range(3)] + [(40 + i, "e", "u", "grid", "correct", "therml resistance", "thermal resistance", "x", None, at) for i in range(4)]
    log = spark.createDataFrame(rows, CORRECTIONS)
    found = {(r.category, r.original_pattern): r.occurrences for r in learn.patterns(log).collect()}
    assert found == {("unit_confusion", "mv"): 5, ("value_scaling", "10x"): 6, ("label_misread", "therml resistance"): 4, ("type_bias", "unit"): 11}
    made = learn.suggest(spark.createDataFrame([("4500 mV",), ("none",)], "value string"), learn.patterns(log)).collect()
    assert {r.value: r.suggestion for r in made} == {"4500 mV": "450 mv", "none": None}
    s = learn.correction_stats(log).first()
    assert (s.total, s.confirms, s.corrects) == (18, 3, 15)


def grid(i, page, cols, y, box, rows):
    cells = [(r, c, v, None) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return (f"g{i}", len(rows), cols, cells, (0.1, y), box, "d1", page, "o", i)


def test_multipage(spark):
    a = grid(1, 0, 2, 0.6, (0.0, 0.6, 1.0, 0.95), [["A", "B"], ["1", "2"], ["3", "4"]])
    b = grid(2, 1, 2, 0.05, (0.0, 0.05, 1.0, 0.3), [["a ", "B"], ["5", "6"], ["7", "8"]])
    far = grid(3, 3, 2, 0.05, (0.0, 0.05, 1.0, 0.3), [["A", "B"]])
    got = {r.id: r for r in multipage.merge(spark.createDataFrame([a, b, far], GRIDS)).collect()}
    m = got["g1_merged_g2"]
    assert set(got) == {"g1_merged_g2", "g3"} and m.rows == 5 and m.bbox.y2 == 0.3
    assert [(c.row, c.value) for c in m.cells if c.col == 0] == [(0, "A"), (1, "1"), (2, "3"), (3, "5"), (4, "7")]


def test_consensus(spark):
    a = facts(spark, [("VCC", 3.3, "V", ""), ("ICC", 50.0, "mA", "")])
    same = consensus.consensus(a, a)
    assert {r.side for r in same.collect()} == {"both"} and consensus.agreement(same).first().agreement == pytest.approx(1.0)
    b = facts(spark, [("VCC", 3.3, "V", ""), ("θJA", "TQFP", None, "")])
    assert sorted(r.side for r in consensus.consensus(a, b).collect()) == ["a", "b", "both"]


def test_extractions(spark):
    text = """```json
    {"units": [{"value": 5, "label": "VCC", "origin": {"x": 1.5, "y": -0.5}}, {"text": "TQFP", "origin": [0.5, 0.2]}, {"value": 1}],
     "bijections": [{"pair": ["1", "VCC"], "origin": [0, 0]}, {"key": 2, "value": "GND", "origin": [0, 0]}, {"left_set": ["a"], "right_set": ["b"], "mapping": {"a": "b"}, "origin": [0, 0]}],
     "grids": [{"rows": [{"cells": [{"value": "h"}, "x"]}, {"cells": ["y"]}]}, {"rows": 1, "cols": 2, "cells": [{"row": 0, "col": 1, "text": "t"}, {"row": -1, "col": 0}]}]}
    ```"""
    pages = spark.createDataFrame([("d1", 2, text), ("d1", 3, "no json")], "doc_id string, page int, json string")
    u = extractions.units(pages).orderBy("fact_ord").collect()
    assert [(r.id, r.value_num, r.value_str, tuple(r.origin)) for r in u] == [("p2_u0", 5.0, None, (1.0, 0.0)), ("p2_u1", None, "TQFP", (0.5, 0.2))]
    b = extractions.bijections(pages).orderBy("fact_ord").collect()
    assert [[(e.k, e.v) for e in r.mapping] for r in b] == [[("1", "VCC")], [("2", "GND")], [("a", "b")]]
    g = extractions.grids(pages).orderBy("fact_ord").collect()
    assert [(r.rows, r.cols, [(c.row, c.col, c.value) for c in r.cells]) for r in g] == [(2, 2, [(0, 0, "h"), (0, 1, "x"), (1, 0, "y")]), (1, 2, [(0, 1, "t")])]


def test_corpus_round_trip(spark):
    u, b, g = fx.units(spark), fx.bijections(spark), fx.grids(spark)
    data = corpus.serialise(units=u, bijections=b, grids=g).first().canonical_data
    entries = spark.createDataFrame([("h1", "MPN1", "Chip", None, data, None)], "content_hash string, mpn string, chip_name string, datasheet_url string, canonical_data string, created_at timestamp")
    files = spark.createDataFrame([("n1", "h1", None), ("n2", "zz", "mpn1"), ("n3", "zz", "other")], "doc_id string, content_hash string, mpn string")
    found = corpus.match(files, entries)
    assert {r.doc_id: r.matched_by for r in found.collect()} == {"n1": "content", "n2": "mpn", "n3": None}
    back = corpus.hydrate(found, entries)
    assert back["units"].where("doc_id = 'n2'").count() == u.count() and back["grids"].count() == 2
    assert corpus.listing(entries).first().n_units == u.count()


def test_exports_and_store(spark):
    log = spark.createDataFrame([(1, "d", "query", "me", '{"b": "2", "a": "1"}', datetime.datetime(2024, 1, 2, 3, 4, 5))], "id long, doc_id string, action string, actor string, details_json string, created_at timestamp")
    r = exports.audit_rows(log, "key")
    assert r.first().details == "a=1; b=2" and exports.verified(r, "key").first().valid and not exports.verified(r, "other").first().valid
    stored = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, write_seq int")
    new = spark.createDataFrame([("b", 2, 2), ("b", 3, 3), ("c", 4, 2)], "k string, v int, write_seq int")
    assert {r.k: r.v for r in store.upsert(stored, new, ["k"]).collect()} == {"a": 1, "b": 3, "c": 4}


def test_metrics(spark):
    lit = F.lit
    r = one(spark, metrics.values_match(lit("3.3"), lit("3.29 V")), metrics.values_match(lit("3.3"), lit("5.0 V")), metrics.answers_match(lit("5 V"), lit("it is 5 V.")), metrics.answers_match(lit("5 V"), lit("")))
    assert tuple(r) == (True, False, True, False)
    rows = spark.createDataFrame([(True, "verified")] * 8 + [(False, "refused")] + [(False, "verified")], "correct boolean, status string")
    g = metrics.gate(rows).first()
    assert (g.accuracy, g.false_refuse_rate, round(g.false_accept_rate, 3), g.refuse_precision, g.passed) == (80.0, 10.0, 11.111, 100.0, False)
    rows = spark.createDataFrame([(True, "verified")] * 4 + [(True, "refused")] * 5 + [(False, "refused")], "correct boolean, status string")
    g = metrics.gate(rows).first()
    assert (g.accuracy, g.false_refuse_rate, round(g.refuse_precision, 3), g.passed) == (90.0, 60.0, 16.667, False)  # all refusals count, right or wrong
    both = {r.correct: (r.verified, r.refused) for r in metrics.confusion(rows.where("correct")).collect()}
    assert both == {True: (4, 5), False: (0, 0)}


def test_streaming(spark, tmp_path):
    from veritab.streaming.ingest import current, follow, ingested

    source, table = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "1.json").write_text('{"doc_id": "d", "page": 0, "json": "{\\"units\\": [{\\"id\\": \\"u\\", \\"value\\": 1, \\"origin\\": [0, 0]}]}"}\n')
    follow(spark, str(source), str(table), str(tmp_path / "cp")).awaitTermination()
    (source / "2.json").write_text('{"doc_id": "d", "page": 0, "json": "{\\"units\\": [{\\"id\\": \\"u\\", \\"value\\": 2, \\"origin\\": [0, 0]}]}"}\n')
    follow(spark, str(source), str(table), str(tmp_path / "cp")).awaitTermination()
    assert [r.value_num for r in current(spark, str(table)).collect()] == [2.0]
    page = {"doc_id": "d", "page": 1, "json": json.dumps({"bijections": [{"pair": ["1", "VCC"], "origin": [0, 0]}], "grids": [{"rows": [{"cells": ["a"]}]}]})}
    (source / "3.json").write_text("".join(json.dumps(p) + "\n" for p in (page, {"doc_id": "d", "page": 2, "json": "no json"}, {"doc_id": "e", "page": 0, "json": None})))
    follow(spark, str(source), str(table), str(tmp_path / "cp")).awaitTermination()
    got = {r.doc_id: r[1:] for r in ingested(spark, str(table)).collect()}
    assert got == {"d": (3, 1, 1, 1, 1, "pages failed"), "e": (1, 1, 0, 0, 0, "nothing extracted")}
