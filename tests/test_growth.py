"""Questions and facts of one document: what meets grows with different words, not with their pairs."""

import random

import facts as fx
import pytest
from pyspark.sql import functions as F

from veritab.operators import consensus, rules
from veritab.operators.facts import prepared
from veritab.plans import queries

WORDS = ["clock", "output", "supply", "core", "pad", "boost"]


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(5)
    rows = [(i, "d", "voltage of " + " ".join(rng.sample(WORDS, rng.randrange(0, 4)) + [f"zz{i}"])) for i in range(400)]
    return rows, rules.gates(spark.createDataFrame(rows, "q_id long, doc_id string, question string"))


def test_topic_facts_by_sets_of_words(spark, asked, monkeypatch):
    rng = random.Random(6)
    facts = [(f"u{i}", " ".join(rng.sample(WORDS, rng.randrange(0, 3))), None, i + 1000.0, "V", "", 0.5, (rng.randrange(3) / 4, rng.randrange(3) / 4), None, "d", 0, "o", i) for i in range(1500)]
    sizes, plain = [], rules.words_met if hasattr(rules, "words_met") else None

    def seen(*args):
        out = plain(*args)
        sizes.append(out[1].count())
        return out

    monkeypatch.setattr(rules, "words_met", seen)
    got = {r.q_id: r.source_id for r in rules.unit_by_topic(asked[1], prepared(spark.createDataFrame(facts, fx.UNITS))).collect()}
    for q_id, _, question in asked[0]:
        words = [w for w in question.split() if w != "of"]
        best = max(facts, key=lambda f: (sum(w in f"{f[3]} {f[1]}" for w in words), f[7][1], f[7][0], -f[12]))
        assert got[q_id] == best[0]
    assert len(got) == 400 and sizes == [len({frozenset(f[1].split()) for f in facts})]


def test_table_rows_by_sets_of_words(spark, asked):
    rng = random.Random(7)
    headers = [" ".join([*rng.sample(WORDS, rng.randrange(0, 4)), f"row{i}"]) for i in range(1500)]
    rows = spark.createDataFrame([("d", 0, "g", 0, 1500, 2, i, h, [str(i)]) for i, h in enumerate(headers)], "doc_id string, grid_ord long, grid_id string, page int, rows int, cols int, row int, header string, values array<string>")
    rows = rows.withColumns({"bbox": F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"), "x": F.lit(0.0), "y": F.lit(0.0)})
    got = {r.q_id: int(r.parts[0]["str"]) for r in rules.grid_by_words(asked[1], rows).collect()}
    for q_id, _, question in asked[0]:
        common = [len(set(question.split()) & set(h.split())) for h in headers]
        assert got.get(q_id) == (common.index(max(common)) if max(common) else None)


def test_numbers_of_one_label_and_place_are_no_pairs(spark):
    """Two extractions of a page with 1500 different numbers of one label: 2.25 million pairs, of which none is made."""
    rng = random.Random(8)
    page = lambda values: spark.createDataFrame([(f"u{i}", "VCC", None, v, "V", "", 0.5, (0.1, 0.2), None, "d", 0, "o", i) for i, v in enumerate(values)], fx.UNITS)
    one, other = [[float(rng.randrange(4000)) for _ in range(1500)] for _ in range(2)]
    edges = consensus.edges_to_pools(*[consensus.compared(consensus.facts(page(v)).withColumn("rid", F.monotonically_increasing_id())) for v in (one, other)], 0.6)
    assert edges.count() <= 4 * 1500
    free, want = dict(enumerate(other)), {}
    for i, v in enumerate(one):
        j = next((j for j, w in free.items() if w == v), None)
        want[i] = 1.0 if j is not None else 0.6
        del free[next(iter(free)) if j is None else j]
    got = {r.fact_ord: round(r.similarity, 9) for r in consensus.consensus(page(one), page(other)).collect()}
    assert got == want


def test_rules_read_scanned_facts(spark):
    """Facts are searched for keywords and measurements once, not again by each family of rules."""
    plan = queries.QUERIES["rule_answers_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1  # of the headers of no tables
