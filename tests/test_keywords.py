"""One pass for all keywords, one for all measurements, and rules as tests of bits, against plain searches."""

import random
import re

import facts as fx
from pyspark.sql import functions as F

from veritab.functions.keywords import Keywords, covers, once
from veritab.functions.text import MEASUREMENTS, measurements, readings
from veritab.operators import rules
from veritab.operators.facts import FactTags, measurement_table, prepared
from veritab.operators.rule_table import RULES, Rule


def test_tags_are_substrings(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab c.(") for _ in range(rng.randrange(1, 5)))
    texts = ["".join(rng.choice("abc .(+") for _ in range(rng.randrange(0, 20))) for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (5, 130):  # one number of bits, and three
        groups = {i: {word() for _ in range(rng.randrange(0, 4))} for i in range(n)}
        index = Keywords(groups)
        both = F.array(*map(F.lit, index.needs([1, n - 1])))
        for r in rows.select("t", index.tags(F.col("t")).alias("tags"), *[index.has(index.tags(F.col("t")), i).alias(f"h{i}") for i in (0, n - 2)], covers(index.tags(F.col("t")), both).alias("both")).collect():
            has = {i: any(w in (r.t or "") for w in words) for i, words in groups.items()}
            assert {i: bool(r.tags[at] >> bit & 1) for i, (at, bit) in index.place.items()} == has
            assert (r.h0, r[f"h{n - 2}"], r.both) == (has[0], has[n - 2], has[1] and has[n - 1])


def test_one_search_finds_what_one_for_each_kind_does(spark):
    rng = random.Random(2)
    bits = ["1", "23", "4.5", ".", "+", "-", " ", "\t", "V", "mv", "kV", "volts", "A", "ua", "µA", "mAh", "Wh", "w", "°C", "K", "k", "GHz", "Hz", "ms", "s", "in", "inch", "mm", "g", "kg", "oz", "x", "_", "É"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", readings(F.col("t")).alias("all"), *[measurements(k, F.col("t")).alias(k) for k in MEASUREMENTS]).collect()
    some = 0
    for r in got:
        for kind, (signed, suffixes, units) in MEASUREMENTS.items():
            want = [(float(n), units[u.lower()]) for n, u in re.findall(rf"(?i)({'[+-]?' if signed else ''}\d+(?:\.\d+)?)\s*({suffixes})\b", r.t or "")]
            assert [(m.value, m.unit) for m in r[kind]] == want, (r.t, kind)
            assert [(m.value, m.unit) for m in r.all if m.kind == kind] == want
            some += len(want)
    assert some > 150


def test_facts_are_searched_once(spark):
    """However many rules, a fact's text is searched three times: context, label, measurements."""
    rows = rules.rule_answers(prepared(fx.units(spark)), [r for r in RULES if r.family != "several"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 3
    table = measurement_table(prepared(fx.units(spark, [("a", "x", "3.3 V to -5 °C", None, "10 mA", 0.0, 0.0, 0)]))).orderBy("cand").collect()
    assert [(r.cand, r.kind, r.value, r.unit) for r in table] == [(1, "voltage", 3.3, "V"), (2, "temperature", -5.0, "°C"), (3, "current", 10.0, "mA")]


def test_more_rules_than_bits(spark):
    """Rules beyond the bits of one number, in the tags and in their answers."""
    more = [Rule(2000 + i, f"own{i}", "best" if i % 2 else "range", (("x",),), (f"word{i}", "supply"), ("V", "mV"), "voltage", default_unit="V") for i in range(60)]
    tags = FactTags([*RULES, *more])
    assert tags.place(more[-1])[0] == 1
    facts = prepared(fx.units(spark), tags)
    got = {r.priority: r for r in rules.rule_answers(facts, [*RULES[:8], *more], tags=tags).collect()}
    plain = {r.priority: r for r in rules.rule_answers(prepared(fx.units(spark)), RULES[:8]).collect()}
    assert {p: got[p] for p in plain} == plain
    assert {p for p in got if p >= 2000} == {r.priority for r in more}
    assert {got[r.priority].source_id for r in more if r.family == "best"} == {"u_vcc"}
    assert {tuple(p.num for p in got[r.priority].parts) for r in more if r.family == "range"} == {(2.7, 3.3)}


def test_once_is_reckoned_once(spark):
    rows = once(spark.range(3), x=F.upper(F.concat(F.col("id").cast("string"), F.lit("abc")))).where("x <> ''").select("x", F.concat("x", "x").alias("y")).where("y <> x")
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("upper(") == 1
    assert sorted(r.y for r in rows.collect()) == ["0ABC0ABC", "1ABC1ABC", "2ABC2ABC"]


def test_repeated_questions_are_answered_alike(spark):
    q = spark.createDataFrame([(1, "d1", "What is the maximum voltage?"), (2, "d1", "What is the maximum voltage?"), (3, "d1", None), (4, None, "What is pin 5?")], "q_id long, doc_id string, question string")
    got = {r.q_id: r for r in rules.dispatch(q, fx.units(spark), fx.bijections(spark), fx.grids(spark)).collect()}
    assert got[1].source_id == got[2].source_id == "u_vmax" and got[1].proof == got[2].proof
    assert [got[i].status for i in (3, 4)] == ["refuse", "refuse"] and len(got) == 4


def test_answers_and_rules_from_sql(spark):
    for name, table in {"units": fx.units(spark), "bijections": fx.bijections(spark), "grids": fx.grids(spark)}.items():
        table.createOrReplaceTempView(name)
    spark.sql("CREATE OR REPLACE TEMP VIEW questions AS SELECT * FROM VALUES (1L, 'd1', 'What is the maximum voltage?'), (2L, 'd1', 'How much does it WEIGH on the purse, in grams?') AS t(q_id, doc_id, question)")
    spark.sql("""CREATE OR REPLACE TEMP VIEW my_rules AS SELECT 10 AS priority, 'purse' AS name, 'first' AS family, array(array('Purse'), array('gram', 'ounce')) AS asked, array('Component Weight') AS context, array('g') AS units,
        CAST(null AS string) AS kind, CAST(null AS array<string>) AS grid, CAST(null AS string) AS default_unit, CAST(null AS int) AS most""")
    rules.answers_view(spark, rules="my_rules")
    got = spark.sql("SELECT q_id, priority, source_id, parts[0].num AS num FROM answers WHERE status = 'answer' ORDER BY q_id").collect()
    assert [tuple(r) for r in got] == [(1, 300, "u_vmax", 5.5), (2, 10, "u_weight", 0.5)]
    bad = spark.sql("SELECT * FROM my_rules UNION ALL SELECT * FROM my_rules")
    try:
        rules.rules_of(bad)
    except ValueError as e:
        assert "priority of their own" in str(e)
    else:
        raise AssertionError("equal priorities")


def test_signatures(spark):
    import hashlib
    import hmac

    from veritab.sources.exports import signature

    for key in ("key", "k" * 64, "é" * 80):
        got = spark.createDataFrame([("text ü",), ("",), (None,)], "t string").select("t", signature(F.col("t"), key).alias("s")).collect()
        assert all(r.s == hmac.new(key.encode(), (r.t or "").encode(), hashlib.sha256).hexdigest() for r in got)
