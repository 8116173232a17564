from facts import ANSWERS, bijections, grids, units

from veritab.functions.display import with_text
from veritab.operators.rules import dispatch


def ask(spark, questions, u=None, b=None, g=None):
    q = spark.createDataFrame([(i, "d1", x) for i, x in enumerate(questions)], "q_id long, doc_id string, question string")
    rows = with_text(dispatch(q, u or units(spark), b or bijections(spark), g or grids(spark))).collect()
    return {r.question: r for r in rows}


def test_answers_of_all_questions(spark):
    got = ask(spark, list(ANSWERS))
    assert {q: r.answer for q, r in got.items()} == ANSWERS


def test_refusals_and_fallbacks(spark):
    got = ask(spark, ["", "What is the weather like?", "What is pin 99?"], units(spark, []), None, grids(spark, []))
    assert {r.status for r in got.values()} == {"refuse"}
    got = ask(spark, ["What are the recommended operating conditions?"], units(spark, []), bijections(spark, []))
    assert [r.answer for r in got.values()] == ["See table"]


def test_order_of_rows_does_not_matter(spark):
    few = list(ANSWERS)[1:8]
    a = {q: r.answer for q, r in ask(spark, few, units(spark).repartition(7), bijections(spark), grids(spark)).items()}
    assert a == {q: ANSWERS[q] for q in few}


def test_derived(spark):
    facts = [("v", "VCC", 3.3, "V", "supply voltage", 0.1, 0.1, 0), ("i", "ICC", 50.0, "mA", "supply current", 0.2, 0.1, 0)]
    got = ask(spark, ["calculate the power"], units(spark, facts, bbox=(0.0, 0.0, 1.0, 1.0)), bijections(spark, []), grids(spark, []))
    r = got["calculate the power"]
    assert r.answer == "Power dissipation: 165.0 mW" and r.score == 0.79
