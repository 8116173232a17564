"""Decontamination: a conflict between placeholders costs only the windows that hold it."""

import pytest

from veritab.llm.decontamination import contaminated

PLAIN = "the river ran past old mills where people once ground corn and carried flour to market towns along narrow roads before trains came through this quiet valley and changed how everyone lived there for good"
TWICE = f"There were 2 boats at first and {PLAIN} until only 2 boats were left on that shore by winter"


@pytest.mark.parametrize(
    ("item", "text"),
    [
        (TWICE, TWICE.replace("only 2", "only 3")),
        (f"Count 3 apples and 4 pears because {PLAIN}", f"Count 5 apples and 5 pears because {PLAIN}"),
        (f"We wait 30 minutes because {PLAIN} and then 45 minutes more", f"We wait 30 minutes because {PLAIN} and then 45 min more"),
        ("Take 3 red apples and 4 green pears", "Take 5 red apples and 5 green pears"),
    ],
)
def test_conflicts_cost_their_windows(spark, item, text):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = contaminated(spark.createDataFrame([(1, f"Before. {text}. After")], "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]
    assert all(r.n_matched <= r.n_windows for r in got)


def test_windows_of_a_conflict_do_not_count(spark):
    items = spark.createDataFrame([(1, TWICE)], "item_id long, text string")
    docs = spark.createDataFrame([(1, TWICE.replace("2", "7").replace("only 7", "only 8"))], "doc_id long, text string")
    (row,) = contaminated(docs, items).collect()
    assert row.n_windows - row.n_matched in (3, 5)  # the windows of one of the two numbers: the first is the third word
