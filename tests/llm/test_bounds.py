"""What is bounded whatever the input holds: rows put in order, samples, filters."""

import random

import numpy as np
import pytest

from veritab.llm import decontamination, language_id
from veritab.llm.quality import importance_resample, select_top


@pytest.mark.parametrize("few", [1, 7, 1000])
def test_border_among_equal_keys_and_ids(spark, few):
    """Equal keys, equal ids and null ids on both sides of the border: as a sort of all rows has it."""
    rng = random.Random(few)
    data = [(rng.choice([0.5, 0.5, 0.5, 1.0, -3.25]), rng.choice([None, 5, 5, 9, -(2**62), 2**62]), rid * 1_000_003) for rid in range(400)]
    rows = spark.createDataFrame(data, "k double, doc_id long, rid long")
    order = sorted(data, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]), reverse=True)
    for share in (0.01, 0.3, 0.5, 0.77, 1.0):
        got = {r.rid for r in select_top(rows, "k", share, cells=8, few=few).where("selected").collect()}
        assert got == {r[2] for r in order[: int(np.ceil(share * len(data)))]}


def test_half_of_equal_rows(spark):
    docs = spark.range(300).selectExpr("1L as doc_id", "'the same words' as text")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert importance_resample(docs, labels).where("selected").count() == 150


def test_copies_of_a_sampled_row_are_one(spark, monkeypatch):
    """Copies of a row, and other texts of its id, do not add to the sample."""
    seen = []
    monkeypatch.setattr(language_id, "train", lambda texts, langs: seen.append(list(zip(texts, langs, strict=True))))
    rows = [(1, "ein text", "de")] * 500 + [(1, f"text {i}", "de") for i in range(500)] + [(2, "a text", "en")]
    language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 20, 1000)
    (sample,) = seen
    assert ("a text", "en") in sample and len(sample) <= 21 and len(set(sample)) == len(sample)


def test_full_filter_loses_nothing(spark, monkeypatch):
    """A filter that is too small for its benchmark lets more windows pass; the pairs stay as they are."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 50}x" for j in range(30))) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{(i * 11 + j) % 60}x" for j in range(12))) for i in range(30)], "item_id long, text string")
    pairs = lambda: sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    want = pairs()
    whole = decontamination.window_filter
    monkeypatch.setattr(decontamination, "window_filter", lambda w: whole(w, 64))
    assert len(want) > 10 and pairs() == want
