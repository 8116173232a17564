"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and columns with clashing names."""

import corpus_pipeline
import pytest

from veritab.llm.decontamination import contaminated
from veritab.llm.exact_dedup import exact_dedup
from veritab.llm.language_id import identify_languages
from veritab.llm.line_dedup import drop_fuzzy_lines, line_report
from veritab.llm.minhash import drop_near_duplicates, near_duplicates
from veritab.llm.mixing import mix_report
from veritab.llm.quality import importance_resample
from veritab.llm.substring_dedup import substring_dedup
from veritab.llm.token_output import token_output
from veritab.llm.toxicity import toxicity

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "one two", "de", "b"), (4, "one two", "de", "b"), (4, "another text here for the id", "de", "b"),
    (None, "alpha beta gamma delta epsilon zeta eta theta", "fr", "c"), (None, None, None, None), (7, LONG, "en", "a"), (8, "...!?", "en", "a"), (9, "line\n\nline\n\tline", "en", "c"), (10, "日本語の文章 テスト 123", "ja", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["rank", "score", "row", "key", "size", "bucket", "label", "hash", "_row", "_key", "component", "at", "rid", "n", "_score"]
OPS = {
    "exact": exact_dedup, "mixing": mix_report, "tokens": token_output, "near": near_duplicates, "lines": line_report, "substrings": substring_dedup, "languages": identify_languages,
    "quality": lambda d: importance_resample(d, labels(d.sparkSession)), "toxicity": lambda d: toxicity(d, labels(d.sparkSession)),
}


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, None, None), (None, 1, 1), (4, 1, 5)], "doc_id long, quality int, toxic int")


def messy(spark, rows=ROWS):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("other").alias(c) for c in CLASHING])


@pytest.mark.parametrize("name", list(OPS))
def test_one_row_per_document(spark, name):
    assert OPS[name](messy(spark)).count() == len(ROWS)
    assert OPS[name](messy(spark, [])).count() == 0


def values(rows, *columns):
    """The given columns of each row, by id; ids with several rows have several."""
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=str) for k, v in found.items()}


def test_values_on_messy_rows(spark):
    d = messy(spark)
    sizes = {1: [(8,)], 2: [(0,)], 3: [(0,)], 4: [(2,), (2,), (6,)], None: [(0,), (8,)], 7: [(30_000,)], 8: [(1,)], 9: [(3,)], 10: [(3,)]}
    got = mix_report(d).collect()
    assert values(got, "size") == sizes and all(r.taken <= 3 * r.size for r in got)
    said = identify_languages(d).collect()
    assert {r.doc_id for r in said if r.lang_pred == "und"} >= {2, 3, 8, None} and all(0 <= r.score <= 1 for r in said)
    rows = toxicity(d, labels(spark)).collect()
    score = values(rows, "score")
    assert score[2] == score[3] == score[8] and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    weights = values(importance_resample(d, labels(spark)).collect(), "n_ngrams")
    assert weights[2] == weights[3] == weights[8] == [(0,)] and weights[4] == [(11,), (3,), (3,)] and weights[7] == [(59_999,)]
    near = values(near_duplicates(d).collect(), "cluster_id", "kept")
    assert near[4] == [(4, False), (4, True), (4, True)] and near[1] == [(None, False)] and near[2] == [(2, True)] and near[8] == [(8, True)]


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "12 34 56"), (6, "another text here"), (5, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(messy(spark), items).collect()}
    assert got == {(4, 6), (1, 5), (None, 5)}  # items 3 and 4 are numbers only: placeholders, which match nothing
    assert contaminated(messy(spark, []), items).count() == 0
    assert contaminated(messy(spark), items.where("false")).count() == 0


def test_exact_keeps_one_of_each(spark):
    got = exact_dedup(messy(spark)).collect()
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_near_duplicates_go(spark):
    """One row of each class stays, also of rows repeated in many tasks; rows without text stay, whatever their id."""
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in drop_near_duplicates(messy(spark)).collect())
    assert [(i, t) for _, i, t in got] == [(0, ""), (0, ROWS[0][1]), (2, ""), (3, ""), (4, ROWS[5][1]), (4, "one two"), (7, LONG), (8, "...!?"), (9, ROWS[10][1]), (10, ROWS[11][1])]
    many = spark.range(3000).repartition(7).selectExpr("if(id % 3 = 0, 5L, id) as doc_id", "if(id % 3 = 0, 'the same words in many rows', if(id % 3 = 1, null, concat('text of its own ', id, ' as ', id))) as text", "id as other")
    rows = drop_near_duplicates(many).collect()
    assert len(rows) == 2001 and len({r.other for r in rows}) == 2001 and sum(r.doc_id == 5 for r in rows) == 2
    same = spark.range(50).selectExpr("null as doc_id", "'' as text", "map('id', id) as other")
    assert drop_near_duplicates(same).count() == 50


def test_lines_of_messy_rows(spark):
    out = drop_fuzzy_lines(messy(spark))
    assert out.columns == messy(spark).columns and out.count() == len(ROWS)
    assert {r.text for r in out.where("doc_id = 9").collect()} == {"line\n"}


def test_stages_keep_columns(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.schema == docs.schema
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
