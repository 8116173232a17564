"""The queries of the numbered operators: each applies its operator, with its
production parameters, to the whole table. ``ORACLE_SQL``: the same in DuckDB's
SQL, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritab.llm._sql import MERKLE, SPELLING
from veritab.llm.decontamination import contaminated
from veritab.llm.exact_dedup import exact_dedup
from veritab.llm.language_id import identify_languages
from veritab.llm.line_dedup import line_report
from veritab.llm.merkle import merkle_manifest
from veritab.llm.minhash import near_duplicates
from veritab.llm.mixing import mix_report
from veritab.llm.quality import importance_resample
from veritab.llm.spelling import spelling_variants
from veritab.llm.substring_dedup import substring_dedup
from veritab.llm.token_output import token_output
from veritab.llm.toxicity import toxicity
from veritab.llm.url_filter import RULES, url_verdicts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from the pages that a rule decides."""
    return url_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_near_dedup": op10_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat('17:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS k
  FROM documents),
s AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
r AS (
  SELECT *, row_number() OVER o AS n,
    CAST(sum(source_size) OVER () - (sum(source_size * 3) OVER o - source_size * 3) AS DOUBLE) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM s WINDOW o AS (ORDER BY source_size * 3.0 / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min(level, n) AS level FROM r WHERE level <= source_size * 3.0 / w),
p AS (
  SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), coalesce(level, 0) * w) AS target FROM s, l),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM p),
u AS (
  SELECT source, k, sum(size) AS size FROM d GROUP BY source, k),
c AS (
  SELECT u.source, u.k, u.size, q.target - q.whole * q.source_size AS extra,
    sum(u.size) OVER (PARTITION BY u.source ORDER BY u.k ROWS UNBOUNDED PRECEDING) - u.size AS before
  FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source),
t AS (SELECT source, max(k) AS cut FROM c WHERE before < extra AND before + size / 2.0 <= extra GROUP BY source)
SELECT d.doc_id, d.source, d.size, q.source_size, q.target,
  CAST(d.size * (q.whole + CASE WHEN d.k <= t.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
""",
    "op4_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
    "op11_spelling_variants": SPELLING,
    "op12_merkle_manifest": MERKLE,
}
