"""Exports: comparison matrices and audit logs as CSV and JSON, signed; and reading question sets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shown_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'")


def flat_details(details: Column) -> Column:
    """A JSON object as ``k=v; k=v``, by key."""
    entries = F.array_sort(F.map_entries(F.from_json(details, "map<string,string>")))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; "), F.lit(""))


def signature(text: Column, key: str) -> Column:
    """HMAC-SHA256 of text, in hexadecimal: the digest of the key's one padding and the digest of its other padding and the text."""
    own = key.encode()
    block = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.coalesce(text, F.lit("")).cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def audit_rows(audit: DataFrame, key: str | None = None) -> DataFrame:
    """Audit events as they are exported: time, document, action, actor, details; with a key, each row's JSON and its signature."""
    rows = audit.select("id", shown_time(F.col("created_at")).alias("timestamp"), "doc_id", "action", "actor", flat_details(F.col("details_json")).alias("details"))
    if key is None:
        return rows
    rows = rows.withColumn("json", F.to_json(F.struct("id", "timestamp", "doc_id", "action", "actor", "details")))
    return rows.withColumn("signature", signature(F.col("json"), key))


def verified(signed: DataFrame, key: str) -> DataFrame:
    """Signed rows with ``valid``: whether the JSON still has its signature."""
    return signed.withColumn("valid", signature(F.col("json"), key) == F.col("signature"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def question_sets(spark: SparkSession, path: str) -> DataFrame:
    """One row per question of files {"chips": [{chip, questions: [...]}]}."""
    schema = "chips array<struct<chip:string,manufacturer:string,questions:array<struct<id:string,question:string,expected_answer:string,source_page:int,source_section:string>>>>"
    chips = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("chips").alias("c"))
    return chips.select("c.chip", "c.manufacturer", F.explode("c.questions").alias("q")).select("chip", "manufacturer", "q.*")
