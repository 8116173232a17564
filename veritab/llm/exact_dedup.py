"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries (Spark's ``freqItems``) name the digests that may be very
frequent; their exact sizes and winners are counted, and those that are frequent
indeed are broadcast, so that their rows are settled map-side. All other digests
meet in an ordinary shuffle: groups are aggregated before it, and joined to their rows.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm._runtime import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest id stays (a null id is smallest; of
    rows with equal ids exactly one stays). Other columns of ``docs`` are ignored.
    ``support``: the share of rows from which a digest is settled map-side; at
    most 1 / support winners are broadcast. An empty table gives an empty result.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("rid"),
            F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("text_sha256"),
        )
    )
    spark = rows.sparkSession
    total = rows.count()
    frequent = rows.stat.freqItems(["text_sha256"], support).first()[0] or []
    candidates = F.broadcast(spark.createDataFrame([(x,) for x in frequent], "text_sha256 string"))
    best = F.max(F.struct("doc_id", "rid"))
    winners = (
        rows.join(candidates, "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= max(2.0, support * total))
    )
    winners = F.broadcast(materialise(winners))
    heavy = rows.join(winners, "text_sha256")
    light = rows.join(winners, "text_sha256", "left_anti")
    groups = light.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
    light = light.join(groups, "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.rid") == F.col("rid")).alias("kept"),
        "text_sha256",
    )
