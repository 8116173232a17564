"""Mixing sources to target weights by capped water-filling.

Each source has a weight. All sources together are to give as many words as the
corpus has; a source gives at most ``max_epochs`` times its own words, and what
it cannot give is shared again among the others by weight until none is above
its cap. A source then takes all of its documents a whole number of times, and
the rest of its target from documents in the order of a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm._runtime import materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """Words per unit of weight, so that the capped targets add up to all words.

    Each round clamps the sources above their cap and shares what is left among
    the others; the level only rises, so there are at most as many rounds as sources.
    """
    capped = F.col("source_size") * max_epochs < F.col("weight") * F.col("level")
    level = -1.0
    while True:
        got = (
            sources.withColumn("level", F.lit(level))
            .agg(
                F.sum("source_size").alias("total"),
                F.sum(F.when(~capped, F.col("weight"))).alias("open"),
                F.sum(F.when(capped, F.col("source_size") * max_epochs)).alias("clamped"),
            )
            .first()
        )
        if not got.total or not got.open:
            return max(level, 0.0)
        new = (got.total - (got.clamped or 0)) / got.open
        if new <= level:
            return level
        level = new


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, whole (epochs), cutoff (the
    last order key that is taken once more; null: none).

    ``sizes`` has source, size and key. Sources in order of code point, null last,
    have the weights in turn. Rows with the same key (a repeated id) are taken alike.
    Only the one bucket of keys in which a source's target ends is put in order.
    """
    sizes = sizes.withColumn("bucket", F.substring("key", 1, 3))
    buckets = materialise(sizes.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(x) for x in weights])
    sources = materialise(
        buckets.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(choices, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    )
    level = water_level(sources, max_epochs)
    cap = (F.col("source_size") * max_epochs).cast("double")
    sources = (
        sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    same = F.col("b.source").eqNullSafe(F.col("s.source"))
    order = Window.partitionBy("b.source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = materialise(
        buckets.alias("b")
        .join(sources.alias("s"), same)
        .withColumn("before", F.sum("b.size").over(order) - F.col("b.size"))
        .where((F.col("before") < F.col("extra")) & (F.col("b.size") > 0))
        .groupBy("s.source")
        .agg(F.max_by(F.struct("bucket", "before", F.col("b.size").alias("size"), "extra"), "bucket").alias("last"))
        .select("source", "last.*")
    )
    # within the last bucket that begins below the target: the keys that still fit better than not
    keys = (
        sizes.alias("d")
        .join(last.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.bucket") == F.col("l.bucket")))
        .groupBy(F.col("d.source").alias("source"), F.col("d.key").alias("key"), "before", "extra")
        .agg(F.sum("d.size").alias("size"))
    )
    within = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        keys.withColumn("start", F.col("before") + F.sum("size").over(within) - F.col("size"))
        .where(F.col("start") + F.col("size") / 2.0 <= F.col("extra"))
        .groupBy("source")
        .agg(F.max("key").alias("cut"))
    )
    out = (
        sources.alias("s")
        .join(last.alias("l"), same_source("s", "l"), "left")
        .join(cut.alias("c"), same_source("s", "c"), "left")
        .select("s.source", "source_size", "target", "whole", F.coalesce("cut", "bucket").alias("cutoff"))
    )
    return materialise(out)


def same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def taken_times() -> Column:
    """Epochs of a document with ``key``, given its source's plan. A cutoff that is
    only a bucket's name sorts before all keys of that bucket and after those of earlier ones."""
    return F.col("whole") + F.when(F.col("key") <= F.col("cutoff"), 1).otherwise(0)


def document_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        order_key(F.col(id_col), seed).alias("key"),
    )


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` is a whole multiple of ``size``, at most ``max_epochs`` times it. A
    source misses its target by at most half of what shares one key: a document, or all rows of
    one id (a null id too), as these are taken together. Null texts have size 0; a null source is a source; an empty table gives an empty result; other
    columns are ignored. The same rows and seed give the same mix.
    """
    sizes = materialise(document_sizes(docs, id_col, text_col, source_col, seed))
    plan = mixing_plan(sizes, weights, max_epochs)
    return (
        sizes.alias("d")
        .join(plan.alias("p"), same_source("d", "p"))
        .select("doc_id", "d.source", "size", "source_size", "target", (F.col("size") * taken_times()).cast("long").alias("taken"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each row as many times as it is taken."""
    sizes = materialise(document_sizes(docs, id_col, text_col, source_col, seed))
    plan = mixing_plan(sizes, weights, max_epochs).select(F.col("source").alias("plan_source"), "whole", "cutoff")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), order_key(docs[id_col], seed).alias("key"))
    return (
        keyed.join(plan, F.col(f"row.{source_col}").eqNullSafe(F.col("plan_source")))
        .withColumn("times", taken_times().cast("int"))
        .where("times > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
        .select("row.*")
    )
