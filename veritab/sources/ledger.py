"""Extraction with a ledger: every attempt at every page is a row, so that a run can be resumed.

The work is pages x prompts. In each round the pages that are not done, and whose time has
come, go through the extractor in parallel; what came back is appended to the ledger. A
page that failed is tried again after a while, which doubles; after the last attempt of
one extractor the next one takes over. A run that is started again goes on where the ledger ends.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators.consensus import agreement, consensus
from veritab.sources.extractions import units

# Attempts, and the seconds before the next one: FIRST, then twice as long each time, LONGEST at most.
ATTEMPTS, FIRST, LONGEST = 6, 8.0, 300.0
PROMPTS = ("precision", "recall")  # fixed values: a page that is extracted twice is asked for both
ROW = "doc_id string, page int, prompt string, attempt int, json string, error string"
#: A function of (batch of work: doc_id, page, prompt, attempt and the page's columns) -> for each row the JSON, or an exception.
Extractor = Callable[[pd.DataFrame], list]


def tried(extractors: list[Extractor], attempts: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for which, some in batch.groupby((batch["attempt"] - 1) // attempts):
                try:
                    got = list(extractors[int(which)](some))
                    got += [ValueError("no answer")] * (len(some) - len(got))
                except Exception as e:  # noqa: BLE001  (a batch that fails is tried again)
                    got = [e] * len(some)
                failed = [isinstance(x, Exception) or x is None for x in got]
                out = some[["doc_id", "page", "prompt", "attempt"]].copy()
                out["json"] = [None if f else str(x) for x, f in zip(got, failed, strict=True)]
                out["error"] = [(str(x) or type(x).__name__) if f else None for x, f in zip(got, failed, strict=True)]
                yield out

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ROW}, at timestamp").parquet(path)


def pending(work: DataFrame, ledger: DataFrame, most: int) -> DataFrame:
    """Work that is not done, with its next attempt and the seconds until it is due."""
    state = ledger.groupBy("doc_id", "page", "prompt").agg(F.max("attempt").alias("tried"), F.bool_or(F.col("error").isNull()).alias("done"), F.max("at").alias("last"))
    open_ = work.join(state, ["doc_id", "page", "prompt"], "left").where(~F.coalesce("done", F.lit(False)) & (F.coalesce("tried", F.lit(0)) < most))
    wait = F.least(F.lit(LONGEST), F.lit(FIRST) * F.pow(F.lit(2.0), F.col("tried") - 1))
    due = F.when(F.col("tried").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), wait - (F.current_timestamp().cast("double") - F.col("last").cast("double"))))
    return open_.withColumns({"attempt": F.coalesce("tried", F.lit(0)) + 1, "due": due}).drop("tried", "done", "last")


def extract_all(pages: DataFrame, extractors: list[Extractor], path: str, twice: DataFrame | None = None, attempts: int = ATTEMPTS, sleep: Callable[[float], None] | None = time.sleep) -> DataFrame:
    """The ledger at ``path`` after all pages are done or given up.

    ``pages``: doc_id, page and what the extractors need. ``extractors``: the first one is tried
    ``attempts`` times, then the next. ``twice``: pages (doc_id, page) that are asked for both
    PROMPTS; others for the first only. ``sleep``: waits for the next time that is due; none: nothing waits.
    """
    spark = pages.sparkSession
    spark.createDataFrame([], f"{ROW}, at timestamp").write.mode("append").parquet(path)  # a ledger that is there stays
    work = pages.withColumn("prompt", F.lit(PROMPTS[0]))
    if twice is not None:
        work = work.unionByName(pages.join(twice.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").withColumn("prompt", F.lit(PROMPTS[1])))
    while True:
        left = pending(work, read_ledger(spark, path), attempts * len(extractors))
        soonest = left.agg(F.min("due").alias("due")).first().due
        if soonest is None:
            return read_ledger(spark, path)
        if soonest > 0 and sleep is not None:
            sleep(soonest)
        now = left.where(F.col("due") <= (soonest if sleep is not None else LONGEST)).drop("due")
        got = now.mapInPandas(tried(extractors, attempts), ROW).withColumn("at", F.current_timestamp())
        got.write.mode("append").parquet(path)


def extracted(ledger: DataFrame, prompt: str = PROMPTS[0]) -> DataFrame:
    """(doc_id, page, json) of the pages that are done; of one given up, json is null, and it counts as failed."""
    rows = ledger.where(F.col("prompt") == prompt).groupBy("doc_id", "page")
    return rows.agg(F.max_by("json", F.when(F.col("error").isNull(), F.col("attempt"))).alias("json"))


def attempts_of(ledger: DataFrame) -> DataFrame:
    """Per page and prompt: how many attempts, whether it is done, and the last error."""
    last = F.max_by("error", F.when(F.col("error").isNotNull(), F.col("attempt")))
    return ledger.groupBy("doc_id", "page", "prompt").agg(F.max("attempt").alias("attempts"), F.bool_or(F.col("error").isNull()).alias("done"), last.alias("last_error"))


def dual_units(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged facts, agreement per page) of the pages that were asked for both prompts."""
    both = [units(extracted(ledger, p)) for p in PROMPTS]
    asked = ledger.where(F.col("prompt") == PROMPTS[1]).select("doc_id", "page").distinct()
    merged = consensus(both[0].join(asked, ["doc_id", "page"], "left_semi").select(*both[0].columns), both[1])
    return merged, agreement(merged)
