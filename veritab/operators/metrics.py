"""Accuracy of answers against expected ones. ``results``: chip, correct (boolean), status (verified, review, refused or error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["verified", "review", "refused", "error"]


def answer_words(text: Column) -> Column:
    """Lower case, without punctuation but . - + and signs of units, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[,;:()\[\]\"']", " "), r"\s+", " "))


def answers_match(expected: Column, actual: Column) -> Column:
    """Equal, one contained in the other, or all expected numbers among the actual ones."""
    e, a = answer_words(expected), answer_words(actual)
    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"-?\d+\.?\d*"), F.lit(0))
    some = (e != "") & (a != "")
    return some & ((e == a) | F.contains(a, e) | F.contains(e, a) | ((F.size(numbers(e)) > 0) & (F.size(F.array_except(numbers(e), numbers(a))) == 0)))


def values_match(expected: Column, actual: Column) -> Column:
    """Contained, or any pair of numbers within 0.01 or 10 %."""
    e, a = F.lower(F.trim(expected)), F.lower(F.trim(actual))
    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"-?\d+\.?\d*"), F.lit(0)), lambda x: x.cast("double"))
    close = F.exists(numbers(e), lambda x: F.exists(numbers(a), lambda y: (F.abs(x - y) <= 0.01) | ((x != 0) & (F.abs(x - y) <= 0.1 * F.abs(x)))))
    return F.coalesce(F.contains(a, e) | close, F.lit(False))


def accuracy(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """In percent: right answers of all, refusals of all, wrong answers of the verified (none: 0), and refusals where the answer would have been wrong, of all refusals (none: 100)."""
    n, ok = F.count("*"), F.count_if("correct")
    of = lambda s, c=None: F.count_if((F.col("status") == s) & (F.lit(True) if c is None else F.col("correct") == c))
    share = lambda a, b, none: F.when(b > 0, a * 100.0 / b).otherwise(F.lit(none))
    figures = [
        n.alias("total"), ok.alias("correct"), share(ok, n, 0.0).alias("accuracy"), share(of("refused"), n, 0.0).alias("false_refuse_rate"),
        share(of("verified", False), of("verified"), 0.0).alias("false_accept_rate"), share(of("refused", False), of("refused"), 100.0).alias("refuse_precision"),
    ]
    return results.groupBy(*by).agg(*figures) if by else results.agg(*figures)


def confusion(results: DataFrame) -> DataFrame:
    """How many results of each status are right, and how many are wrong; both rows are there, whatever the results."""
    both = results.sparkSession.createDataFrame([(True,), (False,)], "correct boolean")
    counts = results.where("correct is not null").groupBy("correct").pivot("status", STATUSES).agg(F.count(F.lit(1)))
    return both.join(counts, "correct", "left").na.fill(0)


def gate(results: DataFrame, least: float = 70.0, refuse: float = 30.0, accept: float = 1.0) -> DataFrame:
    """The figures of all results, and whether they pass."""
    ok = (F.col("accuracy") >= least) & (F.col("false_refuse_rate") <= refuse) & (F.col("false_accept_rate") <= accept)
    return accuracy(results).withColumn("passed", ok)
