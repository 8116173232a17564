"""Quality of facts, confidence of answers, and its tier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_quality(origin: Column, bbox: Column, unit: Column, label: Column, context: Column) -> Column:
    """Sum of the weights of what a fact has; each argument is a condition."""
    parts = ((origin, 0.30), (bbox, 0.20), (unit, 0.20), (label, 0.15), (context, 0.15))
    total = F.lit(0.0)
    for has, weight in parts:
        total = total + F.when(has, weight).otherwise(0.0)
    return F.round(total, 4)


def unit_quality() -> Column:
    """Of a row of units: empty strings count as missing."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return canonical_quality(F.lit(True), F.col("bbox").isNotNull(), filled("unit_of_measure"), filled("label"), filled("context"))


def overall(agreement: Column, quality: Column, strength: Column) -> Column:
    return F.round(0.30 * agreement + 0.30 * quality + 0.40 * strength, 4)


def tier(score: Column, verified: float = 0.85, review: float = 0.50) -> Column:
    return F.when(score >= verified, "verified").when(score >= review, "review").otherwise("refused")
