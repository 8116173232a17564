"""Two extractions of one page: which facts agree, how well, and the merger.

Facts are matched in order, each of the first extraction with the best one of the second that is left. Only
facts that share a block are compared, and the blocks lose no match: where two numbers agree, they share a block of
numbers; where they differ, nothing but an equal label, unit and place makes a match; what is
not a number is compared with the facts of its page whose lengths allow it. Facts of a page that are alike in all of this
are one kind, compared once. Numbers that differ are not compared at all: all facts of a page with one label, unit and place are equally
like each other then, so they are a pool from which the first that is left is taken.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from veritab.functions.keywords import once
from veritab.functions.text import number
from veritab.operators.matching import POOLED, greedy_matching
from veritab.runtime import materialise

HIGH_RISK = ["absolute_max_ratings", "electrical_specs"]  # fixed values: kinds of pages that are extracted twice
WEIGHTS = {"value": 0.4, "label": 0.3, "unit": 0.2, "near": 0.1}  # fixed values: what each counts, of what both have
CLOSE = 0.01  # numbers agree within this


def wanted(enabled: bool, page_type: Column) -> Column:
    return F.lit(enabled) & page_type.isin(HIGH_RISK)


@F.pandas_udf(DoubleType())
def text_ratio(one: pd.Series, other: pd.Series) -> pd.Series:
    """The share of matching letters of two texts; each pair of different texts is compared once a batch."""
    pairs = pd.MultiIndex.from_arrays([one, other])
    codes, known = pairs.factorize()
    ratios = [1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in known]
    return pd.Series([ratios[c] for c in codes], dtype="float64")


def facts(units: DataFrame) -> DataFrame:
    return units.select("doc_id", "page", "fact_ord", "id", "label", F.coalesce("value_str", F.col("value_num").cast("string")).alias("value"), "unit_of_measure", "context", F.col("origin.x").alias("x"), F.col("origin.y").alias("y"))


def digest(*columns: str) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def compared(rows: DataFrame) -> DataFrame:
    """Facts as they are compared: place (document and page), rid, ord, v (text), num, l (label), u (unit), x, y; empty where they have none; and their kind: all but rid and ord."""
    clean = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", ""))
    text = F.coalesce("value", F.lit(""))
    rows = rows.select(F.to_json(F.struct("doc_id", "page")).alias("place"), "rid", F.col("fact_ord").alias("ord"), text.alias("v"), number(text).alias("num"), clean("label").alias("l"), clean("unit_of_measure").alias("u"), "x", "y")
    return rows.withColumn("kind", digest("v", "l", "u", "x", "y"))


def blocks(first: DataFrame, second: DataFrame) -> list[tuple[DataFrame, float | None]]:
    """Pairs (place, a, b: structs) of kinds that may match, with the share of their values (none: of texts that differ); each pair is in one block only.

    Numbers that agree, by cells of their size; equal texts; and on each page the others of which one at least is no number, if their lengths allow a match.
    """
    side = lambda rows, name, key: rows.select("place", key.alias("key"), F.struct(*[c for c in rows.columns if c != "place"]).alias(name)).where("key is not null")
    cell = lambda step: F.when(F.abs("num") < 1e13, F.concat(F.lit("n"), (F.floor(F.col("num") * 100) + step).cast("string"))).otherwise(F.concat(F.lit("d"), F.col("num").cast("string")))
    numbers = [rows.where("num is not null") for rows in (first, second)]
    agree = (F.col("a.v") == F.col("b.v")) | (F.abs(F.col("a.num") - F.col("b.num")) < CLOSE)
    met = lambda one, other, on: one.join(other, on).select("place", "a", "b")
    cells = side(numbers[1], "b", F.array_distinct(F.array(*[cell(k) for k in (-1, 0, 1)]))).withColumn("key", F.explode("key"))
    close = met(side(numbers[0], "a", cell(0)), cells, ["place", "key"]).where(agree)
    text = F.when(F.col("v") != "", F.col("v"))
    equal = met(*[side(rows.where("num is null"), name, text) for rows, name in ((first, "a"), (second, "b"))], ["place", "key"])
    words, others = [[side(rows.where(c), name, F.lit(0)).drop("key") for c in ("num is null", "num is not null")] for rows, name in ((first, "a"), (second, "b"))]
    loose = met(words[0], others[0].unionByName(others[1]), "place").unionByName(met(words[1], others[0], "place"))
    unlike = (F.col("a.v") != F.col("b.v")) | (F.col("a.v") == "")
    return [(close, 1.0), (equal, 1.0), (loose.where(unlike & (highest("a.", "b.") >= 0.6 - 1e-9)), None)]


def weighed(shares: dict[str, tuple[Column, Column]]) -> Column:
    """The mean of shares by WEIGHTS, over those that both facts have: name -> (whether both have it, share)."""
    got, of = F.lit(0.0), F.lit(0.0)
    for name, (has, share) in shares.items():
        got, of = got + F.when(has, WEIGHTS[name] * share).otherwise(0.0), of + F.when(has, WEIGHTS[name]).otherwise(0.0)
    return F.when(of > 0, got / of).otherwise(0.0)


def shares(a: str, b: str, value: Column, label: Column) -> dict[str, tuple[Column, Column]]:
    """The shares of two facts (prefixes of their columns), given those of their values and labels."""
    c = lambda side, name: F.col(side + name)
    both = lambda name: (c(a, name) != "") & (c(b, name) != "")
    dx, dy = c(b, "x") - c(a, "x"), c(b, "y") - c(a, "y")
    return {
        "value": (both("v"), value), "label": (both("l"), label), "unit": (both("u"), F.when(c(a, "u") == c(b, "u"), 1.0).otherwise(0.0)),
        "near": (dx.isNotNull() & dy.isNotNull(), F.greatest(F.lit(0.0), 1 - 5 * F.sqrt(dx * dx + dy * dy))),
    }


def highest(a: str, b: str) -> Column:
    """A similarity that two facts cannot exceed, by the lengths of their texts."""
    ends = lambda name: (F.char_length(a + name), F.char_length(b + name))
    most = lambda name: 2 * F.least(*ends(name)) / F.greatest(F.lit(1), ends(name)[0] + ends(name)[1])
    return weighed(shares(a, b, most("v"), most("l")))


def similar(first: DataFrame, second: DataFrame, least: float) -> DataFrame:
    """(place, a, b, similarity) of the pairs of kinds that are ``least`` alike, but for numbers that differ. Letters are compared only where two texts differ.

    Expressions are kept small: beyond some size Java no longer compiles them.
    """
    ratio = lambda name: text_ratio(F.col(f"a.{name}"), F.col(f"b.{name}"))

    def found(rows: DataFrame, value: Column, label: Column) -> DataFrame:
        rows = once(rows, similarity=weighed(shares("a.", "b.", value, label))).select("place", F.col("a.kind").alias("a"), F.col("b.kind").alias("b"), "similarity")
        return rows.where((F.col("similarity") >= least) & (F.col("similarity") > 0))

    out = []
    for pairs, value in blocks(*[materialise(rows.drop("rid", "ord").distinct()) for rows in (first, second)]):
        if value is None:
            rows = pairs.withColumns({"value_ratio": ratio("v"), "label_ratio": ratio("l")})
            out.append(found(rows, F.col("value_ratio"), F.col("label_ratio")))
            continue
        other = (F.col("a.l") != F.col("b.l")) & (F.col("a.l") != "") & (F.col("b.l") != "")
        out += [found(pairs.where(~other), F.lit(value), F.lit(1.0)), found(pairs.where(other).withColumn("label_ratio", ratio("l")), F.lit(value), F.col("label_ratio"))]
    rows = out[0]
    for one in out[1:]:
        rows = rows.unionByName(one)
    return rows


def edges_to_pools(first: DataFrame, second: DataFrame, least: float) -> DataFrame:
    """The edges for ``greedy_matching``: of each fact to the kinds that are like its own, and to the numbers that share its label, unit and place.

    Of the latter, those that agree with it are among the former, with a similarity of 1, so they are gone when one is taken from the pool.
    """

    def numbers(rows: DataFrame) -> DataFrame:
        rows = once(rows.where("num is not null and x is not null"), similarity=weighed(shares("", "", F.lit(0.0), F.lit(1.0))))
        rows = rows.where((F.col("similarity") >= least) & (F.col("similarity") > 0))
        return rows.select("place", "ord", "rid", digest("l", "u", "x", "y").alias("pool"), "similarity")

    alike = similar(first, second, least).select("place", F.col("a").alias("kind"), F.col("b").alias("pool"), "similarity")
    ways = first.join(alike, ["place", "kind"]).select("place", "ord", "rid", "pool", "similarity").unionByName(numbers(first))
    members = second.select("place", "ord", "rid", F.col("kind").alias("pool")).unionByName(numbers(second).drop("similarity"))
    none = F.lit(None).cast("long")
    ways = ways.select("place", F.col("ord").alias("a_ord"), F.col("rid").alias("a"), (-F.col("similarity")).alias("less"), "pool", none.alias("b_ord"), none.alias("b"))
    return ways.unionByName(members.select("place", none.alias("a_ord"), none.alias("a"), F.lit(None).cast("double").alias("less"), "pool", F.col("ord").alias("b_ord"), F.col("rid").alias("b")))


def consensus(first: DataFrame, second: DataFrame, least: float = 0.6) -> DataFrame:
    """Facts of both extractions per page: side ``both`` (the first's, with their similarity), ``a`` or ``b``.

    In order of ``fact_ord``, each fact of the first extraction takes the most similar one of
    the second that is left (of equals the first), if it is ``least`` similar (0.6 at least).
    """
    if least < 0.6:
        raise ValueError("the blocks hold for a similarity of 0.6 at least")
    a, b = (materialise(facts(x).withColumn("rid", F.monotonically_increasing_id())) for x in (first, second))
    chosen = greedy_matching(edges_to_pools(*[materialise(compared(x)) for x in (a, b)], least), POOLED)
    chosen = materialise(chosen.select("a", "b", (-F.col("less")).alias("similarity")))
    names = [c for c in a.columns if c != "rid"]
    mine = a.join(chosen.select(F.col("a").alias("rid"), "similarity"), "rid", "left").select(*names, F.when(F.col("similarity").isNull(), "a").otherwise("both").alias("side"), "similarity")
    rest = b.join(chosen.select(F.col("b").alias("rid")), "rid", "left_anti").select(*names, F.lit("b").alias("side"), F.lit(None).cast("double").alias("similarity"))
    return mine.unionByName(rest)


def merged_others(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mappings or tables of both extractions: those of the first, and on pages where it has none, those of the second."""
    return first.unionByName(second.join(first.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti"))


def agreement(merged: DataFrame, first: tuple[DataFrame, DataFrame] | None = None, second: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(doc_id, page, agreement): similarities over the larger side, 1 at most.

    ``first`` and ``second``: each extraction's mappings and tables. A page without units
    agrees by their numbers: the smaller of both sides over the larger. A page without
    anything has no row; it agrees wholly.
    """
    a, b = F.count_if(F.col("side") != "b"), F.count_if(F.col("side") != "a")
    by_units = merged.groupBy("doc_id", "page").agg(F.least(F.lit(1.0), F.coalesce(F.sum("similarity"), F.lit(0.0)) / F.greatest(a, b)).alias("agreement"))
    if first is None or second is None:
        return by_units
    rows = None
    for side, tables in ((0, first), (1, second)):
        for kind, table in enumerate(tables):
            one = table.select("doc_id", "page", F.lit(side).alias("side"), F.lit(kind).alias("kind"))
            rows = one if rows is None else rows.unionByName(one)
    n = lambda side: F.count_if(F.col("side") == side)
    counts = rows.groupBy("doc_id", "page", "kind").agg(F.least(n(0), n(1)).alias("lo"), F.greatest(n(0), n(1)).alias("hi"))
    others = counts.groupBy("doc_id", "page").agg((F.sum("lo") / F.greatest(F.sum("hi"), F.lit(1))).alias("agreement"))
    return by_units.unionByName(others.join(by_units, ["doc_id", "page"], "left_anti"))
