"""Patterns in human corrections, rules drawn from them, and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUTO = 5  # occurrences from which a pattern may be applied by itself
RELIABLE = 3  # and from which it is more than chance
DOCUMENTS = 100  # that a pattern names
# The band of original / corrected for each factor, in order.
SCALES = [("10x", 9.0, 11.0, 10.0), ("100x", 90.0, 110.0, 100.0), ("1000x", 900.0, 1100.0, 1000.0), ("0.1x", 0.09, 0.11, 0.1), ("0.01x", 0.009, 0.011, 0.01), ("0.001x", 0.0009, 0.0011, 0.001)]
UNIT_AT_END, NUMBER = r"[a-zA-Z°µ]+/?[a-zA-Z°]*$", r"[-+]?\d*\.?\d+"


def unit_in(text: Column) -> Column:
    found = F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), UNIT_AT_END, 0)
    return F.when(found != "", F.lower(found))


def number_in(text: Column) -> Column:
    found = F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), NUMBER, 0)
    return F.when(found != "", found.try_cast("double"))


def corrected(corrections: DataFrame) -> DataFrame:
    return corrections.where("action = 'correct'")


def scale(ratio: Column) -> Column:
    """The factor by which the original is off, by the first band that holds the ratio."""
    found = F.lit(None).cast("string")
    for name, lo, hi, _ in reversed(SCALES):
        found = F.when(ratio.between(lo, hi), name).otherwise(found)
    return found


def seen_units(rows: DataFrame) -> DataFrame:
    """Units that were corrected to other units."""
    return rows.withColumns({"original_pattern": unit_in(F.col("original_value")), "corrected_pattern": unit_in(F.col("corrected_value"))}).where("original_pattern <> corrected_pattern")


def seen_scales(rows: DataFrame) -> DataFrame:
    """Numbers that were off by a factor."""
    rows = rows.withColumns({"x": number_in(F.col("original_value")), "y": number_in(F.col("corrected_value"))}).where("y <> 0")
    ratio = F.array(F.col("x") / F.col("y"))  # bound once, not written out for each band
    rows = rows.withColumn("original_pattern", F.transform(ratio, scale)[0]).where("original_pattern is not null")
    return rows.withColumn("corrected_pattern", F.concat(F.when(F.startswith("original_pattern", F.lit("0.")), "multiply_by_").otherwise("divide_by_"), F.col("original_pattern")))


def seen_labels(rows: DataFrame) -> DataFrame:
    """Texts without numbers (a number 0 counts as none)."""
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    rows = rows.withColumns({"original_pattern": clean("original_value"), "corrected_pattern": clean("corrected_value")}).where("original_pattern <> '' and corrected_pattern <> '' and original_pattern <> corrected_pattern")
    return rows.where((F.coalesce(number_in(F.col("original_pattern")), F.lit(0.0)) == 0) & (F.coalesce(number_in(F.col("corrected_pattern")), F.lit(0.0)) == 0))


def seen_types(rows: DataFrame) -> DataFrame:
    """The types of corrected facts."""
    return rows.withColumns({"original_pattern": F.col("canonical_type"), "corrected_pattern": F.lit("")})


#: category -> (what is seen of corrections, occurrences for full confidence)
CATEGORIES = {"unit_confusion": (seen_units, 10.0), "value_scaling": (seen_scales, 10.0), "label_misread": (seen_labels, 8.0), "type_bias": (seen_types, 1.0)}
STATE = ["category", "original_pattern", "corrected_pattern", "doc_id"]


def daily(corrections: DataFrame, *categories: str) -> DataFrame:
    """What each day's corrections add: day, category, original_pattern, corrected_pattern, doc_id, n and types.

    Rows of several days, or of parts of a day, can be put under each other in any order:
    ``merged`` finds the patterns of all. So a new day is counted once, and history is not read as corrections again.
    """
    out = None
    for name in categories or CATEGORIES:
        rows = CATEGORIES[name][0](corrected(corrections)).select(F.lit(name).alias("category"), "original_pattern", "corrected_pattern", "doc_id", "canonical_type", F.to_date("created_at").alias("day"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("day", *STATE).agg(F.count("*").alias("n"), F.collect_set("canonical_type").alias("types"))


def merged(state: DataFrame) -> DataFrame:
    """The patterns of a state (``daily``): category, original_pattern, corrected_pattern, occurrences, n_docs, doc_ids (the
    first DOCUMENTS of them), canonical_types, confidence, auto_correctable and reliable.

    Texts that were misread count from two times on; types that have more than 30 % of all
    corrections, at least 3 of at least 5. Counts are added up per document first, so no
    group holds more than its documents, and no row more than DOCUMENTS of their names.
    """
    distinct = lambda c: F.sort_array(F.array_distinct(F.flatten(c)))
    each = state.groupBy(*STATE).agg(F.sum("n").alias("n"), distinct(F.collect_set("types")).alias("types"))
    numbered = F.row_number().over(Window.partitionBy(*STATE[:3], F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy("doc_id"))
    each = each.withColumn("some", F.when(numbered <= DOCUMENTS, F.col("doc_id")))  # the first of each slice: the first of all are among them
    n, bias = F.col("occurrences"), F.col("category") == "type_bias"
    found = each.groupBy(*STATE[:3]).agg(
        F.sum("n").alias("occurrences"), F.count("doc_id").alias("n_docs"), F.slice(F.sort_array(F.collect_set("some")), 1, DOCUMENTS).alias("doc_ids"), distinct(F.collect_set("types")).alias("canonical_types"),
    )
    per = F.create_map(*[F.lit(x) for name, (_, full) in CATEGORIES.items() for x in (name, full)])[F.col("category")]
    return biased(found).select(
        "category", "original_pattern", "corrected_pattern", "occurrences", "n_docs", "doc_ids", "canonical_types",
        F.when(bias, F.col("share")).otherwise(F.least(F.lit(1.0), n / per)).alias("confidence"), (~bias & (n >= AUTO)).alias("auto_correctable"), (n >= RELIABLE).alias("reliable"),
    )


def biased(found: DataFrame) -> DataFrame:
    """Patterns with the share of all corrections that a type has; without those that do not count."""
    bias = F.col("category") == "type_bias"
    total = found.where(bias).agg(F.sum("occurrences").alias("total"))  # one row
    rows = found.crossJoin(F.broadcast(total)).withColumn("share", F.when(bias, F.col("occurrences") / F.col("total")))
    counts = F.when(bias, (F.col("share") > 0.3) & (F.col("occurrences") >= 3) & (F.col("total") >= 5)).when(F.col("category") == "label_misread", F.col("occurrences") >= 2).otherwise(True)
    return rows.where(counts).drop("total")


def unit_confusion(corrections: DataFrame) -> DataFrame:
    return merged(daily(corrections, "unit_confusion"))


def value_scaling(corrections: DataFrame) -> DataFrame:
    return merged(daily(corrections, "value_scaling"))


def label_misread(corrections: DataFrame) -> DataFrame:
    return merged(daily(corrections, "label_misread"))


def type_bias(corrections: DataFrame) -> DataFrame:
    return merged(daily(corrections, "type_bias"))


def patterns(corrections: DataFrame) -> DataFrame:
    """All patterns; read in order of occurrences, then category and pattern."""
    return merged(daily(corrections))


def auto_rules(found: DataFrame) -> DataFrame:
    return found.where(F.col("auto_correctable") & (F.col("occurrences") >= AUTO))


def pattern_stats(found: DataFrame) -> DataFrame:
    """Per category, and of all (category null): how many patterns, corrections, auto-correctable and reliable patterns."""
    figures = F.count("*").alias("n_patterns"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n_corrections"), F.count_if("auto_correctable").alias("n_auto"), F.count_if("reliable").alias("n_reliable")
    return found.rollup("category").agg(*figures)


def top_patterns(found: DataFrame, most: int = 10) -> DataFrame:
    """The patterns of most occurrences; of equals, those of the first category and pattern."""
    return found.orderBy(F.desc("occurrences"), "category", "original_pattern", "corrected_pattern").limit(most)


def plain_number(x: Column) -> Column:
    """A number as text: whole ones in full, others with six significant digits, and an exponent below 0.0001 and from 1,000,000 on."""
    size = F.floor(F.log10(F.abs(x)))
    bare = lambda t: F.regexp_replace(t, r"\.?0+$", "")
    fixed = bare(F.call_function("format_string", F.concat(F.lit("%."), (F.lit(5) - size).cast("string"), F.lit("f")), x))
    parts = F.split(F.format_string("%.5e", x), "e")
    far = F.concat(bare(parts[0]), F.lit("e"), parts[1])
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).when(size.between(-4, 5), fixed).otherwise(far)


def suggest(values: DataFrame, found: DataFrame) -> DataFrame:
    """(…, suggestion): what the most frequent rule that fits makes of each ``value``; null if none fits.

    Rules are the auto-correctable ones of the patterns ``found``. Where ``values`` have a
    ``canonical_type``, a rule fits values of the types that it was seen with only. A rule
    of units fits a value that ends in its unit, a rule of scales any value with a number.
    """
    order = F.struct((-F.col("occurrences")).alias("n"), "category", "original_pattern", "corrected_pattern")
    typed = "canonical_type" in values.columns
    kind = F.explode("canonical_types") if typed else F.lit(None).cast("string")
    rules = auto_rules(found).select("category", "original_pattern", "corrected_pattern", order.alias("o"), kind.alias("_type"))
    keyed = values.withColumns({"_u": unit_in(F.col("value")), "_x": number_in(F.col("value")), "_id": F.monotonically_increasing_id()})
    own = F.coalesce("canonical_type", F.lit("")) if typed else F.lit("")
    keyed = keyed.withColumn("_type", own)
    rules = rules.withColumn("_type", F.coalesce("_type", F.lit("")))
    swap = rules.where("category = 'unit_confusion'").withColumnRenamed("original_pattern", "_u").drop("category")
    swap = keyed.join(swap, ["_u", "_type"]).withColumn("suggestion", F.regexp_replace(F.trim("value"), F.lit(UNIT_AT_END), F.col("corrected_pattern")))
    factor = F.create_map(*[F.lit(x) for name, _, _, f in SCALES for x in (name, f)])
    best = rules.where("category = 'value_scaling'").groupBy("_type").agg(F.min_by(F.struct("original_pattern", "corrected_pattern", "o"), "o").alias("r"))  # a row per type
    f = factor[F.col("r.original_pattern")]
    made = F.when(F.startswith("r.corrected_pattern", F.lit("divide")), F.col("_x") / f).otherwise(F.col("_x") * f)
    scaled = keyed.where("_x is not null").join(best, "_type").select("_id", F.trim(F.concat(plain_number(made), F.lit(" "), F.coalesce("_u", F.lit("")))).alias("suggestion"), F.col("r.o").alias("o"))
    made = swap.select("_id", "suggestion", "o").unionByName(scaled).groupBy("_id").agg(F.min_by("suggestion", "o").alias("suggestion"))
    return keyed.join(made, "_id", "left").drop("_id", "_u", "_x", "_type")


def correction_stats(corrections: DataFrame) -> DataFrame:
    n, right = F.count("*"), F.count_if(F.col("action") == "confirm")
    return corrections.agg(n.alias("total"), right.alias("confirms"), F.count_if(F.col("action") == "correct").alias("corrects"), F.when(n > 0, right / n).otherwise(0.0).alias("rate"))


def review_queue(corrections: DataFrame, doc_id: str | None = None, most: int = 50) -> DataFrame:
    """The first facts, by id, that someone has confirmed or corrected: canonical_id and canonical_type. Of one document, or of all."""
    rows = corrections if doc_id is None else corrections.where(F.col("doc_id") == doc_id)
    return rows.select("canonical_id", "canonical_type").distinct().orderBy("canonical_id", "canonical_type").limit(most)
