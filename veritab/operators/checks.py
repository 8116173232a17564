"""Consistency checks over facts. Each gives issues: doc_id, check_type, severity, key, value_a, value_b (the figures that disagree).

Checked values are those with a known unit, in base units. ``facts`` are units, with
conditional units added by ``checkable``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.text import has_any, number
from veritab.functions.units import base_unit, base_value, exact_multiplier, unit_name

AMBIENT = 25.0
ISSUE = ["doc_id", "check_type", "severity", "key", "value_a", "value_b"]


def checkable(units: DataFrame, conditional: DataFrame | None = None) -> DataFrame:
    """Numeric facts with doc_id, fact_ord, ctx, lbl, value, uom and their base value and unit (null where unknown)."""
    cols = ["doc_id", "fact_ord", "context", "label"]
    rows = units.select(*cols, F.coalesce("value_num", number(F.col("value_str"))).alias("value"), F.col("unit_of_measure").alias("uom"))
    if conditional is not None:
        rows = rows.unionByName(conditional.select(*cols, "value", F.col("unit").alias("uom")))
    rows = rows.where("value is not null and uom is not null")
    trimmed = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return rows.select("doc_id", "fact_ord", trimmed("context").alias("ctx"), trimmed("label").alias("lbl"), "value", "uom", base_value(F.col("value"), F.col("uom")).alias("base"), base_unit(F.col("uom")).alias("base_unit"))


def parameter_key() -> Column:
    """What makes facts the same parameter: label (or the context's first 40 characters) and the first qualifier in the context."""
    qualifier = F.lit("")
    for word in reversed(["minimum", "min", "typical", "typ", "maximum", "max"]):
        qualifier = F.when(F.contains(F.col("ctx"), F.lit(word)), word[:3]).otherwise(qualifier)
    name = F.when(F.col("lbl") != "", F.col("lbl")).when(F.col("ctx") != "", F.concat(F.lit("ctx:"), F.substring("ctx", 1, 40)))
    return F.concat(name, F.lit("|"), qualifier)


def issue(rows: DataFrame, check: str, severity: str, key: Column, a: Column, b: Column) -> DataFrame:
    return rows.select("doc_id", F.lit(check).alias("check_type"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), a.cast("double").alias("value_a"), b.cast("double").alias("value_b"))


def contradictions(facts: DataFrame) -> DataFrame:
    """Facts of one parameter that differ from its first one in the same base unit. The first is found by aggregation, so a frequent parameter needs no window."""
    rows = facts.withColumn("key", parameter_key()).where("key is not null and base is not null")
    first = rows.groupBy("doc_id", "key").agg(F.min_by(F.struct("base", "base_unit", "fact_ord"), "fact_ord").alias("ref"), F.min("base").alias("lo"), F.max("base").alias("hi"))
    # a parameter whose values are all the same contradicts nothing: only the others are joined
    both = rows.join(first.where("hi - lo >= 1e-9"), ["doc_id", "key"]).where("fact_ord > ref.fact_ord and base_unit = ref.base_unit and abs(base - ref.base) >= 1e-9")
    return issue(both, "contradiction", "error", F.col("key"), F.col("ref.base"), F.col("base"))


def range_consistency(ranges: DataFrame) -> DataFrame:
    """Ranges whose present values are not in order: min, typ, max."""
    bad = ranges.where("min > typ or typ > max or min > max")
    return issue(bad, "range_consistency", "error", F.coalesce("label", "id"), F.col("min"), F.col("max"))


def power_constraint(facts: DataFrame) -> DataFrame:
    """Documents whose largest rated power is below largest rated voltage times current."""
    rated = has_any(F.col("ctx"), ["max", "maximum", "absolute"]) | has_any(F.col("lbl"), ["max", "maximum", "absolute"])
    top = lambda unit: F.max(F.when(F.col("base_unit") == unit, F.col("base")))
    d = facts.where(rated & F.col("base").isNotNull()).groupBy("doc_id").agg(top("V").alias("v"), top("A").alias("i"), top("W").alias("p"))
    return issue(d.where("p < v * i"), "power_constraint", "warning", F.lit("power"), F.col("p"), F.col("v") * F.col("i"))


def thermal_viability(facts: DataFrame) -> DataFrame:
    """Documents whose junction gets hotter than allowed at the largest power: 25 + P * theta. The last theta and limit count."""
    compact = F.upper(F.replace("uom", F.lit(" "), F.lit("")))
    theta = (has_any(F.col("ctx"), ["thermal"]) | has_any(F.col("lbl"), ["θja", "theta", "rthja"])) & compact.isin("°C/W", "C/W", "K/W")
    power = ~theta & (has_any(F.col("ctx"), ["power", "dissipation"]) | F.col("lbl").isin("pd", "power")) & F.col("base").isNotNull()
    limit = ~theta & ~power & has_any(F.col("ctx"), ["junction"]) & (has_any(F.col("ctx"), ["max"]) | has_any(F.col("lbl"), ["max"]))
    limit = limit & ((unit_name(F.col("uom")) == "C") | compact.isin("°C", "℃", "C"))
    last = lambda hit: F.max_by(F.when(hit, F.col("value")), F.when(hit, F.col("fact_ord")))
    d = facts.groupBy("doc_id").agg(last(theta).alias("theta"), F.max(F.when(power & (F.col("base_unit") == "W"), F.col("base"))).alias("p"), last(limit).alias("tj"))
    hot = F.lit(AMBIENT) + F.col("p") * F.col("theta")
    return issue(d.where(hot > F.col("tj")), "thermal_viability", "error", F.lit("thermal"), hot, F.col("tj"))


def dropout_margin(facts: DataFrame) -> DataFrame:
    """Documents whose smallest input exceeds the output voltage by less than the dropout. The last of each counts."""
    drop = has_any(F.col("ctx"), ["dropout"]) | has_any(F.col("lbl"), ["dropout", "vdo"])
    vin = ~drop & ((has_any(F.col("ctx"), ["input"]) & has_any(F.col("ctx"), ["min"])) | (has_any(F.col("lbl"), ["vin"]) & has_any(F.col("lbl"), ["min"])))
    vout = ~drop & ~vin & (has_any(F.col("ctx"), ["output voltage"]) | has_any(F.col("lbl"), ["vout"]))
    last = lambda hit: F.max_by(F.when(hit, F.col("base")), F.when(hit, F.col("fact_ord")))
    d = facts.where("base_unit = 'V'").groupBy("doc_id").agg(last(drop).alias("vdo"), last(vin).alias("vin"), last(vout).alias("vout"))
    return issue(d.where("vin - vout < vdo"), "dropout_margin", "warning", F.lit("dropout"), F.col("vin") - F.col("vout"), F.col("vdo"))


def unit_normalisation(facts: DataFrame) -> DataFrame:
    """Facts whose base value, reckoned in doubles, is not the double next to the exact decimal product of value and multiplier.

    The value is taken as it is written and the multiplier from the table of units. Values
    with more than nine digits before or six after the point are not judged.
    """
    written = F.col("value").cast("string").try_cast("decimal(15,6)")
    exact = F.when(written.cast("double") == F.col("value"), (written * exact_multiplier(F.col("uom"))).cast("double"))
    return issue(facts.where(F.col("base").isNotNull() & (exact != F.col("base"))), "unit_normalization", "error", F.col("uom"), F.col("value"), F.col("base"))


def run_checks(units: DataFrame, ranges: DataFrame, conditional: DataFrame | None = None) -> DataFrame:
    """The issues of all six checks."""
    facts = checkable(units, conditional)
    out = unit_normalisation(facts)
    for one in (contradictions(facts), range_consistency(ranges), power_constraint(facts), thermal_viability(facts), dropout_margin(facts)):
        out = out.unionByName(one)
    return out


def rollup(issues: DataFrame) -> DataFrame:
    """One row per document with issues: how many errors and warnings."""
    return issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.lit(6).alias("checks_run"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: the row of the largest ``order`` for each key (of equal ones, the largest by its hash)."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rows.columns)))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*[F.col(f"_last.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns])
