"""Derived quantities: power, junction temperature, voltage margin and current budget.

Each is computed for all documents in one aggregation over their facts; the first
matching numeric fact counts, by ``fact_ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.intent import matches
from veritab.functions.keywords import once
from veritab.operators.confidence import canonical_quality, overall
from veritab.operators.facts import DEFAULT, prepared
from veritab.operators.rule_table import LOOKUPS, OUTPUTS

# What asks for each derivation, and the facts it needs: context | label -> units.
TRIGGERS = {
    "power": r"(power\s+dissipat|calculate.*power|compute.*power|what.*power|p\s*=\s*v\s*[×x*]\s*i)",
    "thermal": r"(thermal\s+check|junction\s+temp.*safe|within.*thermal|t_?junction|calculate.*temperature|thermal\s+margin)",
    "margin": r"(voltage\s+margin|how\s+close.*abs.*max|margin.*voltage|voltage.*headroom|operating.*vs.*max)",
    "budget": r"(current\s+budget|total.*current|sum.*current|current.*sum)",
}
AMBIENT = 25.0


WANTED = {("lookup", name): how[2] for name, how in {**LOOKUPS, "outputs": OUTPUTS}.items()}


def matched(units: DataFrame) -> DataFrame:
    """Numeric facts, prepared, with ``hits``: the lookups that they match by context or label, and by unit (without regard to case)."""
    facts = units if "ctx_tags" in units.columns else prepared(units, scan=False)
    return once(facts.where("value is not null"), hits=DEFAULT.hits(F.lower("unit_of_measure"), WANTED)).where("hits <> 0")


def found(name: str) -> Column:
    return F.col("hits").bitwiseAND(F.lit(DEFAULT.context.mask(("lookup", name)))) != 0


def volts(value: Column, unit: Column) -> Column:
    return F.when(F.upper(unit) == "MV", value / 1000.0).when(F.upper(unit) == "KV", value * 1000.0).otherwise(value)


def amps(value: Column, unit: Column) -> Column:
    low = F.lower(unit)
    return F.when(low == "ma", value / 1000.0).when(low.isin("ua", "µa"), value / 1_000_000.0).otherwise(value)


def per_document(units: DataFrame) -> DataFrame:
    """One row per document with the first fact of each lookup (null: none), and the outputs' sum in the supply's unit."""
    quality = canonical_quality(F.lit(True), F.col("bbox").isNotNull(), F.col("unit_of_measure").isNotNull(), F.col("label").isNotNull(), F.col("context").isNotNull())
    rows = matched(units)
    fact = F.struct("value", F.col("unit_of_measure").alias("unit"), "id", "agreement", quality.alias("quality"), "page", "bbox", "x", "y")
    firsts = [F.min_by(F.when(found(name), fact), F.when(found(name), F.col("fact_ord"))).alias(name) for name in LOOKUPS]
    out, unit = found("outputs"), F.lower("unit_of_measure")
    sums = [
        F.count_if(out).alias("n_out"), F.sum(F.when(out & (unit == "a"), F.col("value"))).alias("sum_a"), F.sum(F.when(out & (unit == "ma"), F.col("value"))).alias("sum_ma"),
        F.min(F.when(out, F.col("agreement"))).alias("out_agreement"),
    ]
    return rows.groupBy("doc_id").agg(*firsts, *sums)


def least(*facts: str, of: str = "agreement") -> Column:
    return F.least(*[F.col(f"{f}.{of}") for f in facts])


def derivations(units: DataFrame) -> DataFrame:
    """(doc_id, power, thermal, margin, budget), of documents with a fact that a derivation needs; ``units`` may be prepared. Structs of value, unit, second (a second figure), score, the first source's place and
    ``proof``, the places of all sources; null where not derivable. A budget's proof is the supply; its outputs, which have no bound, are ``budget_outputs``."""
    d = per_document(units)
    v, i = volts(F.col("volt.value"), F.col("volt.unit")), amps(F.col("amp.value"), F.col("amp.unit"))
    both = F.col("volt").isNotNull() & F.col("amp").isNotNull()
    watts = F.when(F.col("watt").isNotNull(), F.when(F.lower("watt.unit") == "mw", F.col("watt.value") / 1000.0).otherwise(F.col("watt.value"))).otherwise(
        volts(F.col("volt_near.value"), F.col("volt_near.unit")) * F.when(F.lower("amp_near.unit") == "ma", F.col("amp_near.value") / 1000.0).otherwise(F.col("amp_near.value"))
    )
    heat = F.lit(AMBIENT) + watts * F.col("theta.value")
    v_max = F.coalesce("v_abs", "v_top")
    room = F.when((v_max["value"] != 0) & (F.col("v_op.value") <= v_max["value"]), v_max["value"] - F.col("v_op.value"))
    supply_a = F.lower("supply.unit") == "a"
    used = F.when(supply_a, F.coalesce("sum_a", F.lit(0.0)) + F.coalesce("sum_ma", F.lit(0.0)) / 1000.0).otherwise(F.coalesce("sum_ma", F.lit(0.0)) + F.coalesce("sum_a", F.lit(0.0)) * 1000.0)

    def result(ok: Column, value: Column, unit: Column, second: Column, score: Column, *sources: Column) -> Column:
        point = lambda s: F.when(s.isNotNull(), F.struct(s["x"].alias("x"), s["y"].alias("y"), s["page"].alias("page"), s["bbox"].alias("bbox"), s["id"].alias("source_id"), F.lit("unit").alias("source_type")))
        first, proof = sources[0], F.array_compact(F.array(*[point(s) for s in sources]))
        return F.when(ok & value.isNotNull(), F.struct(value.alias("value"), unit.alias("unit"), second.cast("double").alias("second"), score.alias("score"), first["page"].alias("page"), first["x"].alias("x"), first["y"].alias("y"), proof.alias("proof")))

    by_watt = F.col("watt").isNotNull()

    return d.select(
        "doc_id",
        result(both, v * i * 1000.0, F.lit("mW"), v * i, overall(least("volt", "amp"), least("volt", "amp", of="quality"), F.lit(0.85)), F.col("volt"), F.col("amp")).alias("power"),
        result(F.col("theta").isNotNull(), heat, F.lit("°C"), F.col("tj_max.value") - heat, overall(F.when(by_watt, least("theta", "watt", "tj_max")).otherwise(least("theta", "volt_near", "amp_near", "tj_max")), F.lit(0.7), F.lit(0.80)), F.col("theta"), F.col("watt"), F.when(~by_watt, F.col("volt_near")), F.when(~by_watt, F.col("amp_near")), F.col("tj_max")).alias("thermal"),
        result(F.col("v_op").isNotNull(), room / v_max["value"] * 100.0, F.lit("%"), room, overall(F.least(F.col("v_op.agreement"), v_max["agreement"]), F.lit(0.75), F.lit(0.85)), F.col("v_op"), v_max).alias("margin"),
        result(F.col("supply").isNotNull(), F.when(F.col("n_out") > 0, F.col("supply.value") - used).otherwise(F.col("supply.value")), F.col("supply.unit"), F.when(F.col("n_out") > 0, used), overall(F.least(F.col("supply.agreement"), F.col("out_agreement")), F.lit(0.7), F.lit(0.80)), F.col("supply")).alias("budget"),
    )


def budget_outputs(units: DataFrame) -> DataFrame:
    """The facts that the documents' budgets count as outputs, with their places: a row each."""
    return matched(units).where(found("outputs")).select("doc_id", "fact_ord", "id", "value", F.col("unit_of_measure").alias("unit"), "page", F.struct("x", "y").alias("origin"), "bbox")


def asks(question: Column) -> Column:
    """Whether a question asks for any derivation."""
    return matches(F.coalesce(question, F.lit("")), *TRIGGERS.values())


def derive(questions: DataFrame, units: DataFrame) -> DataFrame:
    """The first derivation that a question asks for and its document allows: q_id, derivation, answered and the columns of an answer."""
    d = derivations(units.join(questions.select("doc_id").distinct(), "doc_id", "left_semi"))
    rows = questions.join(d, "doc_id", "left")
    choice = F.coalesce(*[F.when(matches(F.coalesce("question", F.lit("")), TRIGGERS[name]) & F.col(name).isNotNull(), F.struct(F.lit(name).alias("derivation"), F.col(name).alias("r"))) for name in TRIGGERS])
    part = F.struct(F.lit(None).cast("string").alias("label"), F.col("c.r.value").alias("num"), F.lit(None).cast("string").alias("str"), F.col("c.r.unit").alias("unit"))
    return rows.withColumn("c", choice).select(
        "q_id", "doc_id", "question", F.col("c.derivation").alias("derivation"), F.col("c").isNotNull().alias("answered"),
        F.col("c.r.value").alias("value"), F.col("c.r.unit").alias("unit"), F.col("c.r.second").alias("second"),
        F.concat(F.lit("derived_"), F.col("c.derivation")).alias("shape"), F.array(part).alias("parts"), F.lit(None).cast("string").alias("source_id"), F.lit("derived").alias("source_type"), F.col("c.r.proof").alias("proof"),
        F.col("c.r.page").alias("page"), F.col("c.r.x").alias("x"), F.col("c.r.y").alias("y"), F.col("c.r.score").alias("score"),
    )
