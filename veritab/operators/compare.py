"""Comparison of parameters across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.keywords import Keywords, once
from veritab.operators.facts import DEFAULT, prepared
from veritab.operators.rule_table import PARAMETERS

NAMED = Keywords({name: p[5] for name, p in PARAMETERS.items()})


def detected(question: Column) -> Column:
    """The parameters that a question names; all if none."""
    bits = F.create_map(*[F.lit(x) for name in PARAMETERS for x in (name, NAMED.mask(name))]).cast("map<string,bigint>")
    names = F.array(*[F.lit(name) for name in PARAMETERS])
    named = lambda tags: F.filter(names, lambda name: F.element_at(bits, name).bitwiseAND(tags) != 0)
    return F.transform(NAMED.tags(F.lower(question)), lambda tags: F.when(tags != 0, named(tags)).otherwise(names))[0]


def compare(units: DataFrame, documents: DataFrame, question: Column | None = None) -> DataFrame:
    """One row per parameter and document of ``documents`` (doc_id, doc_ord): the document's first matching numeric fact (null: none),
    and whether it is the best one; ties go to the first document. Values are compared as they stand, whatever their unit."""
    facts = prepared(units.join(documents, "doc_id", "left_semi"), scan=False).where("value is not null")
    hits = once(facts, hits=DEFAULT.hits(F.lower("unit_of_measure"), {("parameter", name): p[4] for name, p in PARAMETERS.items()}))
    named = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(DEFAULT.context.mask(("parameter", name))).cast("bigint").alias("bit")) for name in PARAMETERS])
    rows = hits.where("hits <> 0").withColumn("parameter", F.explode_outer(F.transform(F.filter(named, lambda n: n["bit"].bitwiseAND(F.col("hits")) != 0), lambda n: n["name"])))
    fact = rows.groupBy("doc_id", "parameter").agg(F.min_by(F.struct("value", F.col("unit_of_measure").alias("unit"), F.col("id").alias("source_id"), "page"), "fact_ord").alias("f"))
    wanted = detected(question) if question is not None else F.array(*[F.lit(name) for name in PARAMETERS])
    grid = documents.withColumn("parameter", F.explode(wanted))
    sign = F.create_map(*[F.lit(x) for name, p in PARAMETERS.items() for x in (name, {"lower": 1, "higher": -1, "neutral": 0}[p[1]])])
    out = grid.join(fact, ["doc_id", "parameter"], "left").select("parameter", "doc_id", "doc_ord", "f.*")
    best = out.where("value is not null").groupBy("parameter").agg(F.min_by("doc_id", F.struct((F.col("value") * sign[F.col("parameter")]).alias("v"), "doc_ord")).alias("best_doc"))
    return out.join(F.broadcast(best), "parameter", "left").withColumn("is_best", F.coalesce(F.col("doc_id") == F.col("best_doc"), F.lit(False))).drop("best_doc")


def matrix(compared: DataFrame, documents: list[str]) -> DataFrame:
    """Parameters by documents, as text; N/A where there is no fact. The documents are given, so that no extra pass looks for them."""
    shown = compared.withColumn("shown", F.when(F.col("value").isNotNull(), F.concat_ws(" ", F.col("value").cast("string"), F.col("unit"))))
    return shown.groupBy("parameter").pivot("doc_id", documents).agg(F.max("shown")).na.fill("N/A")


def to_json(compared: DataFrame) -> DataFrame:
    """One JSON object per parameter."""
    rows = F.array_sort(F.collect_list(F.struct("doc_ord", "doc_id", "value", "unit", "is_best")))
    return compared.groupBy("parameter").agg(F.to_json(F.struct(rows.alias("rows"))).alias("json"))
