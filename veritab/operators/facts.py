"""Facts as rules, derivations and comparisons see them: scanned once for keywords and measurements.

Keywords become bits, so that whatever is asked of a fact later is a test of bits; the
measurements in its text are a list beside it (``measurement_table``: a row each).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.keywords import Keywords, once
from veritab.functions.text import blank_null, number, readings
from veritab.operators.confidence import overall, unit_quality
from veritab.operators.rule_table import LOOKUPS, OUTPUTS, PARAMETERS, RULES, Rule

SLICES = 16
STORAGE = (("storage",), ("tstg", "storage"))  # fixed values: what the context or the label of a storage temperature says


def unit_bits(masks: Mapping[str, int], unit: Column) -> Column:
    """The bits of ``masks`` for a unit, 0 if it has none."""
    if not masks:
        return F.lit(0).cast("bigint")
    table = F.from_json(F.lit(json.dumps(dict(masks))), "map<string,bigint>")
    return F.coalesce(F.try_element_at(table, F.coalesce(unit, F.lit(""))), F.lit(0))


class FactTags:
    """The groups of keywords that facts are tagged with: of parameters, of lookups, and of each of ``rules``. A group has the same bit in the tags of contexts and of labels."""

    def __init__(self, rules: Iterable[Rule] = RULES) -> None:
        self.rules = tuple(rules)
        context = {("parameter", n): p[2] for n, p in PARAMETERS.items()} | {("lookup", n): p[0] for n, p in LOOKUPS.items()} | {("lookup", "outputs"): OUTPUTS[0], "storage": STORAGE[0]}
        label = {("parameter", n): p[3] for n, p in PARAMETERS.items()} | {("lookup", n): p[1] for n, p in LOOKUPS.items()} | {("lookup", "outputs"): OUTPUTS[1], "storage": STORAGE[1]}
        of_rules = {("rule", r.priority): r.context for r in self.rules}
        self.context, self.label = Keywords(context | of_rules), Keywords(label | of_rules)

    def place(self, rule: Rule) -> tuple[int, int]:
        """The number of the tags that has a rule's bit, and the bit."""
        return self.context.place["rule", rule.priority][0], self.context.mask(("rule", rule.priority))

    def hits(self, unit: Column, units: Mapping[object, Iterable[str]]) -> Column:
        """Bits of the groups (all in the first number) that a tagged fact matches by context or label, and by its unit, in lower case."""
        masks: dict[str, int] = {}
        for name, wanted in units.items():
            for u in wanted:
                masks[u.lower()] = masks.get(u.lower(), 0) | self.context.mask(name)
        return F.col("ctx_tags")[0].bitwiseOR(F.col("lbl_tags")[0]).bitwiseAND(unit_bits(masks, unit))


DEFAULT = FactTags()


def prepared(units: DataFrame, tags: FactTags = DEFAULT, scan: bool = True) -> DataFrame:
    """Units, dealt by document (of very many facts: in SLICES parts), with what all operators need: lower-case context and label and their tags, the value as a number, text, its measurements (unless ``scan`` is off), and the score of a plain answer."""
    value = F.coalesce(F.col("value_num"), number(F.col("value_str")))
    shown = F.coalesce(F.col("value_str"), F.col("value_num").cast("string"))
    agreement = F.coalesce("extraction_agreement", F.lit(0.5))
    rows = units.repartition("doc_id", F.pmod("fact_ord", F.lit(SLICES))).select(
        "doc_id", "fact_ord", "id", "label", "context", "unit_of_measure", "value_num", "value_str", "page", "bbox",
        F.col("origin.x").alias("x"), F.col("origin.y").alias("y"),
        F.lower(F.coalesce("context", F.lit(""))).alias("ctx"), F.lower(F.coalesce("label", F.lit(""))).alias("lbl"), F.upper(F.coalesce("unit_of_measure", F.lit(""))).alias("uom"),
        value.alias("value"), F.concat_ws(" ", blank_null(shown), blank_null(F.col("label")), blank_null(F.col("context"))).alias("text"),
        agreement.alias("agreement"), overall(agreement, unit_quality(), F.lit(0.7)).alias("score"),
    )
    found = {"ctx_tags": tags.context.tags(F.col("ctx")), "lbl_tags": tags.label.tags(F.col("lbl"))}
    if scan:
        found["readings"] = readings(F.col("text"))
    return once(rows, **found)


def measurement_table(facts: DataFrame) -> DataFrame:
    """A row for each measurement in the text of a prepared fact: doc_id, fact_ord, cand (its place, from 1), kind, value, unit."""
    rows = facts.select("doc_id", "fact_ord", F.posexplode("readings").alias("at", "r"))
    return rows.select("doc_id", "fact_ord", (F.col("at") + 1).alias("cand"), "r.kind", "r.value", "r.unit")
