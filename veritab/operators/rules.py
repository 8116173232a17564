"""Questions against facts: gates, answers by rule, and the choice among them.

What a rule says about a document does not depend on the question, but for four
rules. So questions first pass the gates, which need no facts; each rule that any
question may use is answered once per document, by aggregation over its facts; and
each question takes the answer of its first rule that has one. Keywords are looked for
once in a question and once in a fact (``facts.prepared``); rules test the bits.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import intent
from veritab.functions.keywords import TAGS, Keywords, covers, once
from veritab.functions.text import blank_null, has_any, normalised, words_of
from veritab.operators.facts import DEFAULT, FactTags, prepared, unit_bits
from veritab.operators.rule_table import QUESTION_RULES, RULES, TOPICS, Rule
from veritab.runtime import materialise

PART = "struct<label:string,num:double,str:string,unit:string>"
#: ``proof``: where each value stands: x, y, page, bbox, source_id, source_type; ``page``, ``x`` and ``y`` are the first one's.
ANSWER = ["shape", "parts", "proof", "source_id", "source_type", "page", "x", "y", "score"]
RULE_ROW = "priority int, name string, family string, asked array<array<string>>, context array<string>, units array<string>, kind string, grid array<string>, default_unit string, most int"
FAMILIES = ("best", "first", "several", "range")
WHAT_IS_THIS = (("what is this",), ("pin", "voltage", "current", "temperature"))  # fixed values: asks for a description, but not with one of these


def part(label: Column, num: Column, text: Column, unit: Column) -> Column:
    return F.struct(label.cast("string").alias("label"), num.cast("double").alias("num"), text.cast("string").alias("str"), unit.cast("string").alias("unit"))


def own_part(of: str = "") -> Column:
    """A fact as the part of an answer; ``of``: the struct it is in, with a dot."""
    name = f"coalesce(if({of}label = '', null, {of}label), if({of}context = '', null, {of}context))"
    return F.expr(f"named_struct('label', {name}, 'num', cast({of}value_num as double), 'str', {of}value_str, 'unit', {of}unit_of_measure)")


def proof_point(x: Column, y: Column, page: Column, bbox: Column, source_id: Column, source_type: str) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), page.alias("page"), bbox.alias("bbox"), source_id.alias("source_id"), F.lit(source_type).alias("source_type"))


def own_proof(of: str = "") -> Column:
    return F.expr(f"named_struct('x', {of}x, 'y', {of}y, 'page', {of}page, 'bbox', {of}bbox, 'source_id', {of}id, 'source_type', 'unit')")


def rules_of(table: DataFrame, most: int = 1000) -> list[Rule]:
    """Rules from a table (RULE_ROW; what is null is as in ``Rule``): a row each, ``most`` at most, with priorities that no other rule has."""
    rows = table.select(*[F.col(c.split()[0]) for c in RULE_ROW.split(", ")]).limit(most + 1).collect()
    names = [r.priority for r in RULES] + list(QUESTION_RULES) + [r.priority for r in rows]
    if len(rows) > most or len(set(names)) < len(names) or any(r.family not in FAMILIES or not r.asked for r in rows):
        raise ValueError(f"rules need a family of {FAMILIES}, something asked and a priority of their own, and {most} are the most")
    low = lambda words: tuple(w.lower() for w in words or ())
    return [
        Rule(r.priority, r.name, r.family, tuple(low(g) for g in r.asked), low(r.context), None if r.units is None else tuple(r.units), r.kind, low(r.grid), r.default_unit or "", r.most or 4)
        for r in sorted(rows, key=lambda r: r.priority)
    ]


class QuestionTags:
    """The groups of keywords that questions are tagged with: what each of ``rules`` wants asked, and the topics."""

    def __init__(self, rules: Iterable[Rule] = RULES) -> None:
        self.rules = tuple(rules)
        groups = {("asked", r.priority, i): words for r in self.rules for i, words in enumerate(r.asked)}
        self.index = Keywords(groups | {("topic", i): words for i, (words, _, _) in enumerate(TOPICS)} | {"this": WHAT_IS_THIS[0], "not this": WHAT_IS_THIS[1]})

    def rule_array(self) -> Column:
        """The rules as a literal array: priority, need (the tags of a question that asks for it), and the classes of questions that it answers."""
        rows = [
            {"priority": r.priority, "this": r.name == "description", "need": self.index.needs(("asked", r.priority, i) for i in range(len(r.asked))), "classes": [c for c, names in intent.RULE_CLASSES.items() if r.name in names]}
            for r in self.rules
        ]
        return F.from_json(F.lit(json.dumps(rows)), f"array<struct<priority:int,this:boolean,need:{TAGS},classes:array<string>>>")


ASKED = QuestionTags()


def gates(questions: DataFrame, use_intent: bool = True, extra: dict[int, tuple] | None = None, asked: QuestionTags = ASKED) -> DataFrame:
    """(q_id, doc_id, question, q, intent, tags, priority): the rules that each question may use.

    ``extra``: rules of the user's own, priority -> (name, gate, plan). ``gate``: normalised
    question column -> condition; ``plan``: (questions with q_id, doc_id and question,
    prepared facts) -> q_id and the columns ANSWER.
    """
    rows = once(questions, q=normalised(F.col("question")), intent=intent.classify(F.col("question")) if use_intent else F.lit("general_question"))
    rows = once(rows, tags=asked.index.tags(F.col("q")))
    q, kind, tags = F.col("q"), F.col("intent"), F.col("tags")
    any_topic = F.lit(False)
    for i in range(len(TOPICS)):
        any_topic = any_topic | asked.index.has(tags, ("topic", i))
    what_is_this = asked.index.has(tags, "this") & ~asked.index.has(tags, "not this")
    asks = lambda r: covers(tags, r["need"]) | (r["this"] & what_is_this)
    lets = lambda r: (kind == "general_question") | F.array_contains(r["classes"], kind) | ((F.size(r["classes"]) == 0) & (kind != "out_of_scope"))
    listed = F.transform(F.filter(asked.rule_array(), lambda r: asks(r) & lets(r)), lambda r: r["priority"])
    own = {100: q.rlike(r"pin\s+(?:number\s+)?(\d+)"), 900: any_topic, 950: F.size(words_of(q)) > 0, 1000: F.lit(True)}
    others = [(p, n, own[p]) for p, n in QUESTION_RULES.items()] + [(p, n, gate(q)) for p, (n, gate, _) in (extra or {}).items()]
    open_ = F.array_compact(F.array(*[F.when(gate & intent.allows(kind, name), F.lit(p)) for p, name, gate in others]))
    return rows.withColumn("priority", F.explode_outer(F.concat(listed, open_))).where("priority is not null")


def first_of(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each group, by an order without ties."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def single(units: DataFrame) -> DataFrame:
    """Units as plain answers."""
    return units.withColumns({"shape": F.lit("value"), "parts": F.array(own_part()), "proof": F.array(own_proof()), "source_id": F.col("id"), "source_type": F.lit("unit")})


VALUE = "struct<cand:int,own:boolean,v:double,unit:string,s1:bigint,s2:bigint>"


def value_rows(units: DataFrame, rules: list[Rule], tags: FactTags) -> DataFrame:
    """``fact_rows`` of rules whose bits stand in the same number of the tags."""
    word = tags.place(rules[0])[0]
    bits = lambda chosen: sum(tags.place(r)[1] for r in chosen)
    lit = lambda mask: F.lit(mask).cast("bigint")
    family = {name: bits(r for r in rules if r.family == name) for name in ("best", "first", "several", "range")}
    kinds = {r.kind for r in rules if r.kind}
    by_kind = lambda name: {k: bits(r for r in rules if r.kind == k and r.family == name) for k in kinds}
    no_bits, zero = F.bitwise_not, F.lit(0).cast("bigint")

    hit = F.col("ctx_tags")[word].bitwiseOR(F.col("lbl_tags")[word]).bitwiseAND(lit(bits(rules)))
    storage = bits(r for r in rules if r.name == "storage_temperature")
    if storage:  # its keywords alone do not do
        at = tags.context.place["storage"][0]
        says = (F.col("ctx_tags")[at].bitwiseAND(lit(tags.context.mask("storage"))) != 0) | (F.col("lbl_tags")[at].bitwiseAND(lit(tags.label.mask("storage"))) != 0)
        hit = F.when(says, hit).otherwise(hit.bitwiseAND(lit(~storage)))
    allowed: dict[str, int] = {}
    for r in rules:
        for u in {u.upper() for u in r.units or ()}:
            allowed[u] = allowed.get(u, 0) | tags.place(r)[1]
    fit = unit_bits(allowed, F.col("uom")).bitwiseOR(lit(bits(r for r in rules if r.units is None)))
    ranges, bests = by_kind("range"), by_kind("best")
    read = F.aggregate("readings", zero, lambda seen, m: seen.bitwiseOR(unit_bits(ranges, m["kind"])))
    rows = once(units, hit=hit, fit=fit, read=read)

    hit, fit, has, read = F.col("hit"), F.col("fit"), F.col("value").isNotNull(), F.col("read")
    both, unfit = hit.bitwiseAND(fit), hit.bitwiseAND(no_bits(fit))
    best = F.when(has & (F.col("uom") != ""), lit(family["best"])).otherwise(zero)
    spans = F.when(has, lit(family["range"])).otherwise(lit(family["range"]).bitwiseAND(no_bits(read)))
    plain = spans.bitwiseOR(lit(family["several"]))
    own = F.struct(
        F.lit(0).alias("cand"), F.lit(True).alias("own"), F.col("value").alias("v"), F.col("unit_of_measure").alias("unit"),
        both.bitwiseAND(plain.bitwiseOR(lit(family["first"])).bitwiseOR(best)).alias("s1"),
        unfit.bitwiseAND(plain).bitwiseOR(no_bits(hit).bitwiseAND(fit).bitwiseAND(best)).alias("s2"),
    )

    def reading(m: Column, i: Column) -> Column:
        to_best, to_range = unit_bits(bests, m["kind"]), F.when(has, zero).otherwise(unit_bits(ranges, m["kind"]))
        return F.struct(
            (i + 1).alias("cand"), F.lit(False).alias("own"), m["value"].alias("v"), m["unit"].alias("unit"),
            both.bitwiseAND(to_best.bitwiseOR(to_range)).alias("s1"), no_bits(both).bitwiseAND(to_best).bitwiseOR(unfit.bitwiseAND(to_range)).alias("s2"),
        )

    values = F.concat(F.array(own.cast(VALUE)), F.transform("readings", reading).cast(f"array<{VALUE}>"))
    rows = rows.select(*units.columns, F.inline_outer(values)).where("s1 <> 0 or s2 <> 0")
    table = F.from_json(F.lit(json.dumps([{"priority": r.priority, "family": r.family, "bit": tags.place(r)[1]} for r in rules])), "array<struct<priority:int,family:string,bit:bigint>>")
    rows = rows.withColumn("r", F.explode_outer(F.filter(table, lambda r: F.col("s1").bitwiseOR(F.col("s2")).bitwiseAND(r["bit"]) != 0)))
    return rows.select(*units.columns, "r.priority", "r.family", F.when(F.col("s1").bitwiseAND(F.col("r.bit")) != 0, 1).otherwise(2).alias("stage"), "v", "own", "unit", "cand")


def fact_rows(units: DataFrame, rules: list[Rule], tags: FactTags = DEFAULT) -> DataFrame:
    """A row for each value that a fact (prepared with the same ``tags``) has for a rule: priority, family, stage, v, own, unit and cand (its place among the fact's values).

    ``stage`` 1: a fact about the rule with its units. Families: first takes stage 1 only;
    range and several any unit as stage 2; best as stage 2 the values of all facts in its units.
    """
    out = None
    for word in sorted({tags.place(r)[0] for r in rules}):
        rows = value_rows(units, [r for r in rules if tags.place(r)[0] == word], tags)
        out = rows if out is None else out.unionByName(rows)
    return out


PAYLOAD = ["id", "label", "context", "value_num", "value_str", "unit_of_measure", "page", "bbox", "x", "y", "score", "v", "own", "unit"]


def rule_answers(units: DataFrame, rules: list[Rule], largest: bool = True, tags: FactTags = DEFAULT) -> DataFrame:
    """(doc_id, priority, …ANSWER) of the families first, best (with ``largest`` false: the smallest) and range, in one aggregation.

    Of first, the earliest fact; of best, the largest number, ties to the earliest. A range
    goes from the smallest to the largest number: the first of the smallest, the last of the
    largest; of fewer than two facts or numbers, the first fact is the answer.
    """
    rows = fact_rows(units, rules, tags)
    fact, place = F.struct(*PAYLOAD), F.struct("v", "fact_ord", "cand")
    size = F.when(F.col("family") == "best", -F.col("v") if largest else F.col("v"))
    ranged = F.when((F.col("family") == "range") & F.col("v").isNotNull(), place)
    staged = rows.groupBy("doc_id", "priority", "family", "stage").agg(
        F.min_by(fact, F.struct(size.alias("s"), "fact_ord", "cand")).alias("f"), F.min_by(fact, ranged).alias("lo"), F.max_by(fact, ranged).alias("hi"),
        F.count("v").alias("n"), F.min("fact_ord").alias("first"), F.max("fact_ord").alias("last"),
    )
    kept = F.struct("f", "lo", "hi", ((F.col("family") == "range") & (F.col("n") >= 2) & (F.col("first") < F.col("last"))).alias("two"), F.col("family").alias("family"))
    got = staged.groupBy("doc_id", "priority").agg(F.min_by(kept, "stage").alias("k")).select("doc_id", "priority", "k.*")
    default = F.create_map(*[F.lit(x) for r in rules for x in (r.priority, r.default_unit)])[F.col("priority")]
    unit = F.coalesce(blank_null(F.col("lo.unit_of_measure")), blank_null(F.col("hi.unit_of_measure")), default)
    ends = F.array(*[part(F.lit(None), F.col(f"{end}.v"), F.lit(None), unit) for end in ("lo", "hi")])
    read = F.array(part(F.lit(None), F.col("f.v"), F.lit(None), F.col("f.unit")))
    two = F.col("two")
    parts = F.when(two, ends).when((F.col("family") == "best") & ~F.col("f.own"), read).otherwise(F.array(own_part("f.")))
    proof = F.when(two, F.array(own_proof("lo."), own_proof("hi."))).otherwise(F.array(own_proof("f.")))
    at = F.when(two, F.col("lo")).otherwise(F.col("f"))
    return got.select(
        "doc_id", "priority", F.when(two, "range").otherwise("value").alias("shape"), parts.alias("parts"), proof.alias("proof"), at["id"].alias("source_id"), F.lit("unit").alias("source_type"),
        at["page"].alias("page"), at["x"].alias("x"), at["y"].alias("y"), F.when(~two, F.col("f.score")).alias("score"),
    )


def several_facts(units: DataFrame, rules: list[Rule], tags: FactTags = DEFAULT) -> DataFrame:
    """The first N facts of each document and rule, in order, as one answer, with a proof of each; one alone is a plain answer."""
    most = F.create_map(*[F.lit(x) for r in rules for x in (r.priority, r.most)])[F.col("priority")]
    rows = fact_rows(units, rules, tags).select("doc_id", "priority", "stage", "fact_ord", F.struct(*PAYLOAD).alias("f"))
    order = Window.partitionBy("doc_id", "priority").orderBy("stage", "fact_ord")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(r.most for r in rules))  # a literal bound: each task passes on so many only
    all_ = F.array_sort(F.collect_list(F.struct("n", "stage", "f")))
    rows = rows.where(F.col("n") <= most).groupBy("doc_id", "priority").agg(all_.alias("all")).withColumn("all", F.filter("all", lambda a: a["stage"] == F.col("all")[0]["stage"]))
    many, f = (F.size("all") > 1) | (F.col("priority") == 800), F.col("all")[0]["f"]
    name = lambda a: F.when(F.col("priority") == 800, F.coalesce(a["label"], F.lit(""))).otherwise(F.coalesce(blank_null(a["label"]), blank_null(a["context"])))
    return rows.select(
        "doc_id", "priority", F.when(many, "several").otherwise("value").alias("shape"),
        F.transform("all", lambda a: part(name(a["f"]), a["f"]["value_num"], a["f"]["value_str"], a["f"]["unit_of_measure"])).alias("parts"),
        F.transform("all", lambda a: proof_point(*[a["f"][c] for c in ("x", "y", "page", "bbox", "id")], "unit")).alias("proof"),
        f["id"].alias("source_id"), F.lit("unit").alias("source_type"), f["page"].alias("page"), f["x"].alias("x"), f["y"].alias("y"), F.when(~many, f["score"]).alias("score"),
    )


def cells(grids: DataFrame) -> DataFrame:
    """One row per visible cell: inside the declared rows and columns, the first of each place."""
    rows = grids.select("doc_id", F.col("fact_ord").alias("grid_ord"), F.col("id").alias("grid_id"), "page", "bbox", F.col("origin").alias("grid_origin"), "rows", "cols", F.posexplode("cells").alias("n", "c"))
    rows = rows.where((F.col("c.row") >= 0) & (F.col("c.row") < F.col("rows")) & (F.col("c.col") >= 0) & (F.col("c.col") < F.col("cols")))
    keys = ["doc_id", "grid_ord", "grid_id", "page", "bbox", "rows", "cols"]
    rows = rows.groupBy(*keys, F.col("c.row").alias("row"), F.col("c.col").alias("col")).agg(F.min_by(F.struct("c.value", F.coalesce("c.origin", "grid_origin").alias("at")), "n").alias("c"))
    return rows.select(*keys, "row", "col", F.col("c.value").alias("value"), F.col("c.at.x").alias("x"), F.col("c.at.y").alias("y"))


def grid_rows(grid_cells: DataFrame) -> DataFrame:
    """Rows of tables that have a header cell in column 0 and some value: (…, header, values)."""
    filled = F.when((F.col("col") > 0) & (F.trim("value") != ""), F.struct("col", "value"))
    return (
        grid_cells.groupBy("doc_id", "grid_ord", "grid_id", "page", "bbox", "rows", "cols", "row")
        .agg(F.max(F.when(F.col("col") == 0, F.struct("value", "x", "y"))).alias("h"), F.array_sort(F.collect_list(filled)).alias("v"))
        .where(F.col("h").isNotNull() & (F.size("v") > 0))
        .select("*", F.lower("h.value").alias("header"), F.transform("v", lambda c: c["value"]).alias("values"), "h.x", "h.y")
        .drop("h", "v")
    )


def grid_answer(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "shape": F.lit("row"), "parts": F.transform("values", lambda v: part(F.lit(None), F.lit(None), v, F.lit(None))),
        "proof": F.array(proof_point(*[F.col(c) for c in ("x", "y", "page", "bbox", "grid_id")], "grid")),
        "source_id": F.col("grid_id"), "source_type": F.lit("grid"), "score": F.lit(None).cast("double"),
    })


def grid_by_header(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """The first table row of each document whose header has a keyword of the rule."""
    index = Keywords({r.priority: r.grid for r in rules if r.grid})
    table = F.from_json(F.lit(json.dumps([{"priority": p, "need": index.needs([p])} for p in index.groups])), f"array<struct<priority:int,need:{TAGS}>>")
    rows = once(rows, tags=index.tags(F.col("header")))
    found = rows.withColumn("priority", F.explode_outer(F.transform(F.filter(table, lambda r: covers(F.col("tags"), r["need"])), lambda r: r["priority"])))
    found = grid_answer(found.where("priority is not null").drop("tags"))
    return first_of(found, ["doc_id", "priority"], [F.col("grid_ord"), F.col("row")], ANSWER)


def bijection_answer(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "shape": F.lit("value"), "source_id": F.col("id"), "source_type": F.lit("bijection"),
        "x": F.col("origin.x"), "y": F.col("origin.y"), "score": F.lit(None).cast("double"),
        "proof": F.array(proof_point(F.col("origin.x"), F.col("origin.y"), F.col("page"), F.col("bbox"), F.col("id"), "bijection")),
    })


def bijection_rules(bijections: DataFrame) -> DataFrame:
    """Part numbers (150: the first value of the first mapping about parts or orders) and pin counts (740: the larger side of the first mapping about pins)."""
    text = F.lower(F.concat_ws(" ", F.transform("mapping", lambda e: e["k"]), F.transform("mapping", lambda e: e["v"])))
    pins = F.lower(F.concat_ws(" ", F.col("id"), F.array_join("left_set", " "), F.array_join("right_set", " ")))
    value = lambda v: F.array(part(F.lit(None), F.lit(None), v, F.lit(None)))
    both = F.array(
        F.when(has_any(text, ["part", "order"]) & (F.size("mapping") > 0), F.struct(F.lit(150).alias("priority"), value(F.get(F.col("mapping"), F.lit(0))["v"]).alias("parts"))),
        F.when(has_any(pins, ["pin"]), F.struct(F.lit(740).alias("priority"), value(F.greatest(F.size("left_set"), F.size("right_set"))).alias("parts"))),
    )
    rows = bijections.withColumn("b", F.explode(F.array_compact(both))).select("*", "b.priority", "b.parts").drop("b")
    return first_of(bijection_answer(rows), ["doc_id", "priority"], [F.col("fact_ord")], ANSWER)


def pin_lookup(asked_: DataFrame, bijections: DataFrame, grid_cells: DataFrame) -> DataFrame:
    """Rule 100: what a pin is. Mappings in order, each from left to right, then from right to left (the last left of equal rights); then tables."""
    pins = asked_.where("priority = 100").select("q_id", "doc_id", F.regexp_extract("q", r"pin\s+(?:number\s+)?(\d+)", 1).alias("pin"))
    entries = bijections.select("doc_id", "fact_ord", "id", "page", "bbox", "origin", F.posexplode("mapping").alias("n", "e"))
    ways = entries.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("way"), F.col("e.k").alias("pin"), F.col("e.v").alias("other")), F.struct(F.lit(1).alias("way"), F.col("e.v").alias("pin"), F.col("e.k").alias("other")),
    )).alias("w")).select("doc_id", "fact_ord", "id", "page", "bbox", "origin", "n", "w.*")
    hit = pins.join(ways, ["doc_id", "pin"])
    hit = bijection_answer(hit.withColumn("parts", F.array(part(F.lit(None), F.lit(None), F.col("other"), F.lit(None)))))
    by_map = first_of(hit, ["q_id"], [F.col("fact_ord"), F.col("way"), -F.col("n")], ANSWER).withColumn("step", F.lit(0))
    row = Window.partitionBy("doc_id", "grid_ord", "row").orderBy("col")
    beside = F.when(F.lead("col").over(row) == F.col("col") + 1, F.lead("value").over(row)).when(F.lag("col").over(row) == F.col("col") - 1, F.lag("value").over(row))
    near = grid_cells.withColumn("values", F.array(F.coalesce(beside, F.col("value")))).withColumnRenamed("value", "pin")
    found = grid_answer(pins.join(near, ["doc_id", "pin"]))
    by_grid = first_of(found, ["q_id"], [F.col("grid_ord"), F.col("row"), F.col("col")], ANSWER).withColumn("step", F.lit(1))
    return first_of(by_map.unionByName(by_grid), ["q_id"], [F.col("step")], ANSWER).withColumn("priority", F.lit(100))


def words_met(asked_: DataFrame, facts: DataFrame, held: Callable[[Column], Column], by: list[str], order: list[Column], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Questions (q_id, doc_id, words, …) and facts of their documents, each reduced to what the other side's words can tell apart.

    ``held``: a document's asked words -> those that a fact has. Facts with the same ones, and the same ``by``,
    rank alike for every question, so the first by ``order`` stands for all; of a question only words that some fact has
    matter. Returns the questions with ``words`` cut to those, and (doc_id, by, held, columns): the two are as many as there
    are different sets of words, not as questions and facts, and no pair of a question and a fact is made.
    """
    none = F.array().cast("array<string>")
    every = lambda rows, words, name: rows.select("doc_id", F.explode(words).alias("w")).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("w")).alias(name))
    met = facts.join(every(asked_, "words", "vocabulary"), "doc_id", "left")
    met = once(met, held=held(F.coalesce("vocabulary", none))).drop("vocabulary")
    sets = materialise(first_of(met, ["doc_id", *by, "held"], order, columns))
    cut = asked_.join(every(sets, "held", "said"), "doc_id", "left")
    return once(cut, words=F.array_sort(F.array_intersect("words", F.coalesce("said", none)))).drop("said"), sets


def of_equals(asked_: DataFrame, keys: list[str], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``answer`` (questions -> q_id and ANSWER) of one question of each group with equal ``keys``, given to all of the group."""
    asked_ = materialise(asked_.select("q_id", *keys))
    one = materialise(asked_.groupBy(*keys).agg(F.min("q_id").alias("q_id")))
    got = one.join(answer(one), "q_id").select(*keys, *ANSWER)
    return asked_.join(got, keys).select("q_id", *ANSWER)


def unit_by_topic(asked_: DataFrame, units: DataFrame, asked: QuestionTags = ASKED) -> DataFrame:
    """Rule 900: facts in units of the question's topics, by common words; ties by place on the page, then the earliest.

    The words of a question are found before it meets any fact, and the texts of facts are lowered before.
    """
    hits = F.array_compact(F.array(*[F.when(asked.index.has(F.col("tags"), ("topic", i)), F.lit(i)) for i in range(len(TOPICS))]))
    words = F.filter(words_of(F.col("question")), lambda w: F.char_length(w) > 1)
    topics = once(asked_.where("priority = 900"), words=words, topics=hits).select("q_id", "doc_id", "words", "topics")
    of_unit: dict[str, list[int]] = {}
    for i, (_, names, _) in enumerate(TOPICS):
        for name in names:
            of_unit.setdefault(name, []).append(i)
    by_unit = F.from_json(F.lit(json.dumps(of_unit)), "map<string,array<int>>")
    by_kind = F.create_map(*[F.lit(x) for i, (_, _, kind) in enumerate(TOPICS) if kind for x in (kind, i)])
    none = F.array().cast("array<int>")
    entry = lambda t, bonus, p, cand: F.struct(t.cast("int").alias("topic"), F.lit(bonus).alias("bonus"), p.alias("p"), cand.cast("int").alias("cand"))
    own = F.transform(F.coalesce(F.try_element_at(by_unit, F.col("uom")), none), lambda t: entry(t, 10, own_part(), F.lit(0)))
    read = F.transform("readings", lambda m, n: entry(F.try_element_at(by_kind, m["kind"]), 5, part(F.lit(None), m["value"], F.lit(None), m["unit"]), n + 1))
    columns = ["doc_id", "fact_ord", "id", "label", "context", "value_num", "value_str", "unit_of_measure", "page", "bbox", "x", "y", "score"]
    facts = units.select(*columns, F.lower("text").alias("low"), F.inline_outer(F.concat(own, read))).where("topic is not null")
    place = [-F.col("y"), -F.col("x"), F.col("fact_ord")]
    holds = lambda vocabulary: F.filter(vocabulary, lambda w: F.contains(F.col("low"), w))
    topics, sets = words_met(topics, facts, holds, ["topic", "bonus"], [*place, F.col("cand")], [*columns[1:], "p", "cand"])

    def answer(one: DataFrame) -> DataFrame:
        rows = one.select("q_id", "doc_id", "words", F.posexplode("topics").alias("t_ord", "topic"))
        rows = single(rows.join(sets, ["doc_id", "topic"])).withColumn("parts", F.array("p"))
        rows = rows.withColumn("rank", F.col("bonus") + F.size(F.array_intersect("words", "held")))
        return first_of(rows, ["q_id"], [-F.col("rank"), *place, F.col("t_ord"), F.col("cand")], ANSWER)

    return of_equals(topics, ["doc_id", "topics", "words"], answer).withColumn("priority", F.lit(900))


def grid_by_words(asked_: DataFrame, rows: DataFrame) -> DataFrame:
    """Rule 950: the table row whose header shares most words with the question, the earliest of equals."""
    asked_ = asked_.where("priority = 950").select("q_id", "doc_id", words_of(F.col("q")).alias("words"))
    header = F.array_distinct(F.regexp_extract_all("header", F.lit(r"[a-z0-9.]+"), F.lit(0)))
    place = [F.col("grid_ord"), F.col("row")]
    large = grid_answer(rows.where("rows >= 2 and cols >= 2"))
    asked_, sets = words_met(asked_, large, lambda vocabulary: F.array_sort(F.array_intersect(header, vocabulary)), [], place, ["grid_ord", "row", *ANSWER])

    def answer(one: DataFrame) -> DataFrame:
        hit = one.join(sets, "doc_id").withColumn("common", F.size(F.array_intersect("words", "held"))).where("common > 0")
        return first_of(hit, ["q_id"], [-F.col("common"), *place], ANSWER)

    return of_equals(asked_.where(F.size("words") > 0), ["doc_id", "words"], answer).withColumn("priority", F.lit(950))


def unit_by_name(asked_: DataFrame, units: DataFrame) -> DataFrame:
    """Rule 1000: the first fact whose label, or context of four letters or more, stands in the question."""
    longer = lambda c, volt: F.replace(F.replace(F.replace(c, F.lit("temp"), F.lit("temperature")), F.lit("freq"), F.lit("frequency")), F.lit("volt"), F.lit("voltage" if volt else "volt"))
    columns = ["fact_ord", "lbl", "ctx", "id", "label", "context", "value_num", "value_str", "unit_of_measure", "page", "bbox", "x", "y", "score"]
    names = first_of(units, ["doc_id", "lbl", "ctx"], [F.col("fact_ord")], [c for c in columns if c not in ("lbl", "ctx")])  # names repeat: questions meet each once
    names = once(names.where("lbl <> '' or char_length(ctx) > 3"), long_label=longer(F.col("lbl"), False))
    q = once(asked_.where("priority = 1000").select("q_id", "doc_id", "q"), long_q=longer(F.col("q"), True))
    label = (F.col("lbl") != "") & (F.contains("q", "lbl") | F.contains("long_q", "long_label"))
    named = label | ((F.char_length("ctx") > 3) & F.contains("q", "ctx"))
    hit = q.join(names, "doc_id").where(named)
    return first_of(single(hit), ["q_id"], [F.col("fact_ord")], ANSWER).withColumn("priority", F.lit(1000))


def document_answers(units: DataFrame, bijections: DataFrame, rows: DataFrame, rules: list[Rule] | None = None, tags: FactTags = DEFAULT) -> DataFrame:
    """(doc_id, priority, …ANSWER): what each rule says about each document, whatever the question. ``units`` are prepared."""
    rules = RULES if rules is None else rules
    columns = ["doc_id", "priority", *ANSWER, "step"]
    # (answers, step by which they come; rule 800 asks tables first)
    found = [(bijection_rules(bijections).where(F.col("priority").isin([r.priority for r in rules])), F.lit(1)), (grid_by_header(rows, rules), F.when(F.col("priority") == 800, 0).otherwise(2))]
    if one := [r for r in rules if r.family != "several"]:
        found.append((rule_answers(units, one, tags=tags), F.lit(0)))
    if several := [r for r in rules if r.family == "several"]:
        found.append((several_facts(units, several, tags), F.when(F.col("priority") == 800, 2).otherwise(0)))
    union = None
    for answers, step in found:
        answers = answers.withColumn("step", step).select(*columns)
        union = answers if union is None else union.unionByName(answers)
    return first_of(union, ["doc_id", "priority"], [F.col("step")], ANSWER)


def dispatch(questions: DataFrame, units: DataFrame, bijections: DataFrame, grids: DataFrame, use_intent: bool = True, extra: dict[int, tuple] | None = None, own: Iterable[Rule] = ()) -> DataFrame:
    """One row per question: q_id, doc_id, question, intent, priority, status and the columns ANSWER.

    The rule of the smallest priority that has an answer wins; then the derivations; else
    the question is refused. ``own``: more rules of the families (``rules_of`` a table); ``extra``: plans of
    the user's own, as for ``gates``. Only the
    documents asked about are read, and only the rules that a question may use are answered
    (which of the listed rules those are is the one thing that the driver asks first).
    """
    from veritab.operators.derived import asks, derive

    # A question put to a document several times is answered once; q_id names the answer, not the question, from here on.
    asks_ = materialise(questions.groupBy("doc_id", "question").agg(F.min("q_id").alias("q_id")))
    every_rule = sorted([*RULES, *own], key=lambda r: r.priority)
    tags, asked = (DEFAULT, ASKED) if len(every_rule) == len(RULES) else (FactTags(every_rule), QuestionTags(every_rule))
    asked_ = materialise(gates(asks_, use_intent, extra, asked))
    used = {r.priority for r in asked_.select("priority").distinct().collect()}
    documents = asks_.select("doc_id").distinct()
    of_asked = lambda table: table.join(documents, "doc_id", "left_semi")
    facts, grid_cells, pins = materialise(prepared(of_asked(units), tags)), cells(of_asked(grids)), of_asked(bijections)
    rows = grid_rows(grid_cells)
    wanted = asked_.select("q_id", "doc_id", "priority")
    found = wanted.join(document_answers(facts, pins, rows, [r for r in every_rule if r.priority in used], tags), ["doc_id", "priority"]).select("q_id", "priority", *ANSWER)
    by_question = {100: lambda: pin_lookup(asked_, pins, grid_cells), 900: lambda: unit_by_topic(asked_, facts, asked), 950: lambda: grid_by_words(asked_, rows), 1000: lambda: unit_by_name(asked_, facts)}
    for priority, plan in by_question.items():
        if priority in used:
            found = found.unionByName(plan().select("q_id", "priority", *ANSWER))
    for priority, (_, _, plan) in (extra or {}).items():
        if priority in used:
            found = found.unionByName(plan(asked_.where(F.col("priority") == priority), facts).select("q_id", F.lit(priority).alias("priority"), *ANSWER))
    found = found.unionByName(derive(asks_.where(asks(F.col("question"))), facts).where("answered").select("q_id", F.lit(2000).alias("priority"), *ANSWER))
    best = first_of(found, ["q_id"], [F.col("priority")], ["priority", *ANSWER])
    kind = intent.classify(F.col("question")) if use_intent else F.lit("general_question")
    answered = once(asks_, intent=kind).join(best, "q_id", "left").drop("q_id").withColumnsRenamed({"doc_id": "_doc", "question": "_question"})
    open_ = (F.col("intent") != "out_of_scope") & F.col("priority").isNotNull()
    every = questions.join(answered, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("question").eqNullSafe(F.col("_question")), "left")
    return every.select("q_id", "doc_id", "question", "intent", *[F.when(open_, F.col(c)).alias(c) for c in ["priority", *ANSWER]], F.when(open_, "answer").otherwise("refuse").alias("status"))


def answers_view(spark, questions: str = "questions", units: str = "units", bijections: str = "bijections", grids: str = "grids", rules: str | None = None, name: str = "answers") -> DataFrame:
    """Answers, for SQL: the temporary view ``name`` of the questions in one table, or view, against the facts in others, with the rules of a further one beside the library's.

    The facts are read when this is called; call it again for new ones.
    """
    own = rules_of(spark.table(rules)) if rules else ()
    got = dispatch(*[spark.table(t) for t in (questions, units, bijections, grids)], own=own)
    got.createOrReplaceTempView(name)
    return got
