"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import intent, units
from veritab.functions.text import MEASUREMENTS, keyword_overlap, measurements
from veritab.operators import checks, compare, consensus, derived, learn, metrics, multipage, rules, store
from veritab.operators.confidence import overall, tier, unit_quality
from veritab.operators.facts import measurement_table, prepared
from veritab.operators.rule_table import RULES
from veritab.plans.adapters import audit_fx, bijections_fx, corpus_fx, corrections_fx, grids_fx, questions_fx, ranges_fx, results_fx, spec_fx, table, units_fx, usage_fx
from veritab.runtime import divided, materialise
from veritab.sources import corpus, exports, extractions
from veritab.streaming.ingest import usage_by_window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BY_NAME = {r.name: r for r in RULES}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("long")


def answer_number(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("parts")[0]["num"].alias("value"), F.col("parts")[0]["unit"].alias("unit"), "source_id", "score")


@query
def facts_by_doc(s, d):
    return units_fx(s, d).where("doc_id = '7'").select("id", "label", "value_num", "unit_of_measure", "context", "page", "fact_ord")


@query
def facts_union_all(s, d):
    return store.all_facts(units=units_fx(s, d), ranges=ranges_fx(s, d), bijections=bijections_fx(s, d))


@query
def doc_object_counts(s, d):
    docs = units_fx(s, d).select("doc_id").distinct()
    return store.object_counts(docs, units=units_fx(s, d), ranges=ranges_fx(s, d), bijections=bijections_fx(s, d))


def projects(s, d) -> tuple[DataFrame, DataFrame]:
    """Nations as projects, customers as their documents."""
    rows = table(s, d, "nation").selectExpr("n_nationkey as project_id", "n_name as name", "cast(n_regionkey as string) as owner_uid")
    return rows, table(s, d, "customer").selectExpr("c_nationkey as project_id", "cast(c_custkey as string) as doc_id")


@query
def project_doc_counts(s, d):
    return store.project_counts(*projects(s, d)).select("project_id", "name", "doc_count")


@query
def project_documents(s, d):
    documents = table(s, d, "customer").selectExpr("cast(c_custkey as string) as doc_id", "c_name as filename")
    return store.project_documents(projects(s, d)[1], documents)


@query
def project_links(s, d):
    """Links of every document to the next project added, and those of each third document taken away."""
    links = projects(s, d)[1]
    more = links.withColumn("project_id", (F.col("project_id") + 1) % 25).unionByName(links)
    gone = links.where("cast(doc_id as int) % 3 = 0")
    return store.unlink(store.link(links, more, ["project_id", "doc_id"]), gone, ["project_id", "doc_id"])


@query
def doc_delete_cascade(s, d):
    gone = units_fx(s, d).where("cast(doc_id as int) % 10 = 3").select("doc_id").distinct()
    kept = store.all_facts(units=units_fx(s, d), ranges=ranges_fx(s, d))
    return store.delete_documents(kept, gone).groupBy("kind", "doc_id").agg(F.count("*").alias("n"))


@query
def upsert_last_write_wins(s, d):
    rows = table(s, d, "orders")
    stored = rows.where("o_orderkey % 3 = 0").selectExpr("o_custkey", "o_totalprice as price", "o_orderkey as write_seq")
    stored = checks.latest(stored, ["o_custkey"], "write_seq")
    written = rows.where("o_orderkey % 3 <> 0").selectExpr("o_custkey", "o_totalprice as price", "o_orderkey as write_seq")
    return store.upsert(stored, written, ["o_custkey"])


@query
def first_match_unit(s, d):
    return answer_number(rules.rule_answers(rules.prepared(units_fx(s, d)), [BY_NAME["thermal_resistance"]]))


def best(s, d, largest: bool) -> DataFrame:
    return answer_number(rules.rule_answers(rules.prepared(units_fx(s, d)), [BY_NAME["max_voltage"]], largest))


@query
def best_numeric_max(s, d):
    return best(s, d, True)


@query
def best_numeric_min(s, d):
    return best(s, d, False)


@query
def range_assembly(s, d):
    rows = rules.rule_answers(rules.prepared(units_fx(s, d)), [BY_NAME["operating_voltage_range"]])
    return rows.select("doc_id", "shape", F.col("parts")[0]["num"].alias("low"), F.get("parts", F.lit(1))["num"].alias("high"), F.col("parts")[0]["unit"].alias("unit"), "source_id")


@query
def multi_value_concat(s, d):
    rows = rules.several_facts(rules.prepared(units_fx(s, d)), [BY_NAME["threshold_voltage"]])
    shown = F.transform("parts", lambda p: F.concat(p["label"], F.lit(":"), cents(p["num"]).cast("string"), p["unit"]))
    return rows.select("doc_id", "shape", F.array_join(shown, ";").alias("shown"), "source_id")


@query
def keyword_overlap_score(s, d):
    rows = rules.prepared(units_fx(s, d))
    return rows.select("fact_ord", keyword_overlap(F.lit("What is the maximum supply voltage of the clock output?"), F.col("text")).alias("overlap"))


@query
def intent_classify(s, d):
    return questions_fx(s, d).select("q_id", "question", intent.classify(F.col("question")).alias("intent"))


@query
def rule_gate_matrix(s, d):
    return rules.gates(questions_fx(s, d)).where("priority not in (900, 950, 1000)").select("q_id", "priority")


#: Two ways to write units of each kind, for the measurements below.
WRITTEN = {"voltage": (" mV", "kV"), "current": ("ua", " A"), "capacity": (" mah", "Wh"), "power": ("mw", " WATTS"), "temperature": (" K", "k"), "frequency": ("ghz", " Hz"), "time": ("us", " ms"), "dimension": ("inch", " mm"), "weight": ("KG", " oz")}


def parse_measurements(kind: str) -> Query:
    def run(s, d):
        a, b = WRITTEN[kind]
        rows = table(s, d, "orders").select("o_orderkey", measurements(kind, F.concat(F.lit("rated "), (F.col("o_orderkey") % 1000).cast("string"), F.lit(f".5{a}, typ "), (F.col("o_custkey") % 77).cast("string"), F.lit(f"{b} max"))).alias("m"))
        return rows.select("o_orderkey", F.size("m").alias("n"), F.col("m")[0]["value"].alias("value_1"), F.col("m")[0]["unit"].alias("unit_1"), F.col("m")[1]["value"].alias("value_2"), F.col("m")[1]["unit"].alias("unit_2"))

    return run


for _kind in MEASUREMENTS:
    QUERIES[f"parse_measurements_{_kind}"] = parse_measurements(_kind)


def asked_of_all(s, rows: DataFrame, question: str) -> DataFrame:
    """The question, put to each document."""
    return rows.select("doc_id").distinct().select(F.col("doc_id").cast("long").alias("q_id"), "doc_id", F.lit(question).alias("question"))


@query
def unit_by_intent(s, d):
    u = units_fx(s, d)
    asked = rules.gates(asked_of_all(s, u, "Tell me the frequency"))
    return rules.unit_by_topic(asked, rules.prepared(u)).select("q_id", F.col("parts")[0]["num"].alias("value"), F.col("parts")[0]["unit"].alias("unit"), "source_id")


def grid_rows(s, d) -> DataFrame:
    return rules.grid_rows(rules.cells(grids_fx(s, d)))


@query
def grid_header_lookup(s, d):
    rule = rules.Rule(1, "by_name", "first", (("x",),), grid=("7", "9"))
    return rules.grid_by_header(grid_rows(s, d), [rule]).select("doc_id", F.col("parts")[0]["str"].alias("value"), "source_id", "page")


@query
def grid_cell_lookup(s, d):
    g = grids_fx(s, d)
    asked = rules.gates(asked_of_all(s, g, "Supplier 000000042"))
    return rules.grid_by_words(asked, grid_rows(s, d)).select("q_id", F.col("parts")[0]["str"].alias("value"), "source_id")


def pins(s, d, swapped: bool) -> DataFrame:
    q = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("q_id"), F.col("n_regionkey").cast("string").alias("doc_id"), F.concat(F.lit("What is pin "), F.col("n_nationkey").cast("string"), F.lit("?")).alias("question"))
    got = rules.pin_lookup(rules.gates(q), bijections_fx(s, d, swapped), rules.cells(grids_fx(s, d)))
    return got.select("q_id", F.col("parts")[0]["str"].alias("answer"), "source_id", "source_type")


@query
def pin_lookup(s, d):
    return pins(s, d, False)


@query
def pin_inverse_lookup(s, d):
    return pins(s, d, True)


@query
def pin_count(s, d):
    return rules.bijection_rules(bijections_fx(s, d)).where("priority = 740").select("doc_id", F.col("parts")[0]["str"].cast("int").alias("n_pins"), "source_id")


@query
def unit_label_lookup(s, d):
    u = units_fx(s, d)
    asked = rules.gates(asked_of_all(s, u, "Give me RthJA or the output current"))
    return rules.unit_by_name(asked, rules.prepared(u)).select("q_id", F.col("parts")[0]["num"].alias("value"), "source_id")


@query
def measurements_of_facts(s, d):
    """The measurements of all kinds in the texts of facts, by one search each."""
    return measurement_table(prepared(spec_fx(s, d)))


@query
def rule_answers_all(s, d):
    """What each rule says about each document."""
    got = rules.document_answers(materialise(prepared(spec_fx(s, d))), bijections_fx(s, d).where("false"), grid_rows(s, d).where("false"))
    ids, num = F.array_join(F.transform("proof", lambda p: p["source_id"]), ","), lambda at: F.element_at("parts", at)["num"]
    return got.select("doc_id", "priority", "shape", "source_id", "page", ids.alias("proof_ids"), F.size("proof").alias("n_proofs"), num(1).alias("first_num"), num(-1).alias("last_num"), F.col("parts")[0]["unit"].alias("unit"))


@query
def dispatch_all(s, d):
    """All questions, each about its document."""
    got = rules.dispatch(questions_fx(s, d), spec_fx(s, d), bijections_fx(s, d), grids_fx(s, d))
    ids = F.array_join(F.transform("proof", lambda p: p["source_id"]), ",")
    return got.select("q_id", "intent", "priority", "status", "shape", "source_id", "source_type", "page", F.when(F.col("proof").isNotNull(), F.size("proof")).alias("n_proofs"), ids.alias("proof_ids"))


def derivation(name: str) -> Query:
    def run(s, d):
        rows = derived.derivations(units_fx(s, d)).where(F.col(name).isNotNull())
        return rows.select("doc_id", F.round(f"{name}.value", 3).alias("value"), F.col(f"{name}.unit").alias("unit"), F.round(f"{name}.second", 3).alias("second"), F.col(f"{name}.score").alias("score"))

    return run


for _name in ("power", "thermal", "margin", "budget"):
    QUERIES[f"derived_{_name}"] = derivation(_name)


@query
def canonical_quality(s, d):
    return units_fx(s, d).select("fact_ord", unit_quality().alias("quality"))


@query
def confidence_tier(s, d):
    score = overall((F.col("o_orderkey") % 11) / 10.0, (F.col("o_custkey") % 11) / 10.0, F.lit(0.7))
    return table(s, d, "orders").select("o_orderkey", score.alias("score"), tier(score).alias("tier"))


@query
def unit_to_base(s, d):
    return units_fx(s, d).select("fact_ord", F.round(units.base_value(F.col("value_num"), F.col("unit_of_measure")), 6).alias("base_value"), units.base_unit(F.col("unit_of_measure")).alias("base_unit"))


@query
def contradictions(s, d):
    return checks.contradictions(checks.checkable(units_fx(s, d))).withColumns({"value_a": F.round("value_a", 6), "value_b": F.round("value_b", 6)})


@query
def range_consistency(s, d):
    return checks.range_consistency(ranges_fx(s, d)).groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.round(F.sum("value_a"), 4).alias("sum_min"), F.round(F.sum("value_b"), 4).alias("sum_max"))


@query
def power_constraint(s, d):
    facts = checks.checkable(units_fx(s, d).withColumns({"context": F.concat(F.lit("maximum "), F.col("context")), "value_num": F.col("value_num") / 1000}))
    return checks.power_constraint(facts).select("doc_id", "severity", F.round("value_a", 6).alias("rated"), F.round("value_b", 6).alias("needed"))


@query
def thermal_viability(s, d):
    return checks.thermal_viability(checks.checkable(units_fx(s, d))).select("doc_id", "severity", F.round("value_a", 3).alias("junction"), F.round("value_b", 3).alias("limit"))


@query
def dropout_margin(s, d):
    rows = units_fx(s, d)
    named = F.element_at(F.array(F.lit("input voltage minimum"), F.lit("output voltage"), F.lit("dropout")), (F.col("fact_ord") % 3).cast("int") + 1)
    return checks.dropout_margin(checks.checkable(rows.withColumns({"context": named, "label": F.lit("")}))).select("doc_id", "severity", F.round("value_a", 3).alias("margin"), F.round("value_b", 3).alias("dropout"))


@query
def issue_rollup(s, d):
    """Of all six checks, on facts that have issues of each kind."""
    context = """case when label = 'ICC' then 'maximum supply current' when label = 'PD' then 'maximum power dissipation' when label = 'VCC' then
        element_at(array('input voltage minimum', 'output voltage', 'dropout'), cast(fact_ord % 3 as int) + 1) else context end"""
    return checks.rollup(checks.run_checks(units_fx(s, d).withColumn("context", F.expr(context)), ranges_fx(s, d)))


def all_documents(s, d) -> DataFrame:
    return units_fx(s, d).select("doc_id").distinct().withColumn("doc_ord", F.col("doc_id").cast("int"))


@query
def compare_best(s, d):
    return compare.compare(units_fx(s, d), all_documents(s, d)).select("parameter", "doc_id", "value", "unit", "source_id", "is_best")


@query
def compare_pivot(s, d):
    got = compare.compare(units_fx(s, d), all_documents(s, d)).withColumn("value", cents(F.col("value")))
    rows = compare.matrix(got.withColumn("unit", F.lit(None).cast("string")), [str(i) for i in range(97)])
    return rows.select("parameter", *[F.col(str(i)).alias(f"doc_{i}") for i in range(97)])


@query
def param_detect(s, d):
    return questions_fx(s, d).select("q_id", F.explode(compare.detected(F.col("question"))).alias("parameter"))


@query
def correction_stats(s, d):
    return learn.correction_stats(corrections_fx(s, d))


def shown_pattern(rows: DataFrame) -> DataFrame:
    return rows.select("category", "original_pattern", "corrected_pattern", "occurrences", F.col("n_docs").cast("int").alias("n_docs"), F.round("confidence", 4).alias("confidence"), "auto_correctable")


@query
def unit_confusion(s, d):
    return shown_pattern(learn.unit_confusion(corrections_fx(s, d)))


@query
def value_scaling(s, d):
    return shown_pattern(learn.value_scaling(corrections_fx(s, d)))


@query
def label_misread(s, d):
    return shown_pattern(learn.label_misread(corrections_fx(s, d)))


@query
def type_bias(s, d):
    return shown_pattern(learn.type_bias(corrections_fx(s, d)))


@query
def auto_rules(s, d):
    return shown_pattern(learn.auto_rules(learn.patterns(corrections_fx(s, d))))


@query
def pattern_stats(s, d):
    return learn.pattern_stats(learn.patterns(corrections_fx(s, d)))


@query
def patterns_of_days(s, d):
    """Each day counted by itself, into a table by day, and merged."""
    rows = divided(learn.daily(corrections_fx(s, d)), "day")
    days = [r.day for r in rows.select("day").distinct().collect()]
    halves = [rows.where(F.col("day").isin(days[k::2])) for k in (0, 1)]  # the order in which days come does not matter
    return shown_pattern(learn.merged(halves[1].unionByName(halves[0])))


@query
def top_patterns(s, d):
    return shown_pattern(learn.top_patterns(learn.patterns(corrections_fx(s, d))))


@query
def suggest_correction(s, d):
    rows = corrections_fx(s, d)
    return learn.suggest(rows.select("id", "canonical_type", F.col("original_value").alias("value")), learn.patterns(rows))


@query
def review_queue(s, d):
    return learn.review_queue(corrections_fx(s, d))


@query
def usage_summary(s, d):
    return store.usage_summary(usage_fx(s, d)).select("user_id", "action", "used", "remaining")


@query
def usage_limit(s, d):
    return store.usage_summary(usage_fx(s, d)).where("not allowed").select("user_id", "action", "used")


@query
def audit_topk(s, d):
    return store.newest(audit_fx(s, d), "created_at", "id", 100).select("id", "doc_id", "action", "created_at")


@query
def audit_details(s, d):
    return exports.audit_rows(audit_fx(s, d))


@query
def chat_page(s, d):
    return store.page(table(s, d, "conversations"), ["conv_id", "turn"], 50, 10)


@query
def chat_next_page(s, d):
    """The page behind the 15th turn, by its key."""
    pages = store.Pages(table(s, d, "conversations"), ["conv_id", "turn"])
    last = pages.page(1, 14).first()
    return pages.after((last.conv_id, last.turn), 40)


def matched(s, d, by_content: bool) -> DataFrame:
    known, files = corpus_fx(s, d), corpus_fx(s, d).withColumn("content_hash", F.when(F.col("doc_id") % 3 == 0, F.col("content_hash")).otherwise(F.concat(F.lit("new "), "content_hash")))
    return corpus.match(files, known if by_content else known.withColumn("content_hash", F.concat(F.lit("x"), "content_hash"))).select("doc_id", "corpus_hash", "matched_by")


@query
def corpus_hash_match(s, d):
    return matched(s, d, True)


@query
def corpus_mpn_fallback(s, d):
    return matched(s, d, False)


@query
def corpus_availability(s, d):
    chips = s.createDataFrame([("SRC1",), ("src7",), ("src99",)], "chip_name string")
    return corpus.availability(chips, corpus_fx(s, d))


@query
def permalink_id(s, d):
    return table(s, d, "documents").select("doc_id", store.permalink(F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("question_id"))


@query
def share_preview(s, d):
    rows = table(s, d, "documents").select("doc_id", F.concat("source", F.lit(": "), "text").alias("question"), F.col("text").alias("answer"))
    return store.preview(rows)


@query
def share_upsert(s, d):
    c = table(s, d, "customer")
    stored = c.selectExpr("c_custkey as question_id", "c_name as doc_id", "'old' as question", "1 as source_page", "'first' as answer")
    new = c.selectExpr("c_custkey * 2 as question_id", "'new' as doc_id", "'new' as question", "2 as source_page", "c_mktsegment as answer")
    return store.share(stored, new)


@query
def doc_id_valid(s, d):
    return table(s, d, "part").select("p_partkey", store.valid_doc_id(F.col("p_type")).alias("type_ok"), store.valid_doc_id(F.col("p_name")).alias("name_ok"))


@query
def page_types(s, d):
    text = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_size") > 25, "Absolute Maximum Ratings").when(F.col("p_size") > 10, "Ordering Information"))
    kind = extractions.page_type(text)
    return table(s, d, "part").select("p_partkey", kind.alias("kind"), consensus.wanted(True, kind).alias("twice"))


@query
def multipage_candidates(s, d):
    return multipage.candidates(grids_fx(s, d)).select("doc_id", F.col("grid_a.id").alias("id_a"), F.col("grid_b.id").alias("id_b"), F.round("column_similarity", 4).alias("similarity"), "needs_review")


@query
def multipage_merge(s, d):
    return multipage.merge(grids_fx(s, d)).select("doc_id", "id", "page", "rows", "cols", F.size("cells").alias("n_cells"))


@query
def header_jaccard(s, d):
    words = table(s, d, "part").select("p_partkey", F.array_distinct(F.split("p_type", " ")).alias("a"), F.array_distinct(F.split("p_name", " ")).alias("b"))
    return words.select("p_partkey", F.round(multipage.similarity(F.col("a"), F.concat("b", F.slice("a", 1, 1))), 6).alias("similarity"))


@query
def consensus_agreement(s, d):
    """All facts against themselves with every fifth one changed; some pages have tables only."""
    u, g, b = units_fx(s, d), grids_fx(s, d).withColumn("page", F.col("page") + 5), bijections_fx(s, d).withColumn("page", F.lit(9))
    changed = F.col("fact_ord") % 5 == 0
    second = u.withColumns({"label": F.when(changed, F.lit("unlike")).otherwise(F.col("label")), "value_num": F.when(changed, -F.col("value_num")).otherwise(F.col("value_num")), "unit_of_measure": F.when(changed, F.lit("lm")).otherwise(F.col("unit_of_measure"))})
    return consensus.agreement(consensus.consensus(u, second), (b, g), (b.where("false"), g)).withColumn("agreement", F.round("agreement", 6))


@query
def benchmark_metrics(s, d):
    return metrics.accuracy(results_fx(s, d), ["chip"])


@query
def benchmark_gate(s, d):
    return metrics.gate(results_fx(s, d))


@query
def confusion_matrix(s, d):
    return metrics.confusion(results_fx(s, d))


@query
def answers_match(s, d):
    rows = table(s, d, "orders").select("o_orderkey", F.concat((F.col("o_custkey") % 50).cast("string"), F.lit(" mV")).alias("e"), F.concat(F.lit("about "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" mV")).alias("a"))
    return rows.select("o_orderkey", metrics.answers_match(F.col("e"), F.col("a")).alias("same"))


@query
def values_match(s, d):
    rows = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).cast("string").alias("e"), F.concat(F.lit("is "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" V")).alias("a"))
    return rows.select("o_orderkey", metrics.values_match(F.col("e"), F.col("a")).alias("same"))


@query
def events_by_window(s, d):
    return usage_by_window(table(s, d, "events"), "1 day").select("start", "event_type", "n")
