"""Fact tables made of the driver's tables: without datasheets, these give the operators something to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_BOX = "cast(null as struct<x1:double,y1:double,x2:double,y2:double>) as bbox"
QUESTIONS = [
    "What is pin 5?", "What is the maximum voltage?", "What is the maximum current?", "What is the absolute maximum voltage?", "What is the absolute maximum current?",
    "What is the supply voltage range?", "What is the operating temperature range?", "What is the storage temperature range?", "What is the reflow soldering temperature?",
    "What is the max power dissipation?", "What are the ESD ratings?", "What is the input leakage current?", "What are the logic threshold levels?", "What is the max clock frequency?",
    "What is the propagation delay?", "What are the rise and fall times?", "What are the setup and hold times?", "What package is this?", "What are the package dimensions?",
    "What is the thermal resistance?", "What is the component weight?", "How many pins does it have?", "What is the MSL rating?", "What is the part number?",
    "What does this component do?", "What is the gravitational constant of this chip?", "What is the weather?", "How to design a voltage divider?",
    "What are the recommended operating conditions?", "What is the nominal capacity?", "Calculate the power", "Is it within the thermal limit?", "How close is abs max to operating?", "Current budget",
    "Balance of supplier 000000042", "Give me RthJA or the output current", "Tell me the frequency", "What is the impedance?", "What is this?", "",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per order, in 97 documents."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('u', cast(o_orderkey as string)) as id",
        """element_at(array('VCC', 'VCC max', 'ICC', 'PD', 'RthJA', 'TJ max', 'FCLK', 'IO'), cast(o_orderkey % 8 as int) + 1) as label""",
        "cast(null as string) as value_str", "o_totalprice as value_num",
        """case o_orderkey % 8 when 0 then if(o_orderkey % 3 = 0, 'mV', 'V') when 1 then 'V' when 2 then 'mA' when 3 then 'mW' when 4 then '°C/W' when 5 then '°C' when 6 then 'MHz'
           else if(o_orderkey % 5 = 0, 'A', 'mA') end as unit_of_measure""",
        """element_at(array('supply voltage', 'absolute maximum voltage', 'supply current', 'power dissipation', 'thermal resistance junction to ambient',
           'maximum junction temperature', 'maximum clock frequency', 'output current'), cast(o_orderkey % 8 as int) + 1) as context""",
        "0.5D as extraction_agreement", "named_struct('x', 0.1D, 'y', 0.2D) as origin", NO_BOX,
        "cast(o_custkey % 97 as string) as doc_id", "cast(o_orderkey % 7 as int) as page", "'org' as org_id", "o_orderkey as fact_ord",
    )


def ranges_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('r', cast(p_partkey as string)) as id", "p_brand as label", "cast(p_size as double) as min", "cast(p_partkey % 60 as double) as typ", "p_retailprice / 20 as max", "'V' as unit",
        "cast(null as string) as conditions", "p_type as context", "named_struct('x', 0D, 'y', 0D) as origin", NO_BOX, "cast(p_partkey % 97 as string) as doc_id", "0 as page", "'org' as org_id", "p_partkey as fact_ord",
    )


def bijections_fx(spark: SparkSession, sf_dir: str, swapped: bool = False) -> DataFrame:
    """A mapping per region: nation keys to names (or the other way)."""
    k, v = ("n_name", "cast(n_nationkey as string)") if swapped else ("cast(n_nationkey as string)", "n_name")
    rows = table(spark, sf_dir, "nation").selectExpr("n_regionkey", f"struct(n_nationkey as n, {k} as k, {v} as v) as e")
    rows = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return rows.selectExpr(
        "concat('pins', cast(n_regionkey as string)) as id", "transform(e, x -> x.k) as left_set", "transform(e, x -> x.v) as right_set", "transform(e, x -> struct(x.k as k, x.v as v)) as mapping",
        "named_struct('x', 0.5D, 'y', 0.3D) as origin", NO_BOX, "cast(n_regionkey as string) as doc_id", "0 as page", "'org' as org_id", "cast(n_regionkey as long) as fact_ord",
    )


def grids_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per nation, a row per supplier: its name and balance. Five documents, a page each fifth nation."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_nationkey", "struct(s_suppkey, s_name, cast(cast(s_acctbal as decimal(12,2)) as string) as bal) as s")
    rows = rows.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    point = "cast(null as struct<x:double,y:double>)"
    return rows.selectExpr(
        "concat('g', cast(s_nationkey as string)) as id", "size(s) as rows", "2 as cols",
        f"""flatten(transform(s, (x, i) -> array(struct(i as row, 0 as col, x.s_name as value, {point} as origin), struct(i as row, 1 as col, x.bal as value, {point} as origin)))) as cells""",
        "named_struct('x', 0.1D, 'y', 0.06D * (s_nationkey % 5)) as origin", "named_struct('x1', 0D, 'y1', 0.06D * (s_nationkey % 5), 'x2', 1D, 'y2', 0.72D + 0.05D * (s_nationkey % 7)) as bbox",
        "cast(s_nationkey % 5 as string) as doc_id", "cast(floor(s_nationkey / 5) as int) as page", "'org' as org_id", "cast(s_nationkey as long) as fact_ord",
    )


def corrections_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = "(event_id % 9 + 1)"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "cast(user_id % 50 as string) as doc_id", "concat('u', cast(event_id % 200 as string)) as canonical_id",
        "element_at(array('unit', 'unit', 'range', 'grid'), cast(event_id % 4 as int) + 1) as canonical_type", "if(event_id % 3 = 0, 'confirm', 'correct') as action",
        f"""case event_id % 5 when 0 then concat({n}, ' mV') when 1 then concat(10 * {n}, ' V') when 2 then 'therml resistance' when 3 then concat({n}, ' mA') else concat(1000 * {n}, ' Hz') end as original_value""",
        f"""case event_id % 5 when 0 then concat({n}, ' V') when 1 then concat({n}, ' V') when 2 then 'thermal resistance' when 3 then concat({n}, ' A') else concat({n}, ' Hz') end as corrected_value""",
        "cast(user_id as string) as corrected_by", "cast(null as string) as notes", "ts as created_at",
    )


def usage_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as user_id", "if(event_type = 'purchase', 'document', 'query') as action", "ts as created_at")


def audit_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id as id", "cast(user_id % 50 as string) as doc_id", "event_type as action", "cast(user_id as string) as actor", "props as details_json", "ts as created_at")


def results_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("concat('chip', cast(doc_id % 5 as string)) as chip", "quality = 1 as correct", "element_at(array('verified', 'review', 'refused'), cast(doc_id % 3 as int) + 1) as status")


def corpus_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "sha2(text, 256) as content_hash", "concat('M', cast(doc_id % 500 as string)) as mpn", "source as chip_name")


def questions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per part, about one of 97 documents; every second one also names the part."""
    rows = table(spark, sf_dir, "part").withColumn("asked", F.array(*[F.lit(q) for q in QUESTIONS]))
    return rows.selectExpr(
        "cast(p_partkey as long) as q_id", f"concat(asked[cast(p_partkey % {len(QUESTIONS)} as int)], if(p_partkey % 2 = 0, '', concat(' (', p_name, ')'))) as question", "cast(p_partkey % 97 as string) as doc_id",
    )


#: Label, context, unit, text (``#``: a number; none: a number is the value), and the measurements in the text: place, kind, value, unit.
SPEC_FACTS = [
    ("VCC", "supply voltage", "V", None, None), ("VCC max", "absolute maximum voltage", "V", None, None), ("ICC max", "absolute maximum current", "mA", None, None), ("ICC", "supply current", "mA", None, None),
    ("PD", "power dissipation", "mW", None, None), ("ESD HBM", "ESD human body model", "V", None, None), ("ESD CDM", "electrostatic discharge", "V", None, None), ("IIL", "input leakage current", "µA", None, None),
    ("VIL", "input low threshold voltage", "V", None, None), ("VIH", "input high threshold voltage", "mV", None, None), ("FCLK", "maximum clock frequency", "MHz", None, None), ("tPD", "propagation delay", "ns", None, None),
    ("tR", "rise time", "ns", None, None), ("tF", "fall time", "ns", None, None), ("tSU", "setup time", "ns", None, None), ("tH", "hold time", "ns", None, None),
    ("Package", "package type", None, "TQFP-48", None), ("Length", "body size", "mm", None, None), ("Width", "package dimension width", "mil", None, None), ("RthJA", "thermal resistance junction to ambient", "°C/W", None, None),
    ("Weight", "component mass", "g", None, None), ("MSL", "moisture sensitivity level", None, "3", None), ("TOPR", "operating temperature", "°C", None, None), ("TSTG", "storage temperature", "°C", None, None),
    ("Tsolder", "reflow soldering", "°C", None, None), ("MPN", "part number ordering", None, "XQ-48Q", None), ("Description", "general description", None, "High-speed logic IC", None), ("Pins", "pin count", None, None, None),
    ("Conditions", "recommended operating conditions", None, "2.7 to 5.5 V", "1 voltage 5.5 V"), ("CAP", "nominal capacity", "mAh", None, None), ("TJ max", "maximum junction temperature", "°C", None, None),
    ("VDD", "operating voltage", None, "#.5 V typ", "1 voltage #.5 V"), ("TA", "ambient temperature", None, "-# °C min", "1 temperature -# °C"), ("IO", "output current", "mA", None, None),
    ("Battery", "capacity", None, "# mAh or #.25 Wh", "1 capacity # mAh;2 capacity #.25 Wh"), ("FOSC", "oscillator", None, "# MHz", "1 frequency # MHz"), ("PTOT", "total power", None, "#.25 W at 25°C", "1 power #.25 W;2 temperature 25 °C"),
    ("Slew", "slew rate", "V/µs", None, None), ("Order code", "order code", None, "A-17", None), ("Z0", "impedance", "Ω", None, None),
]


def spec_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per order, in 97 documents, about something of every rule."""
    names = ("labels", "contexts", "units", "texts")
    rows = table(spark, sf_dir, "orders").withColumns({name: F.array(*[F.lit(f[i]).cast("string") for f in SPEC_FACTS]) for i, name in enumerate(names)}).withColumn("k", F.expr(f"cast(o_orderkey % {len(SPEC_FACTS)} as int)"))
    return rows.selectExpr(
        "concat('s', cast(o_orderkey as string)) as id", "labels[k] as label", "replace(texts[k], '#', cast(o_custkey % 50 as string)) as value_str", "if(texts[k] is null, o_totalprice, null) as value_num", "units[k] as unit_of_measure",
        "contexts[k] as context", "0.5D as extraction_agreement", "named_struct('x', (o_orderkey % 10) / 10.0D, 'y', (o_orderkey % 9) / 10.0D) as origin", NO_BOX,
        "cast(o_custkey % 97 as string) as doc_id", "cast(o_orderkey % 7 as int) as page", "'org' as org_id", "o_orderkey as fact_ord",
    )
