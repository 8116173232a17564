"""Pages, their extraction as JSON, and the facts made of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.text import has_any, number

MAX_BYTES, MAX_JSON = 100 << 20, 10 << 20
# Kinds of pages, with words that tell them by rule, and hints for the extractor.
PAGE_TYPES = {
    "pinout_table": (["pin configuration", "pinout", "pin description"], "Extract every pin as a pair of number and name."),
    "absolute_max_ratings": (["absolute maximum"], "Extract every limit with its unit."),
    "electrical_specs": (["electrical characteristics", "dc characteristics"], "Extract minimum, typical and maximum values with units and conditions."),
    "timing_characteristics": (["timing characteristics", "switching characteristics"], "Extract times with units."),
    "package_info": (["package dimensions", "package outline", "mechanical"], "Extract dimensions with units."),
    "block_diagram": (["block diagram"], ""),
    "text_description": (["ordering information", "features", "applications", "description"], "Extract part numbers and what the component does."),
    "other": ([], ""),
}
#: Nested values of several shapes stay JSON text here.
RAW = """units array<struct<id:string,label:string,value:string,text:string,content:string,unit_of_measure:string,context:string,origin:string,bbox:string>>,
bijections array<struct<id:string,pair:array<string>,key:string,value:string,left_set:array<string>,right_set:array<string>,mapping:string,origin:string,bbox:string>>,
grids array<struct<id:string,rows:string,cols:string,cells:string,origin:string,bbox:string>>"""
ROW_OBJECTS = "array<struct<cells:array<string>,cell:array<string>>>"
CELL_OBJECTS = "array<struct<row:string,col:string,value:string,text:string,content:string,origin:string>>"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files with whether each is a PDF that may be ingested, its hash and why not. (Spark's reader may leave out files without any bytes.)"""
    rows = spark.read.format("binaryFile").load(path)
    why = (
        F.when(~F.lower("path").endswith(".pdf"), "suffix").when(F.col("length") == 0, "empty").when(F.col("length") > MAX_BYTES, "too large")
        .when(~F.startswith(F.col("content"), F.lit(b"%PDF-")), "not a PDF")
    )
    return rows.select("path", "length", F.sha2("content", 256).alias("content_hash"), why.alias("rejected"), "content")


def page_type(text: Column) -> Column:
    """The kind of a page by its words; a classifier of the user's own may replace it."""
    low, found = F.lower(F.coalesce(text, F.lit(""))), F.lit("other")
    for name, (words, _) in reversed(PAGE_TYPES.items()):
        if words:
            found = F.when(has_any(low, words), name).otherwise(found)
    return found


def hint(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for name, (_, text) in PAGE_TYPES.items() for x in (name, text)])[kind], F.lit(""))


def extract(pages: DataFrame, extractor: Callable) -> DataFrame:
    """Runs ``extractor`` (batches of page rows as pandas -> doc_id, page, json) over pages; failures are the extractor's to turn into empty JSON."""
    return pages.mapInPandas(extractor, "doc_id string, page int, json string")


def _number(path: str, raw: Column) -> Column:
    return number(F.get_json_object(raw, path))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def origin(raw: Column) -> Column:
    """A point of JSON {x, y} or [x, y], within 0 and 1; null for anything else."""
    x, y = F.coalesce(_number("$.x", raw), _number("$[0]", raw)), F.coalesce(_number("$.y", raw), _number("$[1]", raw))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(clamp(x).alias("x"), clamp(y).alias("y")))


def bbox(raw: Column) -> Column:
    """A box of JSON {x1, y1, x2, y2} or a list of four; not clamped."""
    at = [F.coalesce(_number(f"$.{name}", raw), _number(f"$[{i}]", raw)) for i, name in enumerate(("x1", "y1", "x2", "y2"))]
    every = at[0].isNotNull() & at[1].isNotNull() & at[2].isNotNull() & at[3].isNotNull()
    return F.when(every, F.struct(*[a.alias(n) for a, n in zip(at, ("x1", "y1", "x2", "y2"), strict=True)]))


def filled(*options: Column) -> Column:
    """The first that is neither null nor empty nor zero, else empty text."""
    return F.coalesce(*[F.when(~F.coalesce(o, F.lit("")).isin("", "0", "0.0", "false"), o) for o in options], F.lit(""))


def bare_json() -> Column:
    """The JSON of a page without the code fences around it."""
    return F.regexp_replace(F.trim("json"), r"(?s)^```(?:json)?\s*|\s*```$", "")


def page_status(pages: DataFrame) -> DataFrame:
    """(doc_id, page, failed): pages whose extraction is missing, too large or no JSON have failed; an empty one has not."""
    return parsed(pages).select("doc_id", "page", "failed")


def ingest_counts(status: DataFrame, **facts: DataFrame) -> DataFrame:
    """Per document: total_pages, pages_failed, the number of facts of each kind (``units`` gives units_count), and note.

    ``note``: "nothing extracted", "pages failed" or null. Facts are counted before they are joined.
    """
    out = status.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count_if("failed").alias("pages_failed"))
    total = F.lit(0)
    for kind, table in facts.items():
        name = f"{kind}_count"
        out = out.join(table.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").na.fill(0, [name])
        total = total + F.col(name)
    return out.withColumn("note", F.when(total == 0, "nothing extracted").when(F.col("pages_failed") > 0, "pages failed"))


def parsed(pages: DataFrame) -> DataFrame:
    """(doc_id, page, e, failed): extractions; code fences are stripped, and text that is no JSON or too large is an empty extraction. Pages that are parsed already stay as they are."""
    if "e" in pages.columns:
        return pages
    bare = bare_json()
    fits = F.length("json") <= MAX_JSON
    failed = ~F.coalesce(fits & F.get_json_object(bare, "$").isNotNull(), F.lit(False))
    return pages.select("doc_id", "page", F.from_json(F.when(fits, bare), RAW, {"mode": "PERMISSIVE"}).alias("e"), failed.alias("failed"))


def _named(kind: str) -> Column:
    return F.when(F.trim(F.coalesce("i.id", F.lit(""))) != "", F.col("i.id")).otherwise(F.concat(F.lit("p"), F.col("page"), F.lit(f"_{kind}"), F.col("n")))


def _tail() -> list[Column]:
    """Facts keep their order: by page, then by place in the extraction."""
    order = F.col("page").cast("long") * 1_000_000 + F.col("n")
    return [origin(F.col("i.origin")).alias("origin"), bbox(F.col("i.bbox")).alias("bbox"), "doc_id", "page", F.lit(None).cast("string").alias("org_id"), order.alias("fact_ord")]


def units(pages: DataFrame, agreement: float = 0.5) -> DataFrame:
    """Units of extractions, as read back from the store: text that writes a number is a number. Without an origin a unit is dropped."""
    rows = parsed(pages).select("doc_id", "page", F.posexplode("e.units").alias("n", "i"))
    value = F.coalesce("i.value", filled(F.col("i.text"), F.col("i.label"), F.col("i.content")))
    num = F.when(value.rlike(r"^\s*[+-]?\d+\s*$") | F.contains(value, F.lit(".")), number(value))
    return rows.select(
        _named("u").alias("id"), F.col("i.label").alias("label"), F.when(num.isNull(), value).alias("value_str"), num.alias("value_num"),
        F.col("i.unit_of_measure").alias("unit_of_measure"), F.col("i.context").alias("context"), F.lit(agreement).alias("extraction_agreement"), *_tail(),
    ).where("origin is not null")


def bijections(pages: DataFrame) -> DataFrame:
    """Mappings: a pair, a key and a value, or two sets and a mapping."""
    rows = parsed(pages).select("doc_id", "page", F.posexplode("e.bijections").alias("n", "i"))
    pair = F.when(F.size("i.pair") >= 2, F.struct(F.col("i.pair")[0].alias("k"), F.get("i.pair", F.lit(1)).alias("v"))).when(F.col("i.key").isNotNull() & F.col("i.value").isNotNull(), F.struct(F.col("i.key").alias("k"), F.col("i.value").alias("v")))
    whole = F.transform(F.map_entries(F.from_json("i.mapping", "map<string,string>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    rows = rows.withColumn("mapping", F.when(pair.isNotNull(), F.array(pair)).when(F.col("i.left_set").isNotNull() & F.col("i.right_set").isNotNull(), whole))
    left, right = F.transform("mapping", lambda e: e["k"]), F.transform("mapping", lambda e: e["v"])
    return rows.select(
        _named("b").alias("id"), F.when(pair.isNotNull(), left).otherwise(F.col("i.left_set")).alias("left_set"), F.when(pair.isNotNull(), right).otherwise(F.col("i.right_set")).alias("right_set"), "mapping", *_tail(),
    ).where("origin is not null and mapping is not null")


def grids(pages: DataFrame) -> DataFrame:
    """Tables: rows as a list of objects with cells, or numbers of rows and columns and a list of cells."""
    rows = parsed(pages).select("doc_id", "page", F.posexplode("e.grids").alias("n", "i"))
    rows = rows.withColumns({"by_row": F.from_json("i.rows", ROW_OBJECTS), "by_cell": F.from_json("i.cells", CELL_OBJECTS)})
    text = lambda c: F.when(F.startswith(F.trim(c), F.lit("{")), filled(F.get_json_object(c, "$.value"), F.get_json_object(c, "$.text"), F.get_json_object(c, "$.content"))).otherwise(c)
    cell = lambda r, c, v, o: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), v.alias("value"), o.alias("origin"))
    listed = F.flatten(F.transform("by_row", lambda row, r: F.transform(F.coalesce(row["cells"], row["cell"], F.array().cast("array<string>")), lambda c, k: cell(r, k, text(c), origin(F.get_json_object(c, "$.origin"))))))
    flat = F.transform("by_cell", lambda c: cell(c["row"].try_cast("int"), c["col"].try_cast("int"), filled(c["value"], c["text"], c["content"]), origin(c["origin"])))
    wide = F.aggregate(F.transform("by_row", lambda row: F.size(F.coalesce(row["cells"], row["cell"], F.array().cast("array<string>")))), F.lit(1), lambda a, b: F.greatest(a, b))
    as_rows = F.startswith(F.trim(F.coalesce("i.rows", F.lit(""))), F.lit("["))
    out = rows.select(
        _named("g").alias("id"), F.when(as_rows, F.size("by_row")).otherwise(F.col("i.rows").try_cast("int")).alias("rows"), F.when(as_rows, wide).otherwise(F.col("i.cols").try_cast("int")).alias("cols"),
        F.when(as_rows, listed).otherwise(F.coalesce(F.filter(flat, lambda c: (c["row"] >= 0) & (c["col"] >= 0)), F.array().cast("array<struct<row:int,col:int,value:string,origin:struct<x:double,y:double>>>"))).alias("cells"), *_tail(),
    )
    return out.where("rows is not null and cols is not null").withColumn("origin", F.coalesce("origin", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))))


def canonical(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid facts, and those that are not (no id, a negative page): nothing is dropped silently."""
    ok = F.coalesce((F.trim("id") != "") & (F.col("page") >= 0), F.lit(False))
    return facts.where(ok), facts.where(~ok)
