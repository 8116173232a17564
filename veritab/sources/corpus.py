"""A corpus of documents whose facts are known: match, hydrate, serialise and list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.schemas import BIJECTIONS, CONDITIONAL_UNITS, GRIDS, RANGES, UNITS

#: The payload: one array of facts of each kind.
KINDS = {"units": UNITS, "bijections": BIJECTIONS, "grids": GRIDS, "ranges": RANGES, "conditional_units": CONDITIONAL_UNITS}


def match(files: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each file (content_hash, mpn) with the hash of its corpus entry and how it was found: by content, else by part number without regard to case."""
    by_hash = corpus.select(F.col("content_hash").alias("hash_a"))
    by_mpn = corpus.groupBy(F.lower("mpn").alias("key")).agg(F.min("content_hash").alias("hash_b")).where("key is not null")
    rows = files.join(by_hash.dropDuplicates(), F.col("content_hash") == F.col("hash_a"), "left").join(by_mpn, F.lower("mpn") == F.col("key"), "left")
    how = F.when(F.col("hash_a").isNotNull(), "content").when(F.col("hash_b").isNotNull(), "mpn")
    return rows.select(*files.columns, F.coalesce("hash_a", "hash_b").alias("corpus_hash"), how.alias("matched_by"))


def hydrate(matched: DataFrame, corpus: DataFrame) -> dict[str, DataFrame]:
    """The facts of matched entries under the files' own doc_id, a table of each kind; page 0 and origin (0, 0) where missing."""
    rows = matched.where("corpus_hash is not null").select("doc_id", "corpus_hash").join(corpus.select(F.col("content_hash").alias("corpus_hash"), "canonical_data"), "corpus_hash")
    out = {}
    for kind, schema in KINDS.items():
        data = F.from_json("canonical_data", f"{kind} array<struct<{as_struct(schema)}>>")[kind]
        facts = rows.select(F.col("doc_id").alias("new_id"), F.posexplode(data).alias("n", "f")).select("new_id", "n", "f.*")
        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        facts = facts.withColumns({"doc_id": F.col("new_id"), "page": F.coalesce("page", F.lit(0)), "origin": F.coalesce("origin", zero), "fact_ord": F.col("n").cast("long")})
        out[kind] = facts.drop("new_id", "n")
    return out


def as_struct(schema: str) -> str:
    """A DDL of columns as the inside of a struct type."""
    depth, parts, last = 0, [], 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts, last = [*parts, schema[last:i]], i + 1
    return ",".join(":".join(p.strip().split(" ", 1)) for p in [*parts, schema[last:]])


def serialise(**tables: DataFrame) -> DataFrame:
    """(doc_id, canonical_data): the facts of each document as JSON, in order."""
    out = None
    for kind, table in tables.items():
        one = table.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("fact_ord", F.struct(*table.columns).alias("f")))), lambda x: x["f"]).alias(kind))
        out = one if out is None else out.join(one, "doc_id", "full")
    return out.select("doc_id", F.to_json(F.struct(*tables)).alias("canonical_data"))


def listing(corpus: DataFrame) -> DataFrame:
    """Entries by name, with how many facts of each kind they have."""
    counts = [F.coalesce(F.json_array_length(F.get_json_object("canonical_data", f"$.{kind}")), F.lit(0)).alias(f"n_{kind}") for kind in KINDS]
    return corpus.select("content_hash", "mpn", "chip_name", *counts).orderBy("chip_name", "content_hash")


def availability(chips: DataFrame, corpus: DataFrame) -> DataFrame:
    """Common chips (chip_name), and whether the corpus has them, without regard to case."""
    have = corpus.select(F.lower("chip_name").alias("key")).where("key is not null").distinct().withColumn("available", F.lit(True))
    return chips.join(have, F.lower("chip_name") == F.col("key"), "left").select("chip_name", F.coalesce("available", F.lit(False)).alias("available"))
