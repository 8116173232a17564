"""Tables that go on over the next page: candidates, and their merger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.operators.matching import greedy_matching

BOTTOM, TOP, ALIKE, SURE = 0.80, 0.20, 0.5, 0.8  # fixed values: how near the edges, how alike the columns


def headers(cells: Column) -> Column:
    """The texts of row 0 by column, lower case, trimmed."""
    first = F.array_sort(F.transform(F.filter(cells, lambda c: c["row"] == 0), lambda c: F.struct(c["col"].alias("col"), F.lower(F.trim(c["value"])).alias("value"))))
    return F.transform(first, lambda c: c["value"])


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of headers; two empty ones are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def edges(grids: DataFrame) -> DataFrame:
    """Grids with headers, top and bottom on their page (of the box, else of cells or origin)."""
    ys = F.transform(F.filter("cells", lambda c: c["origin"].isNotNull()), lambda c: c["origin"]["y"])
    return grids.withColumns({"headers": headers(F.col("cells")), "bottom": F.coalesce("bbox.y2", F.array_max(ys), "origin.y"), "top": F.coalesce("bbox.y1", "origin.y")})


def candidates(grids: DataFrame) -> DataFrame:
    """Pairs of grids of one document on consecutive pages, at the foot and at the head, with as many or like columns."""
    g = edges(grids).select("doc_id", "page", "fact_ord", "id", "cols", "headers", "bottom", "top", F.col("origin.y").alias("y"))
    a, b = g.where(F.col("bottom") >= BOTTOM).alias("a"), g.where(F.col("top") <= TOP).alias("b")
    both = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.page") == F.col("a.page") + 1))
    same = F.col("a.cols") == F.col("b.cols")
    both = both.withColumn("column_similarity", similarity(F.col("a.headers"), F.col("b.headers")))
    both = both.where((same | (F.col("a.cols") <= 0) | (F.col("b.cols") <= 0)) & (same | (F.col("column_similarity") >= ALIKE)))
    side = lambda s: F.struct(f"{s}.page", f"{s}.y", f"{s}.fact_ord", f"{s}.id").alias(f"grid_{s}")
    return both.select("a.doc_id", side("a"), side("b"), "column_similarity", (F.col("column_similarity") < SURE).alias("needs_review"))


def chosen(pairs: DataFrame) -> DataFrame:
    """Of the candidates, in order of place, those whose grids are in no pair before: (doc_id, a_ord, b_ord)."""
    edges = pairs.select(F.to_json(F.struct("doc_id")).alias("place"), "doc_id", F.col("grid_a.page").alias("page"), F.col("grid_a.y").alias("a_y"), F.col("grid_b.y").alias("b_y"), F.col("grid_a.fact_ord").alias("a"), F.col("grid_b.fact_ord").alias("b"))
    found = greedy_matching(edges.withColumn("a_first", F.col("a")), ["page", "a_y", "a_first", "b_y"], two_sided=False)
    return found.select(F.get_json_object("place", "$.doc_id").alias("doc_id"), F.col("a").alias("a_ord"), F.col("b").alias("b_ord"))


def merge(grids: DataFrame) -> DataFrame:
    """Grids with each chosen pair as one: rows of the second below the first, without a repeated header. Keyed by page and order, so equal ids elsewhere stay."""
    pairs = chosen(candidates(grids))
    a = edges(grids).alias("a")
    b = edges(grids).alias("b")
    repeated = (F.size("a.headers") > 0) & (F.col("a.headers") == F.col("b.headers"))
    shift = F.col("a.rows") - F.when(repeated, 1).otherwise(0)
    moved = F.transform(F.filter("b.cells", lambda c: ~(repeated & (c["row"] == 0))), lambda c: c.withField("row", c["row"] + shift))
    box = F.when(F.col("a.bbox").isNotNull() & F.col("b.bbox").isNotNull(), F.struct(F.least("a.bbox.x1", "b.bbox.x1").alias("x1"), F.col("a.bbox.y1").alias("y1"), F.greatest("a.bbox.x2", "b.bbox.x2").alias("x2"), F.col("b.bbox.y2").alias("y2")))
    new = {"id": F.concat("a.id", F.lit("_merged_"), "b.id"), "rows": shift + F.col("b.rows"), "cols": F.greatest("a.cols", "b.cols"), "cells": F.concat("a.cells", moved), "bbox": box}
    p = pairs.alias("p")
    joined = p.join(a, (F.col("a.doc_id") == F.col("p.doc_id")) & (F.col("a.fact_ord") == F.col("p.a_ord"))).join(b, (F.col("b.doc_id") == F.col("p.doc_id")) & (F.col("b.fact_ord") == F.col("p.b_ord")))
    merged = joined.select(*[(new[c] if c in new else F.col(f"a.{c}")).alias(c) for c in grids.columns])
    used = pairs.select("doc_id", F.explode(F.array("a_ord", "b_ord")).alias("fact_ord"))
    return grids.join(used, ["doc_id", "fact_ord"], "left_anti").select(*grids.columns).unionByName(merged)
