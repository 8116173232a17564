"""Links from buckets of candidates, and connected components of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._runtime import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, component) for the vertices of ``links`` (a, b); the component is its smallest vertex.

    Alternates large-star and small-star steps until the links no longer change:
    about log(diameter) rounds of two shuffles, each written to the shared folder.
    Only a count and a checksum of the links reach the driver.
    """
    forward = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = None
    while True:
        got = forward.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("x")).first()
        if (got.n, got.x) == state or not got.n:
            break
        state = (got.n, got.x)
        both = forward.unionByName(forward.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        forward = materialise(small.unionByName(least.withColumnRenamed("m", "lo")).distinct())
    roots = forward.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct()
    return forward.select(F.col("hi").alias("vertex"), F.col("lo").alias("component")).unionByName(roots)


def components_of_buckets(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], link_rest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(vertex, component) after verifying candidates that share a bucket.

    ``buckets``: (bucket, vertex), any number of times each. Each bucket has a hub:
    the vertex with the most neighbours in all its buckets, as the original of
    edited copies has. ``verify`` takes the distinct pairs (a, b) of hubs and others
    and returns them with a boolean ``link``. Where a bucket still falls apart,
    ``link_rest`` gets its rows (bucket, vertex, component, top: the component of most
    of the bucket) and returns pairs (a, b) that connect whatever candidates are
    linked, so that the components are those of all pairs that share a bucket.
    Buckets with the same vertices are passed on once.
    """
    buckets = buckets.select("bucket", "vertex").distinct()
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(buckets.join(sizes, "bucket"))
    known = shared.groupBy("vertex").agg(F.sum("n").alias("fame"))
    known = materialise(shared.join(known, "vertex"))
    hubs = known.groupBy("bucket").agg(F.max(F.struct("fame", "vertex")).alias("hub"))
    stars = known.join(hubs, "bucket").where("vertex <> hub.vertex").select(F.col("hub.vertex").alias("a"), F.col("vertex").alias("b")).distinct()
    links = materialise(verify(stars).where("link").select("a", "b"))
    parts = materialise(connected_components(links))
    placed = shared.select("bucket", "vertex").join(parts, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    placed = materialise(placed)
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("vertex").cast("decimal(20,0)")).alias("x"))
    mixed = (
        counts.groupBy("bucket")
        .agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("x").alias("x"))
        .where("parts > 1")
        .groupBy("n", "x")
        .agg(F.min("bucket").alias("bucket"), F.min_by("top", "bucket").alias("top"))
        .select("bucket", F.col("top.component").alias("top"))
    )
    rest = materialise(placed.join(mixed, "bucket"))
    more = materialise(link_rest(rest).select("a", "b").distinct())
    if more.isEmpty():
        return parts
    return materialise(connected_components(links.unionByName(more)))
