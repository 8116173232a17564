"""Greedy matching in a fixed order, without a group in one task's memory.

Edges are taken in order; one is chosen if neither of its ends is in an edge chosen before.
Groups of edges (a page, a document) stream through a task in order, which remembers
the ends that are used. A group of very many edges is not left to one task: in rounds,
each edge that is the first at both its ends is chosen at once, as no edge before it can
take an end, and what touches it goes. Both give what the sequential run gives.

Edges may also lead to pools of ends that are alike: then as many rows as ends and edges to
pools stream through, and never the pairs of ends, which grow with the square of a group.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.runtime import materialise


POOLED = ["a_ord", "a", "less", "b_ord"]


def in_turn(two_sided: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("place", "a", "b")), strict=True))
        chosen: list[tuple] = []
        schema = pa.schema([("place", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
        for place, edges in groupby(rows, key=itemgetter(0)):
            used_a: set[int] = set()
            used_b = set() if two_sided else used_a
            for _, a, b in edges:
                if a not in used_a and b not in used_b:
                    used_a.add(a)
                    used_b.add(b)
                    chosen.append((place, a, b))
                    if len(chosen) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*chosen, strict=True), schema, strict=True)], schema=schema)
                        chosen = []
        if chosen:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*chosen, strict=True), schema, strict=True)], schema=schema)

    return run


def in_rounds(edges: DataFrame, two_sided: bool) -> DataFrame:
    """The chosen (place, a, b) of ``edges`` (place, a, b, rank)."""
    side = F.lit(1 if two_sided else 0)
    rest = materialise(edges.select("place", F.struct(F.lit(0).alias("side"), F.col("a").alias("x")).alias("a"), F.struct(side.alias("side"), F.col("b").alias("x")).alias("b"), "rank").distinct())
    chosen = rest.where("false")
    while not rest.isEmpty():
        ends = rest.select("place", "rank", F.explode(F.array("a", "b")).alias("end"))
        first = ends.groupBy("place", "end").agg(F.min("rank").alias("rank"))
        taken = materialise(first.groupBy("place", "rank").agg(F.count("*").alias("n"), F.min("end").alias("one"), F.max("end").alias("other")).where("n = 2"))  # first at both ends
        chosen = chosen.unionByName(rest.join(taken.select("place", "rank"), ["place", "rank"], "left_semi"))
        gone = taken.select("place", F.explode(F.array("one", "other")).alias("end"))
        for end in ("a", "b"):
            rest = rest.join(gone.withColumnRenamed("end", end), ["place", end], "left_anti")
        rest = materialise(rest.select("place", "a", "b", "rank"))
    return chosen.select("place", F.col("a.x").alias("a"), F.col("b.x").alias("b"))


def from_pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (a null) come before edges, each in order. A pool is a queue of b's, of which the first that is free stands at its front."""
    names = ("place", "a", "less", "pool", "b_ord", "b")
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
    schema = pa.schema([("place", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("less", pa.float64())])
    made = lambda chosen: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*chosen, strict=True), schema, strict=True)], schema=schema)
    chosen: list[tuple] = []
    for place, group in groupby(rows, key=itemgetter(0)):
        queues: dict[bytes, int] = {}
        at, end, ords, ids = (array("q") for _ in range(4))  # of each queue the front and the end; of its members
        used: set[int] = set()
        for a, edges in groupby(group, key=itemgetter(1)):
            best = None
            for _, _, less, pool, b_ord, b in edges:
                if a is None:
                    if pool not in queues:
                        queues[pool] = len(at)
                        at.append(len(ids))
                        end.append(len(ids))
                    ords.append(b_ord)
                    ids.append(b)
                    end[-1] = len(ids)
                elif (q := queues.get(pool)) is not None:
                    while at[q] < end[q] and ids[at[q]] in used:
                        at[q] += 1
                    if at[q] < end[q]:
                        way = less, ords[at[q]], ids[at[q]]
                        best = way if best is None else min(best, way)
            if best is not None:
                used.add(best[2])
                chosen.append((place, a, best[2], best[0]))
                if len(chosen) >= 10_000:
                    yield made(chosen)
                    chosen = []
    if chosen:
        yield made(chosen)


def pooled_matching(edges: DataFrame) -> DataFrame:
    """The chosen (place, a, b, less): each a, in the order of a_ord and a, takes of all b's in its pools that are left the first by less, b_ord and b.

    ``edges`` (place string, a_ord, a, less double, pool binary, b_ord, b): from a to a pool, b null; or, a null, from a pool to
    its member b, which may be in several. A place streams through one task, which keeps 16 bytes for each member, a number for each pool and the b's that are used.
    """
    none = F.lit(-(1 << 63))
    rows = edges.select("place", "a", F.coalesce("a_ord", none).alias("a_ord"), "less", "pool", F.coalesce("b_ord", none).alias("b_ord"), "b")
    order = [F.col("place"), F.col("a").isNotNull(), F.when(F.col("a").isNull(), F.col("pool")), F.col("a_ord"), F.col("a"), F.col("b_ord"), F.col("b")]
    ready = rows.repartition("place").sortWithinPartitions(*order).select("place", "a", "less", "pool", "b_ord", "b")
    return ready.mapInArrow(from_pools, "place string, a bigint, b bigint, less double")


def greedy_matching(edges: DataFrame, order: list[str], two_sided: bool = True, bound: int = 1_000_000) -> DataFrame:
    """The chosen edges: (place, a, b) of ``edges`` (place string, a and b long, and the columns of ``order``).

    Matched within each ``place`` in the order of ``order``, then a, then b. ``two_sided``: a and
    b are numbers of different things. Places of more than ``bound`` edges are matched in rounds.
    Edges with a ``pool`` are matched by ``pooled_matching``, in its order, which is to be given.
    """
    if "pool" in edges.columns:
        if order != POOLED or not two_sided:
            raise ValueError(f"edges to pools are of two sides, in the order of {POOLED}")
        return pooled_matching(edges)
    rank = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate([*order, "a", "b"])])
    edges = materialise(edges.select("place", "a", "b", rank.alias("rank")))
    hot = materialise(edges.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("place"))
    few = edges.join(hot, "place", "left_anti").repartition("place").sortWithinPartitions("place", "rank").select("place", "a", "b")
    chosen = few.mapInArrow(in_turn(two_sided), "place string, a bigint, b bigint")
    if hot.isEmpty():
        return chosen
    return chosen.unionByName(in_rounds(edges.join(hot, "place", "left_semi"), two_sided))
