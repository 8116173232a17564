"""Merkle manifest of a dataset: a tree per source, a tree of their roots, and proofs for each row.

Pregel-style supersteps on RDDs keyed by a node's place. Upward, children send their
digests to their parent; a parent that has all of them hashes them and forwards the
result in the next superstep. Downward, a node's path (the siblings on its way to the
root) goes to its children, with the child's own siblings in front, and at last to the
rows, which are verified by it. The nodes of each superstep are a table in the shared
folder, so a lost executor costs tasks, not supersteps. A node meets at most ``fan``
children, wherever it is: a source of any size is spread over its places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from veritab.llm._runtime import materialise
from veritab.llm.exact_dedup import ascii_lower

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node: its tree, its place among ``total`` nodes of its level, its digest, and what it was made of. ``bent``: the digest of a row that was tampered with.
KID = "struct<slot:int,doc_id:long,digest:string,bent:string>"
NODE = f"tree string, place long, total long, digest string, kids array<{KID}>"
#: A way up: at each level the node's place among its siblings, and their digests in order.
WAY = "array<struct<slot:int,others:array<string>>>"
PLACED = f"tree string, place long, subroot string, way {WAY}"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha256(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in fields]), 256)


def numbered(rows: DataFrame, tree: Column, order: list[Column]) -> DataFrame:
    """``rows`` with tree, place (by ``order``, from 0) and total (the rows of the tree), without a sort of a whole tree in one task.

    Rows are sorted by ranges into a table; only counts for each tree and range are added up.
    """
    span = 1 << 33  # monotonically_increasing_id() counts each partition's rows from a multiple of this
    table = rows.withColumn("tree", tree).repartitionByRange(F.col("tree").asc_nulls_first(), *order).sortWithinPartitions(F.col("tree").asc_nulls_first(), *order)
    table = materialise(table.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.floor(F.col("at") / span))
    parts = table.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_tree = Window.partitionBy("tree")  # a row for each range
    before = F.sum("n").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("tree").alias("of_tree"), F.col("part").alias("of_part"), (F.col("first") - F.coalesce(before, F.lit(0))).alias("zero"), F.sum("n").over(of_tree).alias("total"))
    found = table.join(parts, (F.col("part") == F.col("of_part")) & F.col("tree").eqNullSafe(F.col("of_tree")))
    return found.select(*table.columns, (F.col("at") - F.col("zero")).alias("place"), "total").drop("at", "part")


def width(rows: int) -> int:
    """Partitions for a superstep of so many messages."""
    return max(1, min(10_000, rows // 20_000))


def to_parent(fan: int) -> Callable:
    def send(node: Row) -> tuple:
        return (node.tree, node.place // fan, node.total), (node.place % fan, node.doc_id, node.digest, node.bent)

    return send


def hashed(fan: int) -> Callable:
    def complete(parent: tuple) -> tuple:
        (tree, place, total), messages = parent
        kids = sorted(messages, key=lambda m: m[0])
        if len(kids) != min(fan, total - place * fan):
            raise ValueError(f"node {place} of {tree!r} got {len(kids)} messages")
        return tree, place, -(-total // fan), sha256(m[2] for m in kids), kids

    return complete


def grown(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """The levels (NODE) above ``leaves`` (tree, place, total, doc_id, digest, bent): parents of rows, their parents, and so on until each tree has one node."""
    levels, sending = [], leaves.where("total > 1")
    while n := sending.count():
        spark = leaves.sparkSession
        parents = sending.rdd.map(to_parent(fan)).groupByKey(width(n)).map(hashed(fan))
        levels.append(materialise(spark.createDataFrame(parents, NODE)))
        sending = levels[-1].where("total > 1").select("tree", "place", "total", F.lit(None).cast("long").alias("doc_id"), "digest", F.lit(None).cast("string").alias("bent"))
    return levels


def by_place(table: DataFrame, value: Callable) -> RDD:
    return table.rdd.map(lambda r: ((r.tree, r.place), value(r)))


def to_kids(fan: int) -> Callable:
    def send(met: tuple) -> Iterator[tuple]:
        (tree, place), (kids, (subroot, way)) = met
        for k in kids:
            others = [o.digest for o in kids if o.slot != k.slot]
            yield tree, place * fan + k.slot, subroot, [(k.slot, others), *way]

    return send


def descended(levels: list[DataFrame], tops: DataFrame, fan: int, last: int) -> DataFrame:
    """The ways (PLACED) of the nodes of level ``last`` (0: the leaves), from those of the trees' only nodes ``tops`` (PLACED and ``height``, their level)."""
    spark, ways = tops.sparkSession, None
    for level in range(len(levels), last - 1, -1):
        begun = tops.where(F.col("height") == level).drop("height")
        ways = begun if ways is None else begun.unionByName(ways)
        if level > last:
            nodes = by_place(levels[level - 1], lambda r: r.kids)
            n = max(width(levels[level - 1].count()), 1)
            sent = nodes.join(by_place(ways, lambda r: (r.subroot, r.way)), n).flatMap(to_kids(fan))
            ways = materialise(spark.createDataFrame(sent, PLACED))
    return ways


def folded(digest: str, way: Iterable[Row]) -> str:
    """The root that a digest and the siblings on its way give."""
    for slot, others in way:
        digest = sha256([*others[:slot], digest, *others[slot:]])
    return digest


def proved(root: str) -> Callable:
    """Rows (PROVED) for the leaves ``kids`` of a node whose way is known; ``alone``: the only leaf of its tree, which the way begins at."""

    def verify(kids: list[Row], subroot: str, way: list[Row], alone: bool) -> Iterator[tuple]:
        for k in kids:
            own = [] if alone else [(k.slot, [o.digest for o in kids if o.slot != k.slot])]
            whole = [*own, *way]
            found = folded(k.digest if k.bent is None else k.bent, whole)
            yield k.doc_id, k.digest, subroot, root, sha256(d for _, others in whole for d in others), found, found == root

    return verify


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, fan: int = 16, tamper_every: int = 5) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields``: the columns of a leaf, among them doc_id, source and text. A source's leaves
    ascend by doc_id (nulls first; equal ids by their leaf), ``fan`` consecutive nodes
    become one, until one remains; these subroots, by source (null first), likewise.
    ``proof_sha256``: of the siblings on the way to the root. A document whose id has a
    crc32 that ``tamper_every`` divides is verified with the A-Z of its text lower-cased (a
    null id never is); the others as they are. ``verified``: whether the way leads to the root. Null and
    empty fields differ, repeated rows each have their place, an empty table has no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    column = {f: F.col(f) for f in fields}
    lowered = column | {"text": ascii_lower(F.col("text"))}
    tampered = F.crc32(F.col("doc_id").cast("string")) % tamper_every == 0
    leaves = docs.select(F.col("source"), "doc_id", leaf_digest(column.values()).alias("digest"), F.when(tampered, leaf_digest(lowered.values())).alias("bent"))
    leaves = materialise(leaves)  # texts are read once, before ranges are sampled
    leaves = materialise(numbered(leaves, F.col("source"), [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("bent")]))

    levels = grown(leaves, fan)
    no_kids = F.array().cast(f"array<{KID}>")
    lone = leaves.where("total = 1").select("tree", "place", "digest", F.lit(0).alias("height"))
    subroots = lone
    for height, level in enumerate(levels, 1):
        subroots = subroots.unionByName(level.where("total = 1").select("tree", "place", "digest", F.lit(height).alias("height")))
    subroots = materialise(subroots.withColumnRenamed("tree", "source").drop("place"))

    # The tree of the sources' roots: one tree, whose leaves carry no rows.
    upper = materialise(numbered(subroots, F.lit("all"), [F.col("source").asc_nulls_first()]).withColumns({"doc_id": F.lit(None).cast("long"), "bent": F.lit(None).cast("string")}))
    above = grown(upper, fan)
    found = (above[-1] if above else upper).select("digest").first()
    root = found.digest if found else ""
    top = spark.range(1 if found else 0).select(F.lit("all").alias("tree"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("subroot"), F.array().cast(WAY).alias("way"), F.lit(len(above)).alias("height"))
    placed = descended(above, top, fan, 0)
    tops = placed.drop("subroot", "tree").join(upper.select("place", "source", F.col("digest").alias("subroot"), F.col("height")), "place")
    tops = materialise(tops.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "subroot", "way", "height"))

    verify = proved(root)
    ways = descended(levels, tops.where("height > 0"), fan, 1) if levels else None
    alone = leaves.where("total = 1").select("tree", "place", F.array(F.struct(F.lit(0).alias("slot"), "doc_id", "digest", "bent")).cast(f"array<{KID}>").alias("kids"))
    first = by_place(alone, lambda r: r.kids).join(by_place(tops.where("height = 0"), lambda r: (r.subroot, r.way)), 1 + lone.count() // 20_000)
    rows = first.flatMap(lambda x: verify(x[1][0], *x[1][1], True))
    if levels:
        met = by_place(levels[0], lambda r: r.kids).join(by_place(ways, lambda r: (r.subroot, r.way)), width(leaves.count()))
        rows = rows.union(met.flatMap(lambda x: verify(x[1][0], *x[1][1], False)))
    return spark.createDataFrame(rows, PROVED)
