"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is the weighted set of its five-word shingles (weight: how often each
occurs). Each shingle emits a Poisson process of arrivals, at a rate of its weight;
each arrival hits one of ``rows * bands`` registers, which keeps its earliest.
Two documents agree in a register with their probability Jaccard similarity. A
shingle stops as soon as its arrivals are later than all registers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._components import components_of_buckets
from veritab.llm._runtime import materialise
from veritab.llm._words import GOLDEN, U64, mix, pieces, sequence_digest, shingles, text_bytes, words

SKETCH = "doc_id long, rid long, row_key string, vertex binary, bands array<long>"


def weighted_shingles(texts: pa.Array, n: int):
    """(words, document, shingle, weight) with each shingle once per document, ordered by document and shingle."""
    w = words(texts)
    _, doc, value = shingles(w, n)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return w, doc[at], value[at], np.diff(np.append(at, len(doc)))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m registers with the element whose arrival came first (0: none). Elements are distinct within a document."""
    earliest, winner = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, U64)
    base, time, weight, k = doc * m, np.zeros(len(doc)), weight.astype(float), 0
    doc, element = doc.copy(), element.copy()
    while len(doc):
        k += 1
        bits = mix(element + U64(k * int(GOLDEN) % (1 << 64)))
        time = time - np.log(((bits >> U64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        cell = base + (mix(bits ^ U64(0x5851F42D4C957F2D)) % U64(m)).astype(np.int64)
        better = time < earliest[cell]
        at, when, who = cell[better], time[better], element[better]
        np.minimum.at(earliest, at, when)
        won = earliest[at] == when
        winner[at[won]] = who[won]
        go_on = time < earliest.reshape(n_docs, m).max(axis=1)[doc]
        doc, element, base, time, weight = doc[go_on], element[go_on], base[go_on], time[go_on], weight[go_on]
    return winner.reshape(n_docs, m)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers."""
    n, m = registers.shape
    parts = registers.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=U64), (n, m // rows)).copy()
    for j in range(rows):
        key = mix(key * GOLDEN + parts[:, :, j])
    return key


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common i of 1 / sum over j of max(wa[j] / wa[i], wb[j] / wb[i]), for sorted distinct a and b."""
    if not len(a) or not len(b):
        return 0.0
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(common) / (len(a) + len(b) - len(common))
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio)
    above = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])
    below = np.concatenate([[0.0], np.cumsum(y[order])])
    cut = np.searchsorted(ratio[order], ratio, side="left")
    total = (only_a + above[cut]) + ratio * (only_b + below[cut])
    return float((x / total).sum())


def sketch(docs: DataFrame, id_col: str, text_col: str, n: int, rows: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            w, doc, value, weight = weighted_shingles(piece.column(3), n)
            registers = prob_minhash(doc, value, weight, piece.num_rows, rows * bands)
            keys = band_keys(registers, rows).astype(np.int64)
            one, two = sequence_digest(w)
            full = w.counts > 0
            vertex = np.stack([one, two], axis=1).astype(">u8").tobytes()
            _, at = text_bytes(piece.column(3))
            marks = {i: hashlib.md5(piece.column(3)[i].as_py().encode()).digest() for i in np.flatnonzero(~full & (np.diff(at) > 0))}  # texts of signs only
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *piece.columns[:3],
                    pa.array([vertex[16 * i : 16 * i + 16] if words_ else marks.get(i) for i, words_ in enumerate(full.tolist())], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys[full].ravel())),
                ],
                names=["doc_id", "rid", "row_key", "vertex", "bands"],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("rid"),
        row_key(id_col, text_col).alias("row_key"),
        F.col(text_col).alias("text"),
    ).mapInArrow(run, SKETCH)


def row_key(id_col: str, text_col: str):
    """Names a row by its content; rows of the same id and text share it."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))


def verifier(texts: DataFrame, n: int, threshold: float):
    """Pairs (a, b) with ``link``: whether the probability Jaccard similarity of their texts is ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text_b"):
            a, text_a, b, text_b = piece.columns
            # a bucket's first document comes with many others: its shingles are found once for a run of them
            heads = [i for i, (x, y) in enumerate(zip([None, *a.to_pylist()[:-1]], a.to_pylist(), strict=True)) if x != y]
            head_of = np.searchsorted(heads, np.arange(len(a)), side="right") - 1
            _, doc_a, value_a, weight_a = weighted_shingles(text_a.take(pa.array(heads, pa.int64())), n)
            _, doc_b, value_b, weight_b = weighted_shingles(text_b, n)
            at_a, at_b = np.searchsorted(doc_a, np.arange(len(heads) + 1)), np.searchsorted(doc_b, np.arange(len(b) + 1))
            found = []
            for i, h in enumerate(head_of):
                x, y = slice(at_a[h], at_a[h + 1]), slice(at_b[i], at_b[i + 1])
                found.append(probability_jaccard(value_a[x], weight_a[x], value_b[y], weight_b[y]) >= threshold)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(found, pa.bool_())], names=["a", "b", "link"])

    def verify(pairs: DataFrame) -> DataFrame:
        with_b = pairs.join(texts.select(F.col("vertex").alias("b"), F.col("text").alias("text_b")), "b")
        both = with_b.join(texts.select(F.col("vertex").alias("a"), F.col("text").alias("text_a")), "a")
        return both.select("a", "text_a", "b", "text_b").mapInArrow(run, "a binary, b binary, link boolean")

    return verify


def shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """(vertex, shingles, weights, size): a text's sorted shingles and how often each occurs, as binary arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            _, doc, value, weight = weighted_shingles(piece.column(1), n)
            at = np.searchsorted(doc, np.arange(piece.num_rows + 1))
            cut = [slice(x, y) for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([value[x].tobytes() for x in cut], pa.binary()), pa.array([weight[x].astype("<i4").tobytes() for x in cut], pa.binary()), pa.array(np.diff(at), pa.int64())],
                names=["vertex", "shingles", "weights", "size"],
            )

    return texts.select("vertex", "text").mapInArrow(run, "vertex binary, shingles binary, weights binary, size long")


def linked_parts(sets: list[tuple[np.ndarray, np.ndarray]], part: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs that connect what is linked among ``sets`` (shingles, weights), but for what ``part`` says is connected.

    The probability Jaccard similarity is at most the smaller of the two weight
    shares of what is common, and equal to the Jaccard similarity where all weights are 1.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x, _ in sets])
    _, column, uses = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True, return_counts=True)
    weight = np.concatenate([y for _, y in sets]).astype(np.float32)
    total = np.bincount(owner, weight, n)
    common = uses[column] > 1
    name = np.cumsum(uses > 1)[column] - 1
    owner, name, weight = owner[common], name[common], weight[common]
    width, high = max(1, (4 << 20) // n), int(name.max()) + 1 if len(name) else 0
    share = np.zeros((n, n), np.float32)  # weight of a row's shingles that a column has too
    for lo in range(0, high, width):
        some = (name >= lo) & (name < lo + width)
        heavy, has = np.zeros((n, min(width, high - lo)), np.float32), np.zeros((n, min(width, high - lo)), np.float32)
        heavy[owner[some], name[some] - lo], has[owner[some], name[some] - lo] = weight[some], 1
        share += heavy @ has.T
    plain = np.array([y.max() == 1 for _, y in sets])
    both = plain[:, None] & plain
    sure = both & (share / (total[:, None] + total - share) >= threshold)
    maybe = ~both & (np.minimum(share / total[:, None], share.T / total) >= threshold - 1e-6)
    leader, edges = np.unique(part, return_inverse=True)[1], []

    def join(i: int, j: int) -> None:
        edges.append((i, j))
        leader[leader == leader[j]] = leader[i]

    for i in range(n):
        while len(other := np.flatnonzero(sure[i] & (leader != leader[i]))):
            join(i, int(other[0]))
    for i in range(n):
        for j in np.flatnonzero(maybe[i, :i]):
            if leader[i] != leader[j] and probability_jaccard(sets[i][0], sets[i][1], sets[j][0], sets[j][1]) >= threshold:
                join(i, int(j))
    return edges


def rest_linker(texts: DataFrame, n: int, threshold: float, block_rows: int = 1500, block_shingles: int = 1 << 20):
    """Compares all rows of a bucket in pairs of blocks of bounded size; only pairs that connect something come out."""

    def run(table: pa.Table) -> pa.Table:
        vertex = table["vertex"].to_pylist()
        sets = [(np.frombuffer(x, np.uint64), np.frombuffer(y, "<i4")) for x, y in zip(table["shingles"].to_pylist(), table["weights"].to_pylist(), strict=True)]
        edges = linked_parts(sets, np.array([x.hex() for x in table["component"].to_pylist()]), threshold)
        return pa.table({"a": pa.array([vertex[i] for i, _ in edges], pa.binary()), "b": pa.array([vertex[j] for _, j in edges], pa.binary())})

    def link(rest: DataFrame) -> DataFrame:
        sets = materialise(shingle_sets(texts.join(rest.select("vertex").distinct(), "vertex", "left_semi"), n))
        sized = rest.join(sets.select("vertex", "size"), "vertex")
        blocks = sized.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_shingles)).cast("int").alias("blocks"))
        mine = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
        dealt = (
            sized.join(blocks, "bucket")
            .select("bucket", "vertex", "component", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .select("bucket", "vertex", "component", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
        )
        with_sets = dealt.join(sets.drop("size"), "vertex")
        return with_sets.groupBy("bucket", "one", "two").applyInArrow(run, "a binary, b binary")

    return link


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, rows: int = 5, bands: int = 25) -> DataFrame:
    """One row per document: doc_id, row_key, cluster_id (the smallest id of its class), cluster_size, kept.

    Documents are linked when their word sequences are the same, or when they share
    a band and their probability Jaccard similarity is ``threshold`` or more; classes
    are connected components. At a similarity of 0.8 a pair shares a band with
    probability 0.9999. One document of each class is kept, that of the smallest id
    (null first). A document of fewer than ``n`` words is one shingle; one without
    words meets exact copies only; an empty or null one is a class of its own. A text in a
    script without spaces is one word, so only its exact copies (but for signs) are found.
    Other columns are ignored; an empty table gives an empty result. Only vertices (distinct word sequences) are compared, so
    exact copies cost nothing.
    """
    table = materialise(sketch(docs, id_col, text_col, n, rows, bands))
    full = table.where("vertex is not null")
    buckets = full.select(F.explode("bands").alias("bucket"), "vertex").distinct()
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    buckets = materialise(buckets.join(shared, "bucket"))
    wanted = buckets.select("vertex").distinct()
    names = full.join(wanted, "vertex", "left_semi").groupBy("vertex").agg(F.min("row_key").alias("row_key"))
    keyed = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    texts = materialise(keyed.join(names, "row_key").groupBy("vertex").agg(F.max("text").alias("text")))
    parts = components_of_buckets(buckets, verifier(texts, n, threshold), rest_linker(texts, n, threshold))
    placed = (
        table.drop("bands")
        .join(parts, "vertex", "left")
        .select("doc_id", "rid", "row_key", F.coalesce("component", "vertex", F.encode(F.col("rid").cast("string"), "utf-8")).alias("class"))
    )
    placed = materialise(placed)
    classes = placed.groupBy("class").agg(F.min(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("cluster_size"))
    return placed.join(classes, "class").select("doc_id", "row_key", F.col("best.doc_id").alias("cluster_id"), "cluster_size", (F.col("rid") == F.col("best.rid")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for near duplicates: one document of each class stays.

    Of rows with the same id and text one stays, whatever their other columns; rows
    without text are classes of their own, so all of them stay.
    """
    rows = near_duplicates(docs, id_col, text_col).groupBy(F.col("row_key").alias("_key"))
    kept = materialise(rows.agg(F.count("*").alias("_rows"), F.sum(F.col("kept").cast("long")).alias("_kept")).where("_kept > 0"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_key(id_col, text_col).alias("_key"))
    found = packed.join(kept, "_key")
    # grouped by another name of the key: each task of the join, which AQE may split, keeps one row before they meet
    repeated = found.where("_kept < _rows").groupBy(F.md5("_key").alias("_twin")).agg(F.first("_row").alias("_row"))
    return found.where("_kept = _rows").select("_row.*").unionByName(repeated.select("_row.*"))
