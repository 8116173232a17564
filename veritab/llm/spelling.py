"""Spelling variants: words one edit apart, found in an inverted index of positional q-grams.

Two words one edit apart agree in their first or in their last half. So words are dealt
by these halves, and a block of words that share one is small; a block that is not is
dealt again, by the halves of what its words do not share. Each block is an index of
the positional 2-grams of that rest: the postings of a word's 2-grams, under the limits
of length and position, are merged by a heap that skips what cannot reach the overlap
which one edit leaves, and what reaches it is verified.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm._runtime import materialise
from veritab.llm.exact_dedup import ascii_lower

LETTERS = "[A-Za-zÀ-ÿ]+"
FOUND = "word string, n_near long, top long, near string"


def with_slips(docs: DataFrame, id_col: str, text_col: str, every: int) -> DataFrame:
    """(word) for each run of letters, lower-cased; where ``every`` divides the run's checksum, one letter is lost."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    without = F.concat(F.expr("left(run, at)"), F.expr("substring(run, at + 2)"))
    return runs.select("run", F.when(h % every == 0, at).alias("at")).select(F.when(F.col("at").isNull(), F.col("run")).otherwise(without).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip_every: int = 97, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the distinct words of ``min_chars`` letters and ``min_count`` occurrences at least. Null texts have none; a null id counts as empty."""
    words = with_slips(docs, id_col, text_col, slip_every).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def dealt(rows: DataFrame) -> DataFrame:
    """Deal words by the halves of ``rest`` (what their block does not share yet).

    A block of half size q has rests of 2q - 1 to 2q + 1 letters. Each pair one edit apart
    meets in one block only: ``apart`` holds what two words must not have in common, that
    both are of 2q - 1 letters (these meet at q - 1), or, behind equal last halves, that
    the first ones are equal too.
    """
    m = F.char_length("rest")
    halves = F.array_distinct(F.array((m / 2).cast("int"), ((m + 1) / 2).cast("int")))
    rows = rows.withColumn("q", F.explode(halves)).withColumn("end", F.explode(F.array(F.lit("p"), F.lit("s"))))
    first = F.expr("left(rest, q)")
    is_first = F.col("end") == "p"
    shared, rest = F.when(is_first, first).otherwise(F.expr("right(rest, q)")), F.when(is_first, F.expr("substring(rest, q + 1)")).otherwise(F.expr("left(rest, char_length(rest) - q)"))
    apart = F.array(F.when(m == 2 * F.col("q") - 1, F.lit("short")), F.when(~is_first, first))
    return rows.select("word", "n", F.concat_ws(" ", "block", "end", "q", shared).alias("block"), rest.alias("rest"), F.concat("apart", apart).alias("apart"), "q")


def grams(rest: str) -> list[tuple[str, int]]:
    """The positional 2-grams of ``rest``, framed."""
    framed = f"<{rest}>"
    return [(framed[p : p + 2], p) for p in range(len(rest) + 1)]


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """The numbers that occur in ``least`` of the ascending lists at least, by a heap of their heads.

    Where the smallest head stands in too few lists, the ``least - 1`` smallest heads
    skip to the next one: what is smaller cannot occur often enough.
    """
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= least:
        smallest, behind = heap[0][0], []
        while heap and heap[0][0] == smallest:
            behind.append(heappop(heap)[1])
        if len(behind) >= least:
            yield smallest
            to = smallest + 1
        else:
            while len(behind) < least - 1:
                behind.append(heappop(heap)[1])
            to = heap[0][0]
        for i in behind:
            at[i] = bisect_left(lists[i], to, at[i])
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))


def one_edit(a: str, b: str) -> bool:
    """Whether ``b``, as long as ``a`` or one letter longer, is one edit away."""
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] and a != b if len(a) == len(b) else a[i:] == b[i + 1 :]


def near_in_block(rests: list[str], aparts: list[list[str | None]]) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of rests one edit apart that nothing holds apart."""
    index, of_size = defaultdict(list), defaultdict(list)
    for i, rest in enumerate(rests):
        of_size[len(rest)].append(i)
        for gram, p in grams(rest):
            index[gram, p, len(rest)].append(i)
    for i, rest in enumerate(rests):
        own = grams(rest)
        for longer in (0, 1):
            size = len(rest) + longer
            if size not in of_size:
                continue
            least = size - 1  # of size + 1 framed 2-grams one edit takes two
            if least < 1:
                found = of_size[size]
            else:
                lists = [x for gram, p in own for to in range(p, p + longer + 1) if (x := index.get((gram, to, size)))]
                if not longer:
                    lists = [y for x in lists if (y := x[bisect_left(x, i + 1) :])]
                found = merged(lists, least) if len(lists) >= least else ()
            for j in found:
                if (longer or j > i) and one_edit(rest, rests[j]) and not any(a is not None and a == b for a, b in zip(aparts[i], aparts[j], strict=True)):
                    yield i, j


def near_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the words of each block (rows come by block): how many others are near, and the most frequent of these."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("block", "word", "n", "rest", "apart")), strict=True))
    schema, out = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("top", pa.int64()), ("near", pa.string())]), []
    for _, group in groupby(rows, key=itemgetter(0)):
        _, words, counts, rests, aparts = zip(*group, strict=True)
        if len(words) < 2:
            continue
        found: dict[int, tuple[int, int, str]] = {}
        for pair in near_in_block(rests, aparts):
            for i, j in (pair, pair[::-1]):
                n, top, near = found.get(i, (0, 0, ""))
                better = (-counts[j], words[j]) < (-top, near)
                found[i] = (n + 1, counts[j], words[j]) if better else (n + 1, top, near)
        out += [(words[i], *x) for i, x in found.items()]
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def near_words(words: DataFrame, block_size: int = 400) -> DataFrame:
    """(word, n_near, top, near) of the words (word, n) that have near ones; of these, ``near`` is the most frequent one, ``top`` times.

    Blocks of more than ``block_size`` words are dealt again while they share four letters
    or more; shorter rests bound a block by the alphabet.
    """
    rows = words.select("word", "n", F.lit("").alias("block"), F.col("word").alias("rest"), F.array().cast("array<string>").alias("apart"))
    ready = None
    while True:
        rows = materialise(dealt(rows))
        sizes = rows.groupBy("block").agg(F.count("*").alias("size")).where("size > 1")
        rows = materialise(rows.join(sizes, "block"))
        hot = (F.col("size") > block_size) & (F.col("q") >= 4)
        done = rows.where(~hot)
        ready = done if ready is None else ready.unionByName(done)
        rows = rows.where(hot).drop("size", "q")
        if rows.isEmpty():
            break
    blocks = ready.select("block", "word", "n", "rest", "apart").repartition("block").sortWithinPartitions("block")
    found = blocks.mapInArrow(near_of_blocks, FOUND)
    best = F.min(F.struct((-F.col("top")).alias("less"), F.col("near").alias("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("top"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: forms are followed to the last, twice as far each round.

    A form is at least twice as frequent as its word, so there are few rounds: the logarithm of a logarithm.
    """
    found = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if found.join(further, "root", "left_semi").isEmpty():
            return found
        found = materialise(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip_every: int = 97, min_chars: int = 5, min_count: int = 3, times: float = 2, block_size: int = 400) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    Words and counts: as for ``vocabulary``. ``form``: the most frequent word that is one
    inserted, deleted or replaced letter away (ties: the smallest by code points), if it is
    ``times`` as frequent at least, else null. ``root``: the last form of forms, the word
    itself if it has none. Null and empty texts have no words, equal rows count each, an empty
    table has no rows; other columns are ignored.
    """
    words = materialise(vocabulary(docs, id_col, text_col, slip_every, min_chars, min_count))
    near = near_words(words, block_size)
    fits: Column = F.col("top") >= times * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("top")).alias("form_n")
    )
    rows = materialise(rows)
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
