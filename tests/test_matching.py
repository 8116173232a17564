"""Consensus and merging against sequential runs on random pages."""

import random
from difflib import SequenceMatcher
from math import hypot

import facts as fx
import pytest

from veritab.operators import consensus, multipage
from veritab.operators.matching import greedy_matching


def as_number(text):
    try:
        return float(text)
    except ValueError:
        return None


def similarity(a, b):
    """Of two facts (label, value text, unit, x, y)."""
    got = of = 0.0
    clean = lambda t: (t or "").strip().lower()
    for weight, one, other, share in (
        (0.4, a[1] or "", b[1] or "", lambda x, y: 1.0 if x == y else SequenceMatcher(None, x, y).ratio() if None in (as_number(x), as_number(y)) else float(abs(as_number(x) - as_number(y)) < 0.01)),
        (0.3, clean(a[0]), clean(b[0]), lambda x, y: SequenceMatcher(None, x, y).ratio()),
        (0.2, clean(a[2]), clean(b[2]), lambda x, y: float(x == y)),
    ):
        if one and other:
            got, of = got + weight * share(one, other), of + weight
    if a[3] is not None and b[3] is not None:
        got, of = got + 0.1 * max(0.0, 1 - 5 * hypot(a[3] - b[3], a[4] - b[4])), of + 0.1
    return got / of if of else 0.0


def in_sequence(a, b, least):
    """(index in a, index in b, similarity), in order."""
    free, out = set(range(len(b))), []
    for i, one in enumerate(a):
        best = max(free, key=lambda j: (similarity(one, b[j]), -j), default=None)
        if best is not None and similarity(one, b[best]) >= least:
            free.discard(best)
            out.append((i, best, similarity(one, b[best])))
    return out


def random_page(rng, n):
    rows = []
    for _ in range(n):
        value = rng.choice([rng.choice([1.0, 1.005, 1.012, 3.3, 1e15]), rng.choice(["TQFP-48", "TQFP48", "3.3", "see note 1", "see note 2", ""]), None])
        rows.append((rng.choice(["VCC", "vcc ", "VCC max", "Icc", None, ""]), value, rng.choice(["V", "mV", "v", None]), rng.choice([0.1, 0.1, 0.15, 0.9]), rng.choice([0.2, 0.2, 0.21])))
    return rows


def as_units(spark, pages):
    rows = []
    for (doc, page), facts in pages.items():
        for i, (label, value, unit, x, y) in enumerate(facts):
            number = value if isinstance(value, float) else None
            rows.append((f"u{i}", label, None if number is not None else value, number, unit, "", 0.5, None if x is None else (x, y), None, doc, page, "o", i))
    return spark.createDataFrame(rows, fx.UNITS)


@pytest.mark.parametrize("bound", [1_000_000, 5])
def test_consensus_equals_the_sequential_run(spark, bound, monkeypatch):
    rng = random.Random(3)
    places = [("d1", 0), ("d1", 1), (None, 0), ("d2", None), ("d3", 4), ("d4", 0)]
    first = {p: random_page(rng, rng.randrange(0, 14)) for p in places}
    second = {p: [rng.choice(rows) if rows and rng.random() < 0.7 else random_page(rng, 1)[0] for _ in range(rng.randrange(0, 14))] for p, rows in first.items()}
    monkeypatch.setattr(consensus, "greedy_matching", lambda edges, order: greedy_matching(edges, order, bound=bound))
    got = consensus.consensus(as_units(spark, first), as_units(spark, second)).collect()
    for place in places:
        a, b = [[(f[0], repr(f[1]) if isinstance(f[1], float) else f[1], *f[2:]) for f in side[place]] for side in (first, second)]
        matched = {i: (j, s) for i, j, s in in_sequence(a, b, 0.6)}
        rows = [r for r in got if (r.doc_id, r.page) == place]
        mine = {r.fact_ord: r for r in rows if r.side != "b"}
        assert set(mine) == set(range(len(a)))
        assert {i: round(r.similarity, 9) for i, r in mine.items() if r.side == "both"} == {i: round(s, 9) for i, (_, s) in matched.items()}
        assert sorted(r.fact_ord for r in rows if r.side == "b") == sorted(set(range(len(b))) - {j for j, _ in matched.values()})


@pytest.mark.parametrize(("two_sided", "bound"), [(True, 1000), (True, 3), (False, 1000), (False, 3)])
def test_matching_in_turn_and_in_rounds(spark, two_sided, bound):
    rng = random.Random(4)
    edges = {(rng.choice("xyz"), rng.randrange(12), rng.randrange(12) + (0 if two_sided else 6)) for _ in range(150)}
    edges = [(p, a, b, rng.randrange(4)) for p, a, b in edges if two_sided or a != b]
    want, used = set(), set()
    for p, a, b, _ in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        ends = {(p, 0, a), (p, 1 if two_sided else 0, b)}
        if not ends & used:
            used |= ends
            want.add((p, a, b))
    got = greedy_matching(spark.createDataFrame(edges, "place string, a long, b long, o int").repartition(5), ["o"], two_sided, bound)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_pairs_of_tables_in_order(spark):
    """Of tables on three pages, each is in one pair only, the first one that may have it."""
    pairs = [("d", (0, 0.8, 1, "a"), (1, 0.1, 2, "b"), 1.0, False), ("d", (0, 0.9, 3, "c"), (1, 0.1, 2, "b"), 1.0, False), ("d", (1, 0.9, 2, "b"), (2, 0.1, 4, "e"), 1.0, False), ("d", (1, 0.95, 5, "f"), (2, 0.1, 4, "e"), 1.0, False)]
    point = "struct<page:int,y:double,fact_ord:long,id:string>"
    rows = spark.createDataFrame(pairs, f"doc_id string, grid_a {point}, grid_b {point}, column_similarity double, needs_review boolean")
    assert sorted((r.a_ord, r.b_ord) for r in multipage.chosen(rows).collect()) == [(1, 2), (5, 4)]
