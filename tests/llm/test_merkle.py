"""The manifest against a sequential one."""

import hashlib
import random
import zlib

import pytest

from veritab.llm.merkle import merkle_manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def way(levels, place, fan):
    """(place among siblings, siblings) at each level."""
    out = []
    for level in levels[:-1]:
        lo = place // fan * fan
        out.append((place - lo, [d for i, d in enumerate(level[lo : lo + fan], lo) if i != place]))
        place //= fan
    return out


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, fan):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(map(frame, r)))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels_of([leaf(r) for r in own[s]], fan) for s in sources}
    upper = levels_of([trees[s][-1][0] for s in sources], fan)
    out = []
    for n, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            path = way(trees[s], i, fan) + way(upper, n, fan)
            d = leaf((*r[:4], lowered(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for slot, others in path:
                d = h("".join([*others[:slot], d, *others[slot:]]))
            out.append((r[0], leaf(r), trees[s][-1][0], upper[-1][0], h("".join(x for _, o in path for x in o)), d, d == upper[-1][0]))
    return sorted(out, key=str)


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Ärger A-Z", "lower only", "X" * 50_000, "日本 Q"])
    rows = [(rng.randrange(10 * n), rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([None, 0, 17]), text()) for _ in range(n)]
    return [*rows, rows[0], rows[0], (None, sources[0], None, None, None), (None, None, None, None, "A")]


@pytest.mark.parametrize(("n", "sources", "fan"), [(700, ["a", "a", "a", "b", "é", "", None, "Z"], 16), (120, [f"s{i}" for i in range(60)], 3), (17, ["a"], 16), (0, ["one"], 16)])
def test_manifest(spark, n, sources, fan):
    rows = rows_of(n, n, sources) if n else [(1, "one", "en", 1, "A")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string, place int").repartition(7)
    got = merkle_manifest(docs, fan=fan).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, fan)
    if n > 100:
        assert {r.verified for r in got} == {True, False}


def test_empty(spark):
    assert merkle_manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).collect() == []
