"""Spelling variants against all pairs of the vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritab.llm.spelling import merged, near_in_block, near_words, spelling_variants, vocabulary


def slipped(doc_id, run):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
    i = h % len(low)
    return low if h % 97 else low[:i] + low[i + 1 :]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter(slipped(i, run) for i, text in rows for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""))
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    found = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 2 * n[w] else None for w, x in found.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(found[w]), n.get(form[w])))
    return out


def corpus(seed=1):
    rng, words = random.Random(seed), []
    syllables = ["th", "ti", "on", "er", "ä", "né", "ing", "ab", "Ÿ", "÷"]
    for _ in range(150):
        w = "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 7)))
        words += [w] * rng.choice([1, 3, 9, 30])
        for _ in range(3):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abtÿ") + w[i:], w[:i] + rng.choice("abté") + w[i + 1 :]])] * rng.choice([1, 3, 4])
    rows = []
    for i in range(200):
        rows.append((i, " ".join(rng.choice([str.title, str.upper, str])(x) for x in rng.choices(words, k=60)) + "x2y,abcde·abcde"))
    return [*rows, (7, rows[7][1]), (None, rows[8][1]), (None, None), (300, ""), (301, "1234 ... 日本語")]


def test_variants(spark):
    rows = corpus()
    want = brute(rows)
    assert sum(r[4] > 0 for r in want) > 200 and any(r[1] and r[1] != r[2] for r in want)
    docs = spark.createDataFrame([(i, t, "other", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    for block_size in (400, 3):
        got = spelling_variants(docs, block_size=block_size).collect()
        assert len(got) == len(want) and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want


def test_empty(spark):
    for rows in ([], [(1, None), (2, "abc ab")]):
        assert spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_runs_of_one_letter(spark):
    """Long words that share nearly everything: dealt again and again, each pair once."""
    words = [("a" * k, k) for k in range(5, 60)] + [("a" * 20 + x + "a" * 20, 3) for x in "bcdefgh"] + [("a" * 40 + x + y, 3) for x in "bcd" for y in "bcd"]
    got = {r.word: (r.n_near, r.top, r.near) for r in near_words(spark.createDataFrame(words, "word string, n long"), block_size=2).collect()}
    for w, _ in words:
        others = sorted(((-c, x) for x, c in words if near(w, x)))
        assert got.get(w) == ((len(others), -others[0][0], others[0][1]) if others else None)


@given(st.lists(st.lists(st.integers(0, 25), unique=True, max_size=20).map(sorted), max_size=8), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_heap_merge(lists, least):
    count = Counter(x for y in lists for x in y)
    assert list(merged(lists, least)) == sorted(x for x, c in count.items() if c >= least)


@given(st.lists(st.text("ab", max_size=6), unique=True, max_size=25))
@settings(max_examples=200, deadline=None)
def test_index_of_a_block(rests):
    got = [tuple(sorted(p)) for p in near_in_block(rests, [[None]] * len(rests))]
    assert sorted(got) == [(i, j) for i in range(len(rests)) for j in range(i + 1, len(rests)) if near(rests[i], rests[j])]


@pytest.mark.parametrize("text", ["Straße straße STRASSE", "a" * 200_000 + " b"])
def test_vocabulary(spark, text):
    got = {r.word: r.n for r in vocabulary(spark.createDataFrame([(5, text)] * 3, "doc_id long, text string")).collect()}
    want = Counter(slipped(5, run) for run in re.findall("[A-Za-zÀ-ÿ]+", text) for _ in range(3))
    assert got == {w: c for w, c in want.items() if len(w) >= 5}
