"""Accuracy on rows that were never learned from, and recall of links, on the driver's tables."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from veritab.llm import toxicity
from veritab.llm.language_id import identify_languages
from veritab.llm.minhash import near_duplicates, probability_jaccard, weighted_shingles

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")


def test_toxicity():
    """Recall of 0.85 and precision of 0.9 at least, with 305 toxic texts to learn from."""
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pydict()
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    rows = [(i, text[i], y) for i, y in zip(labels["doc_id"], labels["toxic"], strict=True) if y in (0, 1) and text.get(i)]
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    s = toxicity.Settings()
    known = [r for r, h in zip(rows, held, strict=True) if not h and len(r[1]) <= s.max_chars]
    new = [r for r, h in zip(rows, held, strict=True) if h]
    model = toxicity.train([t for _, t, _ in known], np.array([y for _, _, y in known]), s)
    a, b = model.scale
    said = 1 / (1 + np.exp(-np.clip(a * toxicity.text_logits(model, pa.array([t for _, t, _ in new], pa.large_string())).astype(float) + b, -30, 30))) >= 0.7
    truth = np.array([y for _, _, y in new]) == 1
    print("toxicity: recall", said[truth].mean(), "precision", truth[said].mean())
    assert said[truth].mean() >= 0.85 and truth[said].mean() >= 0.9


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = {r.doc_id: r for r in identify_languages(docs).collect()}
    pairs = [(r.lang, said[r.doc_id].lang_pred) for r in docs.select("doc_id", "lang").where("lang is not null").collect() if said[r.doc_id].held_out]
    assert np.mean([a == b for a, b in pairs]) >= 0.98 and len(pairs) > 100
    assert all(0 <= r.score <= 1 for r in said.values())


def test_near_duplicate_pairs(spark):
    """Of all pairs of documents at the threshold or above, found by brute force, 99 % share a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    _, doc, value, weight = weighted_shingles(pa.array([r.text or "" for r in rows], pa.large_string()), 5)
    at = np.searchsorted(doc, np.arange(len(rows) + 1))
    sets = [(value[x:y], weight[x:y]) for x, y in zip(at, at[1:], strict=False)]
    order = np.argsort(value, kind="stable")
    edge = np.flatnonzero(np.append(True, value[order][1:] != value[order][:-1]))
    meet = set()
    for x, y in zip(edge, np.append(edge[1:], len(order)), strict=True):
        if 1 < y - x <= 200:
            some = sorted(doc[order[x:y]].tolist())
            meet.update((some[i], some[j]) for i in range(len(some)) for j in range(i + 1, len(some)))
    pairs = [(i, j) for i, j in meet if probability_jaccard(*sets[i], *sets[j]) >= 0.8]
    cluster = {r.doc_id: r.cluster_id for r in near_duplicates(docs).collect()}
    found = np.mean([cluster[rows[i].doc_id] == cluster[rows[j].doc_id] for i, j in pairs])
    print("near duplicates: pairs", len(pairs), "recall", found)
    assert len(pairs) > 20 and found >= 0.99
