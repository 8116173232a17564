"""Language identification by a linear-chain conditional random field over words.

A word's emission is the sum of learned weights of its hashed features: affixes and
character n-grams of ``<word>``, and the word itself (the lexicon). Learned
transitions say how likely the language changes from word to word; the training
sequences are stitched together from texts in different languages. Marginals come
from forward-backward; a text's language is the one with the largest share of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm._words import Words, char_ngrams, distinct, pieces, words
from veritab.llm.toxicity import id_remainder

BUCKETS, NGRAMS, BLOCK = 1 << 15, (2, 3, 4), 64
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Crf:
    """``weight``: buckets x labels; ``change``: labels x labels, log weights of transitions."""

    labels: list[str]
    weight: np.ndarray
    change: np.ndarray

    def emissions(self, w: Words, example: np.ndarray) -> np.ndarray:
        """Log emission of each label, for each distinct word given by an example."""
        out = np.zeros((len(example), len(self.labels)))
        for lo in range(0, len(example), 20_000):
            some = example[lo : lo + 20_000]
            owner, feature, size = word_features(w, some)
            for k in range(len(self.labels)):
                out[lo : lo + 20_000, k] = np.bincount(owner, self.weight[feature, k], len(some)) / np.sqrt(size)
        return out


def word_features(w: Words, example: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature bucket) pairs, and how many features each word has."""
    owner, gram = char_ngrams(w.data, w.start[example], w.end[example], NGRAMS)
    owner = np.concatenate([owner, np.arange(len(example))])
    feature = (np.concatenate([gram, w.hash[example]]) % np.uint64(BUCKETS)).astype(np.int64)
    return owner, feature, np.bincount(owner, minlength=len(example))


def forward_backward(emit: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (sequence, place, label), expected transitions, and the sum of the log partition, for sequences of one length. The first word is reached from an even mix of labels."""
    n, length, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e, a = np.exp(emit - top), np.exp(change)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    state, total = np.full((n, k), 1 / k), top.sum()
    scale = np.empty((n, length, 1))
    for t in range(length):
        state = (state @ a) * e[:, t]
        scale[:, t] = state.sum(axis=1, keepdims=True)
        state = state / scale[:, t]
        alpha[:, t] = state
    total += np.log(scale).sum()
    for t in range(length - 2, -1, -1):
        beta[:, t] = ((e[:, t + 1] * beta[:, t + 1]) @ a.T) / scale[:, t + 1]
    before = np.concatenate([np.full((n, 1, k), 1 / k), alpha[:, :-1]], axis=1)
    pairs = a * np.einsum("nti,ntj->ij", before, e * beta / scale)
    return alpha * beta, pairs, float(total)


def document_marginals(emit: np.ndarray, which: np.ndarray, counts: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The sum of each document's word marginals, exactly, however long it is.

    Documents are cut into blocks. The products of each block's transfer matrices are
    found for all blocks side by side, carried along each document from block to block,
    and then the words within all blocks are gone through side by side.
    """
    k, a = emit.shape[1], np.exp(change)
    e_word = np.exp(emit - emit.max(axis=1, keepdims=True))
    blocks = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), blocks)
    start_block = np.cumsum(blocks) - blocks
    inner = np.arange(len(doc)) - start_block[doc]
    begin = (np.cumsum(counts) - counts)[doc] + inner * BLOCK
    size = np.minimum(BLOCK, counts[doc] - inner * BLOCK)
    e = np.ones((BLOCK, len(doc), k))
    live = np.arange(BLOCK)[:, None] < size
    e[live] = e_word[which[(np.arange(BLOCK)[:, None] + begin)[live]]]
    product = np.broadcast_to(np.eye(k), (len(doc), k, k)).copy()
    for t in range(BLOCK):
        step = (product @ a) * e[t][:, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        product = np.where(live[t][:, None, None], step, product)
    into, out_of = np.full((len(doc), k), 1 / k), np.ones((len(doc), k))
    for j in range(1, int(blocks.max(initial=0))):
        at = start_block[blocks > j] + j
        v = np.einsum("nk,nkl->nl", into[at - 1], product[at - 1])
        into[at] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(blocks.max(initial=0)) - 2, -1, -1):
        at = start_block[blocks > j + 1] + j
        v = np.einsum("nkl,nl->nk", product[at + 1], out_of[at + 1])
        out_of[at] = v / v.sum(axis=1, keepdims=True)
    alpha, state = np.empty_like(e), into
    for t in range(BLOCK):
        step = (state @ a) * e[t]
        step /= step.sum(axis=1, keepdims=True)
        state = alpha[t] = np.where(live[t][:, None], step, state)
    total, beta = np.zeros((len(doc), k)), out_of
    for t in range(BLOCK - 1, -1, -1):
        gamma = alpha[t] * beta
        total += np.where(live[t][:, None], gamma / gamma.sum(axis=1, keepdims=True), 0)
        step = (e[t] * beta) @ a.T
        step /= step.sum(axis=1, keepdims=True)
        beta = np.where(live[t][:, None], step, beta)
    return np.stack([np.bincount(doc, total[:, j], len(counts)) for j in range(k)], axis=1)


def train(texts: list[str], langs: list[str], sequences: int = 4000, length: int = 40, epochs: int = 8, seed: int = 5) -> Crf:
    """Maximum likelihood with Adam. A sequence is one to four stretches of words, each out of a text of some language."""
    rng, labels = np.random.default_rng(seed), sorted(set(langs))
    w = words(pa.array(texts, pa.large_string()))
    example, which = distinct(w)
    owner, feature, size = word_features(w, example)
    gold_of = np.array([labels.index(x) for x in langs])
    by_label = [np.flatnonzero((gold_of == y) & (w.counts > 0)) for y in range(len(labels))]
    usable = [y for y, d in enumerate(by_label) if len(d)]
    seq, gold = np.empty((sequences, length), np.int64), np.empty((sequences, length), np.int64)
    for i in range(sequences):
        cuts = [0, *sorted(rng.choice(np.arange(1, length), rng.integers(0, 4), replace=False)), length]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            y = usable[rng.integers(len(usable))]
            d = by_label[y][rng.integers(len(by_label[y]))]
            at = w.first[d] + rng.integers(w.counts[d])
            seq[i, lo:hi] = which[w.first[d] + (at - w.first[d] + np.arange(hi - lo)) % w.counts[d]]
            gold[i, lo:hi] = y
    k = len(labels)
    crf = Crf(labels, np.zeros((BUCKETS, k)), np.zeros((k, k)))
    of_word = np.argsort(owner, kind="stable")
    begin = np.concatenate([[0], np.cumsum(size)])
    feature = feature[of_word]
    moments = [np.zeros_like(x) for x in (crf.weight, crf.weight, crf.change, crf.change)]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(sequences), max(1, sequences // 250)):
            used, inverse = np.unique(seq[part], return_inverse=True)
            n = size[used]
            index = np.repeat(begin[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own, feat = np.repeat(np.arange(len(used)), n), feature[index]
            emit = np.stack([np.bincount(own, crf.weight[feat, j], len(used)) for j in range(k)], axis=1) / np.sqrt(n)[:, None]
            inverse = inverse.reshape(len(part), length)
            marginal, pairs, _ = forward_backward(emit[inverse], crf.change)
            error = marginal - np.eye(k)[gold[part]]
            d_emit = np.stack([np.bincount(inverse.ravel(), error[:, :, j].ravel(), len(used)) for j in range(k)], axis=1) / np.sqrt(n)[:, None]
            d_weight = np.stack([np.bincount(feat, d_emit[own, j], BUCKETS) for j in range(k)], axis=1) / len(part) + 1e-4 * crf.weight
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[part][:, :-1], gold[part][:, 1:]), 1)
            first = np.bincount(gold[part][:, 0], minlength=k)
            d_change = (pairs - seen - first / k) / len(part) + 1e-3 * crf.change
            step += 1
            for x, g, i, rate in ((crf.weight, d_weight, 0, 0.05), (crf.change, d_change, 2, 0.05)):
                moments[i] = 0.9 * moments[i] + 0.1 * g
                moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g * g
                x -= rate * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 1] / (1 - 0.99**step)) + 1e-8)
    return crf


def label_words(crf: Crf, text: str) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of each word of a text, as for code-switched text."""
    w = words(pa.array([text], pa.large_string()))
    if not len(w.hash):
        return []
    example, which = distinct(w)
    marginal = forward_backward(crf.emissions(w, example)[which][None], crf.change)[0][0]
    best = marginal.argmax(axis=1)
    return [(bytes(w.raw[a:b]).decode(), crf.labels[y], float(marginal[i, y])) for i, (a, b, y) in enumerate(zip(w.start, w.end, best, strict=True))]


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, max_chars: int) -> Crf | None:
    """The field, fitted on up to ``per_language`` texts of each language, of at most ``max_chars``, whose crc32(id) mod 5 is not 0.

    Copies of a sampled row (equal id, language and hash of the text) are one row before
    they reach the driver, and other texts of its id are no part of the sample.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (id_remainder(id_col, 5) != 0) & F.char_length(text_col).between(1, max_chars))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("tie", "id", "print"))
    ids = known.select("id", "lang", "print", F.xxhash64("id").alias("tie")).withColumn("_n", order).where(F.col("_n") <= per_language)
    sample = known.join(F.broadcast(ids.select("id", "lang", "print").distinct()), ["id", "lang", "print"]).groupBy("id", "lang", "print").agg(F.min("text").alias("text"))
    rows = sample.toPandas().sort_values(["id", "text"])
    return train(list(rows["text"]), list(rows["lang"])) if len(rows) else None


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, max_chars: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is a learned language; ``und`` with score 0 where the text is null, has
    no letter, or nothing could be learned. ``score`` is the share of the word marginals.
    Rows with a null id are predicted, never learned from, and not held out. Extra
    columns are ignored; an empty table gives an empty result.
    """
    crf = fit(docs, id_col, text_col, lang_col, per_language, max_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            w = words(piece.column(3))
            pred, score = np.full(piece.num_rows, "und", object), np.zeros(piece.num_rows)
            if crf is not None and len(w.hash):
                example, which = distinct(w)
                mass = document_marginals(crf.emissions(w, example), which, w.counts, crf.change)
                sure = piece.column(2).to_numpy(zero_copy_only=False).astype(bool) & (w.counts > 0)
                best = mass.argmax(axis=1)
                pred[sure] = np.array(crf.labels, object)[best[sure]]
                score[sure] = np.clip(mass[sure, best[sure]] / w.counts[sure], 0, 1)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(pred.tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(id_remainder(id_col, 5) == 0, F.lit(False))
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), letters.alias("letters"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PREDICTED)
