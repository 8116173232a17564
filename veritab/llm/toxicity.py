"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as five numbers from tables of log odds, which are counted over the
labelled texts: that of the word, the mean and the highest one of its character n-grams,
and those of its first characters. Two gated recurrent layers read windows of words
forwards and backwards; attention over their states gives one vector a window, and a
logistic unit its score. All overlapping windows of a text are scored, and its highest
window, calibrated, is the text's score. Everything is trained in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._words import Words, char_ngrams, distinct, hash_runs, mix, pieces, runs, words

NGRAMS, PREFIXES = (3, 4, 5), (4, 6)  # bytes
FOLDS = 5
TABLES = "word", "char", "prefix"
F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * F32(0.5)) * F32(0.5) + F32(0.5)


@dataclass
class Settings:
    """``max_documents`` and ``max_chars`` bound the labelled sample that the network is fitted on.

    It is gone through until ``seen`` texts have been seen, but at least ``epochs`` and at most ``most_epochs`` times.
    """

    max_documents: int = 4500
    max_chars: int = 50_000
    buckets: int = 1 << 16
    hidden: int = 8
    window: int = 32
    stride: int = 16
    epochs: int = 6
    most_epochs: int = 20
    seen: int = 30_000
    seed: int = 7

    @property
    def inputs(self) -> int:
        return 3 + len(PREFIXES)


def highest(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The highest value of each of n owners; 0 for one without values."""
    out, order = np.zeros(n, F32), np.argsort(owner, kind="stable")
    owner, value = owner[order], value[order]
    if len(owner):
        edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[edge]] = np.maximum.reduceat(value, edge)
    return out


def prefixes(w: Words, example: np.ndarray, n: int) -> list[np.ndarray]:
    """The buckets of each word's first characters, for each length."""
    start, end = w.start[example], w.end[example]
    return [(mix(hash_runs(w.data, start, np.minimum(start + k, end)) + np.uint64(k)) % np.uint64(n)).astype(np.int64) for k in PREFIXES]


@dataclass
class BiGru:
    """The weights. ``input`` and ``state`` have the update, reset and candidate parts side by side, a row of matrices for each direction."""

    settings: Settings
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, s: Settings) -> BiGru:
        rng, h, d = np.random.default_rng(s.seed), s.hidden, s.inputs
        near = lambda *shape: rng.normal(0, 0.3, shape).astype(F32)
        p = {k: np.zeros(s.buckets, F32) for k in TABLES} | {"attend": near(2 * h), "out": near(2 * h), "bias": np.full(1, -1, F32)}
        for way in ("f", "b"):
            p |= {f"in_{way}": near(d, 3 * h), f"at_{way}": near(h, 3 * h), f"on_{way}": np.zeros(3 * h, F32)}
        return cls(s, p)

    def embed(self, w: Words, example: np.ndarray) -> np.ndarray:
        """One input vector for each distinct word, given by an example; some thousand words at a time."""
        s, n = self.settings, np.uint64(self.settings.buckets)
        out = np.zeros((len(example), s.inputs), F32)
        out[:, 0] = self.p["word"][(w.hash[example] % n).astype(np.int64)]
        for lo in range(0, len(example), 5_000):
            some = example[lo : lo + 5_000]
            owner, gram = char_ngrams(w.data, w.start[some], w.end[some], NGRAMS)
            gram = (gram % n).astype(np.int64)
            value = self.p["char"][gram]
            out[lo : lo + 5_000, 1] = np.bincount(owner, value, len(some)) / np.maximum(np.bincount(owner, minlength=len(some)), 1)
            out[lo : lo + 5_000, 2] = highest(owner, value, len(some))
        for j, bucket in enumerate(prefixes(w, example, s.buckets)):
            out[:, 3 + j] = self.p["prefix"][bucket]
        return out

    def states(self, steps_in: Callable[[int], np.ndarray], n: int, mask: np.ndarray | None, way: str, keep: bool = False):
        """States of one direction, (words of a window, n windows, hidden), from the projected input at each place; ``keep``: also what the gradient needs."""
        h, length, at = self.settings.hidden, self.settings.window, self.p[f"at_{way}"]
        state, out, kept = np.zeros((n, h), F32), np.empty((length, n, h), F32), {}
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            px, ph = steps_in(t), state @ at
            gates = sigmoid(px[:, : 2 * h] + ph[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(px[:, 2 * h :] + r * ph[:, 2 * h :])
            after = new + z * (state - new)
            if mask is not None:
                after = np.where(mask[:, t, None], after, state)
            if keep:
                kept[t] = (state, z, r, new, ph[:, 2 * h :])
            state = out[t] = after
        return (out, kept) if keep else out

    def pooled(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray | None):
        h = self.settings.hidden
        weight = forward @ self.p["attend"][:h] + backward @ self.p["attend"][h:]
        if mask is not None:
            weight = np.where(mask.T, weight, F32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        vector = np.concatenate([np.einsum("tb,tbh->bh", weight, forward), np.einsum("tb,tbh->bh", weight, backward)], axis=1)
        return weight, vector

    def logits(self, x: np.ndarray, take: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """The logit of each window, some windows at a time. The distinct words' inputs are projected once."""
        projected = {way: x @ self.p[f"in_{way}"] + self.p[f"on_{way}"] for way in "fb"}
        found = [np.zeros(0, F32)]
        for i in range(0, len(take), 2048):
            part, m = np.ascontiguousarray(take[i : i + 2048].T), None if mask is None else mask[i : i + 2048]
            forward, backward = (self.states(lambda t, way=way: projected[way][part[t]], part.shape[1], m, way) for way in "fb")
            _, vector = self.pooled(forward, backward, m)
            found.append(vector @ self.p["out"] + self.p["bias"])
        return np.concatenate(found)

    def gradient(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss by the weights. ``x``: windows x words x inputs."""
        h, p = self.settings.hidden, self.p
        forward, kept_f = self.states(lambda t: x[:, t] @ p["in_f"] + p["on_f"], len(x), mask, "f", True)
        backward, kept_b = self.states(lambda t: x[:, t] @ p["in_b"] + p["on_b"], len(x), mask, "b", True)
        weight, vector = self.pooled(forward, backward, mask)
        error = (sigmoid(vector @ p["out"] + p["bias"]) - label) / F32(len(label))
        g = {"out": vector.T @ error, "bias": error.sum(keepdims=True)}
        d_vector = error[:, None] * p["out"]
        both = np.concatenate([forward, backward], axis=2)
        d_weight = np.einsum("tbh,bh->tb", both, d_vector)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", d_score, both)
        d_both = weight[:, :, None] * d_vector + d_score[:, :, None] * p["attend"]
        for way, kept, d_out in (("f", kept_f, d_both[:, :, :h]), ("b", kept_b, d_both[:, :, h:])):
            at = p[f"at_{way}"]
            g_in, g_at, g_on = np.zeros_like(p[f"in_{way}"]), np.zeros_like(at), np.zeros(3 * h, F32)
            d_state = np.zeros((len(x), h), F32)
            for t in range(x.shape[1] - 1, -1, -1) if way == "f" else range(x.shape[1]):
                state, z, r, new, ph = kept[t]
                d_after = d_state + d_out[t]
                live = mask[:, t, None]
                d_hold = np.where(live, 0, d_after)
                d_after = np.where(live, d_after, 0)
                d_new = d_after * (1 - z) * (1 - new * new)
                d_z = d_after * (state - new) * z * (1 - z)
                d_r = d_new * ph * r * (1 - r)
                d_px = np.concatenate([d_z, d_r, d_new], axis=1)
                d_ph = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g_at += state.T @ d_ph
                d_state = d_hold + d_after * z + d_ph @ at.T
                g_in += x[:, t].T @ d_px
                g_on += d_px.sum(axis=0)
            g |= {f"in_{way}": g_in, f"at_{way}": g_at, f"on_{way}": g_on}
        return g


def windows_of(w: Words, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of all overlapping windows; the last one of a document ends with it."""
    count = w.counts
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - s.window) // s.stride)), 0)
    doc = np.repeat(np.arange(len(count)), n)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(count[doc], s.window)
    return doc, w.first[:-1][doc] + np.minimum(step * s.stride, count[doc] - size), size


def words_in(first: np.ndarray, size: np.ndarray, which: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word at each place of each window, and which places are filled."""
    place = np.arange(s.window)
    mask = place < size[:, None]
    return which[np.minimum(first[:, None] + place, len(which) - 1)], mask


def text_logits(model: BiGru, texts: pa.Array) -> np.ndarray:
    """The highest window's logit of each text; -10 for a text without words."""
    s, w = model.settings, words(texts)
    top = np.full(len(w.counts), -10, F32)
    if len(w.hash):
        example, which = distinct(w)
        x = model.embed(w, example)
        doc, first, size = windows_of(w, s)
        full = size == s.window
        for some in (full, ~full):
            if some.any():
                take, mask = words_in(first[some], size[some], which, s)
                np.maximum.at(top, doc[some], model.logits(x, take, mask if not full[some].all() else None))
    return top


def occurrences(texts: list[str], toxic: np.ndarray, n: int) -> np.ndarray:
    """(fold, kind, label, bucket): in how many texts words, n-grams and prefixes (the kinds) of each bucket occur. Some texts at a time; text i is in fold i mod FOLDS."""
    counts, size = np.zeros((FOLDS, 3, 2, n), np.float32), np.uint64(n)
    for lo in range(0, len(texts), 200):
        w = words(pa.array(texts[lo : lo + 200], pa.large_string()))
        if not len(w.hash):
            continue
        bad, fold = toxic[lo : lo + 200], np.arange(lo, min(lo + 200, len(texts))) % FOLDS
        example, which = distinct(w)
        doc, word = np.divmod(np.unique(w.doc * len(example) + which), len(example))
        owner, gram = char_ngrams(w.data, w.start[example], w.end[example], NGRAMS)
        gram = (gram % size).astype(np.int64)[np.argsort(owner, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(example)))])
        index, _ = runs(begin[word], np.diff(begin)[word])
        found = [(0, doc, (w.hash[example] % size).astype(np.int64)[word]), (1, np.repeat(doc, np.diff(begin)[word]), gram[index])]
        found += [(2, doc, bucket[word]) for bucket in prefixes(w, example, n)]
        for kind, who, bucket in found:
            who, bucket = np.divmod(np.unique(who * n + bucket), n)
            for f in range(FOLDS):
                for y in (0, 1):
                    counts[f, kind, y] += np.bincount(bucket[(bad[who] == y) & (fold[who] == f)], minlength=n)
    return counts


def log_odds(counts: np.ndarray, share: float, weight: float = 5.0) -> np.ndarray:
    """For the buckets of each kind: how much more often they occur in toxic texts, smoothed towards not at all."""
    odds = (counts[:, 1] + weight * share) / (counts[:, 0] + weight * (1 - share)) * (1 - share) / share
    return (np.clip(np.log(odds), -4, 4) / 2).astype(F32)


def train(texts: list[str], toxic: np.ndarray, s: Settings) -> BiGru:
    """Fits the network on labelled texts.

    The tables hold smoothed log odds; while the network learns, those of a text are
    counted without its fold, as those of a new text will be. A toxic text says nothing of its single
    windows, so the windows to learn from are chosen by the model itself: its highest
    ones of each text, toxic or not, and others of clean texts; chosen anew as it learns.
    """
    model, rng = BiGru.fresh(s), np.random.default_rng(s.seed)
    toxic = np.asarray(toxic)
    counts, share = occurrences(texts, toxic, s.buckets), toxic.mean()

    def tables(of: np.ndarray) -> None:
        model.p |= zip(TABLES, log_odds(of, share), strict=True)

    parts, n_words, n_inputs = [], 0, 0
    for fold in range(FOLDS):
        tables(counts.sum(axis=0) - counts[fold])
        own = np.arange(fold, len(texts), FOLDS)
        for lo in range(0, len(own), 200):
            some = own[lo : lo + 200]
            w = words(pa.array([texts[i] for i in some], pa.large_string()))
            if len(w.hash):
                example, which = distinct(w)
                doc, first, size = windows_of(w, s)
                parts.append((model.embed(w, example), (which + n_inputs).astype(np.int32), some[doc], first + n_words, size))
                n_words, n_inputs = n_words + len(which), n_inputs + len(example)
    tables(counts.sum(axis=0))
    if not parts:
        return model
    x, which, doc, first, size = (np.concatenate(each) for each in zip(*parts, strict=True))
    take, mask = words_in(first, size, which, s)
    rank = np.where(mask, x.sum(axis=1)[take], -9).max(axis=1)
    slow, square = ({k: np.zeros_like(v) for k, v in model.p.items() if k not in TABLES} for _ in range(2))
    step, epochs = 0, max(s.epochs, min(s.most_epochs, s.seen // len(texts)))
    for epoch in range(epochs):
        order = np.lexsort((-rank, doc))
        place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])  # of each window among its text's
        clean = toxic[doc[order]] == 0
        chosen = order[np.where(clean, (place < 3) | (rng.random(len(order)) < 0.02), place < 1)]
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 128)):
            t, m = take[part], mask[part]
            g = model.gradient(x[t], m, toxic[doc[part]].astype(F32))
            step += 1
            for k, v in g.items():
                slow[k] = 0.9 * slow[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                model.p[k] -= (0.02 * (slow[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(F32)
        if epoch % 2 == 1 or epoch == epochs - 1:
            rank = model.logits(x, take, mask)
    top = np.full(len(texts), -10, F32)
    np.maximum.at(top, doc, rank)
    model.scale = calibrated(top, toxic)
    return model


def calibrated(top: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of the labels by the texts' highest logits (Newton's method with halved steps, lightly regularised)."""
    x, y, at = top.astype(float), toxic.astype(float), np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        z = v[0] * x + v[1]
        return float((np.logaddexp(0, z) - y * z).sum() + 0.05 * (v[0] - 1) ** 2)

    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        e, v = q - y, q * (1 - q) + 1e-6
        gradient = np.array([(e * x).sum() + 0.1 * (at[0] - 1), e.sum()])
        step = np.linalg.solve(np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum()]]), gradient)
        while np.abs(step).max() > 1e-9 and loss(at - step) > loss(at):
            step = step / 2
        at = at - step
    return float(max(at[0], 0.05)), float(at[1])


def id_remainder(id_col: str, m: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(m))


def fit(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str, label_col: str) -> BiGru | float:
    """The network, fitted on labelled rows whose crc32(id) mod 3 is not 1; the share of toxic labels where there is but one class."""
    marked = labels.groupBy(id_col).agg(F.max(label_col).alias("_label")).where(F.col("_label").isin(0, 1) & (id_remainder(id_col, 3) != 1))
    pick = lambda y, n: marked.where(F.col("_label") == y).orderBy(F.xxhash64(id_col), id_col).limit(n)
    sample = pick(1, s.max_documents // 3).unionByName(pick(0, s.max_documents - s.max_documents // 3))
    texts = docs.select(id_col, F.col(text_col).alias("_text")).where(F.char_length("_text").between(1, s.max_chars))
    rows = texts.join(F.broadcast(sample), id_col).orderBy(F.xxhash64(id_col), id_col, "_text").limit(2 * s.max_documents).toPandas().sort_values([id_col, "_text"])
    toxic = rows["_label"].to_numpy(int)
    if len(set(toxic)) < 2:
        return float(toxic.mean()) if len(toxic) else 0.0
    return train(list(rows["_text"]), toxic, s)


def with_score(docs: DataFrame, model: BiGru | float, text_col: str, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(name, DoubleType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            texts = piece.column(piece.schema.get_field_index(text_col))
            if isinstance(model, BiGru):
                a, b = model.scale
                score = 1 / (1 + np.exp(-np.clip(a * text_logits(model, texts).astype(float) + b, -30, 30)))
            else:
                score = np.full(piece.num_rows, model)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(score, pa.float64())], names=arrow.names)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, settings: Settings | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts, and those without words, have the lowest score. Labels that
    are neither 0 nor 1 are ignored; of several labels of a document the highest
    counts. Rows with a null id are scored, never learned from, and not held out.
    Extra columns are ignored; an empty table gives an empty result; without labels
    of both classes each score is the share of toxic labels (0 if there are none).
    """
    model = fit(docs, labels, settings or Settings(), id_col, text_col, label_col)
    held = F.coalesce(id_remainder(id_col, 3) == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return with_score(rows, model, "text").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; the network is fitted on their labelled ones."""
    model = fit(docs, labels, Settings(), id_col, text_col, label_col)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    return with_score(packed, model, "_text", "_score").where(F.col("_score") < threshold).select("_row.*")
