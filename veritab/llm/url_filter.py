"""URL filters: rules for hosts and paths, and a logistic regression for the other URLs.

A rule is found by a join on the URL's host and its parent domains. URLs that no rule
fits are judged by a logistic regression on hashed character n-grams of host and path,
fitted by numpy on a small table of labelled URLs. Scoring is a map over all URLs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm._runtime import materialise
from veritab.llm._words import char_ngrams, lower, mix, pieces, text_bytes
from veritab.llm.exact_dedup import ascii_lower

BUCKETS, NGRAMS = 1 << 16, (3, 4, 5)
#: (host, path, verdict): a rule fits its host and all subdomains, where the URL's path starts with the rule's.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PATH_SEED = np.uint64(0x9E3779B97F4A7C15)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; then up to ``?``, ``#`` or the end. Both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def domains(host: Column) -> Column:
    """The host and the domains it is in: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(rid, rule, rule_verdict) of the rows (rid, host, path) that a rule (host, path, verdict) fits: the longest, and of equally long ones that of the longer host, then by code points.

    Rules of equal host and path: block wins.
    """
    rules = rules.select(F.col("host").alias("domain"), F.col("path").alias("start"), "verdict")
    met = urls.select("rid", "path", F.explode(domains(F.col("host"))).alias("domain")).join(rules, "domain").where(F.startswith("path", "start"))
    rank = F.struct(F.char_length(F.concat("domain", "start")).alias("size"), F.char_length("domain").alias("of_host"), F.concat("domain", "start").alias("rule"), "verdict")
    return met.groupBy("rid").agg(F.max(rank).alias("r")).select("rid", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"))


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) for each different n-gram of ``<host>`` and of ``<path>``; the same n-gram of both has two buckets."""
    rows, buckets = [], []
    for part, seed in ((hosts, np.uint64(0)), (paths, PATH_SEED)):
        data, offsets = text_bytes(part)
        owner, gram = char_ngrams(lower(data) if len(data) else data, offsets[:-1], offsets[1:], NGRAMS)
        rows.append(owner)
        buckets.append((mix(gram ^ seed) % np.uint64(BUCKETS)).astype(np.int64))
    found = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets))
    return found // BUCKETS, found % BUCKETS


@dataclass
class UrlModel:
    """``weight``: of each bucket; a URL's logit is the bias and the sum of its n-grams' weights over the root of their number."""

    weight: np.ndarray
    bias: float

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """How likely each URL is one to block, 0 to 1."""
        row, bucket = features(hosts, paths)
        n = len(hosts)
        z = np.bincount(row, self.weight[bucket], n) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(hosts: list[str], paths: list[str], block: Iterable[int], epochs: int = 60, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> UrlModel:
    """Logistic regression by AdaGrad over shuffled batches; both labels weigh the same in all. Without labels of both kinds, the bias alone says the one there is (none: allow)."""
    y = np.array(list(block), float)
    model = UrlModel(np.zeros(BUCKETS), 0.0)
    if len(y) == 0 or y.min() == y.max():
        model.bias = 5.0 if len(y) and y[0] else -5.0
        return model
    row, bucket = features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    first = np.searchsorted(row, np.arange(len(y) + 1))
    scale = 1 / np.sqrt(np.maximum(np.diff(first), 1))
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng, seen, seen_bias = np.random.default_rng(seed), np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            size = first[some + 1] - first[some]
            owner = np.repeat(np.arange(len(some)), size)
            at = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            b = bucket[at]
            z = np.bincount(owner, model.weight[b], len(some)) * scale[some] + model.bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * share[some] / len(some)
            touched, where = np.unique(b, return_inverse=True)
            step = np.bincount(where, (error * scale[some])[owner], len(touched)) + decay * model.weight[touched]
            seen[touched] += step**2
            model.weight[touched] -= rate * step / np.sqrt(seen[touched])
            seen_bias += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(seen_bias)
    return model


def fit(labelled: DataFrame, per_label: int = 4000, max_bytes: int = 2000) -> UrlModel:
    """Fit on rows (host, path, verdict): of each verdict at most ``per_label`` different URLs of ``max_bytes`` at most, the first by their hash. These bounds hold what the driver gets to some MB."""
    rows = labelled.where(F.octet_length("host") + F.octet_length("path") <= max_bytes).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # both: block
    order, some = [F.xxhash64("host", "path"), F.col("host"), F.col("path")], []
    for verdict in ("allow", "block"):
        some += rows.where(F.col("verdict") == verdict).orderBy(*order).limit(per_label).collect()
    return train([r.host for r in some], [r.path for r in some], [r.verdict == "block" for r in some])


def with_scores(urls: DataFrame, model: UrlModel) -> DataFrame:
    """``urls`` (host, path, ...) with ``score``."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in urls.schema.fields] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "path"):
            names = batch.schema.names
            hosts, paths = (batch.column(names.index(c)) for c in ("host", "path"))
            for lo, hi in spans(pc.binary_length(hosts).to_numpy(zero_copy_only=False)):
                scores = model.scores(hosts.slice(lo, hi - lo), paths.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(scores)], [*names, "score"])

    return urls.mapInArrow(run, schema)


def spans(sizes: np.ndarray, n_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``n_bytes``."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + n_bytes, side="right")), at + 1)
        yield at, to
        at = to


def url_verdicts(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, per_label: int = 4000) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    ``rules`` (host, path, verdict): the longest that fits decides, ``rule`` is its host and
    path. Other URLs are blocked from a ``score`` of ``threshold``. ``labelled`` (url, verdict): the
    table that the model is fitted on, at most ``per_label`` of each verdict; none: the pages
    that a rule decides. A null URL, or one without ``://``, has empty host and path, and a
    score like any other; repeated rows are judged alike, an empty table has no rows,
    other columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    urls = materialise(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("rid")))
    ruled = materialise(with_rules(urls, rules))
    rows = urls.join(ruled, "rid", "left")
    if labelled is None:
        known = rows.where("rule is not null").select("host", "path", F.col("rule_verdict").alias("verdict"))
    else:
        host, path = url_parts(F.col("url"))
        known = labelled.select(host.alias("host"), path.alias("path"), "verdict")
    model = fit(known, per_label)
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return with_scores(rows.drop("rid"), model).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", judged).alias("verdict"), "score")
