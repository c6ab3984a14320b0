"""Mixing sources to target weights by soft membership (op 3).

A multinomial logistic classifier over hashed words, fitted on a bounded sample of the labelled rows, gives every
document a posterior over domains. Rates r >= `least` minimise |E r - T|^2 / (2 total), where E holds the expected tokens of each
domain (posterior times length) and T the wanted ones; of the rates that do, those nearest to r = start. In coordinates scaled by
the square root of a document's length the optimum is its own projected gradient step: max(least, start + p m) for a posterior p and one
multiplier m for each domain. Newton steps on the multipliers need sums over the table of posteriors with their tokens, which Spark
computes where it lies, until the condition holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged, text_of, unit_draw

_WORD = re.compile(r"[^\W\d_]+")
_NONE = -(1 << 63)  # stands for a null id in joins
TIE = 1e-7  # weight of the distance from `start` against the distance from the targets


@dataclass
class Domains:
    names: list[str]
    weights: np.ndarray  # buckets x domains
    offset: np.ndarray

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors (rows sum to 1) and numbers of words."""
        x = _Counts(len(self.weights))
        z, n = np.empty((len(texts), len(self.names))), np.empty(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            ids, n[i] = x.of(t)
            z[i] = self.weights[ids].sum(axis=0) / np.sqrt(max(1, len(ids))) + self.offset
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), n


class _Counts:
    """The hash buckets of a text's distinct words."""

    def __init__(self, buckets: int, most: int = 100_000):
        self._n, self._most, self._known = buckets, most, {}

    def of(self, text: str) -> tuple[np.ndarray, int]:
        words = text.lower().split()
        known = self._known
        if len(known) > self._most:
            known.clear()
        distinct = set(words)
        for w in distinct.difference(known):
            core = _WORD.search(w)
            known[w] = zlib.crc32(core[0].encode()) % self._n if core else -1
        ids = {known[w] for w in distinct}
        ids.discard(-1)
        return np.fromiter(ids, np.int64, len(ids)), len(words)


def fit_domains(texts: list[str], domains: list[str], buckets: int = 1 << 14, epochs: int = 30, rate: float = 0.5, shrink: float = 1e-4) -> Domains:
    """Multinomial logistic regression by full-batch gradient steps with momentum; domains in alphabetical order."""
    names = sorted(set(domains))
    if not names:
        return Domains(["unknown"], np.zeros((buckets, 1)), np.zeros(1))
    x = _Counts(buckets)
    rows = [x.of(t)[0] for t in texts]
    y = np.zeros((len(rows), len(names)))
    y[np.arange(len(rows)), [names.index(d) for d in domains]] = 1
    size = np.array([len(r) for r in rows])
    col, row = np.concatenate(rows) if rows else np.empty(0, np.int64), np.repeat(np.arange(len(rows)), size)
    scale = 1 / np.sqrt(np.maximum(size, 1))
    w, b = np.zeros((buckets, len(names))), np.log((y.sum(axis=0) + 1) / (len(rows) + len(names)))
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(epochs):
        z = np.stack([np.bincount(row, weights=w[col, k], minlength=len(rows)) for k in range(len(names))], axis=1) * scale[:, None] + b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        d = (p / p.sum(axis=1, keepdims=True) - y) / len(rows)
        g = np.stack([np.bincount(col, weights=(d[:, k] * scale)[row], minlength=buckets) for k in range(len(names))], axis=1) + shrink * w
        vw, vb = 0.9 * vw - rate * g * 10, 0.9 * vb - rate * d.sum(axis=0)
        w, b = w + vw, b + vb
    return Domains(names, w, b)


def train(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", most: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Domains:
    """The classifier, fitted on at most `most` of the documents that the labelled table names, with their domain. Rows with a
    null id or domain aren't learned from."""
    known = labels.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_d"), text_of(text_col).alias("_t")).where("_d is not null")
    got = rows.join(F.broadcast(known), "_id").orderBy(F.xxhash64("_id"), "_t", "_d").limit(most).collect()
    return fit_domains([r["_t"] for r in got], [r["_d"] for r in got])


def _posteriors(batches: Iterator[pa.RecordBatch], model: Domains) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            p, n = model.posteriors([t or "" for t in some.column("text").to_pylist()])
            d = p.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d * len(p) + 1, d, dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("h"), lists, pa.array(n)], names=["doc_id", "h", "p", "n_tokens"])


def membership(docs: DataFrame, model: Domains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), p (posterior of each domain) and n_tokens (words between white space)."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(partial(_posteriors, model=model), "doc_id long, h long, p array<double>, n_tokens long")


@dataclass
class Rates:
    """The rate of a posterior: start plus its product with the domains' multipliers, kept at `least` or above."""

    multipliers: np.ndarray
    start: float
    least: float
    gap: np.ndarray | None = None  # expected tokens less wanted ones, by domain, as shares of all tokens

    def column(self, p: Column) -> Column:
        by = F.array(*[F.lit(float(v)) for v in self.multipliers])
        dot = F.aggregate(F.zip_with(p, by, lambda g, v: g * v), F.lit(0.0), lambda a, v: a + v)
        return F.greatest(F.lit(float(self.start)) + dot, F.lit(float(self.least)))

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(self.start + p @ self.multipliers, self.least)


#: Parts of a step that are tried in one pass.
_PARTS = np.array([1.0, 0.5, *0.25 ** np.arange(1, 15)])


def _sums(p: np.ndarray, n: np.ndarray, tried: np.ndarray, start: float, least: float) -> np.ndarray:
    """For each of the tried multipliers: the value's part from these posteriors, their expected tokens of each domain, and the
    curvature (domains x domains) of those above `least`."""
    out = []
    for m in tried:
        u = start + p @ m
        free = u >= least
        e = p.T @ (n * np.where(free, u, least))
        h = p.T @ (p * (n * free)[:, None])
        out.append(np.concatenate([[(n * np.where(free, u * u / 2, least * u - least * least / 2)).sum()], e, h.ravel()]))
    return np.array(out)


def _summed(batches: Iterator[pa.RecordBatch], tried: np.ndarray, start: float, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            p = batch.column("p").flatten().to_numpy().reshape(batch.num_rows, -1)
            e = _sums(p, batch.column("n_tokens").to_numpy().astype(np.float64), tried, start, least).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(e), dtype=np.int32)), pa.array(e)], names=["d", "e"])


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float], total: float | None = None, start: float = 1.0, least: float = 0.0, enough: float = 1e-6, bound: int = 200) -> Rates:
    """Rates whose expected domain totals come as near to the targets as they can. members: p (posteriors in the order of names, of sum 1)
    and n_tokens, which each pass reads; targets: weights by domain, scaled to sum 1
    over the domains that the classifier knows (others can't be reached); total: wanted tokens, as many as there are if None.
    Raises if the optimum isn't reached to within `enough` of the wanted tokens in `bound` passes."""
    pooled = members.select("p", "n_tokens")
    tokens = float(pooled.agg(F.sum("n_tokens")).first()[0] or 0)
    t = np.array([max(0.0, targets.get(x, 0.0)) for x in names])
    if tokens == 0 or t.sum() == 0:
        return Rates(np.zeros(len(names)), start, least)
    want = t / t.sum() * (start if total is None else total / tokens)

    def sums(tried: np.ndarray) -> np.ndarray:
        rows = pooled.mapInArrow(partial(_summed, tried=tried, start=start, least=least), "d int, e double").groupBy("d").agg(F.sum("e").alias("e")).collect()  # a few per domain
        out = np.zeros(len(tried) * (1 + len(names) + len(names) ** 2))
        for r in rows:
            out[r["d"]] = r["e"] / tokens
        return out.reshape(len(tried), -1)

    return solved(sums, want, start, least, enough, bound)


def solved(sums: Callable[[np.ndarray], np.ndarray], want: np.ndarray, start: float, least: float, enough: float = 1e-6, bound: int = 200) -> Rates:
    """The optimum by damped Newton steps on the convex function of the multipliers m whose gradient is (expected - wanted + TIE m).
    Where it is 0, r = max(least, start - p (expected - wanted) / TIE): the rates are their own projected gradient step."""
    d = len(want)
    tried = np.zeros((1, d))
    for _ in range(bound):
        got = sums(tried)
        value = got[:, 0] - tried @ want + TIE / 2 * (tried**2).sum(axis=1)
        best = int(value.argmin())
        m, gap, curve = tried[best], got[best, 1 : d + 1] - want, got[best, d + 1 :].reshape(d, d)
        slope = gap + TIE * m
        if np.abs(slope).max() <= enough * want.sum():
            return Rates(m, start, least, gap)
        tried = m - _PARTS[:, None] * np.linalg.solve(curve + TIE * np.eye(d), slope)
    raise RuntimeError(f"rates not found in {bound} passes: {np.abs(slope).max() / want.sum():.3g} of the wanted tokens are left")


def natural_targets(members: DataFrame, names: list[str]) -> dict[str, float]:
    """Each domain's expected tokens as they are."""
    g = members.select(F.posexplode("p").alias("d", "g"), "n_tokens").groupBy("d").agg(F.sum(F.col("g") * F.col("n_tokens")).alias("e")).collect()
    return {names[r["d"]]: float(r["e"] or 0) for r in g}


def mix(docs: DataFrame, model: Domains, targets: dict[str, float], total: float | None = None, least: float = 0.0, start: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, domain (the likeliest), n_tokens, rate, and copies: the rate rounded up or down by a draw from the id and text,
    so that a document's expected copies are its rate.

    Null texts are empty and have the prior's posterior; repeated rows get equal results; null ids are kept; ties between domains go to the
    first by name; an empty table gives an empty result; other columns aren't read.
    """
    members = staged(membership(docs, model, id_col, text_col), "members")
    rates = fit_rates(members, model.names, targets, total, start, least)
    return rated(members, model, rates).select("doc_id", "domain", "n_tokens", "rate", "copies")


def rated(members: DataFrame, model: Domains, rates: Rates) -> DataFrame:
    names = F.array(*[F.lit(x) for x in model.names])
    out = members.withColumn("domain", F.get(names, F.array_position("p", F.array_max("p")).cast("int") - 1)).withColumn("rate", rates.column(F.col("p")))
    draw = unit_draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("h").cast("string"))
    return out.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def resample(docs: DataFrame, model: Domains, targets: dict[str, float], least: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, each as often as its copies say, with all their columns. With `least` 1 every document stays and
    scarce domains are repeated: the total is what the most plentiful domain, at its target share, asks for. Null texts are empty, null ids
    are kept, repeated rows each get the copies of their id and text, and an empty table gives an empty result."""
    members = staged(membership(docs, model, id_col, text_col), "members")
    share = natural_targets(members, model.names)
    t = {k: v for k, v in targets.items() if v > 0 and share.get(k, 0) > 0}
    total = max((share[k] / (v / sum(t.values())) for k, v in t.items()), default=None)
    tokens = members.agg(F.sum("n_tokens")).first()[0] or 0
    rates = fit_rates(members, model.names, t, total, start=(total or tokens or 1) / (tokens or 1), least=least)
    i, h, n = fresh(docs, "id"), fresh(docs, "hash"), fresh(docs, "copies")
    counted = rated(members, model, rates).groupBy("doc_id", "h").agg(F.max("copies").alias(n)).select(F.coalesce("doc_id", F.lit(_NONE)).alias(i), F.col("h").alias(h), n)
    keyed = docs.withColumn(i, F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))).withColumn(h, F.xxhash64(text_of(text_col)))
    joined = keyed.join(counted, [i, h]).where(F.col(n) > 0)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
