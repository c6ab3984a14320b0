"""Counterfactual-regularised toxicity classifier (op 6).

A sentence scores z = offset + the sum of the weights of its distinct words; a word's weight is its own and those of
its first 4 and 5 letters, so that inflected and compound forms of one stem share what is learned. A document counts by its WORST worst
sentences with different scores: e = sum of softplus(z) - softplus(offset) over them, so its length and repetitions don't matter, and
P = sigmoid(shift + slope log(exp(e) - 1)), both fitted on a part of the sample that the weights used for it haven't seen. Fitting penalises (z - z')^2 over counterfactuals of
labelled sentences: one with identity terms has them swapped for others of their kind, and left out; a sample of the others has a term
put in, which is compared with the sentence as it is and with another term in its place. So naming a group doesn't move a score by
itself. Words and beginnings that are too rare in the sample have weight 0, and no weight is negative: what surrounds an insult can't
excuse it. While weights are fitted a document is 1 - prod(1 - sigmoid(z)) over all its sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .quality import labelled_sample

#: Identity terms by kind; a swap stays within its kind and number.
KINDS = (
    "women men girls boys mothers fathers",
    "woman man girl boy mother father",
    "christians muslims jews hindus buddhists sikhs atheists catholics protestants",
    "christian muslim jewish hindu buddhist sikh atheist catholic protestant",
    "gay lesbian straight bisexual heterosexual homosexual transgender queer",
    "black white asian latino african european arab indigenous",
    "americans mexicans chinese indians russians germans french turks poles nigerians",
    "immigrants refugees foreigners migrants citizens natives",
    "old young elderly teenage",
    "disabled deaf blind autistic",
    "frauen männer femmes hommes mujeres hombres",
    "christen muslime juden chrétiens musulmans juifs cristianos musulmanes judíos",
    "ausländer flüchtlinge étrangers réfugiés extranjeros refugiados",
)
_SWAP = {w: [x for x in kind.split() if x != w] for kind in KINDS for w in kind.split()}
_WORDS = re.compile(r"[^\W_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")
WORST = 3


def _features(word: str) -> list[str]:
    """The word, and its first letters (written with a bar, which no word has)."""
    return [word, *(f"{word[:n]}|" for n in (4, 5) if len(word) >= n)]


@dataclass
class Model:
    weights: dict[str, float]
    offset: float
    shift: float = 0.0
    slope: float = 1.0

    def of(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in _features(word))


def _sentences(text: str) -> list[list[str]]:
    """Sentences (and lines) as lists of lower-case words; a text without words has one empty sentence."""
    out, now = [], []
    for w in _WORDS.findall(text.lower()):
        if w in _ENDS:
            if now:
                out.append(now)
                now = []
        else:
            now.append(w)
    if now or not out:
        out.append(now)
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _counterfactuals(found: list[list[str]], n: int, slots: int, swaps: int, rng: np.random.Generator) -> list[tuple[list[str], list[str]]]:
    """(words taken out, words put in) of each counterfactual. found: the identity terms of each labelled sentence that has some;
    n: of how many others there are."""
    out: list[tuple[list[str], list[str]]] = []
    other = lambda t: _SWAP[t][int(rng.integers(len(_SWAP[t])))]
    for terms in found:
        out.append((terms, []))
        out += [(terms, [other(t) for t in terms]) for _ in range(swaps)]
    every = sorted(_SWAP)
    for k in range(min(slots, n)):  # terms in turn, so that each kind is put in
        term = every[k % len(every)]
        out.append(([term], []))
        out += [([term], [other(term)]) for _ in range(swaps)]
    return out


def fit(texts: list[str], labels: np.ndarray, pull: float = 1.0, aside: int = 4, **how) -> Model:
    """The model: weights from all texts, shift and slope from every `aside`-th, by weights from the others. pull: weight of the counterfactual
    penalty, a mean over counterfactuals; how: see `weighted`. Without texts of both labels aside, shift and slope are 0 and 1."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(y):
        return Model({}, 0.0)
    out = weighted(texts, y, pull, **how)
    held = np.arange(len(y)) % aside == aside - 1
    if min(y[held].sum(), (1 - y[held]).sum()) >= 5:
        part = weighted([t for t, h in zip(texts, held, strict=True) if not h], y[~held], pull, **how)
        x = Scorer(part).levels([t for t, h in zip(texts, held, strict=True) if h])
        out.shift, out.slope = _line(x, y[held])
    return out


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Shift and slope (not negative) of a logistic regression, held near 0 and 1 by a weak prior; Newton steps."""
    p, prior = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -30, 30)))
        step = np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + 0.1 * np.eye(2), design.T @ (q - y) + 0.1 * (p - prior))
        p = p - np.clip(step, -1, 1)
    return float(p[0]), float(max(p[1], 0.0))


def weighted(texts: list[str], y: np.ndarray, pull: float, shrink: float = 5e-5, least: int = 4, most_words: int = 50_000, epochs: int = 60, rate: float = 0.1, swaps: int = 2, slots: int = 2000, seed: int = 7) -> Model:
    """shrink: weight of the squared weights; least: documents that a word must be in; most_words: bound of the vocabulary; swaps:
    counterfactuals with another term for each sentence that has one; slots: sentences that a term is put into."""
    rng = np.random.default_rng(seed)
    features: dict[str, list[str]] = {}
    seen: Counter = Counter()
    for t in texts:
        words = {w for w in _WORDS.findall(t.lower()) if w not in _ENDS}
        features.update((w, _features(w)) for w in words if w not in features)
        seen.update({f for w in words for f in features[w]})
    vocab = {w: k for k, (w, _) in enumerate(sorted(((w, n) for w, n in seen.items() if n >= least), key=lambda x: (-x[1], x[0]))[:most_words])}
    del seen
    for w in _SWAP:
        for f in _features(w):
            vocab.setdefault(f, len(vocab))
    known = {w: np.array([vocab[f] for f in fs if f in vocab], np.int32) for w, fs in features.items()}
    del features
    cols, sizes, owner, found = [], [], [], []  # sentence-word incidence
    for k, t in enumerate(texts):
        for s in _sentences(t):
            words = set(s)
            ids = [i for w in words if len(i := known[w])]
            cols.append(np.concatenate(ids) if ids else np.empty(0, np.int32))
            sizes.append(len(cols[-1]))
            owner.append(k)
            if terms := sorted(w for w in words if w in _SWAP):
                found.append(terms)
    n = len(owner)
    col, row, owner = np.concatenate(cols), np.repeat(np.arange(n, dtype=np.int32), sizes), np.array(owner, np.int32)
    del cols, known
    delta = _counterfactuals(found, n - len(found), slots, swaps, rng)
    signed = [(i, vocab[f], sign) for i, pair in enumerate(delta) for words, sign in zip(pair, (1.0, -1.0), strict=True) for w in words for f in _features(w)]
    d_row, d_col = (np.array([x[j] for x in signed], np.int64) for j in (0, 1))
    d_sign = np.array([x[2] for x in signed])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w, b = np.zeros(len(vocab)), np.array([np.log(share / (1 - share)) - np.log(max(1.0, n / len(y)))])
    m, v, bm, bv = np.zeros_like(w), np.zeros_like(w), np.zeros(1), np.zeros(1)
    for step in range(1, epochs + 1):
        z = np.bincount(row, weights=w[col], minlength=n) + b
        total = np.maximum(np.bincount(owner, weights=_softplus(z), minlength=len(y)), 1e-9)
        g_doc = np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0) / len(y)
        g_z = np.maximum(g_doc, -5)[owner] / (1 + np.exp(-z))
        g = np.bincount(col, weights=g_z[row], minlength=len(w)) + 2 * shrink * w
        if len(d_col):
            gap = np.bincount(d_row, weights=d_sign * w[d_col], minlength=len(delta))
            g += 2 * pull / len(delta) * np.bincount(d_col, weights=d_sign * gap[d_row], minlength=len(w))
        for p, gg, mm, vv in ((w, g, m, v), (b, np.array([g_z.sum()]), bm, bv)):
            mm += 0.1 * (gg - mm)
            vv += 0.02 * (gg * gg - vv)
            p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.98**step)) + 1e-7)
        np.maximum(w, 0, out=w)
    return Model({t: float(w[k]) for t, k in vocab.items() if w[k] > 1e-3}, float(b[0]))


class Scorer:
    """Scores texts; keeps the weights of words that it met."""

    def __init__(self, model: Model, most: int = 100_000):
        self._model, self._most, self._known = model, most, dict.fromkeys(_ENDS)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._model.shift + self._model.slope * self.levels(texts), -40, 40)))

    def levels(self, texts: list[str]) -> np.ndarray:
        """log(exp(e) - 1) of each text; a text without any weight has the level of e = 1e-6."""
        z = np.zeros((len(texts), WORST))
        for k, t in enumerate(texts):
            worst = self._worst(t)
            z[k, : len(worst)] = worst
        e = (_softplus(z + self._model.offset) - _softplus(np.array(self._model.offset))).sum(axis=1)
        e = np.maximum(e, 1e-6)
        return e + np.log(-np.expm1(-e))

    def _worst(self, text: str) -> list[float]:
        """The WORST largest sums of weights of the text's sentences, without repetitions."""
        words = _WORDS.findall(text.lower())
        known, of = self._known, self._model.of
        if len(known) > self._most:
            self._known = known = dict.fromkeys(_ENDS)
        for w in set(words).difference(known):
            known[w] = of(w)
        sums, z, hit = set(), 0.0, set()
        for w in words:
            f = known[w]
            if f is None:
                if hit:
                    sums.add(round(z, 9))
                    z, hit = 0.0, set()
            elif f and w not in hit:
                hit.add(w)
                z += f
        if hit:
            sums.add(round(z, 9))
        return nlargest(WORST, sums)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        texts = batch.column("text")
        out = np.concatenate([scorer.scores([t or "" for t in texts.slice(k, 256).to_pylist()]) for k in range(0, max(1, len(texts)), 256)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])


def _kept(batches: Iterator[pa.RecordBatch], model: Model, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            yield part.filter(pa.array(scorer.scores([t or "" for t in part.column(at).to_pylist()]) < threshold))


def train(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, most: int = 6000) -> Model:
    """The model for labels.toxic, fitted on at most `most` labelled documents (see `labelled_sample` for the bound of their bytes)."""
    return fit(*labelled_sample(docs, labels, "toxic", learnable, most))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (the probability of label 1) of every whole text. Null texts are empty; an empty text scores as one
    sentence without words. Repeated rows are scored each; an empty table gives an empty result; other columns aren't read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(partial(_scored, model=model), "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score under `threshold`, with all their columns. Null texts count as empty; a score equal to the threshold
    goes; repeated rows stay or go together; an empty table gives an empty result."""
    return docs.mapInArrow(partial(_kept, model=model, at=docs.columns.index(text_col), threshold=threshold), docs.schema)
