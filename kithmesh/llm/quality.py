"""Quality classifier (op 8): a byte-level convolutional network in numpy.

The input is the UTF-8 text. Learned filters over WIDTH bytes slide over the whole document; a filter's answer at a
place is a sum of WIDTH table entries, one for each byte. Answers are max-pooled over overlapping chunks (each
of two half chunks, the next one beginning with the second half), the chunks' values combine into a mean and a maximum per filter, and a
logistic layer makes one probability of them. Fitting runs on the driver over a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

WIDTH = 6
HALF = 256
_BLOCK = 1 << 18  # bytes that are scored at once


@dataclass
class Net:
    tables: np.ndarray  # WIDTH x 256 x filters
    bias: np.ndarray  # filters
    dense: np.ndarray  # mean and maximum of each filter
    offset: float

    def pairs(self) -> list[np.ndarray]:
        """The filters as tables over pairs of bytes, 65,536 rows each; the bias is in the first."""
        out = [(self.tables[j][:, None, :] + self.tables[j + 1][None, :, :]).reshape(1 << 16, -1) for j in range(0, WIDTH, 2)]
        out[0] = out[0] + self.bias
        return [np.ascontiguousarray(t, dtype=np.float32) for t in out]


def _laid_out(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after the other, each zero-filled to whole half chunks with room for the last window; and
    how many half chunks each has (1 at least)."""
    halves = np.array([max(1, -(-(len(d) + WIDTH - 1) // HALF)) for d in docs], dtype=np.int64)
    buf = np.zeros(int(halves.sum()) * HALF + WIDTH, dtype=np.uint8)
    at = 0
    for d, n in zip(docs, halves.tolist(), strict=True):
        buf[at : at + len(d)] = np.frombuffer(d, np.uint8)
        at += n * HALF
    return buf, halves


def _answers(buf: np.ndarray, halves: np.ndarray, docs: list[bytes], pairs: list[np.ndarray]) -> np.ndarray:
    """Filters' answers at every place (after ReLU), half chunk by half chunk; 0 beyond a document's end."""
    n = int(halves.sum()) * HALF
    two = (buf[:-1].astype(np.int32) << 8) | buf[1:]
    out = pairs[0].take(two[:n], axis=0)
    for j, t in enumerate(pairs[1:], 1):
        out += t.take(two[2 * j : 2 * j + n], axis=0)
    np.maximum(out, 0, out=out)
    at = 0
    for d, h in zip(docs, halves.tolist(), strict=True):
        out[at + len(d) : at + h * HALF] = 0
        at += h * HALF
    return out.reshape(-1, HALF, out.shape[1])


def _chunks(half: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk values, the first chunk of each document, and for each half chunk whether it is a document's last."""
    first = np.concatenate([[0], np.cumsum(halves)[:-1]])
    last = np.zeros(len(half), dtype=bool)
    last[first + halves - 1] = True
    after = np.where(last[:, None], half, np.roll(half, -1, axis=0))
    return np.maximum(half, after), first, last


def scores(docs: list[bytes], net: Net, pairs: list[np.ndarray] | None = None) -> np.ndarray:
    pairs = pairs or net.pairs()
    out = np.empty(len(docs))
    k = 0
    while k < len(docs):
        stop, size = k, 0
        while stop < len(docs) and (stop == k or size + len(docs[stop]) <= _BLOCK):
            size += len(docs[stop])
            stop += 1
        if stop == k + 1 and size > 4 * _BLOCK:
            features = _long(docs[k], net, pairs)
        else:
            some = docs[k:stop]
            buf, halves = _laid_out(some)
            chunk, first, _ = _chunks(_answers(buf, halves, some, pairs).max(axis=1), halves)
            features = np.concatenate([np.add.reduceat(chunk, first) / halves[:, None], np.maximum.reduceat(chunk, first)], axis=1)
        out[k:stop] = 1 / (1 + np.exp(-np.clip(features.astype(np.float64) @ net.dense + net.offset, -30, 30)))
        k = stop
    return out


def _long(doc: bytes, net: Net, pairs: list[np.ndarray]) -> np.ndarray:
    """Features of one very long document, in pieces that hold whole half chunks, so that memory stays bounded."""
    halves = []
    step = _BLOCK // HALF * HALF
    for at in range(0, len(doc) + WIDTH - 1, step):
        part = doc[at : at + step + WIDTH - 1]
        n = min(step, len(doc) - at + WIDTH - 1)
        count = -(-n // HALF)
        buf = np.zeros(count * HALF + WIDTH, dtype=np.uint8)
        got = np.frombuffer(part, np.uint8)[: len(buf)]
        buf[: len(got)] = got
        inside = [doc[at : at + step]]
        halves.append(_answers(buf, np.array([count]), inside, pairs).max(axis=1))
    half = np.concatenate(halves)
    chunk = np.maximum(half, np.concatenate([half[1:], half[-1:]]))
    return np.concatenate([chunk.mean(axis=0), chunk.max(axis=0)])[None, :]


def fit(docs: list[bytes], labels: np.ndarray, filters: int = 16, epochs: int = 6, batch: int = 32, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Net:
    """Fits the network by Adam on the logistic loss. With one class (or no rows) it gives that class' smoothed share."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    net = Net(rng.normal(0, 0.15, (WIDTH, 256, filters)), np.zeros(filters), rng.normal(0, 0.3, 2 * filters), math.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        net.dense[:] = 0
        return net
    params = [net.tables, net.bias, net.dense, np.array([net.offset])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        speed = rate * (1 - epoch / epochs)
        for b in range(0, len(order), batch):
            some = [docs[i] for i in order[b : b + batch]]
            net.offset = float(params[3][0])
            grads = _gradients(net, some, y[order[b : b + batch]], decay)
            step += 1
            for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p -= speed * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    net.offset = float(params[3][0])
    return net


def _gradients(net: Net, docs: list[bytes], y: np.ndarray, decay: float) -> list[np.ndarray]:
    filters = len(net.bias)
    buf, halves = _laid_out(docs)
    answers = _answers(buf, halves, docs, net.pairs())
    place = answers.argmax(axis=1)
    half = np.take_along_axis(answers, place[:, None, :], axis=1)[:, 0, :]
    chunk, first, last = _chunks(half, halves)
    mean, top = np.add.reduceat(chunk, first) / halves[:, None], np.maximum.reduceat(chunk, first)
    features = np.concatenate([mean, top], axis=1).astype(np.float64)
    z = features @ net.dense + net.offset
    d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    to_features = d[:, None] * net.dense
    doc = np.repeat(np.arange(len(docs)), halves)
    to_chunk = (to_features[:, :filters] / halves[:, None])[doc]
    is_top = chunk == top[doc]
    to_chunk += np.where(is_top, to_features[:, filters:][doc] / np.add.reduceat(is_top.astype(np.float64), first)[doc], 0)
    own = half >= chunk  # a chunk's value comes from its own half, or else from the next one
    to_half = np.where(own, to_chunk, 0)
    to_half[1:] += np.where(~own & ~last[:, None], to_chunk, 0)[:-1]
    to_half[half <= 0] = 0
    rows, cols = np.nonzero(to_half)
    value, at = to_half[rows, cols], rows * HALF + place[rows, cols]
    g_tables = np.empty_like(net.tables)
    for j in range(WIDTH):
        g_tables[j] = np.bincount(buf[at + j].astype(np.int64) * filters + cols, weights=value, minlength=256 * filters).reshape(256, filters)
    g_tables += decay * net.tables
    return [g_tables, np.bincount(cols, weights=value, minlength=filters), d @ features + decay * net.dense, np.array([d.sum()])]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column | None, most: int, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """At most `most` labelled texts and their 0/1 labels, in the order of a hash of the id and as long as they begin within
    `most_bytes` bytes of text: the bound of what reaches the driver. Rows with a null id or label, or outside `learnable`, aren't learned from."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    if learnable is not None:
        known = known.withColumnRenamed("_id", id_col).where(learnable).withColumnRenamed(id_col, "_id")
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    some = rows.join(F.broadcast(known), "_id").select("_text", "_y", F.xxhash64("_id").alias("_h")).orderBy("_h", "_text").limit(most)
    upto = F.sum(F.octet_length("_text")).over(Window.orderBy("_h", "_text", "_y").rowsBetween(Window.unboundedPreceding, -1))  # of `most` rows
    got = some.withColumn("_upto", F.coalesce(upto, F.lit(0))).where(F.col("_upto") < most_bytes).orderBy("_h", "_text", "_y").select("_text", "_y").collect()
    return [r["_text"] for r in got], np.array([r["_y"] for r in got], dtype=np.float64)


def _scored(batches: Iterator[pa.RecordBatch], net: Net) -> Iterator[pa.RecordBatch]:
    pairs = net.pairs()
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        out = np.empty(batch.num_rows)
        for at in range(0, batch.num_rows, 256):
            some = [(t or "").encode() for t in texts.slice(at, 256).to_pylist()]
            out[at : at + len(some)] = scores(some, net, pairs)
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(out)], names=[*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (the probability of label 1) of every whole text. Null texts are empty; an empty text gets
    the score of a document in which no filter answers. Repeated rows are scored each; an empty table gives an empty result; other columns aren't read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(partial(_scored, net=net), "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, most: int = 3000) -> Net:
    """The network for labels.quality, fitted on at most `most` labelled documents."""
    texts, y = labelled_sample(docs, labels, "quality", learnable, most)
    return fit([t.encode() for t in texts], y)


def keep(docs: DataFrame, net: Net, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score at least `threshold`, with all their columns. Null texts count as empty; a score equal to the threshold
    stays; repeated rows stay or go together; an empty table gives an empty result."""
    schema = docs.schema
    at = docs.columns.index(text_col)
    return docs.mapInArrow(partial(_kept, net=net, at=at, threshold=threshold), schema)


def _kept(batches: Iterator[pa.RecordBatch], net: Net, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    pairs = net.pairs()
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            s = scores([(t or "").encode() for t in part.column(at).to_pylist()], net, pairs)
            yield part.filter(pa.array(s >= threshold))
