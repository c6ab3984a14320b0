"""Token ids in a grammar-compressed binary file (op 10): Re-Pair, one grammar per shard.

File format (little-endian): magic `KMRP1\\0\\0\\0`, then int64: first nonterminal, number of rules, of symbols, of ids,
of documents; then per rule two uint32 (left, right) and a uint32 expansion length; per symbol a uint32; per document an int64 id (with
a uint8 that tells whether it is null) and an int64 end, counted in ids. A symbol below the first nonterminal is a token id.
Expansion lengths find the symbols that cover any range of ids, so a document is decoded without the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, text_of
from .tokens import blocks, pieces

MAGIC = b"KMRP1\0\0\0"
SHARD = "part int, seq int, n_docs long, n_ids long, payload binary"
MEAN_BYTES = 2.5  # of text for an id, about; only the number of tasks depends on it
DOCS = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def compress(ids: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules, first nonterminal): in each round the pairs that occur at least `least` times without overlap are
    replaced by new symbols, the more frequent one where two of them overlap. Ends when no such pair is left.

    Counts are exact. Symbols are a linked list over the places of `ids`, and a round looks only at places whose pair may be
    frequent: a pair that was too rare once stays so, as only pairs with a new symbol get more frequent."""
    seq = np.array(ids, dtype=np.uint32)
    n, first = len(seq), int(seq.max(initial=0)) + 1
    free, rules, salt = first, [], 0
    after, before = np.arange(1, n + 1), np.arange(-1, n)  # n: the end; -1: the start, or a place whose symbol is gone
    at = np.arange(max(n - 1, 0))
    while len(at) >= least:
        salt += 1
        follow = after.take(at) if rules else after[:-1]
        key = (seq.take(at) if rules else seq[:-1]).astype(np.uint64)
        key <<= np.uint64(32)
        key |= seq.take(follow) if rules else seq[1:]
        bits = min(20, len(at).bit_length())
        slot = _slots(key, salt, bits)
        often = np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= least).take(slot))
        at, key, follow = at.take(often), key.take(often), follow.take(often)
        beside = follow[:-1] == at[1:]
        odd = _odd(np.flatnonzero(beside & (key[1:] == key[:-1])))
        counted = np.delete(key, odd)
        counted.sort()
        edge = np.flatnonzero(np.concatenate([[True], counted[1:] != counted[:-1], [True]]))
        count = np.diff(edge)
        frequent = count >= least
        if not len(counted) or not frequent.any():
            break
        pair, count = counted[edge[:-1][frequent]], count[frequent]
        which = _places(key, pair, salt)
        rank = np.empty(len(pair) + 1, dtype=np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(pair) + 1, dtype=np.int32)
        rank[-1] = 0  # for `which` -1: too rare
        rank = rank.take(which, mode="wrap")
        take = rank > 0
        take[odd] = False
        chosen = _apart(rank, take, beside)
        of = which.take(chosen)
        worth = np.bincount(of, minlength=len(pair)) >= least
        kept = worth.take(of)
        chosen, of = chosen[kept], of[kept]
        got = pair[worth]
        rules.append(np.stack([(got >> np.uint64(32)).astype(np.uint32), got.astype(np.uint32)], axis=1))
        left, right = at.take(chosen), follow.take(chosen)
        then = after.take(right)
        seq[left] = (free + np.cumsum(worth) - 1).astype(np.uint32).take(of)
        free += len(got)
        after[left], before[then], after[right] = then, left, -1
        # The pairs with a new symbol are at `left` and before it.
        at = np.concatenate([at[rank > 0], before.take(left)])
        at.sort(kind="stable")
        follow = after.take(at)
        at = at[(follow >= 0) & (follow < n) & (at >= 0) & np.concatenate([[True], at[1:] != at[:-1]])]
    return seq[after >= 0], np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), first


def _odd(same: np.ndarray) -> np.ndarray:
    """same: places (ascending) that have the same pair as the next one, which overlaps it. Of each run of such places, the second,
    the fourth and so on."""
    k = np.arange(len(same))
    start = np.ones(len(same), dtype=bool)
    start[1:] = same[1:] != same[:-1] + 1
    return same[(k - np.maximum.accumulate(np.where(start, k, 0))) % 2 == 0] + 1


def _slots(key: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15 * (2 * salt + 1) & (1 << 64) - 1)) >> np.uint64(64 - bits)).view(np.int64)


def _places(key: np.ndarray, pair: np.ndarray, salt: int) -> np.ndarray:
    """The place of each key in `pair` (ascending), or -1: by a hash table with one pair a slot, and a search for the pairs that lost theirs."""
    bits = max(8, len(pair).bit_length() + 2)
    table = np.full(1 << bits, -1, dtype=np.int32)
    own, slot = _slots(pair, salt, bits), _slots(key, salt, bits)
    table[own] = np.arange(len(pair), dtype=np.int32)
    out = table[slot]
    out[pair[out] != key] = -1
    lost = np.flatnonzero(table[own] != np.arange(len(pair)))
    if len(lost):
        shared = np.zeros(1 << bits, dtype=bool)
        shared[own[lost]] = True
        again = np.flatnonzero(shared[slot] & (out < 0))
        at = np.minimum(np.searchsorted(pair[lost], key[again]), len(lost) - 1)
        found = pair[lost[at]] == key[again]
        out[again[found]] = lost[at[found]]
    return out


def _apart(rank: np.ndarray, take: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Places of pairs to replace, of which no two overlap: of those to take, a pair gives way to one beside it of higher rank;
    the highest rank keeps all its places."""
    up = rank[1:] > rank[:-1]
    same = rank[1:] == rank[:-1]
    take = take.copy()
    take[1:] &= ~(beside & ~up & ~same)
    take[:-1] &= ~(beside & up)
    return np.flatnonzero(take)


def _layers(rules: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of rules that don't use each other; a rule only uses symbols that are older than it."""
    newest = rules.astype(np.int64).max(axis=1, initial=0) - first
    done = 0
    while done < len(rules):
        inside = newest[done:] >= done
        stop = done + int(np.argmax(inside)) if inside.any() else len(rules)
        yield done, stop
        done = stop


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each nonterminal stands for."""
    out = np.ones(len(rules), dtype=np.int64)
    at = rules.astype(np.int64) - first
    for done, stop in _layers(rules, first):
        part = at[done:stop]
        out[done:stop] = np.where(part < 0, 1, out[np.maximum(part, 0)]).sum(axis=1)
    return out


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), then those of start[1], and so on."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Grammar:
    """Rules with each nonterminal's ids written out, so that symbols are expanded by one gather."""

    def __init__(self, rules: np.ndarray, first: int):
        self.first, self.size = first, lengths(rules, first)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.empty(int(self.size.sum()), dtype=np.uint32)
        for done, stop in _layers(rules, first):
            self.flat[int(self.start[done]) : int(self.start[done] + self.size[done:stop].sum())] = self.expand(rules[done:stop].ravel())

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        of = symbols.astype(np.int64) - self.first
        if not len(self.size):
            return symbols.astype(np.uint32)
        size = np.where(of < 0, 1, self.size[np.maximum(of, 0)])
        out = self.flat[np.minimum(_ragged(np.where(of < 0, 0, self.start[np.maximum(of, 0)]), size), max(len(self.flat) - 1, 0))]
        ends = np.cumsum(size)
        out[ends[of < 0] - 1] = symbols[of < 0]
        return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that the symbols stand for."""
    return Grammar(rules, first).expand(symbols)


def descend(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first: int, start: int, stop: int) -> np.ndarray:
    """The ids start to stop - 1 of what the symbols stand for, through the rules of these symbols alone: level by level each
    nonterminal is replaced by its two symbols, and symbols outside the range are let go."""
    symbols = symbols.astype(np.int64)
    while True:
        size = np.where(symbols < first, 1, sizes[np.maximum(symbols - first, 0)]) if len(sizes) else np.ones(len(symbols), np.int64)
        ends = np.cumsum(size)
        inside = np.flatnonzero((ends > start) & (ends - size < stop))
        if not len(inside):
            return np.empty(0, np.uint32)
        before = int(ends[inside[0]] - size[inside[0]])
        symbols, start, stop = symbols[inside], start - before, stop - before
        inner = symbols >= first
        if not inner.any():
            return symbols[start:stop].astype(np.uint32)
        out = np.repeat(symbols, np.where(inner, 2, 1))
        at = (np.cumsum(np.where(inner, 2, 1)) - np.where(inner, 2, 1))[inner]
        out[at], out[at + 1] = rules[symbols[inner] - first].T
        symbols = out


def write_shard(docs: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: docs are the documents' ids (or None), ends where each ends in `ids`."""
    symbols, rules, first = compress(ids)
    head = np.array([first, len(rules), len(symbols), len(ids), len(docs)], dtype="<i8").tobytes()
    null = np.array([d is None for d in docs], dtype=np.uint8).tobytes()
    keys = np.array([0 if d is None else d for d in docs], dtype="<i8").tobytes()
    sizes = lengths(rules, first).astype("<u4").tobytes()
    return b"".join([MAGIC, head, rules.astype("<u4").tobytes(), sizes, symbols.astype("<u4").tobytes(), null, keys, np.asarray(ends, dtype="<i8").tobytes()])


class Shard:
    """A file as written: `doc(k)` and `ids(start, stop)` decode only what they need, `all()` everything."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a grammar file of token ids")
        self.first, n_rules, n_symbols, self.n_ids, n_docs = np.frombuffer(payload, "<i8", 5, 8).tolist()
        at = 48

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.sizes, self.symbols = take("<u4", n_rules).astype(np.int64), take("<u4", n_symbols)
        null, keys, self.ends = take("u1", n_docs), take("<i8", n_docs), take("<i8", n_docs)
        self.docs = [None if x else k for x, k in zip(null.tolist(), keys.tolist(), strict=True)]
        of = self.symbols.astype(np.int64) - self.first
        self.after = np.cumsum(np.where(of < 0, 1, self.sizes[np.maximum(of, 0)] if n_rules else 1))

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(self.after, [start, stop - 1], side="right")
        before = int(self.after[a - 1]) if a else 0
        return descend(self.symbols[a : b + 1], self.rules, self.sizes, self.first, start - before, stop - before)

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.first)


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq, end = TaskContext.get().partitionId(), 0, int(end_id).to_bytes(4, "little")
    docs: list = []
    raws: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal docs, raws, held, seq
        ends = np.cumsum([len(r) // 4 for r in raws])
        payload = write_shard(docs, ends, np.frombuffer(b"".join(raws), "<u4"))
        row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(docs), "n_ids": held, "payload": payload}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))
        docs, raws, held, seq = [], [], 0, seq + 1
        return row

    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, some in blocks(texts):
            for doc, raw in zip(keys[at : at + len(some)], pieces(tokenizer).encode(some), strict=True):
                docs.append(doc)
                raws.append(raw + end)
                held += len(raw) // 4 + 1
                if held >= shard_ids:
                    yield flush()
    if docs:
        yield flush()


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, shard_ids: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents in ascending id order; returns the table of shard files as it is read again:
    part, seq (their order is that of the documents), n_docs, n_ids, payload.

    Each document is its ids and `end_id`; null or empty texts are the end id alone. Null ids come first; rows with
    equal ids are ordered by their text. An empty table writes no shard. Other columns aren't read. A shard closes at the first document
    that brings it to `shard_ids` ids. The table is committed by Spark, so a lost executor leaves no half-written file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(4)), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, int(size / (8 * MEAN_BYTES * shard_ids)) + 1)  # about eight shards each
    sorted_rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    files = sorted_rows.mapInArrow(partial(_write, tokenizer=tokenizer, end_id=end_id, shard_ids=shard_ids), SHARD)
    if path is None:
        return staged(files, "grammar")
    files.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["payload"])
            raw, n = shard.all().astype("<u4").tobytes(), len(shard.docs)
            ends = shard.ends.tolist()
            starts = [0, *ends[:-1]]
            middle = n // 2
            if n and shard.doc(middle).astype("<u4").tobytes() != raw[4 * starts[middle] : 4 * ends[middle]]:
                raise ValueError("a document read alone differs from the whole file")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["seq"]] * n, pa.int32()),
                    pa.array(shard.docs, pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                    pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)], pa.int64()),
                ],
                names=["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from the shard files: doc_id, start (ids of all documents before it), n_tokens
    (with the end id), ids_crc32."""
    by_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = by_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("a"))
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("b")).join(before_part, "part").select("part", "seq", (F.col("a") + F.col("b")).alias("before"))
    docs = shards.select("part", "seq", "payload").mapInArrow(_read, DOCS)
    return docs.join(offsets, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local_start")).cast("long").alias("start"), "n_tokens", "ids_crc32")
