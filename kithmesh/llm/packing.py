"""Best-fit packing with large-item matching (op 9).

Pieces over a third of the capacity go at most two to a bin: each, longest first, with the longest that still fits.
Smaller pieces, longest first, go to the open bin with the smallest gap that takes them. Which piece of a length goes
where doesn't matter, so the plan is made from the number of pieces of each length alone: at most `capacity` numbers,
whatever the size of the corpus. It is a list of runs; pieces take their places in the runs of their length by rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, staged, text_of
from .tokens import blocks, pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first bin, offset): pieces of `length` with ranks from `first rank` on go one
    each into the bins from `first bin` on, at `offset`. counts: pieces of each length, lengths 1 to capacity."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("lengths lie between 1 and the capacity")
    taken: dict[int, int] = dict.fromkeys(left, 0)
    runs, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, number)
    order: list[int] = []  # gaps that have bins, ascending

    def put(length: int, number: int, first: int, offset: int) -> None:
        runs.append((length, taken[length], number, first, offset))
        taken[length] += number
        left[length] -= number

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, number))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect_left(large, min(n, capacity - n) + 1) - 1
            while k >= 0 and (left[large[k]] == 0 or large[k] == n and left[n] < 2):
                k -= 1
            if k < 0:
                number, gap = left[n], capacity - n
                put(n, number, bins, 0)
            else:
                mate = large[k]
                number = left[n] // 2 if mate == n else min(left[n], left[mate])
                gap = capacity - n - mate
                put(n, number, bins, 0)
                put(mate, number, bins, n)
            leave(gap, bins, number)
            bins += number
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(order, n)
            if k == len(order):
                fresh = -(-left[n] // (capacity // n))
                leave(capacity, bins, fresh)
                bins += fresh
                continue
            gap = order[k]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            each = min(gap // n, left[n])
            full = min(number, left[n] // each)
            for j in range(each):
                put(n, full, first, capacity - gap + j * n)
            leave(gap - each * n, first, full)
            leave(gap, first + full, number - full)
    return runs


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    end = int(end_id).to_bytes(4, "little")
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, some in blocks(texts):
            rows: list = []
            for doc, raw in zip(ids[at : at + len(some)], pieces(tokenizer).encode(some), strict=True):
                raw += end
                for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[start : start + 4 * capacity]
                    rows.append((doc, k, start // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def _placed(batches: Iterator[pa.RecordBatch], capacity: int, runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    wide = np.int64(1) << 48  # ranks stay below
    keys = runs[:, 0] * wide + runs[:, 1]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        length, rank = (batch.column(k).to_numpy() for k in ("length", "_rank"))
        run = runs[np.searchsorted(keys, length * wide + rank, side="right") - 1]
        out = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
        out += [pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then `end_id`; longer ones than `capacity` are cut. A null or empty text is the end
    id alone; repeated rows are packed each; null ids are kept; an empty table gives an empty result; other columns
    aren't read. Pieces that tie in length are placed in the order of hash bucket, doc_id and piece.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    cut = staged(rows.mapInArrow(partial(_pieces, tokenizer=tokenizer, capacity=capacity, end_id=end_id), PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(sorted(plan(counts, capacity)) or [(0, 0, 0, 0, 0)], dtype=np.int64)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(256)).cast("int")
    ranked = gapless_rank(cut, ["length"], bucket, [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], "_rank")
    return ranked.mapInArrow(partial(_placed, capacity=capacity, runs=runs), PIECES + ", sequence_id long, offset long")
