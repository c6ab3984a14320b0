"""Hard-negative mining by a Voronoi-partitioned distributed nearest-neighbour join (op 12).

Rows are points (x, sqrt(M^2 - |x|^2)), M being the largest norm, and anchors (q M/|q|, 0), so that a score |q| (2 M^2 - d^2) / (2 M) falls with the
distance d. Pivots from a bounded sample divide the space; an anchor belongs to the cell of its nearest pivot. A bounded sample, scored by every anchor, says
which distances matter to it at least; the triangle inequality turns them into an interval of distances from the cell's pivot, and a
row is sent to the cells whose interval its own distance lies in, and to no other: nothing that it could serve is left out. Anchors and rows of a cell then meet in
blocks of bounded size, whose scores are exact.

Two such joins follow one another: the first finds each anchor's positives (same label, distances up to that of the last one), the second the negatives
(other labels, distances between those of its score bands). Rows of equal label and vector are one point, which stands for its
smallest ids, so a hot vector is scored once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, staged

_SLACK = 1e-6  # share of M by which intervals are widened, for rounding
_FEW = 200_000  # rows of a broadcast table


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of `dim` numbers; shorter ones end with zeros."""
    flat = np.asarray(col.flatten(), dtype=np.float64)
    if len(flat) == len(col) * dim:
        return flat.reshape(-1, dim)
    sizes = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), dim))
    row = np.repeat(np.arange(len(col)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class _Space:
    """Pivots and a sample, as every task holds them: `pivots` in the lifted space; `sample` vectors with their labels."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, most: float, pivots: int, seed: int = 7):
        self.sample, self.labels, self.most, self.dim = sample, labels, most, sample.shape[1]
        lifted = self.lifted(sample)
        rng = np.random.default_rng(seed)
        chosen = lifted[rng.choice(len(lifted), min(pivots, len(lifted)), replace=False)]
        for _ in range(4):
            nearest = self._squares(lifted, chosen).argmin(axis=1)
            size = np.bincount(nearest, minlength=len(chosen))
            sums = np.zeros_like(chosen)
            np.add.at(sums, nearest, lifted)
            chosen = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], chosen)
        self.pivots = chosen

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.most**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)

    def aimed(self, q: np.ndarray) -> np.ndarray:
        norm = np.sqrt((q**2).sum(axis=1))
        return np.concatenate([q * (self.most / np.where(norm > 0, norm, 1))[:, None], np.zeros((len(q), 1))], axis=1)

    @staticmethod
    def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T

    def distances(self, a: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self._squares(a, self.pivots), 0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of rows with this score from each anchor; all distances for a zero anchor, whose scores are all 0."""
        norm = np.sqrt((q**2).sum(axis=1))
        square = 2 * self.most**2 - 2 * self.most * score / np.where(norm > 0, norm, 1)
        return np.sqrt(np.clip(np.where(norm > 0, square, np.inf if self.most else 0), 0, None))


def _blocks(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _positive_reach(batches: Iterator[pa.RecordBatch], space: _Space, k: int) -> Iterator[pa.RecordBatch]:
    """The cell of each anchor, and the interval of distances from its pivot in which the k best rows of its label lie."""
    for batch in batches:
        for some in _blocks(batch):
            q = _matrix(some.column("v"), space.dim)
            scores = np.where(np.asarray(some.column("label"))[:, None] == space.labels, q @ space.sample.T, -np.inf)
            bound = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
            far = space.reach(q, bound)
            yield _placed(some, space, q, np.zeros(len(q)), far, ["p", "label", "v"])


def _negative_reach(batches: Iterator[pa.RecordBatch], space: _Space, k: int, low: float, high: float) -> Iterator[pa.RecordBatch]:
    """The cell of each anchor, and the interval of distances from its pivot in which the k best rows of each of its bands lie.
    Anchors without a band that can hold rows are left out."""
    for batch in batches:
        for some in _blocks(batch):
            q, labels = _matrix(some.column("v"), space.dim), np.asarray(some.column("label"))
            found = some.column("bands")
            bands = [np.array([x for x in found[i].as_py() if x >= 0]) for i in range(len(q))]
            scores = np.where(labels[:, None] != space.labels, q @ space.sample.T, -np.inf)
            least, top = np.zeros(len(q)), np.zeros(len(q))
            for i, p in enumerate(bands):
                if len(p):
                    ordered = np.sort(scores[i])
                    # The k-th best of the sample that is not above the band bounds what the band needs, if it isn't below it.
                    at = np.searchsorted(ordered, high * p / 100, side="right") - k
                    kth = np.where(at >= 0, ordered[np.maximum(at, 0)], -np.inf)
                    least[i], top[i] = np.maximum(kth, low * p / 100).min(), (high * p / 100).max()
            keep = np.flatnonzero([len(p) > 0 for p in bands])
            some, q, least, top = some.take(pa.array(keep)), q[keep], least[keep], top[keep]
            near = np.where((q**2).sum(axis=1) > 0, space.reach(q, top), 0)
            yield _placed(some, space, q, near, space.reach(q, least), ["p", "label", "v", "bands"])


def _placed(some: pa.RecordBatch, space: _Space, q: np.ndarray, near: np.ndarray, far: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    d = space.distances(space.aimed(q)) if len(q) else np.zeros((0, len(space.pivots)))
    cell = d.argmin(axis=1)
    own = d[np.arange(len(q)), cell]
    slack = _SLACK * max(space.most, 1e-300)
    low, high = np.maximum(np.maximum(own - far, near - own), 0) - slack, own + far + slack
    return pa.RecordBatch.from_arrays([*[some.column(c) for c in columns], pa.array(cell.astype(np.int32)), pa.array(low), pa.array(high)], names=[*columns, "cell", "low", "high"])


def _sent(batches: Iterator[pa.RecordBatch], space: _Space, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row once for every cell whose interval holds its distance from the pivot."""
    for batch in batches:
        for some in _blocks(batch, 4096):
            d = space.distances(space.lifted(_matrix(some.column("v"), space.dim)))[:, cells]
            row, col = np.nonzero((d >= low) & (d <= high))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cells[col].astype(np.int32)), *[some.column(c).take(take) for c in ("p", "first", "label", "v")]], names=["cell", "p", "first", "label", "v"])


def _ranked(rows: pa.Table, anchors: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points and first ids of the rows, by first id, their labels, and the scores of each anchor."""
    rows = rows.combine_chunks().sort_by("first")
    whole = lambda t, c: _matrix(t.column(c).combine_chunks(), dim)
    return rows.column("p").to_numpy(), rows.column("first").to_numpy(), rows.column("label").to_numpy(), whole(anchors, "v") @ whole(rows, "v").T


_HITS = pa.schema([("anchor", pa.int64()), ("band", pa.float64()), ("p", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])


def _best(anchors: np.ndarray, bands: np.ndarray, points: np.ndarray, first: np.ndarray, scores: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x) for x in (anchors, bands, points, first, scores)], schema=_HITS)


def _positives(key: tuple, rows: pa.Table, anchors: pa.Table, dim: int, k: int) -> pa.Table:
    """The k best rows of each anchor in one block; all are of its label."""
    if not len(rows) or not len(anchors):
        return _HITS.empty_table()
    points, first, _, scores = _ranked(rows, anchors, dim)
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    asked = np.repeat(anchors.column("p").to_numpy(), top.shape[1])
    return _best(asked, np.zeros(len(asked)), points[top].ravel(), first[top].ravel(), np.take_along_axis(scores, top, axis=1).ravel())


def _negatives(key: tuple, rows: pa.Table, anchors: pa.Table, dim: int, k: int, low: float, high: float) -> pa.Table:
    """The k best rows of another label in each band of each anchor in one block."""
    if not len(rows) or not len(anchors):
        return _HITS.empty_table()
    points, first, labels, scores = _ranked(rows, anchors, dim)
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    own, names, bands = anchors.column("label").to_numpy(), anchors.column("p").to_numpy(), anchors.column("bands").to_pylist()
    for i in range(len(anchors)):
        other = np.flatnonzero(labels != own[i])
        s = scores[i, other]
        order = np.argsort(-s, kind="stable")
        s, other = s[order], other[order]
        for p in sorted({x for x in bands[i] if x >= 0}):
            a = int(np.searchsorted(-s, -high * p / 100, side="left"))
            # Bounds are compared by the products themselves, which are exact for whole scores.
            while a > 0 and 100 * s[a - 1] <= high * p:
                a -= 1
            while a < len(s) and 100 * s[a] > high * p:
                a += 1
            at = np.arange(a, min(a + k, len(s)))
            at = at[100 * s[at] >= low * p]
            for column, value in zip(out, (np.full(len(at), names[i]), np.full(len(at), p, dtype=np.float64), points[other[at]], first[other[at]], s[at]), strict=True):
                column.append(value)
    return _best(*[np.concatenate(c) if c else np.empty(0) for c in out]) if out[0] else _HITS.empty_table()


def _few(df: DataFrame, rows: int = _FEW) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _joined(points: DataFrame, anchors: DataFrame, space: _Space, same_label: bool, block: Callable, n: int, part_rows: int, anchor_rows: int, scratch: Scratch) -> DataFrame:
    """anchor, band, p, first, score from the blocks in which rows and anchors (staged, with cell, low and high) meet; `block` scores one.
    n: the number of points."""
    spans = anchors.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # at most a row for each pivot
    if not spans:
        return anchors.sparkSession.createDataFrame([], "anchor long, band double, p long, first long, score double")
    cells, low, high = (np.array([r[c] for r in spans]) for c in ("cell", "low", "high"))
    sent = points.select("p", F.col("ids")[0].alias("first"), "label", "v").mapInArrow(partial(_sent, space=space, cells=cells, low=low, high=high), "cell int, p long, first long, label long, v array<double>")
    # Rows of a cell (and label) are dealt over so many parts, and its anchors over so many sets, that a block is bounded.
    kind = F.col("label") if same_label else F.lit(0).cast("long")
    plan = anchors.groupBy("cell", kind.alias("kind")).agg(F.ceil(F.count(F.lit(1)) / anchor_rows).alias("sets"))
    if same_label:
        plan = plan.join(points.groupBy(F.col("label").alias("kind")).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts")), "kind")
    else:
        plan = plan.withColumn("parts", F.lit(-(-n // part_rows)).cast("long"))
    plan = _few(scratch(plan, "blocks"))
    keys = ["cell", "kind", "set", "part"]
    deal = lambda n: F.pmod(F.xxhash64("p"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = sent.withColumn("kind", kind).join(plan, ["cell", "kind"]).withColumn("part", deal("parts")).select("cell", "kind", "part", "p", "first", "label", "v", each("sets").alias("set"))
    asked = anchors.withColumn("kind", kind).join(plan, ["cell", "kind"]).withColumn("set", deal("sets")).select("cell", "kind", "set", *[c for c in anchors.columns if c not in ("cell", "low", "high")], each("parts").alias("part"))
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(block, "anchor long, band double, p long, first long, score double")


def _merged(hits: DataFrame, points: DataFrame, k: int, parts: int) -> DataFrame:
    """anchor, band and top [(s: negated score, id)], the k best ids, of hits from `parts` blocks."""
    first = lambda c: F.slice(F.array_sort(c), 1, k)
    hit = hits.withColumn("hit", F.struct((-F.col("score")).alias("s"), F.col("first"), F.col("p")))
    salted = hit.groupBy("anchor", "band", F.pmod(F.xxhash64("p"), F.lit(max(1, parts // 64))).alias("salt")).agg(first(F.collect_list("hit")).alias("hit"))
    best = salted.groupBy("anchor", "band").agg(first(F.flatten(F.collect_list("hit"))).alias("hit")).select("anchor", "band", F.explode("hit").alias("hit"))
    ids = best.select("anchor", "band", F.col("hit.p").alias("p"), F.col("hit.s").alias("s")).join(points.select("p", "ids"), "p")
    return ids.groupBy("anchor", "band").agg(first(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("s"), i.alias("id")))))).alias("top"))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    sample: int = 2_048,
    most_pivots: int = 1_024,
    cell_anchors: int = 1_024,
    part_rows: int = 4_096,
    anchor_rows: int = 1_024,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score (doubles), exactly.

    An anchor's positives are its first `positives` other rows of the same label by inner product, ties to the smaller id. For each, the first `negatives`
    rows of another label whose score lies between `low` and `high` hundredths of the positive's; none if that is negative.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different length are compared as if the
    shorter ended with zeros. Rows that share id, label and vector are one row; anchors are given once for each such row. Fewer rows than asked for, or
    none, are given where there are no more. An empty table gives an empty result; other columns aren't read. Scores are exact if the
    products and sums of components are, as for whole numbers below 2^53.

    `sample` bounds the vectors from which pivots and first bounds come, `most_pivots` the pivots; neither changes the result. A block holds about `part_rows`
    rows and `anchor_rows` anchors.
    """
    spark, keep = vectors.sparkSession, max(positives + 1, negatives)
    vector = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # -0.0 is 0.0, or equal vectors would be two points.
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, keep)
    # Each salt of a hot vector keeps its smallest ids, then all salts together do.
    some = rows.groupBy("label", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(least(F.collect_list("id")).alias("ids"), F.max("asks").alias("asks"))
    made = some.groupBy("label", "v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("asks").alias("asks"))
    # Written before it is read, so a point keeps its number whatever is computed again.
    scratch = Scratch()
    points = staged(made.withColumn("p", F.monotonically_increasing_id()).select("p", "label", "ids", "asks", "v"), "points")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"), F.sqrt(F.max(norm)).alias("most"), F.max(F.size("v")).alias("dim")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double"
    if not facts["asks"]:
        return spark.createDataFrame([], out)
    dim, parts = max(1, facts["dim"]), -(-facts["n"] // part_rows)
    drawn = points.orderBy(F.xxhash64("p"), "p").select("label", "v").limit(sample).collect()
    x = np.zeros((len(drawn), dim))
    for i, r in enumerate(drawn):
        x[i, : len(r["v"])] = r["v"]
    space = _Space(x, np.array([r["label"] for r in drawn]), facts["most"], int(min(most_pivots, -(-facts["asks"] // cell_anchors))))

    placed = "p long, label long, v array<double>, cell int, low double, high double"
    anchors = scratch(points.where("asks").select("p", "label", "v").mapInArrow(partial(_positive_reach, space=space, k=positives + 1), placed), "anchors")
    hits = _joined(points, anchors, space, True, partial(_positives, dim=dim, k=positives + 1), facts["n"], part_rows, anchor_rows, scratch)
    near = staged(_merged(hits, points, positives + 1, parts).select("anchor", "top"), "positives")

    bands = near.select(F.col("anchor").alias("p"), F.array_distinct(F.transform("top", lambda t: -t["s"])).alias("bands"))
    placed = "p long, label long, v array<double>, bands array<double>, cell int, low double, high double"
    second = points.where("asks").select("p", "label", "v").join(bands, "p").mapInArrow(partial(_negative_reach, space=space, k=negatives, low=low, high=high), placed)
    hits = _joined(points, scratch(second, "banded"), space, False, partial(_negatives, dim=dim, k=negatives, low=low, high=high), facts["n"], part_rows, anchor_rows, scratch)
    found = staged(_merged(hits, points, negatives, parts).groupBy("anchor").agg(F.collect_list(F.struct("band", "top")).alias("found")), "negatives")
    scratch.clear()

    both = near.join(found, "anchor").withColumnRenamed("anchor", "p")
    asking = rows.where("asks").select("id", "label", "v").join(points.where("asks").select("p", "label", "v"), ["label", "v"]).select("id", "p").distinct()
    own = asking.join(both, "p").select(F.col("id").alias("anchor_id"), F.explode(F.slice(F.filter("top", lambda t: t["id"] != F.col("id")), 1, positives)).alias("t"), "found")
    # A band is the positive's score itself, so bands are found by equality.
    own = own.select("anchor_id", F.col("t.id").alias("positive_id"), (-F.col("t.s")).alias("positive_score"), F.get(F.filter("found", lambda f: f["band"] == -F.col("t.s")), F.lit(0))["top"].alias("top"))
    each = own.select("anchor_id", "positive_id", "positive_score", F.posexplode("top").alias("rank", "hit"))
    return each.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("negative_id"), "positive_score", (-F.col("hit.s")).alias("negative_score"))
