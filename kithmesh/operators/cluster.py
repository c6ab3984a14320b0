"""Principal components, nearest-neighbour distances, knees, density clustering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithmesh.operators.graph import components
from kithmesh.operators.neighbours import kth_distance
from kithmesh.operators.staging import cut, ranked


@dataclass
class Components:
    """scores: entity, pc1..pck; loadings: feature, pc1..pck; shares: pc, share of the variance; and the last two as arrays."""

    scores: DataFrame
    loadings: DataFrame
    shares: DataFrame
    load: np.ndarray
    share: np.ndarray


def _summed(batches: Iterator[pa.RecordBatch], mean: np.ndarray | None, d: int) -> Iterator[pa.RecordBatch]:
    """Of one task's vectors: their sum and number, or the products of their deviations from the mean, as (a, b, s) for a <= b."""
    n, total = 0, np.zeros(d) if mean is None else np.zeros((d, d))
    for batch in batches:
        x = np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(-1, d)
        n += len(x)
        total += x.sum(axis=0) if mean is None else (x - mean).T @ (x - mean)
    a, b = (np.arange(d + 1), np.zeros(d + 1)) if mean is None else np.triu_indices(d)
    s = np.append(total, n) if mean is None else total[a, b]
    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(s)], names=["a", "b", "s"])


def principal(vectors: DataFrame, k: int = 2, id_col: str = "entity", vector_col: str = "vector") -> Components:
    """The first k principal components, centred and not scaled. Each task sums the products of its own vectors, Spark adds the sums of the tasks, and
    d x d numbers reach the driver. A component's largest loading is positive. Features (places in the vector) without variance have no loading.
    Vectors that are null, of another length than the longest, or hold a null or non-finite number take no part; with fewer than two, an error."""
    v = vectors.select(F.col(id_col).alias("entity"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    d = v.agg(F.max(F.size("v"))).first()[0] or 0
    v = v.where(F.size("v") == d)
    added = lambda mean: v.select("v").mapInArrow(partial(_summed, mean=mean, d=d), "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect()
    first = np.zeros(d + 1)
    for r in added(None) if d else []:
        first[r["a"]] = r["s"]
    n = first[-1]
    if n < 2:
        raise ValueError("components need two vectors at least")
    mean, cov = first[:-1] / n, np.zeros((d, d))
    for r in added(mean):
        cov[r["a"], r["b"]] = cov[r["b"], r["a"]] = r["s"] / (n - 1)
    value, vec = np.linalg.eigh(cov)
    order = np.argsort(-value)[:k]
    load = vec[:, order]
    load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])
    share = value[order] / value.sum() if value.sum() > 0 else np.zeros(len(order))
    names, spark = [f"pc{j + 1}" for j in range(load.shape[1])], vectors.sparkSession
    dot = lambda j: F.aggregate(F.zip_with("v", F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(m)).alias("m")) for x, m in zip(load[:, j], mean, strict=True)]), lambda x, y: (x - y["m"]) * y["x"]), F.lit(0.0), lambda a, x: a + x)
    scores = v.select("entity", *[dot(j).alias(c) for j, c in enumerate(names)])
    rows = [(int(i), *map(float, load[i])) for i in np.flatnonzero(np.diag(cov) > 0)]
    loadings = spark.createDataFrame(rows, "feature long, " + ", ".join(f"{c} double" for c in names))
    return Components(scores, loadings, spark.createDataFrame([(c, float(x)) for c, x in zip(names, share, strict=True)], "pc string, share double"), load, share)


def pca(vectors: DataFrame, k: int = 2, id_col: str = "entity", vector_col: str = "vector") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(scores entity, pc1..pck; loadings d x k; share of variance) of `principal`."""
    c = principal(vectors, k, id_col, vector_col)
    return c.scores, c.load, c.share


def top_loadings(loadings: DataFrame, labels: DataFrame | None = None, pc: str = "pc1", n: int = 15) -> DataFrame:
    """feature, label, loading, positive: the n features with the largest absolute loadings, and those that tie with the last; labels (feature, label) name
    them, else their number does."""
    t = loadings.select("feature", F.col(pc).alias("loading"))
    t = t.join(labels.select("feature", "label"), "feature", "left") if labels is not None else t.withColumn("label", F.lit(None).cast("string"))
    size = F.abs("loading")
    least = t.orderBy(size.desc()).limit(n).agg(F.min(size).alias("least"))
    named = F.coalesce("label", F.col("feature").cast("string")).alias("label")
    return t.crossJoin(F.broadcast(least)).where(size >= F.col("least")).select("feature", named, "loading", (F.col("loading") > 0).alias("positive"))


def knn_distance(points: DataFrame, k: int) -> DataFrame:
    """entity, d: distance to the k-th nearest other point in the plane (entity, x, y); see `kth_distance`."""
    return kth_distance(points, k)


def knee(values: DataFrame, value: str) -> DataFrame:
    """rank, value of the knee of the ascending curve: largest distance from the chord between its ends, both axes scaled to 1; the first of equal ones. Values
    that are null are left out; of one value, or of equal ones, the first is the knee."""
    r = ranked(values.where(F.col(value).isNotNull()).select(value), [value], "rank")
    e = r.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max("rank").alias("n"))
    along = lambda x, width: F.coalesce(x / F.nullif(width.cast("double"), F.lit(0.0)), F.lit(0.0))
    gap = F.abs(along(F.col("rank") - 1, F.col("n") - 1) - along(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")))
    s = r.crossJoin(F.broadcast(e)).withColumn("gap", F.round(gap, 12))
    return s.agg(F.max_by(F.struct("rank", F.col(value).alias("value")), F.struct("gap", -F.col("rank"))).alias("k")).where("k is not null").select("k.rank", "k.value")


def clustered(points: DataFrame, min_pts: int) -> DataFrame:
    """entity, cluster, eps: DBSCAN of points (entity, ord, x, y) with the distance at the knee of their sorted distances to the min_pts-th neighbour."""
    found = knee(knn_distance(points, min_pts), "d").first()
    if found is None or not found["value"] > 0:
        eps = 0.0  # no distance tells points apart: every place is a cluster of its own, or noise
        places = points.groupBy("x", "y").agg(F.min("ord").alias("component"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pts)
        number = ranked(places.select("x", "y", "component"), ["component"], "cluster")
        return points.join(number, ["x", "y"], "left").select("entity", F.coalesce("cluster", F.lit(0)).cast("long").alias("cluster"), F.lit(eps).alias("eps"))
    return dbscan(points, float(found["value"]), min_pts).withColumn("eps", F.lit(float(found["value"])))


def legend(points: DataFrame, height: str = "lat") -> DataFrame:
    """cluster, mean, n, row: clusters from the highest mean of `height` down, noise (0) last."""
    m = points.groupBy("cluster").agg(F.avg(height).alias("mean"), F.count(F.lit(1)).alias("n"))
    return ranked(m, [(F.col("cluster") == 0).cast("int"), F.col("mean").desc(), "cluster"], "row")


def dbscan(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """entity, cluster (0: noise) of points (entity, ord, x, y): a core point has min_pts points within eps, itself included; a border point goes to the
    first cluster that reaches it; clusters are numbered by their first core point's ord. Points with a null or non-finite coordinate are noise.

    Points at one place are one place with a count. Places that share a cell of width eps / sqrt(2) are within eps of each other: in a cell of min_pts points all are core
    without a comparison, and a cell's core places are one node of the graph of clusters. Neighbouring cells are linked if two of their outermost places are close enough;
    only cells that lie in different components after that are compared place by place."""
    finite = "isnotnull(x) and isnotnull(y) and not isnan(x + y) and abs(x) < double('infinity') and abs(y) < double('infinity')"
    width = eps / 2**0.5 * (1 - 1e-12)
    cell = [F.floor(F.col(c) / width).alias(f"c{c}") for c in "xy"]
    places = points.where(finite).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).select("*", *cell)
    full = places.groupBy("cx", "cy").agg((F.sum("n") >= min_pts).alias("full"))
    places = cut(places.join(full, ["cx", "cy"]))
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    step = lambda some: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in some])).alias("s")
    around = lambda df: df.select("x", "y", F.col("cx").alias("hx"), F.col("cy").alias("hy"), step(steps)).select("x", "y", (F.col("hx") + F.col("s.i")).alias("cx"), (F.col("hy") + F.col("s.j")).alias("cy"))
    close = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")) <= eps * eps
    there = places.select("cx", "cy", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("n").alias("on"))
    counted = around(places.where("not full")).join(there, ["cx", "cy"]).where(close).groupBy("x", "y").agg(F.sum("on").alias("near")).where(F.col("near") >= min_pts).select("x", "y")
    core = cut(places.where("full").unionByName(places.where("not full").join(counted, ["x", "y"], "left_semi")).select("x", "y", "ord", "cx", "cy"))

    outer = [f(F.struct(e.alias("e"), "x", "y")) for e in (F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")) for f in (F.min, F.max)]
    cells = core.groupBy("cx", "cy").agg(F.min("ord").alias("id"), F.array(*outer).alias("outer"))
    cells = cut(cells)
    ahead = cells.select(F.col("id").alias("src"), F.col("outer").alias("a"), "cx", "cy", step([s for s in steps if s > (0, 0)])).select("src", "a", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    square = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    pairs = ahead.join(cells.select("cx", "cy", F.col("id").alias("dst"), F.col("outer").alias("b")), ["cx", "cy"])
    pairs = cut(pairs.select("src", "dst", F.exists("a", lambda p: F.exists("b", lambda q: square(p, q) <= eps * eps)).alias("linked")))
    first = components(pairs.where("linked").select("src", "dst"), cells.select("id"))
    ends = pairs.where("not linked").join(first.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(first.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a <> b")
    held = core.join(cells.select("cx", "cy", "id"), ["cx", "cy"])
    left, right = held.select(F.col("id").alias("src"), "x", "y"), held.select(F.col("id").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    more = ends.select("src", "dst", "a", "b").join(left, "src").join(right, "dst").where(close).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    second = components(more, first.select(F.col("component").alias("id")).distinct())
    whole = first.withColumnRenamed("component", "part").join(second.select(F.col("id").alias("part"), "component"), "part")
    number = ranked(whole.select("component").distinct(), ["component"], "cluster")
    cored = cut(held.join(whole.join(number, "component").select("id", "cluster"), "id").select("x", "y", "cx", "cy", "cluster"))

    rest = places.join(cored.select("x", "y"), ["x", "y"], "left_anti")
    border = around(rest).join(cored.select("cx", "cy", F.col("x").alias("ox"), F.col("y").alias("oy"), "cluster"), ["cx", "cy"]).where(close).groupBy("x", "y").agg(F.min("cluster").alias("cluster"))
    return points.join(cored.select("x", "y", "cluster").unionByName(border), ["x", "y"], "left").select("entity", F.coalesce("cluster", F.lit(0)).cast("long").alias("cluster"))
