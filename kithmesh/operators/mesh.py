"""Polygons by cells of a grid, triangular meshes within them, their checks, and rasters of values on a mesh.

Rings are rows (region, part, ord, lon, lat), ord from 0 without gaps; a region is what an odd number of its rings hold, so holes are rings too. Points meet
the sides of a region in their own row of grid cells only, and only those in cells that a side passes are tested themselves; any other cell is inside or
outside as a whole, which its middle decides once for all points in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithmesh.operators.graph import components
from kithmesh.operators.staging import cut

#: Height of a row of an equilateral triangular mesh, in steps.
ROW = 3**0.5 / 2


def sides(rings: DataFrame) -> DataFrame:
    """region, x1, y1, x2, y2 of each ring's sides, the one back to the start included. A null coordinate leaves out the sides beside it."""
    sizes = rings.groupBy("region", "part").agg((F.max("ord") + 1).alias("n"))
    a = rings.join(sizes, ["region", "part"]).select("region", "part", F.pmod(F.col("ord") + 1, F.col("n")).alias("ord"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    b = rings.select("region", "part", "ord", F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    return a.join(b, ["region", "part", "ord"]).where("x1 is not null and y1 is not null and x2 is not null and y2 is not null and (x1 <> x2 or y1 <> y2)").select("region", "x1", "y1", "x2", "y2")


def _right_of(x: str, y: str) -> Column:
    """Whether a side lies to the right of (x, y) in its height; a side holds its lower end but not its upper one."""
    x, y, x1, y1, x2, y2 = (F.col(c) for c in (x, y, "x1", "y1", "x2", "y2"))
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def within(points: DataFrame, rings: DataFrame, cell: float | None = None) -> DataFrame:
    """id, region: the regions that hold each point (id, lon, lat), a row for each. Points with a null or non-finite coordinate are in none, points on a side in the region
    above or to the left of it. `cell` is the width of the grid, by default a 128th of the rings' extent; it doesn't change the result. Equal
    places are looked at once, however many points share them."""
    s = cut(sides(rings))
    if cell is None:
        box = s.agg(F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("w")).first()
        cell = (box["w"] or 1.0) / 128
    at = lambda c: F.floor(c / cell)
    spots = cut(points.where("isnotnull(lon) and isnotnull(lat) and not isnan(lon + lat) and abs(lon) < double('infinity') and abs(lat) < double('infinity')").select("lon", "lat").distinct().withColumn("cx", at(F.col("lon"))).withColumn("cy", at(F.col("lat"))))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = cut(s.withColumn("cy", F.explode(F.sequence(at(low), at(high)))))
    # The part of a side that lies in its row of cells, a little widened for rounding.
    slope = F.when(F.col("y1") != F.col("y2"), (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    x_at = lambda y: F.col("x1") + (y - F.col("y1")) * slope
    ends = [F.coalesce(x_at(F.greatest(low, F.col("cy") * cell)), F.col("x1")), F.coalesce(x_at(F.least(high, (F.col("cy") + 1) * cell)), F.col("x2"))]
    border = banded.select("region", "cy", F.explode(F.sequence(at(F.least(*ends) - 1e-9 * cell), at(F.greatest(*ends) + 1e-9 * cell))).alias("cx")).distinct()
    cells = spots.select("cx", "cy").distinct().withColumn("mx", (F.col("cx") + 0.5) * cell).withColumn("my", (F.col("cy") + 0.5) * cell)
    odd = F.count(F.lit(1)) % 2 == 1
    inside = cells.join(banded, "cy").where(_right_of("mx", "my")).groupBy("region", "cx", "cy").agg(odd.alias("odd")).where("odd").select("region", "cx", "cy")
    sure = spots.join(inside.join(border, ["region", "cx", "cy"], "left_anti"), ["cx", "cy"]).select("lon", "lat", "region")
    close = spots.join(border, ["cx", "cy"]).select("lon", "lat", "region", "cy")
    tested = close.join(banded, ["region", "cy"]).where(_right_of("lon", "lat")).groupBy("lon", "lat", "region").agg(odd.alias("odd")).where("odd").select("lon", "lat", "region")
    return points.select("id", "lon", "lat").join(sure.unionByName(tested), ["lon", "lat"]).select("id", "region")


def clipped_lattice(rings: DataFrame, step: float) -> tuple[DataFrame, DataFrame]:
    """(nodes id, lon, lat; edges src, dst) of the triangular lattice of width `step` over the rings' box, of which only nodes inside a region
    stay, and edges between two of them. Every other row is shifted by half a step; ids go row by row from the south-west corner."""
    box = rings.agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "lon"), ("x1", F.max, "lon"), ("y0", F.min, "lat"), ("y1", F.max, "lat"))]).first()
    spark = rings.sparkSession
    if box["x0"] is None:
        return spark.createDataFrame([], "id long, lon double, lat double"), spark.createDataFrame([], "src long, dst long")
    cols, rows = (int(np.floor((box[b] - box[a]) / w)) + 1 for a, b, w in (("x0", "x1", step), ("y0", "y1", step * ROW)))
    c, r = F.col("id") % cols, F.expr(f"id div {cols}")
    every = spark.range(cols * rows).select("id", (box["x0"] + (c + r % 2 * 0.5) * step).alias("lon"), (box["y0"] + r * (step * ROW)).alias("lat"))
    nodes = cut(every.join(within(every, rings).select("id").distinct(), "id"))
    odd = r % 2
    to = F.array(*[F.struct(x.alias("c"), y.alias("r")) for x, y in ((c + 1, r), (c + odd, r + 1), (c + odd - 1, r + 1))])
    edges = nodes.select(F.col("id").alias("src"), F.explode(to).alias("t")).where(f"t.c between 0 and {cols - 1}").select("src", (F.col("t.r") * cols + F.col("t.c")).alias("dst"))
    return nodes, edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def _chain(points: np.ndarray) -> np.ndarray:
    """The convex hull's corners, counter-clockwise from the lowest of the leftmost."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(order: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    corners = np.empty((0, 2))
    for batch in batches:
        corners = _chain(np.concatenate([corners, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat")])]))
    yield pa.RecordBatch.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], names=["lon", "lat"])


def hull(nodes: DataFrame, most: int = 100_000) -> DataFrame:
    """ord, lon, lat: the convex hull's corners, counter-clockwise. Each task keeps the corners of its own hull, so what reaches the
    driver are corners alone (over `most` of them are refused)."""
    spark = nodes.sparkSession
    rows = nodes.where("lon is not null and lat is not null").select(F.col("lon").cast("double"), F.col("lat").cast("double")).mapInArrow(_hulls, "lon double, lat double").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the hulls of the parts have over {most} corners")
    corners = _chain(np.array([(r["lon"], r["lat"]) for r in rows]).reshape(-1, 2))
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(corners)], "ord int, lon double, lat double")


def stranded(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """The points (id, lon, lat) that the hull of the nodes doesn't hold inside: those on its border and those with a null coordinate are stranded."""
    corners = hull(nodes).agg(F.array_sort(F.collect_list(F.struct("ord", "lon", "lat"))).alias("h"))
    a, b = F.col("h"), F.concat(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(1))), F.slice("h", 1, 1))
    left = F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda s: (s["b"]["lon"] - s["a"]["lon"]) * (F.col("lat") - s["a"]["lat"]) > (s["b"]["lat"] - s["a"]["lat"]) * (F.col("lon") - s["a"]["lon"]))
    inside = (F.size("h") > 2) & left
    return points.crossJoin(F.broadcast(corners)).where(~F.coalesce(inside, F.lit(False))).select(*points.columns)


def mesh_report(nodes: DataFrame, edges: DataFrame, points: DataFrame, near: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_components, n_stranded (points outside the nodes' hull), n_occupied nodes (of near: id, node), most and median points of
    an occupied node. Counts are 0 and the others null where there is nothing."""
    taken = near.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        nodes.agg(F.count(F.lit(1)).alias("n_nodes")),
        edges.agg(F.count(F.lit(1)).alias("n_edges")),
        components(edges, nodes.select("id")).agg(F.count_distinct("component").alias("n_components")),
        stranded(points, nodes).agg(F.count(F.lit(1)).alias("n_stranded")),
        taken.agg(F.count(F.lit(1)).alias("n_occupied"), F.max("n").alias("most"), F.median("n").alias("median")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, c (ascending): the triangles of a mesh, three nodes that are linked to each other."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()
    ac, bc = e.withColumnRenamed("b", "c"), e.toDF("b", "c")
    return e.join(ac, "a").join(bc, ["b", "c"]).select("a", "b", "c")


def rasterised(corners: DataFrame, box: tuple[float, float, float, float], cols: int, rows: int) -> DataFrame:
    """col, row, lon, lat, value on a grid of cols x rows points over box (lon0, lon1, lat0, lat1): linear interpolation in the triangles (id, x1, y1, v1, x2, y2, v2, x3, y3, v3).

    Each triangle is spread to the grid points of the rows, and in each row of the columns, that it covers, and weighs its corners there; nothing is joined and no
    triangle is held by the driver. On a shared side or corner the triangle with the smallest id counts. Points in no triangle are left out, and so are
    triangles without area or with a null value."""
    x0, x1, y0, y1 = box
    dx, dy = (x1 - x0) / max(cols - 1, 1), (y1 - y0) / max(rows - 1, 1)
    c = {n: F.col(n) for n in ("x1", "y1", "v1", "x2", "y2", "v2", "x3", "y3", "v3")}
    det = (c["y2"] - c["y3"]) * (c["x1"] - c["x3"]) + (c["x3"] - c["x2"]) * (c["y1"] - c["y3"])
    t = corners.where(" and ".join(f"{n} is not null" for n in c)).withColumn("det", det).where("det <> 0")
    span = lambda low, high, start, width, n: F.sequence(F.greatest(F.ceil((low - start) / width - 1e-9), F.lit(0)), F.least(F.floor((high - start) / width + 1e-9), F.lit(n - 1)))
    some = lambda low, high, start, width, n: F.when(F.greatest(F.ceil((low - start) / width - 1e-9), F.lit(0)) <= F.least(F.floor((high - start) / width + 1e-9), F.lit(n - 1)), span(low, high, start, width, n))
    ys, xs = [c[f"y{k}"] for k in (1, 2, 3)], [c[f"x{k}"] for k in (1, 2, 3)]
    t = t.withColumn("row", F.explode(some(F.least(*ys), F.greatest(*ys), y0, dy, rows))).withColumn("lat", y0 + F.col("row") * dy)
    # Where the row cuts the triangle: the ends of its cuts with the three sides.
    lat, cuts = F.col("lat"), []
    for i, j in ((1, 2), (2, 3), (3, 1)):
        a, b = c[f"y{i}"], c[f"y{j}"]
        share = F.least(F.greatest((lat - a) / (b - a), F.lit(0.0)), F.lit(1.0))
        cuts.append(F.when((a != b) & (lat >= F.least(a, b) - 1e-9 * dy) & (lat <= F.greatest(a, b) + 1e-9 * dy), c[f"x{i}"] + share * (c[f"x{j}"] - c[f"x{i}"])))
    t = t.withColumn("west", F.least(*cuts)).withColumn("east", F.greatest(*cuts))
    t = t.withColumn("col", F.explode(some(F.col("west"), F.col("east"), x0, dx, cols))).withColumn("lon", x0 + F.col("col") * dx)
    p = ((c["y2"] - c["y3"]) * (F.col("lon") - c["x3"]) + (c["x3"] - c["x2"]) * (lat - c["y3"])) / F.col("det")
    q = ((c["y3"] - c["y1"]) * (F.col("lon") - c["x3"]) + (c["x1"] - c["x3"]) * (lat - c["y3"])) / F.col("det")
    value = p * c["v1"] + q * c["v2"] + (1 - p - q) * c["v3"]
    best = t.groupBy("col", "row").agg(F.min_by(F.struct("lon", "lat", value.alias("value")), "id").alias("b"))
    return best.select("col", "row", "b.lon", "b.lat", "b.value")


def surface_raster(nodes: DataFrame, edges: DataFrame, values: DataFrame, rings: DataFrame, cols: int, rows: int) -> DataFrame:
    """lon, lat, value: values (id, value) of a mesh's nodes on a grid over the rings' box, interpolated in the mesh's triangles and masked by the regions."""
    box = rings.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if box[0] is None:
        return rings.sparkSession.createDataFrame([], "lon double, lat double, value double")
    found = triangles(nodes, edges).withColumn("id", F.struct("a", "b", "c"))
    for k, n in enumerate("abc", 1):
        at = nodes.join(values.select("id", "value"), "id").select(F.col("id").alias(n), F.col("lon").alias(f"x{k}"), F.col("lat").alias(f"y{k}"), F.col("value").alias(f"v{k}"))
        found = found.join(at, n)
    grid = cut(rasterised(found, tuple(box), cols, rows).withColumn("id", F.struct("col", "row")))
    return grid.join(within(grid, rings).select("id").distinct(), "id", "left_semi").select("lon", "lat", "value")
