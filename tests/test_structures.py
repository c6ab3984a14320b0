"""Trees, meshes, neighbours and clusters against plain Python and numpy, and their odd cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithmesh.operators import cluster, graph, mesh, neighbours, staging, stats, tree

TREE = "node long, parent long, length double"


def grown(kind, n, seed=0):
    """(node, parent, length) of a caterpillar or a random tree; the root is 0."""
    rng = random.Random(seed)
    if kind == "caterpillar":
        spine = [(k, k - 1 if k else None, 1.0 + k % 3) for k in range(n)]
        return spine + [(1000 + k, k, 0.5 + k) for k in range(n)]
    return [(0, None, None)] + [(k, rng.randrange(max(0, k - 6), k), rng.randint(1, 8) / 4) for k in range(1, n)]


def drawn(rows):
    kids = {}
    for node, parent, _ in sorted(rows, key=lambda r: r[0]):
        kids.setdefault(parent, []).append(node)
    length, places, tips = {r[0]: r[2] or 0.0 for r in rows}, {}, []

    def walk(node, x):
        x += length[node]
        if node not in kids:
            tips.append(node)
            places[node] = (x, float(len(tips)), True)
        else:
            ys = [walk(k, x) for k in kids[node]]
            places[node] = (x, sum(ys) / len(ys), False)
        return places[node][1]

    for root in kids[None]:
        # the root's own length isn't below it
        length[root] = 0.0
        walk(root, 0.0)
    return places


@pytest.mark.parametrize("rows", [grown("caterpillar", 13), grown("random", 120), grown("random", 60, 5) + [(500, None, 0.0), (501, 500, 2.0)], [(7, None, 0.0)]])
def test_layout_of_trees_of_any_depth(spark, rows):
    got = {r["node"]: (r["x"], r["y"], r["tip"]) for r in tree.layout(spark.createDataFrame(rows, TREE)).collect()}
    want = drawn(rows)
    assert got.keys() == want.keys()
    for node, (x, y, tip) in want.items():
        assert got[node] == (pytest.approx(x), pytest.approx(y), tip)


def test_elbows_and_strips(spark):
    rows = [(0, None, 0.0), (1, 0, 1.0), (2, 0, 2.0), (3, 1, 1.0), (4, 1, 1.0), (5, 2, 1.0), (6, 2, 1.0)]
    places = tree.layout(spark.createDataFrame(rows, TREE))
    lines = {(r["node"], r["kind"]): (r["x0"], r["y0"], r["x1"], r["y1"]) for r in tree.elbows(places).collect()}
    assert len(lines) == 12 and lines[2, "branch"] == (0.0, 3.5, 2.0, 3.5) and lines[2, "stem"] == (0.0, 2.5, 0.0, 3.5)
    runs = sorted(map(tuple, tree.strips(places, spark.createDataFrame([(3, "a"), (4, "a"), (6, "a")], "node long, label string")).collect()))
    assert runs == [(1, "a", 1.0, 2.0, 1.5, 2), (2, None, 3.0, 3.0, 3.0, 1), (3, "a", 4.0, 4.0, 4.0, 1)]
    assert tree.layout(spark.createDataFrame([], TREE)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_trees_keep_distances(spark, seed):
    rows = grown("random", 80, seed)
    inner = {p for _, p, _ in rows}
    tips = [n for n, _, _ in rows if n not in inner]
    kept = random.Random(seed).sample(tips, 9)
    df, wanted = spark.createDataFrame(rows, TREE), spark.createDataFrame([(k,) for k in [*kept, kept[0], max(x for x in inner if x is not None), 999]], "node long")
    small = tree.pruned(df, wanted)
    got = [tuple(r) for r in small.collect()]
    roots = [r for r in got if r[1] is None]
    kids = [p for _, p, _ in got if p is not None]
    assert len(roots) == 1 and roots[0][2] == 0 and all(kids.count(n) != 1 for n, _, _ in got)
    assert {n for n, _, _ in got if n not in kids} == set(kept)
    at = spark.createDataFrame([(k,) for k in kept], "node long")
    whole, part = ({(r["i"], r["j"]): r["v"] for r in tree.patristic(t, at).collect()} for t in (df, small))
    assert len(whole) == 36 and part == {k: pytest.approx(v) for k, v in whole.items()}
    assert [tuple(r) for r in tree.pruned(df, at.limit(1)).collect()] == [(kept[0], None, 0.0)]
    assert tree.pruned(df, at.limit(0)).collect() == []


def test_patristic_distance_of_a_deep_tree(spark):
    rows = grown("caterpillar", 12)
    df = spark.createDataFrame(rows, TREE)
    up = {n: (p, x) for n, p, x in rows}

    def way(n):
        out, d = {}, 0.0
        while n is not None:
            out[n] = d
            n, d = up[n][0], d + up[n][1]
        return out

    tips = [n for n, _, _ in rows if n >= 1000]
    got = {(r["i"], r["j"]): r["v"] for r in tree.patristic(df, spark.createDataFrame([(t,) for t in tips], "node long")).collect()}
    for i in tips:
        for j in tips:
            if i < j:
                a, b = way(i), way(j)
                assert got[i, j] == pytest.approx(min(a[n] + b[n] for n in a if n in b))
    with pytest.raises(ValueError, match="circle"):
        tree.ancestors(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], TREE))


def test_path_rounds_do_not_depend_on_the_order_of_sums(spark, monkeypatch):
    rng, asked = random.Random(3), []
    edges = spark.createDataFrame([(a, rng.randrange(60), rng.random()) for a in range(60) for _ in range(2)], "src long, dst long, cost double")
    settled = graph._settled
    monkeypatch.setattr(graph, "_settled", lambda *a: asked.append(1) or settled(*a))
    results, rounds = [], []
    for parts in (2, 7, 5):
        asked.clear()
        results.append(sorted(map(tuple, graph.all_pairs(edges.repartition(parts)).collect())))
        rounds.append(len(asked))
    assert len(set(rounds)) == 1 and rounds[0] <= 8
    assert results[0] == results[1] == results[2]


# --- polygons and meshes


def ring_rows(rings):
    return [(region, part, k, x, y) for region, parts in rings.items() for part, ring in enumerate(parts) for k, (x, y) in enumerate(ring)]


def holds(parts, x, y):
    inside = False
    for ring in parts:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


RINGS = "region long, part int, ord int, lon double, lat double"


@pytest.mark.parametrize("cell", [None, 0.07, 1.3, 50.0])
def test_points_in_polygons(spark, cell):
    rng = random.Random(1)
    star = lambda x, y, r, n: [(x + r * (0.5 + rng.random() / 2) * math.cos(2 * math.pi * k / n), y + r * (0.5 + rng.random() / 2) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rings = {1: [star(0, 0, 5, 23), star(0, 0, 1.5, 7)], 2: [star(3, 1, 4, 11)], 3: [[(-6.0, -6.0), (-2.0, -6.0), (-2.0, -2.0), (-6.0, -2.0)]], 4: [[(0.0, 0.0), (1.0, 1.0)]]}
    points = [(k, rng.uniform(-7, 8), rng.uniform(-7, 6)) for k in range(400)] + [(k, -3.0, -3.0) for k in range(400, 420)] + [(420, None, 0.0), (421, float("nan"), 0.0), (422, float("inf"), 0.0), (423, -6.0, -4.0), (424, -2.0, -4.0), (425, -4.0, -6.0), (426, -4.0, -2.0)]
    got = {tuple(r) for r in mesh.within(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(ring_rows(rings), RINGS), cell).collect()}
    want = {(i, region) for i, x, y in points if x is not None and math.isfinite(x) for region, parts in rings.items() if holds(parts, x, y)}
    assert got == want and len(want) > 150


def test_mesh_hull_and_raster(spark):
    square = spark.createDataFrame(ring_rows({1: [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]}), RINGS)
    nodes, edges = mesh.clipped_lattice(square, 0.5)
    at = {r["id"]: (r["lon"], r["lat"]) for r in nodes.collect()}
    assert all(0 <= x < 4 and 0 <= y < 4 for x, y in at.values()) and len(at) > 60
    for r in edges.collect():
        assert math.dist(at[r["src"]], at[r["dst"]]) == pytest.approx(0.5)
    values = nodes.select("id", (1 + 2 * F.col("lon") - 3 * F.col("lat")).alias("value"))
    raster = mesh.surface_raster(nodes, edges, values, square, 41, 33).collect()
    assert len(raster) > 900
    for r in raster:  # linear interpolation keeps a linear surface
        assert r["value"] == pytest.approx(1 + 2 * r["lon"] - 3 * r["lat"])
    corners = [tuple(r) for r in mesh.hull(nodes).orderBy("ord").collect()]
    area = sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(corners, corners[1:] + corners[:1], strict=True)) / 2
    assert area > 11 and len(corners) >= 4
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 9.0, 9.0), (3, None, 1.0), (4, corners[0][1], corners[0][2])], "id long, lon double, lat double")
    assert sorted(r["id"] for r in mesh.stranded(points, nodes).collect()) == [2, 3, 4]
    near = graph.nearest(points.where("id < 3"), nodes)
    report = mesh.mesh_report(nodes, edges, points, near).first()
    assert (report["n_nodes"], report["n_components"], report["n_stranded"], report["n_occupied"]) == (len(at), 1, 3, 2)
    none = spark.createDataFrame([], RINGS)
    assert mesh.clipped_lattice(none, 0.5)[0].collect() == [] and mesh.within(points, none).collect() == []


def test_raster_takes_the_first_triangle_and_leaves_out_flat_ones(spark):
    flat = (0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 1.0)
    rows = [flat, (1, 0.0, 0.0, 5.0, 2.0, 0.0, 5.0, 0.0, 2.0, 5.0), (2, 0.0, 0.0, 7.0, 2.0, 0.0, 7.0, 0.0, 2.0, 7.0), (3, 2.0, 2.0, 9.0, 2.0, 0.0, 9.0, 0.0, 2.0, None)]
    t = spark.createDataFrame(rows, "id long, " + ", ".join(f"x{k} double, y{k} double, v{k} double" for k in (1, 2, 3)))
    got = [tuple(r) for r in mesh.rasterised(t, (0.0, 2.0, 0.0, 2.0), 5, 5).collect()]
    assert {r[4] for r in got} == {5.0} and {(r[0], r[1]) for r in got} == {(c, r) for c in range(5) for r in range(5) if c + r <= 4}


# --- neighbours, numbers over a whole table, clusters


def test_kth_distance_with_copies_and_outliers(spark):
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal(size=(150, 2)), 1e-2 * rng.normal(size=(200, 2)) + 5, [[1e4, 0], [1e4, 1], [-1e3, 7]], np.zeros((9, 2)), [[3, 3]] * 2])
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)] + [(9001, None, 0.0), (9002, float("nan"), 1.0)], "entity long, x double, y double")
    d = np.sort(np.sqrt(((xy[:, None] - xy) ** 2).sum(axis=2)), axis=1)
    for k in (1, 9):
        got = {r["entity"]: r["d"] for r in neighbours.kth_distance(points, k).collect()}
        assert got.keys() == set(range(len(xy)))
        assert [got[i] for i in range(len(xy))] == pytest.approx(d[:, k].tolist(), abs=1e-12)
    assert [r["d"] for r in neighbours.kth_distance(points.limit(3), 5).collect()] == [None] * 3
    assert neighbours.kth_distance(points.limit(0), 2).collect() == []


def test_nearest_on_the_sphere(spark):
    rng = random.Random(2)
    place = lambda k: (k, rng.choice([rng.uniform(-90, 90), rng.uniform(14, 14.01)]), rng.choice([rng.uniform(-180, 180), 179.99, -179.99]))
    nodes, points = [place(k) for k in range(150)], [place(k) for k in range(200)]
    nodes += [(300, nodes[5][1], nodes[5][2]), (301, None, 1.0)]
    points += [(500, 90.0, 0.0), (501, -90.0, 3.0), (502, None, 0.0), (503, nodes[5][1], nodes[5][2])]
    schema = "id long, lat double, lon double"
    got = {r["id"]: (r["node"], r["distance"]) for r in graph.nearest(spark.createDataFrame(points, schema), spark.createDataFrame(nodes, schema)).collect()}

    def metres(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * graph.EARTH_M * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    for i, lat, lon in points:
        if lat is None:
            assert got[i] == (None, None)
            continue
        best = min((metres(lat, lon, y, x), n) for n, y, x in nodes if y is not None)
        assert got[i][1] == pytest.approx(best[0], abs=1e-6)
    assert got[503][0] == 5  # ties to the smaller node
    few = graph.nearest(spark.createDataFrame(points, schema), spark.createDataFrame(nodes[:20], schema))
    assert {r["id"]: r["distance"] for r in few.collect()}[502] is None


def test_numbers_over_a_whole_table(spark):
    rows = [(k % 3 if k % 7 else None, (k * 37) % 101, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g long, v long, _part long")
    got = staging.running(df, ["g"], ["v", "_part"], F.col("v"), "s").collect()
    for g in (0, 1, 2, None):
        mine = sorted((r["v"], r["_part"], r["s"]) for r in got if r["g"] == g)
        assert [m[2] for m in mine] == np.cumsum([m[0] for m in mine]).tolist()
    assert [r["n"] for r in staging.ranked(df, [F.col("v").desc(), "_part"], "n").orderBy(F.desc("v"), "_part").collect()] == list(range(1, 301))
    for n, size in ((3, 10), (4, 3), (7, 300)):
        tiles = [r["t"] for r in stats.tiles(df.orderBy("_part").limit(size), ["_part"], n, "t").orderBy("_part").collect()]
        assert tiles == sorted(tiles) and tiles == [k + 1 for k in range(n) for _ in range(size // n + (k < size % n))]
    assert staging.ranked(df.limit(0), ["v"], "n").collect() == []


def scanned(xy, eps, least):
    near = ((xy[:, None] - xy) ** 2).sum(axis=2) <= eps * eps
    core, label, n = near.sum(axis=1) >= least, np.zeros(len(xy), int), 0
    for i in np.flatnonzero(core):
        if not label[i]:
            n += 1
            todo = [i]
            while todo:
                j = todo.pop()
                if not label[j]:
                    label[j] = n
                    todo += np.flatnonzero(near[j] & core & (label == 0)).tolist()
    for i in np.flatnonzero(~core):
        reached = label[near[i] & core]
        label[i] = reached.min() if len(reached) else 0
    return label


@pytest.mark.parametrize(("eps", "least"), [(0.3, 4), (0.05, 3), (2.0, 10)])
def test_density_clusters(spark, eps, least):
    rng = np.random.default_rng(4)
    t = rng.uniform(0, 6, 150)
    xy = np.round(np.concatenate([np.column_stack([np.cos(t), np.sin(t)]) + 0.05 * rng.normal(size=(150, 2)), 0.2 * rng.normal(size=(150, 2)), [[4, 4]] * 12, rng.uniform(-5, 5, (40, 2))]), 3)
    xy = xy[rng.permutation(len(xy))]
    points = spark.createDataFrame([(1000 + k, k, float(x), float(y)) for k, (x, y) in enumerate(xy)] + [(1, 9999, None, 1.0)], "entity long, ord long, x double, y double")
    got = {r["entity"]: r["cluster"] for r in cluster.dbscan(points, eps, least).collect()}
    assert [got[1000 + k] for k in range(len(xy))] == scanned(xy, eps, least).tolist() and got[1] == 0


def test_principal_components_and_their_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 5)) * [3, 1, 0.5, 0.2, 0], rng.normal(size=(60, 5)) * [0.3, 0.3, 0.5, 0.2, 0] + [12, 5, 0, 0, 0]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(900, None), (901, [1.0]), (902, [float("nan")] * 5), (903, [None] * 5)]
    c = cluster.principal(spark.createDataFrame(rows + bad, "entity long, vector array<double>"), 2)
    centred = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    load = vt[:2].T * np.sign(vt[:2].T[np.abs(vt[:2].T).argmax(axis=0), [0, 1]])
    assert np.array([list(r)[1:] for r in c.scores.orderBy("entity").collect()]) == pytest.approx(centred @ load)
    assert np.array([list(r)[1:] for r in c.loadings.orderBy("feature").collect()]) == pytest.approx(load[:4])  # the last has no variance
    assert [r["share"] for r in c.shares.orderBy("pc").collect()] == pytest.approx((s[:2] ** 2 / (s**2).sum()).tolist())
    labels = spark.createDataFrame([(0, "first")], "feature long, label string")
    top = cluster.top_loadings(c.loadings, labels, "pc2", 2).collect()
    biggest = np.argsort(-np.abs(load[:, 1]))[:2]
    assert {r["feature"] for r in top} == set(biggest.tolist()) and all(r["label"] == ("first" if r["feature"] == 0 else str(r["feature"])) for r in top)
    points = c.scores.select("entity", F.col("entity").alias("ord"), F.col("pc1").alias("x"), F.col("pc2").alias("y"))
    found = cluster.clustered(points, 4).collect()
    xy = centred @ load
    d = np.sort(np.sort(np.sqrt(((xy[:, None] - xy) ** 2).sum(axis=2)), axis=1)[:, 4])
    gap = np.abs(np.arange(len(d)) / (len(d) - 1) - (d - d[0]) / (d[-1] - d[0]))
    eps = d[np.round(gap, 12).argmax()]
    assert found[0]["eps"] == pytest.approx(eps)
    got = {r["entity"]: r["cluster"] for r in found}
    assert [got[k] for k in range(len(xy))] == scanned(xy, found[0]["eps"], 4).tolist()
    order = cluster.legend(spark.createDataFrame([(1, 2.0), (2, 5.0), (0, 9.0), (1, 4.0)], "cluster long, lat double")).orderBy("row").collect()
    assert [r["cluster"] for r in order] == [2, 1, 0]
    same = spark.createDataFrame([(k, k, 1.0, 1.0) for k in range(5)], "entity long, ord long, x double, y double")
    assert {tuple(r)[1:] for r in cluster.clustered(same, 4).collect()} == {(1, 0.0)}
    with pytest.raises(ValueError, match="two vectors"):
        cluster.principal(spark.createDataFrame([], "entity long, vector array<double>"))
