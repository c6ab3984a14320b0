"""Operators on small frames with answers worked out by hand, and properties that must hold."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kithmesh.functions import nulls
from kithmesh.functions import text as tx
from kithmesh.operators import cluster, graph, models, relational, similarity, stats, surface, tree, weights
from kithmesh.sources import tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def present(spark):
    return spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "x")], "entity string, feature string")


def test_idf(spark, present):
    d = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "feature string")
    got = {r["feature"]: r["idf"] for r in weights.idf(present, dictionary=d).collect()}
    assert got["w"] == pytest.approx(math.log(4)) and got["x"] == 0 and got["y"] == pytest.approx(math.log(2))
    assert {r["feature"]: r["idf"] for r in weights.idf(present, "none", d).collect()}["w"] is None


def test_cosine_is_symmetric_and_bounded(present):
    v = similarity.weighted(present, weights.idf(present, n_total=5))
    m = {(r["i"], r["j"]): r["v"] for r in similarity.cosine(v).collect()}
    assert all(abs(m[i, j] - m[j, i]) < 1e-12 and 0 <= m[i, j] <= 1 for i, j in m)
    assert m["a", "a"] == pytest.approx(1, abs=1e-6)


def test_contributions_sum_to_mean_similarity(spark, present):
    v = similarity.weighted(present, weights.idf(present, n_total=5))
    core = spark.createDataFrame([("b",), ("c",)], "entity string")
    total = sum(r["contribution"] for r in similarity.contributions(v, core, v.where("entity = 'a'").select("entity").distinct()).collect())
    mean = np.mean([r["v"] for r in similarity.cosine(v, core, spark.createDataFrame([("a",)], "entity string")).collect()])
    assert total == pytest.approx(mean, abs=1e-6)


def test_pairwise_null_cosine(spark):
    v = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", None), ("b", "y", 1.0), ("c", "x", 1.0), ("c", "y", 1.0)], "entity string, feature string, v double")
    m = {(r["i"], r["j"]): r["v"] for r in similarity.cosine_pairwise(v).collect()}
    assert m["a", "b"] is None and m["a", "c"] == pytest.approx(1, abs=1e-6)


def test_coverage_prune_and_one_hot(spark):
    long = spark.createDataFrame([("a", "f", "1"), ("b", "f", "2"), ("c", "f", "3"), ("a", "g", "0"), ("b", "g", None), ("c", "g", None), ("d", "f", None)], "entity string, feature string, value string")
    assert {r["feature"] for r in weights.coverage_prune(long, 2, 1, 2).collect()} == {"f"}
    hot = {(r["entity"], r["feature"]): r["value"] for r in weights.one_hot(long).collect()}
    assert hot["a", "f_1"] == 1 and hot["a", "f_2"] == 0 and hot["d", "f_1"] is None and hot["a", "g"] == 0
    assert {r["feature"] for r in weights.drop_zero_variance(long).collect()} == {"f"}


def test_bh_is_monotone_and_not_below_p(spark):
    df = spark.createDataFrame([("g", p) for p in (0.01, 0.02, 0.02, 0.5, 0.04)], "g string, p double")
    got = sorted((r["p"], r["p_adj"]) for r in stats.bh(df, "p", ["g"]).collect())
    assert [round(a, 6) for _, a in got] == [0.033333, 0.033333, 0.033333, 0.05, 0.5]


def test_empirical_p(spark):
    null = spark.createDataFrame([("a", v) for v in (0.1, 0.2, 0.3, 0.4)], "i string, v double")
    seen = spark.createDataFrame([("a", "s", 0.35)], "i string, baseline string, score double")
    assert stats.empirical_upper(null, seen).first()["p"] == pytest.approx(0.4)


def test_friedman_and_signed_rank(spark):
    block = spark.createDataFrame([(f"e{i}", t, float(i + k)) for i in range(4) for k, t in enumerate("abc")], "entity string, treatment string, value double")
    r = stats.friedman(block).first()
    assert r["chi2"] == pytest.approx(8) and r["w"] == pytest.approx(1) and r["p"] == pytest.approx(math.exp(-4))
    d = spark.createDataFrame([("b", x) for x in (1.0, 2.0, 3.0, -4.0, 5.0)], "baseline string, delta double")
    r = stats.signed_rank(d).first()
    assert (r["n"], r["v"]) == (5, 11) and r["p"] == pytest.approx(7 / 32)


def test_mixed_model_recovers_anova(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=(8, 1)) * 3 + np.array([0.0, 1.0, 2.0]) + rng.normal(size=(8, 3)) * 0.1
    block = spark.createDataFrame([(f"e{i}", t, float(y[i, k])) for i in range(8) for k, t in enumerate("abc")], "entity string, treatment string, value double")
    got = {r["treatment"]: r for r in stats.mixed_model(block, "a").collect()}
    assert got["c"]["estimate"] == pytest.approx(y[:, 2].mean() - y[:, 0].mean()) and got["c"]["df"] == 14 and got["c"]["icc"] > 0.9
    assert sum(r["blup"] for r in stats.random_intercepts(block).collect()) == pytest.approx(0, abs=1e-9)


def test_mixture_and_shapiro():
    rng = np.random.default_rng(1)
    m = stats.best_mixture(np.concatenate([rng.normal(0, 1, 60), rng.normal(9, 1, 20)]))
    assert m.k == 2 and (m.posterior.argmax(axis=1) == 1).sum() == 20 and m.means[0] == pytest.approx(0, abs=0.5) and m.means[1] == pytest.approx(9, abs=0.5)
    w, p = stats.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.001)


def test_paths_and_components(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (4, 5, 1.0)], "src long, dst long, cost double")
    d = {(r["src"], r["dst"]): r["cost"] for r in graph.all_pairs(e).collect()}
    assert d[1, 3] == 2 and (1, 4) not in d and all(d[a, c] <= d[a, b] + d[b, c] for a, b in d for c in (1, 2, 3) if (b, c) in d and (a, c) in d)
    assert {r["id"]: r["cost"] for r in graph.path_costs(e, 1).collect()} == {1: 0, 2: 1, 3: 2}
    n = spark.createDataFrame([(k,) for k in range(1, 7)], "id long")
    assert {r["id"]: r["component"] for r in graph.components(e, n).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_tree(spark):
    t = tree.parse_newick("((a:1,b[&height=1]:2):3,'c d':4);")
    assert [x[3] for x in t if x[3]] == ["a", "b", "c d"]
    df = tree.tree_frame(spark, t)
    tips = df.where("label is not null").select("node")
    name = {r["node"]: r["label"] for r in df.where("label is not null").collect()}
    d = {(name[r["i"]], name[r["j"]]): r["v"] for r in tree.patristic(df, tips).collect()}
    assert d == {("a", "b"): 3, ("a", "c d"): 8, ("b", "c d"): 9}
    assert sorted(x[3] for x in tree.prune(t, {"a", "b"}) if x[3]) == ["a", "b"]
    text = "#NEXUS\nbegin trees;\n translate\n 1 one,\n 2 two;\n tree T = [&R] (1:1,2:2);\nend;\n"
    assert [x[3] for x in tree.parse_nexus(text) if x[3]] == ["one", "two"]


def test_mmrr_and_pgls(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(12, 2))
    x = np.abs(p[:, None, 0] - p[None, :, 0])
    z = np.abs(p[:, None, 1] - p[None, :, 1])
    got = {r["term"]: r for r in models.mmrr(spark, x * 2 + 0.01 * z, [x, z], nperm=99, slices=4).collect()}
    assert got["x1"]["estimate"] > 0.9 and got["x1"]["p"] == pytest.approx(0.01) and all(r["p"] >= 0.01 for r in got.values())
    y = p[:, 0] * 2 + 1
    r = models.pgls(y + rng.normal(size=12) * 1e-3, p[:, 0], np.eye(12), 1e-6)
    assert r["slope"] == pytest.approx(2, abs=0.01) and r["r2"] > 0.99


def test_waic_and_loo_agree_on_easy_data(spark):
    rng = np.random.default_rng(3)
    mu = rng.normal(0, 0.1, 400)
    y = rng.normal(size=20)
    ll = spark.createDataFrame(pd.DataFrame([(int(o), float(-0.5 * (y[o] - m) ** 2 - 0.9189385)) for o in range(20) for m in mu], columns=["obs", "ll"]))
    w, loo = models.waic(ll).first()["waic"], models.psis_loo(ll).first()
    assert w == pytest.approx(loo["looic"], abs=0.1) and loo["max_k"] < 0.7


def test_clusters(spark):
    pts = [("a", 0, 0.0, 0.0), ("b", 1, 0.1, 0.0), ("c", 2, 0.0, 0.1), ("d", 3, 5.0, 5.0), ("e", 4, 5.1, 5.0), ("f", 5, 5.0, 5.1), ("g", 6, 9.0, 0.0)]
    df = spark.createDataFrame(pts, "entity string, ord long, x double, y double")
    assert {r["entity"]: r["cluster"] for r in cluster.dbscan(df, 0.2, 3).collect()} == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": 2, "g": 0}
    d = {r["entity"]: r["d"] for r in cluster.knn_distance(df, 1).collect()}
    assert len(d) == 7 and d["a"] == pytest.approx(0.1) and d["g"] > 6
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [2.0, 2.0]), ("c", [4.0, 4.1])], "entity string, vector array<double>")
    scores, load, share = cluster.pca(v)
    assert share[0] > 0.99 and sum(r["pc1"] for r in scores.collect()) == pytest.approx(0, abs=1e-9)


def test_surface(spark):
    e = spark.createDataFrame([(0, 1, 10.0), (1, 2, 10.0)], "src long, dst long, w double")
    n = spark.createDataFrame([(0,), (3,)], "id long")
    got = {r["id"]: r["value"] for r in surface.node_values(surface.log_ratio(e), n).collect()}
    assert got == {0: 0, 3: None}
    w = surface.fit_weights(np.array([[0, 1], [1, 2]]), 3, np.array([0, 2]), np.array([[1.0, -1.0], [-1.0, 1.0]]), 1.0, 30)
    assert (w > 0).all() and w[0] == pytest.approx(w[1])
    with pytest.raises(ValueError):
        surface.land_lengths(e, [], 0.5)


def test_windows(spark):
    df = spark.createDataFrame([("g", k, float(k), lab) for k, lab in enumerate("aabba")], "g string, k long, v double, lab string")
    assert [r["length"] for r in stats.runs(df, ["g"], "k", "lab").orderBy("run").collect()] == [2, 2, 1]
    assert sorted(r["k"] for r in stats.quantile_picks(df, ["g"], ["k"], [0.0, 0.5, 1.0]).collect()) == [0, 2, 4]
    assert df.select(stats.min_max("v", ["g"]).alias("x")).agg(F.max("x")).first()[0] == 1


def test_null_rules(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 5)], "k string, w int")
    assert sorted(r["w"] or 0 for r in nulls.join_null_safe(a, b, ["k"]).collect()) == [0, 5]
    assert rows(a.where(~nulls.is_in(F.col("k"), ["x"])), "v") == [(None, 1)]
    m = spark.createDataFrame([("g", 1.0), ("g", None), ("h", 2.0)], "g string, v double").groupBy("g").agg(nulls.mean_or_null(F.col("v")).alias("m"))
    assert dict(rows(m)) == {"g": None, "h": 2.0}


def test_text(spark):
    df = spark.createDataFrame([("Ab_cd_12", "p, q ,r", "č͡x")], "a string, b string, c string")
    r = df.select(tx.tip_label(F.col("a")), tx.path_level(F.col("b"), 4), tx.path_level(F.col("b"), 2), tx.nfc("c"), tx.modifiers(F.col("c"))).first()
    assert tuple(r)[:4] == ("Ab cd", "r", "q", "čx") and r[4]


def test_sources(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text(',a,b\na,1,NA\nb,0.5,1\n')
    assert {(r["i"], r["j"]): r["v"] for r in tables.read_matrix(spark, str(p)).collect()}["a", "b"] is None
    q = tmp_path / "t.txt"
    q.write_text("note\nmore\nColumn\tName\n1\tx\n2\t\n")
    assert rows(tables.read_after_preamble(spark, str(q), "Column\t")) == [("1", "x"), ("2", None)]
    made = tables.cached(spark, str(tmp_path / "c"), lambda: spark.range(3))
    assert made.count() == 3 and tables.cached(spark, str(tmp_path / "c"), lambda: spark.range(9)).count() == 3
    g = tmp_path / "g.json"
    g.write_text('{"features": [{"properties": {"name": "r"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}')
    assert tables.read_polygons(spark, str(g)).count() == 3
    tables.write_metadata(spark, {"a": 1.5}, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).first()["a"] == 1.5


def test_streaming_frequency(spark, tmp_path):
    from kithmesh.streaming.frequency import frequencies

    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "entity string, feature string").write.json(str(tmp_path / "in"))
    q = frequencies(spark.readStream.schema("entity string, feature string").json(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("freq").start()
    q.processAllAvailable()
    q.stop()
    assert dict(rows(spark.table("freq"))) == {"x": 2, "y": 1}


def test_surface_cv_uses_every_label_and_component(spark, monkeypatch):
    from types import SimpleNamespace

    from kithmesh.plans import catalog

    table = spark.createDataFrame([(k, [float(k + j) for j in range(20)]) for k in range(9)], "label long, embedding array<double>")
    monkeypatch.setattr(surface, "cross_validate", lambda spark, edges, n, observed, data, lambdas, steps=100: (edges, n, observed, data, steps))
    edges, n, observed, data, steps = catalog.surface_cv(SimpleNamespace(spark=spark, embeddings=table))
    assert data.shape == (9, 20) and data[8, 19] == 4 * 27 and observed.max() < n == edges.max() + 1 and steps == 100


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)], "src long, dst long")
    assert {r["component"] for r in graph.components(e, spark.range(61)).collect()} == {0}


def test_mixture_of_one_component_and_normality_levels(spark):
    rows = [("one", f"e{k}", float(k)) for k in range(9)] + [("two", f"e{k}", float(k % 3 + (100 if k > 5 else 0))) for k in range(9)]
    values = spark.createDataFrame(rows, "g string, entity string, v double")
    got = {(r["g"], r["entity"]): r for r in stats.mixtures(values, "g", "v").collect()}
    assert got["one", "e8"]["posterior"] is None and not got["one", "e8"]["influenced"]
    assert [got["two", f"e{k}"]["influenced"] for k in range(9)] == [False] * 6 + [True] * 3
    assert {r["g"]: r["n_influenced"] for r in stats.mixture_summary(values, "g", "v").collect()} == {"one": 0, "two": 3}
    tested = {r["g"]: r for r in stats.shapiro(values.unionByName(spark.createDataFrame([("none", "e", None), ("two", "e", None)], values.schema)), "g", "v").collect()}
    assert tested["two"]["n"] == 9 and tested["two"]["level"] == "least normal" and tested["one"]["p_adj"] >= tested["one"]["p"] and tested["none"]["level"] is None


LAND = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]]


def test_land_counts_more_on_edges_and_connectors(spark):
    deg = 6371010.0 * np.pi / 180
    nodes = spark.createDataFrame([(1, 0.0, -1.0), (2, 0.0, 3.0), (3, 5.0, 5.0)], "id long, lat double, lon double").withColumn("lat", F.col("lat") + F.when(F.col("id") < 3, 1e-9).otherwise(0.0))
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    e = graph.penalised_edges(edges, nodes, LAND, 3.0).collect()
    assert len(e) == 2 and all(r["cost"] == pytest.approx((2 + 2 * 3) * deg, rel=1e-6) and r["crosses_land"] for r in e)
    points = spark.createDataFrame([(7, 0.0, -2.0), (8, 6.0, 5.0)], "id long, lat double, lon double")
    paths = graph.all_pairs(graph.penalised_edges(edges, nodes, LAND, 3.0))
    got = {r["id"]: r for r in graph.network_distances(points, nodes, paths, LAND, 0.0, 3.0, 3.0).collect()}
    assert got[7]["node"] == 1 and got[7]["h1"] == pytest.approx(deg / 1000, rel=1e-6) and got[8]["node"] == 3
    assert not got[8]["using_network"] and got[8]["h2"] > 0  # node 3 has no edge: the direct line
    both = {(r["i"], r["j"]): r["v"] for r in graph.pairwise_distances(graph.connectors(points, nodes, LAND, 3.0), paths).collect()}
    assert both == {(7, 8): 0.0, (8, 7): 0.0}  # no path
    with pytest.raises(ValueError):
        surface.land_lengths(points, LAND, 0.9)


def test_pairs_of_points_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4, raising=False)
    points = [(i, i % 3 if i > 9 else 0, float(i)) for i in range(1, 61)] + [(61, 7, 5.0)]  # most at node 0; node 7 has no path
    near = spark.createDataFrame(points, "id long, node long, cost double")
    paths = spark.createDataFrame([(a, b, 1000.0 * a + b) for a in range(3) for b in range(3)], "src long, dst long, cost double")
    pairs = graph.pairwise_distances(near, paths)
    got = {(r["i"], r["j"]): r["v"] for r in pairs.collect()}
    want = {(i, j): 0.0 if 7 in (m, n) else (c + d + (1001.0 * (m + n)) / 2) / 1000 for i, m, c in points for j, n, d in points if i != j}
    assert pairs.count() == len(want) and got == pytest.approx(want)
    assert pairs.groupBy(F.spark_partition_id()).count().count() > 8  # these few small rows were one task's before
    assert graph.pairwise_distances(near.limit(0), paths).count() == 0


def test_pairs_of_points_meet_without_copies_in_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 32, raising=False)
    n = 1000
    near = spark.range(n).select("id", (F.col("id") % 3).alias("node"), (F.col("id") % 50).cast("double").alias("cost"))
    near = near.unionByName(spark.createDataFrame([(n, None, None)], near.schema))  # a point without coordinates has no node
    paths = spark.createDataFrame([(a, b, 1000.0 * a + b) for a in range(3) for b in range(3)], "src long, dst long, cost double")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: {x.stageId(): x.shuffleWriteRecords() for x in jvm.jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList()))}
    before = stages()
    r = graph.pairwise_distances(near, paths).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.count_if(F.col("i") == F.col("j")).alias("same")).first()
    want = sum((i % 50 + j % 50 + 1001.0 * (i % 3 + j % 3) / 2) / 1000 for i in range(n) for j in range(n) if i != j)
    assert (r["n"], r["same"]) == (n * (n - 1), 0) and r["v"] == pytest.approx(want)
    assert sum(v for k, v in stages().items() if k not in before) < 10 * n  # 32 copies of each point before


def test_paths_are_traced(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], "src long, dst long, cost double")
    got = {(r["src"], r["dst"]): (r["cost"], r["path"]) for r in graph.traced_paths(e).collect()}
    assert got[1, 3] == (2.0, [1, 2, 3]) and got[3, 1] == (2.0, [3, 2, 1]) and got[2, 2] == (0.0, [2])


def test_verbs_state_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 2.0), ("b", 4, None), (None, 5, 1.0)], "g string, id int, v double")
    assert {(r["g"], r["id"]) for r in relational.top_per_group(df, ["g"], "v", "id").collect()} == {("a", 1), ("b", 4), (None, 5)}
    assert {r["id"] for r in relational.first_per_group(df, ["g"], [F.col("id").desc()]).collect()} == {3, 4, 5}
    kept = relational.keep_unless(df, [F.col("g") == "a", F.col("v") == 2.0])
    assert sorted(r["id"] for r in kept.collect()) == [4, 5]  # row 2: the conjunction is null
    assert relational.smallest_group(df, "g").first()["n"] == 3 and relational.smallest_group(df.limit(0), "g").first()["n"] is None
    assert relational.columns_like(df, "^v", ("id",)).columns == ["id", "v"]
    with pytest.raises(ValueError, match="more than 1"):
        relational.impute_one(df, "v")
    assert relational.impute_one(df, "v", permitted=2).where("v is null").count() == 0
    with pytest.raises(ValueError):
        relational.require(df, F.col("v") > 0, "positive")
    assert [r["n"] for r in df.select(relational.named(F.col("g"), {"a": "x"}).alias("n")).collect()] == ["x"] * 3 + [None] * 2
    q = relational.qq_points(df.fillna({"g": "z"}), "g", "v").where("g = 'a'").orderBy("rank").collect()
    assert [r["theoretical"] for r in q] == pytest.approx([-0.5895, 0.5895], abs=1e-3)  # two values: ranks 1 - 3/8 and 2 - 3/8 of 2.25


def test_frequency_table_and_shift(spark):
    rows = [(1, 1, "p", False), (1, 2, "q", False), (2, 3, "p", True), (2, 3, "q", None), (3, 4, "p", False)]
    inv = spark.createDataFrame(rows, "code int, inventory int, feature string, marginal boolean")
    got = {r["feature"]: r for r in relational.frequency_table(inv, spark.createDataFrame([("p",), ("q",), ("r",)], "feature string"), F.col("code") == 1).collect()}
    assert (got["p"]["n"], got["p"]["n_subset"], got["q"]["n"], got["r"]["n"], got["r"]["idf"]) == (2, 1, 1, 0, None) and got["p"]["n_total"] == 3
    ours = spark.createDataFrame([("p", 0.0), ("q", 1.0)], "feature string, idf double")
    theirs = spark.createDataFrame([("P", 2.0), ("Q", 1.0)], "symbol string, idf double")
    walk = spark.createDataFrame([("p", "p"), ("q", "q")], "feature string, symbol string")
    shift = {r["feature"]: (r["shift"], r["direction"]) for r in relational.idf_shift(ours, theirs, walk, F.upper).collect()}
    assert shift == {"p": (1.0, "rarer"), "q": (-1.0, "commoner")}
