"""Pruning, decompositions, crosswalks, profile intervals, counts of steps and sources against plain Python, and their odd cases."""

import json
import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithmesh.functions import text as tx
from kithmesh.functions.metrics import Watched
from kithmesh.operators import crosswalk, mesh, similarity, stats, weights
from kithmesh.sources import tables


def peeled(cells, f, e):
    while True:
        n, by = len(cells), Counter(c[1] for c in cells)
        cells = {c for c in cells if by[c[1]] >= f}
        by = Counter(c[0] for c in cells)
        cells = {c for c in cells if by[c[0]] >= e}
        if len(cells) == n:
            return cells


def test_prune_until_stable(spark):
    rng = random.Random(0)
    cells = {(f"e{rng.randrange(30)}", f"f{int(rng.triangular(0, 25, 3))}") for _ in range(330)}
    rows = [(*c, rng.randrange(3)) for c in sorted(cells)]
    rows += [rows[0], ("e0", "f0", None), ("e1", "never", None), ("late", "f3", None), (None, "f3", 1), ("e2", None, 1)]
    df = spark.createDataFrame(rows, "entity string, feature string, value int")
    seen = set()
    for f, e in ((5, 4), (8, 7), (9, 9), (30, 30), (0, 0)):
        left = peeled(cells, f, e)
        entities, features = {c[0] for c in left}, {c[1] for c in left}
        if (f, e) == (0, 0):
            entities, features = {r[0] for r in rows if r[0] and r[1]}, {r[1] for r in rows if r[0] and r[1]}
        got = sorted(map(str, map(tuple, weights.prune_until_stable(df, f, e).collect())))
        assert got == sorted(str(r) for r in rows if r[0] in entities and r[1] in features)
        seen.add(len(left))
    assert len(seen) > 3 and weights.prune_until_stable(df.limit(0), 2, 2).collect() == []


def test_decompositions_of_all_entities(spark):
    rng = np.random.default_rng(1)
    names = ["s1", "s2", "s3", "i1", "i2", "lone"]
    x = rng.integers(0, 3, (6, 8)).astype(float)
    x[5] = 0
    x[5, 7], x[:5, 7] = 2.0, 0
    v = spark.createDataFrame([(n, f"f{k}", float(a)) for n, row in zip(names, x, strict=True) for k, a in enumerate(row) if a], "entity string, feature string, v double")
    u = x / np.sqrt((x**2).sum(axis=1))[:, None]
    pairs = [(names[i], names[j], float(u[i] @ u[j])) for i in range(3) for j in (3, 4)] + [("s1", "lone", None)]
    core, of = (spark.createDataFrame([(n,) for n in some], "entity string") for some in (["s1", "s2", "s3"], ["i1", "i2", "lone", "unknown"]))
    got = {(r["entity"], r["feature"]): r for r in similarity.compared_decompositions(v, spark.createDataFrame(pairs, "i string, j string, v double"), core, of).collect()}
    centre = u[:3].mean(axis=0)
    for j in (3, 4):
        best = min((-p[2], p[0]) for p in pairs if p[1] == names[j])[1]
        a, b = u[j] * centre, u[j] * u[names.index(best)]
        mine = {int(k[1][1:]): r for k, r in got.items() if k[0] == names[j]}
        assert set(mine) == set(np.flatnonzero((a > 0) | (b > 0)).tolist())
        for k, r in mine.items():
            assert r["partner"] == best and (r["centre"], r["most"], r["centre_share"], r["most_share"]) == pytest.approx((a[k], b[k], a[k] / a.sum(), b[k] / b.sum()))
    assert not any(k[0] in ("lone", "unknown") for k in got)
    ranks = similarity.contributions(v, core, of.where("entity like 'i%'")).where("entity = 'i1'").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, len(ranks) + 1)) and sum(r["share"] for r in ranks) == pytest.approx(1)
    means = spark.createDataFrame([("a", "x", 0.0), ("b", "x", 0.5), ("c", "x", 0.6), ("d", "x", 9.0), ("e", "x", 1.0)], "i string, j string, v double")
    kept = similarity.core_within(means, spark.createDataFrame([(c,) for c in "abcd"], "entity string")).collect()
    assert {r["entity"] for r in kept} == {"a", "b", "c"}


def test_symbols_match_at_their_first_level(spark):
    nfd = lambda s: unicodedata.normalize("NFD", s)
    ours = [(1, "a"), (2, "ã"), (3, nfd("ã")), (4, "tʰʲ"), (5, "zz"), (6, None), (7, "a"), (8, "t͡s"), (9, "")]
    theirs = [("a", 3), (nfd("ã"), 5), ("ã", 2), ("tʲʰ", 4), ("tʰʲ", 0), ("ts", 1), (None, 9)]
    left, right = spark.createDataFrame(ours, "id long, symbol string"), spark.createDataFrame(theirs, "symbol string, n long")
    got = {r["id"]: (r["match"] and r["match"]["symbol"], r["level"]) for r in crosswalk.first_match(left, right, crosswalk.keys("symbol"), crosswalk.keys("symbol"), [-F.col("n")]).collect()}
    assert got == {1: ("a", 1), 2: ("ã", 1), 3: (nfd("ã"), 1), 4: ("tʰʲ", 1), 5: (None, None), 6: (None, None), 7: ("a", 1), 8: ("ts", 2), 9: (None, None)}
    some = right.where("symbol <> 'tʰʲ' and symbol <> 'ã'")
    got = {r["id"]: (r["match"] and r["match"]["symbol"], r["level"]) for r in crosswalk.first_match(left, some, crosswalk.keys("symbol"), crosswalk.keys("symbol"), [-F.col("n")]).collect()}
    assert got[2] == (nfd("ã"), 2) and got[4] == ("tʲʰ", 3)
    assert crosswalk.first_match(left.limit(0), right, crosswalk.keys("symbol"), crosswalk.keys("symbol"), []).collect() == []
    assert all(r["match"] is None for r in crosswalk.first_match(left, right.limit(0), crosswalk.keys("symbol"), crosswalk.keys("symbol"), []).collect())


def test_marks_vowels_and_letters(spark):
    df = spark.createDataFrame([("tʰʲ",), ("aːˑ",), ("n",), (None,), ("",), ("ʷ",), ("ẽ",)], "s string")
    rows = df.select(tx.modification(tx.nfd("s")).alias("m"), tx.is_vowel(tx.nfd("s")).alias("v")).collect()
    assert [r["m"] for r in rows] == ["aspirated+palatalized", "long", None, None, None, "labialized", "nasalized"]
    assert [r["v"] for r in rows] == [False, True, False, None, False, False, True]
    assert spark.range(1).select(tx.transliterated(F.lit("čañṭk")).alias("x")).first()["x"] == "tʃaɲʈk"


def test_inventories_are_compared(spark):
    ours = spark.createDataFrame([("č", "consonant", 2.0), ("a", "vowel", 0.0), ("q", "consonant", 4.0), ("◌ʰ", "mod_consonant", 1.0), ("◌ʰʰ", "mod_consonant", 3.0)], "symbol string, class string, idf double")
    theirs = spark.createDataFrame([("tʃ", 3, 1.0), ("a", 5, 0.0), ("kʰ", 2, 3.0), ("oː", 2, 2.0), ("x", 0, None)], "symbol string, n long, idf double")
    got = {r["symbol"]: r for r in crosswalk.compared(ours, theirs).collect()}
    assert set(got) == {"č", "a", "q", "kʰ", "oː"}
    assert (got["č"]["ours_idf"], got["č"]["theirs_idf"], got["č"]["direction"], got["č"]["level"]) == (0.5, pytest.approx(1 / 3), "+", 1)
    assert (got["a"]["shift"], got["a"]["direction"]) == (0.0, "0") and not got["q"]["in_theirs"] and got["q"]["shift"] is None
    assert (got["kʰ"]["class"], got["kʰ"]["modification"], got["kʰ"]["shift"], got["kʰ"]["direction"]) == ("mod_consonant", "aspirated", -0.5, "-")
    assert (got["oː"]["class"], got["oː"]["shift"]) == ("mod_vowel", None)


@pytest.mark.parametrize("spread", [2.0, 0.0])
def test_profile_bounds_have_the_right_deviance(spark, spread):
    rng = np.random.default_rng(3)
    n, k = 12, 4
    y = spread * rng.normal(size=(n, 1)) + np.array([0, 0.5, 1.0, 0.2]) + rng.normal(size=(n, k))
    if not spread:
        y -= y.mean(axis=1, keepdims=True) * 0.9  # entities differ less than by chance
    block = spark.createDataFrame([(f"e{i}", "abcd"[j], float(y[i, j])) for i in range(n) for j in range(k)], "entity string, treatment string, value double")
    got = {r["term"]: r for r in stats.profile_intervals(block, "a").collect()}
    assert set(got) == {"b", "c", "d", "entity", "residual"}
    means, total = y.mean(axis=1), y.mean()
    se = k * ((means - total) ** 2).sum()

    def deviance(s, u, fixed=None):
        """Minus twice the log likelihood but for a constant, with one contrast held fixed."""
        t = y.mean(axis=0) - total
        if fixed:
            j, d = fixed  # the nearest treatment means with this contrast move the two apart alike
            off = (d - (t[j] - t[0])) / 2
            t = t + np.eye(k)[j] * off - np.eye(k)[0] * off
        sw = ((y - means[:, None] - t) ** 2).sum()
        w = s + k * u
        return n * (k - 1) * math.log(s) + sw / s + n * math.log(w) + se / w

    grid = np.exp(np.linspace(-5, 4, 1500))
    wide = np.concatenate([[0.0], np.exp(np.linspace(-9, 5, 700))])
    least = lambda f: min(f)
    best = least(deviance(s, u) for s in grid[::5] for u in wide[::5])
    rise = 1.959963984540054**2
    for j, term in enumerate("bcd", 1):
        for bound in ("low", "high"):
            at = least(deviance(s, u, (j, got[term][bound])) for s in grid[::5] for u in wide[::5])
            assert at - best == pytest.approx(rise, abs=0.03)
    for bound in ("low", "high"):
        s = got["residual"][bound] ** 2
        assert least(deviance(s, u) for u in wide) - best == pytest.approx(rise, abs=0.03)
        u = got["entity"][bound] ** 2
        at = least(deviance(s, u) for s in grid) - best
        assert at == pytest.approx(rise, abs=0.03) or (u == 0 and at <= rise + 0.03)
    assert spread or got["entity"]["low"] == got["entity"]["estimate"] == 0
    one = spark.createDataFrame([("e", "a", 1.0), ("e", "b", 2.0)], "entity string, treatment string, value double")
    assert stats.profile_intervals(one, "a").collect() == []


def test_counts_of_steps_need_no_job_of_their_own(spark):
    sc = spark.sparkContext
    rows = spark.createDataFrame([(k, None if k % 4 == 0 else k % 3) for k in range(40)], "id long, g int")

    def jobs(name, run):
        sc.setJobGroup(name, name)
        run()
        return len(sc.statusTracker().getJobIdsForGroup(name))

    build = lambda d: d.where("id >= 10").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    plain = jobs("plain", lambda: build(rows).collect())
    w = Watched(rows, key="id").then("late", lambda d: d.where("id >= 10"), "id").then("by g", lambda d: d.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    assert jobs("watched", lambda: w.frame.collect()) == plain
    sc.setJobGroup("rest", "rest")
    report = [tuple(r) for r in w.report().orderBy("step").collect()]
    assert report == [(0, "input", 40, 10, "0", "39", report[0][6]), (1, "late", 30, 7, "10", "39", report[1][6]), (2, "by g", 4, 1, "0", "2", 3)]
    assert abs(report[0][6] - 40) <= 4


# --- sources


@pytest.mark.parametrize("split", [None, 40, 7])
def test_records_after_a_preamble_that_runs_over_splits(spark, tmp_path, split):
    lines = [f"preamble {k} " + "x" * (3 * k) for k in range(9)] + ["", *(f"{k}\tname {k}\t{k / 2 if k % 3 else 'NA'}\t{'1' if k % 2 else 'NA'}\tmore" for k in range(60)), "60", "bad\tn\tx\ty"]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.tsv").write_text("\n".join(["p"] * 9 + ["100\tother\t1.5\t0"]))
    (tmp_path / "c.tsv").write_text("only\ntwo")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = tables.read_records(spark, str(tmp_path), "id long, name string, v double, flag int", skip=9, zero=["flag"])
        assert df.dtypes == [("id", "bigint"), ("name", "string"), ("v", "double"), ("flag", "int")]
        got = sorted(map(tuple, df.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    want = [(k, f"name {k}", k / 2 if k % 3 else None, k % 2) for k in range(60)] + [(60, None, None, 0), (None, "n", None, 0), (100, "other", 1.5, 0)]
    assert got == sorted(want, key=str)


def test_exports_bridges_and_affiliations(spark):
    rows = spark.createDataFrame([("l1", "GB1", "1"), ("l1", "GB2", "?"), ("l2", "GB1", "0"), ("l2", "GB9", "1"), ("l3", "GB9", "1"), ("l1", "GB1", "3"), (None, "GB1", "1")], "Language_ID string, Parameter_ID string, Value string")
    every = sorted(map(tuple, tables.feature_values(rows, ["gb1", "gb2"]).where("entity is not null").collect()))
    assert every == [("l1", "GB1", 1), ("l1", "GB2", None), ("l2", "GB1", 0), ("l2", "GB2", None)]
    assert {tuple(r) for r in tables.feature_values(rows, ["gb1", "gb2"], keep_null=False).collect()} == {("l1", "GB1", 1), ("l2", "GB1", 0), (None, "GB1", 1)}
    codes = spark.createDataFrame([("g1", "iso1"), ("g1", "iso0"), (None, "iso9")], "glottocode string, iso string")
    some = spark.createDataFrame([("g1", 1), ("g2", 2), (None, 3)], "glottocode string, x int")
    assert {(r["x"], r["iso"]) for r in tables.bridged(some, codes, "glottocode", "iso").collect()} == {(1, "iso0"), (2, None), (3, None)}
    tree = spark.createDataFrame([("g1", "Austronesian, Malayo-Polynesian"), ("g2", "Austro, Austronesian"), ("g3", None)], "glottocode string, affiliation string")
    assert [r["x"] for r in tables.affiliated(some, tree, "glottocode", "Austronesian").collect()] == [1]


def test_multipolygons_keep_their_rings(spark, tmp_path):
    square = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
    features = [("one", "Polygon", [square(0, 0, 4), square(1, 1, 1)]), ("many", "MultiPolygon", [[square(10, 0, 2)], [square(20, 0, 4), square(21, 1, 1)]]), ("many", "Polygon", [square(30, 0, 1)]), ("dot", "Point", [1.0, 2.0])]
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n, "pop": 3}, "geometry": {"type": k, "coordinates": c}} for n, k, c in features]}))
    rings = tables.read_polygons(spark, str(tmp_path / "p.json"))
    assert {(r["region"], r["n"], r["rings"]) for r in rings.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("rings")).collect()} == {("one", 8, 2), ("many", 16, 4)}
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 11.0, 1.0), (4, 21.5, 1.5), (5, 23.5, 1.0), (6, 30.5, 0.5), (7, 8.0, 1.0)], "id long, lon double, lat double")
    assert {tuple(r) for r in mesh.within(points, rings).collect()} == {(1, "one"), (3, "many"), (5, "many"), (6, "many")}
