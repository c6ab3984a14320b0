"""Queries of the relational verbs and figure tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithmesh.operators import graph, relational, similarity, weights
from kithmesh.plans.catalog import _BASE, _NET, _edges, _nodes, _pairs, _point, _present, _query, _roles, _scores, _sql_point, _suppliers


@_query(f"SELECT id FROM (SELECT c_custkey AS id, {_sql_point('c_custkey')} FROM customer) WHERE lat > 6 AND lat < 18 AND lon > 117 AND lon < 125")
def strict_box(t):
    return relational.strict_box(t.customer.select(F.col("c_custkey").alias("id"), *_point("c_custkey")), 6, 18, 117, 125).select("id")


@_query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AND NOT (o_orderstatus = 'O' AND o_totalprice > 100000)")
def negated_conjunctions(t):
    status = F.col("o_orderstatus")
    return relational.keep_unless(t.orders, [status == "F", F.col("o_orderpriority") == "1-URGENT"], [status == "O", F.col("o_totalprice") > 100000]).select("o_orderkey")


@_query("SELECT c_custkey FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) WHERE c_acctbal BETWEEN m - s AND m + s")
def within_one_sd(t):
    return relational.within_sd(t.customer, "c_acctbal").select("c_custkey")


@_query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def columns_by_type(t):
    return relational.columns_like(t.lineitem, "^l_", ("l_orderkey", "l_linenumber"), ("double",))


@_query("SELECT o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice FROM orders")
def guarded_prices(t):
    kept = relational.require(t.orders, F.col("o_orderkey").isNotNull(), "orders without a key")
    return relational.impute_one(kept, "o_totalprice").select("o_orderkey", "o_totalprice")


@_query("SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1")
def first_per_group(t):
    return relational.first_per_group(t.customer, ["c_nationkey"], [F.col("c_custkey")]).select("c_nationkey", "c_custkey", "c_acctbal")


@_query("SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) = 1")
def top_per_group(t):
    return relational.top_per_group(t.customer, ["c_nationkey"], "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "c_acctbal")


@_query("SELECT c AS \"column\", round(v, 6) AS variance FROM (SELECT var_samp(l_quantity) AS l_quantity, var_samp(l_discount) AS l_discount, var_samp(l_tax) AS l_tax FROM lineitem) UNPIVOT (v FOR c IN (l_quantity, l_discount, l_tax))")
def column_variance(t):
    return relational.column_variance(t.lineitem, ["l_quantity", "l_discount", "l_tax"]).withColumn("variance", F.round("variance", 6))


@_query("SELECT min(n) AS n FROM (SELECT count(*) AS n FROM part GROUP BY p_brand) WHERE n > 1")
def smallest_group(t):
    return relational.smallest_group(t.part, "p_brand")


@_query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def in_every_status(t):
    return relational.in_all(*[t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FOP"])


@_query("SELECT s_nationkey::BIGINT AS k FROM supplier UNION SELECT c_nationkey::BIGINT FROM customer")
def in_either_side(t):
    return relational.in_any(t.supplier.select(F.col("s_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")))


@_query("SELECT c_mktsegment, round(s, 9) AS stat, row_number() OVER (ORDER BY s, c_mktsegment) AS ord FROM (SELECT c_mktsegment, avg(c_acctbal) AS s FROM customer GROUP BY 1)")
def level_order(t):
    return relational.level_order(t.customer, "c_mktsegment", F.avg("c_acctbal"))


@_query("SELECT n_name, max(f) FILTER (c_mktsegment = 'BUILDING') AS BUILDING_high, max(f) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY_high FROM nation LEFT JOIN (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) > 4500 AS f FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey GROUP BY n_name")
def flags_folded_back(t):
    flags = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg((F.avg("c_acctbal") > 4500).alias("f"))
    return relational.fold_back(t.nation, flags, "n_nationkey", "c_mktsegment", "f", ["BUILDING", "MACHINERY"], "high").select("n_name", "BUILDING_high", "MACHINERY_high")


_INV = "(SELECT s_nationkey AS code, s_suppkey AS inventory, p_brand AS feature, l_discount = 0 AS marginal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"
_FREQ = f"""inv AS {_INV}, one AS (SELECT * FROM inv WHERE (code, inventory) IN (SELECT code, min(inventory) FROM inv GROUP BY code)),
kept AS (SELECT DISTINCT code, feature FROM one WHERE NOT marginal), tot AS (SELECT count(DISTINCT code) AS n_total FROM inv),
w AS (SELECT DISTINCT p_brand AS feature FROM part UNION SELECT 'Brand#none'),
f AS (SELECT feature, count(code) AS n, n_total, count(code) FILTER (code < 10) AS n_subset FROM w LEFT JOIN kept USING (feature) CROSS JOIN tot GROUP BY feature, n_total)"""


def _inventories(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("s_nationkey").alias("code"), F.col("s_suppkey").alias("inventory"), F.col("p_brand").alias("feature"), (F.col("l_discount") == 0).alias("marginal"))


def _frequencies(t):
    wanted = t.part.select(F.col("p_brand").alias("feature")).unionByName(t.spark.createDataFrame([("Brand#none",)], "feature string"))
    return relational.frequency_table(_inventories(t), wanted, F.col("code") < 10)


@_query(f"WITH {_FREQ} SELECT feature, n, n_total, round(n / n_total, 9) AS freq, n_subset, CASE WHEN n > 0 THEN round(ln((n_total + 1) / (n + 1)), 9) END AS idf FROM f")
def frequency_table(t):
    return _frequencies(t)


@_query(f"""WITH {_FREQ}, a AS (SELECT feature, ln((n_total + 1) / (n + 1)) AS idf FROM f WHERE n > 0), z AS (SELECT count(*) AS z FROM part),
b AS (SELECT p_brand AS feature, ln((z + 1) / (count(*) + 1)) AS other FROM part CROSS JOIN z GROUP BY p_brand, z), j AS (SELECT * FROM a JOIN b USING (feature)),
s AS (SELECT feature, idf, other, round((other - min(other) OVER ()) / nullif(max(other) OVER () - min(other) OVER (), 0) - (idf - min(idf) OVER ()) / nullif(max(idf) OVER () - min(idf) OVER (), 0), 12) AS shift FROM j)
SELECT feature, round(idf, 9) AS idf, round(other, 9) AS other, round(shift, 9) AS shift, CASE WHEN shift > 0 THEN 'rarer' WHEN shift < 0 THEN 'commoner' WHEN shift = 0 THEN 'same' END AS direction FROM s""")
def idf_shift(t):
    brands = t.part.groupBy(F.col("p_brand").alias("symbol")).agg(F.count(F.lit(1)).alias("n")).crossJoin(t.part.agg(F.count(F.lit(1)).alias("z")))
    theirs = brands.select(F.upper("symbol").alias("symbol"), F.log((F.col("z") + 1) / (F.col("n") + 1)).alias("idf"))
    crosswalk = t.part.select(F.col("p_brand").alias("feature"), F.col("p_brand").alias("symbol")).distinct()
    return relational.idf_shift(_frequencies(t).select("feature", "idf"), theirs, crosswalk, F.upper)


@_query(_BASE + """, nul AS (SELECT i, j, v, family, 1 / count(*) OVER (PARTITION BY i, family) AS w FROM pairs WHERE role = 'control'),
rc AS (SELECT i, median(v) + 2 * stddev_samp(v) AS cut FROM nul GROUP BY i), raw AS (SELECT j, count(*) FILTER (v > cut) AS a FROM nul JOIN rc USING (i) GROUP BY j),
sh AS (SELECT *, w / sum(w) OVER (PARTITION BY i) AS s FROM nul), cu AS (SELECT *, sum(s) OVER (PARTITION BY i ORDER BY v, j ROWS UNBOUNDED PRECEDING) AS c FROM sh),
wc AS (SELECT i, min(v) FILTER (c >= 0.5 - 1e-12) + 2 * sqrt((sum(s * v * v) - sum(s * v) ** 2) / (1 - sum(s * s))) AS cut FROM cu GROUP BY i),
wei AS (SELECT j, count(*) FILTER (v > cut) AS b FROM nul JOIN wc USING (i) GROUP BY j), fam AS (SELECT entity AS j, family, count(*) OVER (PARTITION BY family) AS size FROM roles WHERE role = 'control' AND entity IN (SELECT entity FROM pres))
SELECT j AS entity, coalesce(a, 0) AS n_raw, coalesce(b, 0) AS n_weighted, family, size, coalesce(b, 0) - coalesce(a, 0) AS delta FROM raw FULL JOIN wei USING (j) LEFT JOIN fam USING (j)""")
def tally_comparison(t):
    controls = _roles(t).where("role = 'control'").join(_present(t).select("entity").distinct(), "entity", "left_semi")
    nulls = _pairs(t, "role = 'control'")
    return relational.compared_tallies(similarity.skew_outliers(nulls), similarity.weighted_null(nulls, weights.group_weights(controls, "family")), controls)


@_query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status FROM orders")
def named_lookup(t):
    return t.orders.select("o_orderkey", relational.named(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"))


@_query()
def qq_points(t):
    return relational.qq_points(_pairs(t, "role = 'control'").select("i", "v"), "i", "v")


@_query("SELECT -max(abs(c_acctbal - 4500)) AS low, max(abs(c_acctbal - 4500)) AS high FROM customer")
def symmetric_limits(t):
    return relational.symmetric_limits(t.customer.select((F.col("c_acctbal") - 4500).alias("v")), "v")


@_query(_NET + "SELECT src, dst, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM e JOIN nd a ON a.id = src JOIN nd b ON b.id = dst")
def network_segments(t):
    return relational.segments(_edges(t), _nodes(t))


@_query(_NET + "SELECT node, count(*) AS n, round(avg(s_acctbal), 9) AS mean FROM nn JOIN supplier ON s_suppkey = id GROUP BY node")
def samples_per_node(t):
    return relational.per_node(t.supplier.select(F.col("s_suppkey").alias("id"), "s_acctbal"), graph.nearest(_suppliers(t), _nodes(t)), "s_acctbal")


@_query(_BASE + "SELECT entity, feature, round(2 * idf, 9) AS value FROM pres JOIN idf USING (feature)")
def pseudo_genotypes(t):
    p = _present(t)
    return relational.pseudo_genotypes(p, weights.idf(p))


@_query(_BASE + "SELECT s.study, round(max(score) FILTER (baseline = 'control'), 9) AS control_score, count(*) FILTER (score > 0.05) AS n_over FROM scores s GROUP BY s.study")
def scores_by_entity(t):
    s = _scores(t)
    return s.groupBy("study").agg(F.max(F.when(F.col("baseline") == "control", F.col("score"))).alias("control_score"), F.count_if(F.col("score") > 0.05).alias("n_over"))


@_query("SELECT n_nationkey::BIGINT AS i, r_regionkey::BIGINT AS j FROM nation CROSS JOIN region WHERE n_regionkey <> r_regionkey")
def ordered_pairs(t):
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") != F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("i"), F.col("r_regionkey").cast("long").alias("j"))


@_query("WITH v AS (SELECT p_retailprice AS v, (SELECT quantile_cont(p_retailprice, 0.9) FROM part) AS cut FROM part) SELECT count(*) AS n, count(*) FILTER (v >= cut) AS n_over, round(max(cut), 9) AS cut FROM v")
def tail_cutoff(t):
    cut = t.part.agg(F.percentile("p_retailprice", F.lit(0.9)).alias("cut"))
    return t.part.crossJoin(F.broadcast(cut)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_retailprice") >= F.col("cut")).alias("n_over"), F.max("cut").alias("cut"))
