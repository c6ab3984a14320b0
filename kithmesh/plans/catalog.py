"""All registered queries of the library proper over the driver's tables, with equivalent DuckDB SQL.

Doubles are rounded to 9 digits on both sides: sums are taken in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithmesh.functions import text as tx
from kithmesh.operators import cluster, graph, models, similarity, stats, surface, tree, weights
from kithmesh.sources.tables import exclude_box

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _rounded(f(_Tables(spark, sf_dir)))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from kithmesh.plans import inventories, structures, verbs  # noqa: F401  register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from kithmesh.plans import inventories, structures, verbs  # noqa: F401

    return dict(_SQL)


# --- entities, features and roles -----------------------------------------------------------------------------------------


def _present(t: _Tables) -> DataFrame:
    """entity: nation and segment of the customer; feature: brand, type and size of a part that it bought."""
    rows = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(t.part.select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return weights.presence(rows.select(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("e"), F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("f")), "e", "f")


def _roles(t: _Tables) -> DataFrame:
    role = F.when(F.col("n_regionkey") == 0, "study").when(F.col("n_nationkey") == 1, "interest").otherwise("control")
    rows = t.customer.select("c_nationkey", "c_mktsegment").distinct().join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("entity"), role.alias("role"), F.col("n_regionkey").cast("long").alias("family"))


def _vectors(t: _Tables) -> DataFrame:
    p = _present(t)
    return similarity.weighted(p, weights.idf(p))


def _pairs(t: _Tables, other: str = "role <> 'study'") -> DataFrame:
    r = _roles(t)
    return similarity.cosine(_vectors(t), r.where("role = 'study'"), r.where(other))


def _scores(t: _Tables) -> DataFrame:
    return similarity.role_scores(_pairs(t), _roles(t))


_BASE = """WITH pres AS (SELECT DISTINCT c_nationkey::VARCHAR || '|' || c_mktsegment AS entity, p_brand || '|' || p_type || '|' || p_size::VARCHAR AS feature
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
roles AS (SELECT DISTINCT c_nationkey::VARCHAR || '|' || c_mktsegment AS entity, n_regionkey::BIGINT AS family,
  CASE WHEN n_regionkey = 0 THEN 'study' WHEN n_nationkey = 1 THEN 'interest' ELSE 'control' END AS role FROM customer JOIN nation ON c_nationkey = n_nationkey),
total AS (SELECT count(DISTINCT entity) AS n_total FROM pres),
idf AS (SELECT feature, count(*) AS n, n_total, count(*) / n_total AS freq, ln((n_total + 1) / (count(*) + 1)) AS idf FROM pres, total GROUP BY feature, n_total),
vec AS (SELECT entity, feature, idf AS v FROM pres JOIN idf USING (feature) WHERE idf <> 0),
norm AS (SELECT entity, sqrt(sum(v * v)) AS norm FROM vec GROUP BY entity),
dots AS (SELECT a.entity AS i, b.entity AS j, sum(a.v * b.v) AS dot FROM vec a JOIN roles r ON a.entity = r.entity AND r.role = 'study' JOIN vec b USING (feature) GROUP BY ALL),
sims AS (SELECT x.entity AS i, y.entity AS j, coalesce(dot, 0) / (x.norm * y.norm + 1e-9) AS v FROM norm x JOIN roles r ON x.entity = r.entity AND r.role = 'study'
  CROSS JOIN norm y LEFT JOIN dots ON i = x.entity AND j = y.entity),
pairs AS (SELECT s.i, s.j, s.v, r.role, r.family FROM sims s JOIN roles r ON s.j = r.entity AND r.role <> 'study'),
scores AS (SELECT i AS study, j AS baseline, v AS score FROM pairs WHERE role = 'interest' UNION ALL
  SELECT i, 'control', avg(v) FROM pairs WHERE role = 'control' GROUP BY i),
deltas AS (SELECT s.study, s.baseline, s.score - c.score AS delta FROM scores s JOIN scores c ON s.study = c.study AND c.baseline = 'control' WHERE s.baseline <> 'control')
"""


@_query(_BASE + "SELECT entity, feature FROM pres")
def feature_presence(t):
    return _present(t)


@_query(_BASE + "SELECT feature, n, n_total, round(freq, 9) AS freq, round(idf, 9) AS idf FROM idf")
def idf_laplace(t):
    return weights.idf(_present(t))


_PART = "(SELECT p_partkey AS entity, 'brand' AS feature, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part)"


def _part_long(t: _Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))
    return p.unpivot("entity", ["brand", "type", "size"], "feature", "value")


@_query(f"SELECT feature, value, count(*) AS n, round(count(*) / t, 9) AS freq, round(ln(1 / (count(*) / t)), 9) AS idf FROM {_PART} JOIN (SELECT count(*) AS t FROM part) ON TRUE GROUP BY feature, value, t")
def idf_feature_value(t):
    return weights.idf_by_value(_part_long(t))


@_query(_BASE + "SELECT 'feature' AS side, feature AS key, count(*) AS n FROM pres GROUP BY feature UNION ALL SELECT 'entity', entity, count(*) FROM pres GROUP BY entity")
def coverage_counts(t):
    long = _present(t).withColumn("value", F.lit(1))
    side = lambda c: weights.coverage(long, c).select(F.lit(c).alias("side"), F.col(c).alias("key"), "n")
    return side("feature").unionByName(side("entity"))


_ROUND = """f{k} AS (SELECT feature FROM p{p} GROUP BY feature HAVING count(*) >= 8), q{k} AS (SELECT * FROM p{p} SEMI JOIN f{k} USING (feature)),
e{k} AS (SELECT entity FROM q{k} GROUP BY entity HAVING count(*) >= 40), p{k} AS (SELECT * FROM q{k} SEMI JOIN e{k} USING (entity))"""


@_query(_BASE + ", p0 AS (SELECT * FROM pres), " + _ROUND.format(k=1, p=0) + ", " + _ROUND.format(k=2, p=1) + " SELECT entity, feature FROM p2")
def coverage_prune(t):
    return weights.coverage_prune(_present(t).withColumn("value", F.lit(1)), 8, 40, 2).select("entity", "feature")


@_query("SELECT p_partkey AS entity, 'type_' || l AS feature, (p_type = l)::BIGINT AS value FROM part, (SELECT DISTINCT p_type AS l FROM part)")
def one_hot(t):
    return weights.one_hot(_part_long(t).where("feature = 'type'"))


@_query("SELECT DISTINCT 'brand_code_' || p_brand AS name, 'brand_code' AS base, p_brand AS level FROM part")
def parse_dummy(t):
    names = t.part.select(F.concat(F.lit("brand_code_"), "p_brand").alias("name")).distinct()
    base, level = tx.dummy_parts(F.col("name"))
    return names.select("name", base.alias("base"), level.alias("level"))


@_query(_BASE + "SELECT i, j, round(v, 9) AS v FROM pairs")
def weighted_cosine(t):
    return _pairs(t)


_CELLS = """WITH c AS (SELECT p_brand AS entity, p_type AS feature, count(*) AS n FROM part GROUP BY ALL), cells AS (SELECT entity, feature, CASE WHEN n % 7 = 0 THEN NULL ELSE (n % 2)::BIGINT END AS value FROM c),
wt AS (SELECT feature, value, ln(1 / (count(*) / sum(count(*)) OVER (PARTITION BY feature))) AS w FROM cells GROUP BY feature, value),
vec AS (SELECT entity, feature, w AS v FROM cells JOIN wt USING (feature, value))"""


def _cells(t: _Tables) -> DataFrame:
    c = t.part.groupBy(F.col("p_brand").alias("entity"), F.col("p_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("entity", "feature", F.when(F.col("n") % 7 != 0, F.col("n") % 2).alias("value"))


@_query(_CELLS + ", s AS (SELECT a.entity AS i, b.entity AS j, sum(a.v * b.v) AS d, sum(a.v * a.v) AS p, sum(b.v * b.v) AS q FROM vec a JOIN vec b USING (feature) WHERE a.entity <= b.entity GROUP BY ALL), e AS (SELECT DISTINCT entity FROM cells) SELECT x.entity AS i, y.entity AS j, round(d / (sqrt(p) * sqrt(q) + 1e-9), 9) AS v FROM e x JOIN e y ON x.entity <= y.entity LEFT JOIN s ON s.i = x.entity AND s.j = y.entity")
def weighted_cosine_pairwise_na(t):
    c = _cells(t)
    return similarity.cosine_pairwise(similarity.substitute(c, weights.idf_by_value(c)))


@_query(_BASE + "SELECT study, baseline, round(score, 9) AS score FROM scores")
def baseline_scores(t):
    return _scores(t)


@_query(_BASE + "SELECT study, baseline, round(delta, 9) AS delta FROM deltas")
def delta_over_control(t):
    return similarity.over_control(_scores(t))


@_query(_BASE + """, un AS (SELECT entity, feature, v / norm AS u FROM vec JOIN norm USING (entity)), core AS (SELECT entity FROM roles WHERE role = 'study'),
cen AS (SELECT feature, sum(u) / (SELECT count(*) FROM core) AS c FROM un SEMI JOIN core USING (entity) GROUP BY feature),
one AS (SELECT entity, feature, u * c AS x FROM un JOIN cen USING (feature) SEMI JOIN (SELECT entity FROM roles WHERE role = 'interest') USING (entity))
SELECT entity, feature, round(x, 9) AS contribution, round(x / sum(x) OVER (PARTITION BY entity), 9) AS share, row_number() OVER (PARTITION BY entity ORDER BY x DESC, feature) AS rank FROM one""")
def contribution_decomposition(t):
    r = _roles(t)
    return similarity.contributions(_vectors(t), r.where("role = 'study'"), r.where("role = 'interest'"))


@_query(_BASE + "SELECT j, round(avg(v), 9) AS mean, rank() OVER (ORDER BY avg(v) DESC) AS rank FROM pairs GROUP BY j")
def similarity_rank(t):
    return similarity.core_rank(_pairs(t), _roles(t).where("role = 'study'"))


@_query(_BASE + """, h AS (SELECT feature, count(*) FILTER (role = 'study') AS s, count(*) FILTER (role = 'interest') AS n, count(*) FILTER (role = 'control') AS c FROM pres JOIN roles USING (entity) GROUP BY feature),
z AS (SELECT count(*) FILTER (role = 'study') AS zs, count(*) FILTER (role = 'interest') AS zn, count(*) FILTER (role = 'control') AS zc FROM roles),
d AS (SELECT feature, idf, s / zs AS p, h.n / zn AS pi, c / zc AS q, h.n AS n FROM h JOIN idf USING (feature) CROSS JOIN z), l AS (SELECT *, CASE WHEN p > 0 THEN pow(idf, 6) * q * (1 - q) * (1 - 2 * q) ELSE 0 END AS lev FROM d),
c AS (SELECT quantile_cont(lev, 0.9) AS cut FROM l WHERE p > 0 AND q > 0)
SELECT feature, round(idf, 9) AS idf, round(p, 9) AS p_study, round(pi, 9) AS p_interest, round(q, 9) AS p_control, round(p * (1 - p), 9) AS variance, CASE WHEN q > 0 THEN n ELSE 0 END AS n_shared, q > 0 AND n = 0 AS control_only,
round(lev, 9) AS leverage, coalesce(lev >= cut, FALSE) AS high, CASE WHEN lev >= cut AND n > 0 THEN 'both' WHEN lev >= cut THEN 'control tail' WHEN n > 0 THEN 'interest' ELSE 'neither' END AS flag FROM l CROSS JOIN c""")
def driver_table(t):
    p = _present(t)
    return similarity.drivers(p, _roles(t), weights.idf(p))


@_query(_BASE + ", nul AS (SELECT i, j, v FROM pairs WHERE role = 'control'), cut AS (SELECT i, median(v) + 2 * stddev_samp(v) AS cut FROM nul GROUP BY i) SELECT j, count(*) FILTER (v > cut) AS n_exceed FROM nul JOIN cut USING (i) GROUP BY j")
def skew_candidates(t):
    return similarity.skew_outliers(_pairs(t, "role = 'control'"))


@_query(_BASE + """, nul AS (SELECT i, j, v, 1 / count(*) OVER (PARTITION BY i, family) AS w FROM pairs WHERE role = 'control'),
sh AS (SELECT *, w / sum(w) OVER (PARTITION BY i) AS s FROM nul), cu AS (SELECT *, sum(s) OVER (PARTITION BY i ORDER BY v, j ROWS UNBOUNDED PRECEDING) AS c FROM sh),
cut AS (SELECT i, min(v) FILTER (c >= 0.5 - 1e-12) + 2 * sqrt((sum(s * v * v) - sum(s * v) ** 2) / (1 - sum(s * s))) AS cut FROM cu GROUP BY i)
SELECT j, count(*) FILTER (v > cut) AS n_exceed FROM nul JOIN cut USING (i) GROUP BY j""")
def family_weighted_null(t):
    controls = _roles(t).where("role = 'control'").join(_present(t).select("entity").distinct(), "entity", "left_semi")
    return similarity.weighted_null(_pairs(t, "role = 'control'"), weights.group_weights(controls, "family"))


_EMP = """, e AS (SELECT s.study AS i, s.baseline, s.score, (1 + count(*) FILTER (p.v >= s.score)) / (count(*) + 1) AS p, (s.score - avg(p.v)) / stddev_samp(p.v) AS z
  FROM scores s JOIN pairs p ON p.i = s.study AND p.role = 'control' WHERE s.baseline <> 'control' GROUP BY s.study, s.baseline, s.score),
b AS (SELECT *, p * count(*) OVER (PARTITION BY baseline) / count(*) OVER (PARTITION BY baseline ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM e),
a AS (SELECT *, least(1, min(raw) OVER (PARTITION BY baseline ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS adj FROM b)
SELECT i, baseline, round(score, 9) AS score, round(p, 9) AS p, round(z, 9) AS z, round(1 - p, 9) AS percentile, round(adj, 9) AS p_adj, adj < 0.05 AS significant FROM a"""


@_query(_BASE + _EMP)
def empirical_p_bh(t):
    pairs, roles = _pairs(t), _roles(t)
    nulls = pairs.join(roles.where("role = 'control'").select(F.col("entity").alias("j")), "j", "left_semi")
    seen = pairs.join(roles.where("role = 'interest'").select(F.col("entity").alias("j")), "j", "left_semi").select("i", F.col("j").alias("baseline"), F.col("v").alias("score"))
    return stats.empirical_upper(nulls, seen)


# --- tests on a balanced block: brands by return flag ------------------------------------------------------------------------

_BLOCK = "WITH blk AS (SELECT p_brand AS entity, l_returnflag AS treatment, avg(l_discount) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_ANOVA = """, g AS (SELECT avg(value) AS gm, count(DISTINCT entity) AS n, count(DISTINCT treatment) AS k FROM blk), em AS (SELECT entity, avg(value) AS em FROM blk GROUP BY entity), tm AS (SELECT treatment, avg(value) AS tm FROM blk GROUP BY treatment),
ss AS (SELECT gm, n, k, k * (SELECT sum((em - gm) ** 2) FROM em) AS se, n * (SELECT sum((tm - gm) ** 2) FROM tm) AS st, (SELECT sum((value - gm) ** 2) FROM blk) AS sa FROM g),
ms AS (SELECT *, se / (n - 1) AS me, (sa - se - st) / ((n - 1) * (k - 1)) AS mr FROM ss),
vc AS (SELECT *, CASE WHEN me <= mr THEN (sa - st) / ((n - 1) * k) ELSE mr END AS s2, CASE WHEN me <= mr THEN 0 ELSE (me - mr) / k END AS su2 FROM ms)"""


def _block(t: _Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_returnflag", "l_discount").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("entity"), F.col("l_returnflag").alias("treatment")).agg(F.avg("l_discount").alias("value"))


@_query(_BLOCK + ", r AS (SELECT *, rank() OVER (PARTITION BY entity ORDER BY value) + (count(*) OVER (PARTITION BY entity, value) - 1) / 2 AS r FROM blk), s AS (SELECT treatment, sum(r) AS s FROM r GROUP BY treatment), c AS (SELECT count(DISTINCT entity) AS n, count(DISTINCT treatment) AS k FROM blk) SELECT n, k, round(12 * sum(s * s) / (n * k * (k + 1)) - 3 * n * (k + 1), 9) AS chi2, round((12 * sum(s * s) / (n * k * (k + 1)) - 3 * n * (k + 1)) / (n * (k - 1)), 9) AS w, round(exp(-(12 * sum(s * s) / (n * k * (k + 1)) - 3 * n * (k + 1)) / 2), 9) AS p FROM s, c GROUP BY n, k")
def friedman(t):
    return stats.friedman(_block(t))  # three treatments: two degrees of freedom


@_query(_BASE + ", d AS (SELECT baseline, delta, rank() OVER (PARTITION BY baseline ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY baseline, abs(delta)) - 1) / 2 AS r FROM deltas WHERE delta <> 0) SELECT baseline, count(*) AS n, round(sum(CASE WHEN delta > 0 THEN r ELSE 0 END), 9) AS v, round(2 * sum(CASE WHEN delta > 0 THEN r ELSE 0 END) / (count(*) * (count(*) + 1) / 2) - 1, 9) AS r FROM d GROUP BY baseline")
def wilcoxon_stat(t):
    return stats.signed_rank(similarity.over_control(_scores(t))).drop("p", "p_adj")


@_query()
def wilcoxon_p(t):
    return stats.signed_rank(similarity.over_control(_scores(t)))


# Student's t with an even number of degrees of freedom has a finite series.
@_query(_BLOCK + _ANOVA + """, c AS (SELECT treatment, tm - (SELECT tm FROM tm WHERE treatment = 'A') AS est FROM tm WHERE treatment <> 'A'),
x AS (SELECT * EXCLUDE (se), sqrt(2 * s2 / n) AS se, (n - 1) * (k - 1) AS df, est / sqrt(2 * s2 / n) AS t FROM c, vc),
p AS (SELECT *, 1 - abs(t) / sqrt(df + t * t) * (SELECT sum(exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(df / (df + t * t), j)) FROM (SELECT unnest(range(df // 2)) AS j)) AS p FROM x),
b AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM p), a AS (SELECT *, least(1, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS adj FROM b)
SELECT treatment, round(est, 9) AS estimate, round(se, 9) AS se, df, round(t, 9) AS t, round(est / sqrt(s2), 9) AS d, round(su2 / (s2 + su2), 9) AS icc, round(s2, 9) AS s2, round(su2, 9) AS su2, round(p, 9) AS p, round(adj, 9) AS p_adj, adj < 0.05 AS reject FROM a""")
def lmm_balanced(t):
    return stats.mixed_model(_block(t), "A")


@_query(_BLOCK + _ANOVA + " SELECT entity, round(k * su2 / (k * su2 + s2) * (em - gm), 9) AS blup FROM em, vc")
def lmm_blup(t):
    return stats.random_intercepts(_block(t))


@_query("WITH f AS (SELECT p_brand AS entity, avg(l_quantity) > 25.5 AS a, avg(l_discount) > 0.05 AS b, avg(l_tax) > 0.04 AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand), r AS (SELECT entity, coalesce(nullif(concat_ws('&', CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END, CASE WHEN c THEN 'c' END), ''), 'none') AS region FROM f) SELECT region, count(*) AS n, string_agg(entity, ', ' ORDER BY entity) AS members FROM r GROUP BY region")
def venn_regions(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("entity"))
    return stats.regions(rows.agg((F.avg("l_quantity") > 25.5).alias("a"), (F.avg("l_discount") > 0.05).alias("b"), (F.avg("l_tax") > 0.04).alias("c")), ["a", "b", "c"])


@_query()
def gmm_bic(t):
    d = similarity.over_control(_scores(t))
    return stats.mixtures(d.select("baseline", F.col("study").alias("entity"), "delta"), "baseline", "delta")


@_query()
def gmm_summary(t):
    return stats.mixture_summary(similarity.over_control(_scores(t)).select("baseline", "delta"), "baseline", "delta")


@_query()
def shapiro_wilk(t):
    return stats.shapiro(_pairs(t, "role = 'control'").select("i", "v"), "i", "v")


@_query("WITH r AS (SELECT c_mktsegment AS g, c_acctbal AS v, (1 + c_nationkey)::DOUBLE AS w FROM customer), s AS (SELECT g, v, w / sum(w) OVER (PARTITION BY g) AS s FROM r), c AS (SELECT *, sum(s) OVER (PARTITION BY g ORDER BY v RANGE UNBOUNDED PRECEDING) AS c FROM s) SELECT g, round(sum(s * v), 6) AS w_mean, round(sqrt((sum(s * v * v) - sum(s * v) ** 2) / (1 - sum(s * s))), 6) AS w_sd, round(min(v) FILTER (c >= 0.5 - 1e-12), 6) AS w_median FROM c GROUP BY g")
def weighted_summary(t):
    rows = t.customer.select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("v"), (1 + F.col("c_nationkey")).cast("double").alias("w"))
    s = stats.weighted_stats(rows, ["g"], "v", "w")
    return s.select("g", *[F.round(c, 6).alias(c) for c in ("w_mean", "w_sd", "w_median")])


# --- network of nations ---------------------------------------------------------------------------------------------------

_LAT, _LON = "4.5 + ({k} * 37 % 1650) / 100.0", "115 + ({k} * 53 % 1300) / 100.0"


def _sql_point(key: str) -> str:
    return f"(4.5 + ({key} * 37 % 1650) / 100.0)::DOUBLE AS lat, (115 + ({key} * 53 % 1300) / 100.0)::DOUBLE AS lon"


def _point(key: str) -> list:
    k = F.col(key).cast("long")
    return [(4.5 + (k * 37 % 1650) / 100.0).alias("lat"), (115 + (k * 53 % 1300) / 100.0).alias("lon")]


def _sql_hav(a: str, b: str) -> str:
    return f"2 * 6378137.0 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"


_NET = f"""WITH RECURSIVE nd AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS route, {_sql_point("n_nationkey")} FROM nation),
br AS (SELECT min(id) AS src, lead(min(id)) OVER (ORDER BY route) AS dst FROM nd GROUP BY route),
ed AS (SELECT id AS src, lead(id) OVER (PARTITION BY route ORDER BY id) AS dst FROM nd UNION ALL SELECT src, dst FROM br),
e AS (SELECT src, dst, {_sql_hav("a", "b")} AS cost FROM ed JOIN nd a ON a.id = src JOIN nd b ON b.id = dst WHERE dst IS NOT NULL),
bi AS (SELECT src, dst, cost FROM e UNION ALL SELECT dst, src, cost FROM e),
walk AS (SELECT id AS src, id AS dst, -1::BIGINT AS prev, 0.0::DOUBLE AS cost FROM nd UNION ALL SELECT w.src, bi.dst, w.dst, w.cost + bi.cost FROM walk w JOIN bi ON bi.src = w.dst AND bi.dst <> w.prev),
sup AS (SELECT s_suppkey AS id, {_sql_point("s_suppkey")} FROM supplier),
ns AS (SELECT s.id, n.id AS node, {_sql_hav("s", "n")} AS d FROM sup s CROSS JOIN nd n), nn AS (SELECT id, arg_min(node, d) AS node, min(d) AS d FROM ns GROUP BY id)
"""


def _nodes(t: _Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("route"), *_point("n_nationkey"))


def _suppliers(t: _Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("id"), *_point("s_suppkey"))


def _edges(t: _Tables) -> DataFrame:
    from pyspark.sql import Window

    n = _nodes(t)
    firsts = n.groupBy("route").agg(F.min("id").alias("src"))
    bridges = firsts.withColumn("dst", F.lead("src").over(Window.orderBy("route"))).where("dst is not null").select("src", "dst")
    return graph.edge_costs(graph.route_edges(n, bridges), n)


@_query(_NET + "SELECT src, dst, round(cost, 6) AS cost FROM e")
def route_edges(t):
    return _edges(t).withColumn("cost", F.round("cost", 6))


@_query(_NET + "SELECT src, dst, round(cost, 6) AS cost FROM bi")
def bidirectional_edges(t):
    return graph.both_ways(_edges(t)).withColumn("cost", F.round("cost", 6))


@_query(_NET + f"SELECT a.id AS i, b.id AS j, round({_sql_hav('a', 'b')}, 6) AS v FROM nd a JOIN nd b ON a.id < b.id")
def haversine_pairs(t):
    n = _nodes(t)
    a, b = n.select(F.col("id").alias("i"), F.col("lat").alias("la"), F.col("lon").alias("lo")), F.broadcast(n.select(F.col("id").alias("j"), F.col("lat").alias("lb"), F.col("lon").alias("lp")))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", F.round(graph.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), 6).alias("v"))


@_query(_NET + "SELECT id, round(d, 6) AS distance FROM nn")
def nearest_node(t):
    return graph.nearest(_suppliers(t), _nodes(t)).select("id", F.round("distance", 6).alias("distance"))


@_query(_NET + "SELECT dst AS id, round(cost, 6) AS cost FROM walk WHERE src = 0")
def sssp(t):
    return graph.path_costs(_edges(t), 0).withColumn("cost", F.round("cost", 6))


@_query(_NET + "SELECT src, dst, round(cost, 6) AS cost FROM walk")
def all_pairs_paths(t):
    return graph.all_pairs(_edges(t)).withColumn("cost", F.round("cost", 6))


_RECT = ("116 + 2.5 * {r}", "117.5 + 2.5 * {r}", "6 + {r}", "13 + {r}")  # west, east, south, north of a region's land


def _land(t: _Tables) -> list[list[tuple[float, float]]]:
    """A rectangle of land for each region."""
    rows = t.region.select(*[F.expr(x.format(r="r_regionkey")).cast("double").alias(n) for x, n in zip(_RECT, "wesn", strict=True)]).orderBy("w").collect()
    return [[(r["w"], r["s"]), (r["e"], r["s"]), (r["e"], r["n"]), (r["w"], r["n"])] for r in rows]


def _sql_cost(name: str, seg: str) -> str:
    """CTEs that give `name`(id, land, cost) of the segments seg(id, lon1, lat1, lon2, lat2): clipped at each rectangle's four lines."""
    w, e, s, n = (x.format(r="r_regionkey") for x in _RECT)
    side = lambda t, at, lo, hi: f"CASE WHEN {t} > 0 AND {t} < 1 AND {at} BETWEEN {lo} AND {hi} THEN {t} END"
    tx = lambda x: f"(({x}) - lon1) / nullif(lon2 - lon1, 0)"
    ty = lambda y: f"(({y}) - lat1) / nullif(lat2 - lat1, 0)"
    cuts = ", ".join([*[side(tx(x), f"lat1 + {tx(x)} * (lat2 - lat1)", s, n) for x in (w, e)], *[side(ty(y), f"lon1 + {ty(y)} * (lon2 - lon1)", w, e) for y in (s, n)]])
    point = lambda t: f"radians(lat1 + {t} * (lat2 - lat1)) AS y_{t}, radians(lon1 + {t} * (lon2 - lon1)) AS x_{t}"
    return f"""{name}_t AS (SELECT DISTINCT id, t FROM (SELECT id, unnest([0.0, 1.0, {cuts}]) AS t FROM {seg} CROSS JOIN region) WHERE t IS NOT NULL),
{name}_p AS (SELECT id, t AS a, lead(t) OVER (PARTITION BY id ORDER BY t) AS b FROM {name}_t),
{name}_q AS (SELECT p.id, {point("a")}, {point("b")}, EXISTS (SELECT 1 FROM region WHERE lon1 + (a + b) / 2 * (lon2 - lon1) BETWEEN {w} AND {e} AND lat1 + (a + b) / 2 * (lat2 - lat1) BETWEEN {s} AND {n}) AS land FROM {name}_p p JOIN {seg} USING (id) WHERE b IS NOT NULL),
{name}_l AS (SELECT id, land, 2 * 6371010.0 * asin(least(1.0, sqrt(pow(sin((y_b - y_a) / 2), 2) + cos(y_a) * cos(y_b) * pow(sin((x_b - x_a) / 2), 2)))) AS d FROM {name}_q),
{name} AS (SELECT id, coalesce(sum(d) FILTER (land), 0) AS land, sum(CASE WHEN land THEN 4.44 * d ELSE d END) AS cost FROM {name}_l GROUP BY id)"""


_PENALISED = _NET.rstrip() + f""",
eseg AS (SELECT {{'s': src, 'd': dst}} AS id, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM (SELECT DISTINCT src, dst FROM bi) JOIN nd a ON a.id = src JOIN nd b ON b.id = dst),
{_sql_cost("ec", "eseg")}, pe AS (SELECT id.s AS src, id.d AS dst, cost, land > 0 AS crosses_land FROM ec),
trail AS (SELECT id AS src, id AS dst, 0.0::DOUBLE AS cost, [id] AS path FROM nd UNION ALL SELECT w.src, pe.dst, w.cost + pe.cost, list_append(w.path, pe.dst) FROM trail w JOIN pe ON pe.src = w.dst AND NOT list_contains(w.path, pe.dst)),
cseg AS (SELECT s.id, s.lon AS lon1, s.lat AS lat1, n.lon AS lon2, n.lat AS lat2 FROM sup s JOIN nn USING (id) JOIN nd n ON n.id = nn.node), {_sql_cost("cc", "cseg")},
near AS (SELECT id, node, cost FROM cc JOIN nn USING (id))"""


def _penalised(t: _Tables) -> DataFrame:
    return graph.penalised_edges(_edges(t), _nodes(t), _land(t))


@_query(_PENALISED + " SELECT src, dst, round(cost, 6) AS cost, crosses_land FROM pe")
def penalised_edges(t):
    return _penalised(t).withColumn("cost", F.round("cost", 6))


@_query(_PENALISED + " SELECT src, dst, round(cost, 6) AS cost, array_to_string(path, '-') AS path FROM trail")
def traced_paths(t):
    return graph.traced_paths(_penalised(t)).select("src", "dst", F.round("cost", 6).alias("cost"), F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@_query(_PENALISED + f""", hub AS (SELECT arg_min(id, {_sql_hav("nd", "m")}) AS hub FROM nd CROSS JOIN (SELECT 14.6::DOUBLE AS lat, 121.0::DOUBLE AS lon) m),
mseg AS (SELECT id, lon AS lon1, lat AS lat1, 121.0::DOUBLE AS lon2, 14.6::DOUBLE AS lat2 FROM sup), {_sql_cost("mc", "mseg")},
h AS (SELECT near.id, node, near.cost / 1000 AS h1, near.cost / 1000 + w.cost / 1000 AS through, mc.cost / 1000 AS direct FROM near JOIN mc USING (id) CROSS JOIN hub LEFT JOIN trail w ON w.src = node AND w.dst = hub)
SELECT id, node, round(h1, 6) AS h1, round(least(through, direct), 6) AS h2, coalesce(through < direct, FALSE) AS using_network FROM h""")
def h1_h2_distance(t):
    d = graph.network_distances(_suppliers(t), _nodes(t), graph.all_pairs(_penalised(t)), _land(t), 14.6, 121.0)
    return d.withColumn("h1", F.round("h1", 6)).withColumn("h2", F.round("h2", 6))


@_query(_PENALISED + " SELECT a.id AS i, b.id AS j, round(coalesce((a.cost + b.cost + (w.cost + v.cost) / 2) / 1000, 0.0), 6) AS v FROM near a JOIN near b ON a.id <> b.id LEFT JOIN trail w ON w.src = a.node AND w.dst = b.node LEFT JOIN trail v ON v.src = b.node AND v.dst = a.node")
def geographic_matrix(t):
    near = graph.connectors(_suppliers(t), _nodes(t), _land(t))
    return graph.pairwise_distances(near, graph.all_pairs(_penalised(t))).withColumn("v", F.round("v", 6))


@_query(_NET + "SELECT id, min(id) OVER (PARTITION BY route) AS component FROM nd")
def graph_components(t):
    n = _nodes(t)
    return graph.components(graph.route_edges(n), n)


@_query(f"WITH s AS (SELECT s_suppkey AS id, {_sql_point('s_suppkey')} FROM supplier), b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d, avg(lat) AS m FROM (SELECT {_sql_point('n_nationkey')} FROM nation WHERE n_regionkey = 0)) SELECT id FROM s, b WHERE NOT (lat >= a - 200 / 111.32 AND lat <= b + 200 / 111.32 AND lon >= c - 200 / (111.32 * cos(radians(m))) AND lon <= d + 200 / (111.32 * cos(radians(m))))")
def buffered_box_exclusion(t):
    return exclude_box(_suppliers(t), _nodes(t).where("route = 0"), 200.0).select("id")


# --- tree: root, regions, nations -----------------------------------------------------------------------------------------

_TIP = "SELECT n_nationkey::BIGINT AS id, n_regionkey AS r, 1.0 + n_regionkey * 0.25 AS up, 0.5 + (n_nationkey % 7) * 0.125 AS own FROM nation"


def _tree(t: _Tables) -> DataFrame:
    root = t.spark.range(1).select(F.lit(-1).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("length"))
    regions = t.region.select((F.col("r_regionkey") + 1000).cast("long").alias("node"), F.lit(-1).cast("long").alias("parent"), (1.0 + F.col("r_regionkey") * 0.25).alias("length"))
    tips = t.nation.select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"), (0.5 + F.col("n_nationkey") % 7 * 0.125).alias("length"))
    return root.unionByName(regions).unionByName(tips)


def _tips(t: _Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("node"))


_PATR = f"WITH p AS ({_TIP}) SELECT a.id AS i, b.id AS j, (a.own + b.own + CASE WHEN a.r = b.r THEN 0 ELSE a.up + b.up END)::DOUBLE AS v FROM p a JOIN p b ON a.id < b.id"


@_query(_PATR)
def patristic(t):
    return tree.patristic(_tree(t), _tips(t))


@_query(f"WITH p AS ({_TIP}) SELECT a.id AS i, b.id AS j, (CASE WHEN a.id = b.id THEN a.up + a.own WHEN a.r = b.r THEN a.up ELSE 0 END)::DOUBLE AS v FROM p a JOIN p b ON a.id <= b.id")
def phylo_vcv(t):
    return tree.shared_depth(_tree(t), _tips(t))


@_query(f"WITH p AS ({_TIP}) SELECT a.id AS i, b.id AS j, round(CASE WHEN a.id = b.id THEN 1 WHEN a.r = b.r THEN 0.5 * a.up / (sqrt((a.up + a.own)::DOUBLE) * sqrt((b.up + b.own)::DOUBLE)) ELSE 0 END, 9)::DOUBLE AS v FROM p a JOIN p b ON a.id <= b.id")
def pagel_correlation(t):
    return tree.pagel(tree.shared_depth(_tree(t), _tips(t)), 0.5)


@_query("SELECT DISTINCT 'World, ' || r_name || ', ' || n_name || ', ' || c_mktsegment AS path, c_mktsegment AS level4, n_name AS level3, c_mktsegment AS level9 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def subgroup_level(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    p = rows.select(F.concat_ws(", ", F.lit("World"), "r_name", "n_name", "c_mktsegment").alias("path")).distinct()
    return p.select("path", tx.path_level(F.col("path"), 4).alias("level4"), tx.path_level(F.col("path"), 3).alias("level3"), tx.path_level(F.col("path"), 9).alias("level9"))


@_query("SELECT p_partkey AS id, trim(regexp_replace(replace(regexp_replace(replace(p_name, ' ', '_') || '_' || p_partkey, '_\\d+$', ''), '_', ' '), '\\s+', ' ', 'g')) AS name FROM part")
def tip_label_normalise(t):
    return t.part.select(F.col("p_partkey").alias("id"), tx.tip_label(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))).alias("name"))


# --- regressions on pairs of nations ----------------------------------------------------------------------------------------

_NATION_PAIRS = f"""WITH nd AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS r, 1.0 + n_regionkey * 0.25 AS up, 0.5 + (n_nationkey % 7) * 0.125 AS own, {_sql_point("n_nationkey")} FROM nation), b AS (SELECT c_nationkey::BIGINT AS id, avg(c_acctbal) AS b FROM customer GROUP BY c_nationkey),
np AS (SELECT a.id AS i, c.id AS j, abs(x.b - y.b) AS y, {_sql_hav("a", "c")} / 1000 AS geo, (a.own + c.own + CASE WHEN a.r = c.r THEN 0 ELSE a.up + c.up END)::DOUBLE AS phylo FROM nd a JOIN nd c ON a.id < c.id JOIN b x ON x.id = a.id JOIN b y ON y.id = c.id)"""


def _nation_pairs(t: _Tables) -> DataFrame:
    b = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.avg("c_acctbal").alias("b"))
    n = _nodes(t).join(b, "id")
    a, c = (n.select(*[F.col(x).alias(f"{x}{s}") for x in ("id", "lat", "lon", "b")]) for s in ("1", "2"))
    p = a.join(c, F.col("id1") < F.col("id2")).select(F.col("id1").alias("i"), F.col("id2").alias("j"), F.abs(F.col("b1") - F.col("b2")).alias("y"), (graph.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) / 1000).alias("geo"))
    return p.join(patristic(t).withColumnRenamed("v", "phylo"), ["i", "j"])


@_query(_NATION_PAIRS + ", m AS (SELECT count(*) AS n, corr(y, geo) AS a, corr(y, phylo) AS b, corr(geo, phylo) AS c FROM np), k AS (SELECT *, (a - b * c) / (1 - c * c) AS b1, (b - a * c) / (1 - c * c) AS b2 FROM m), q AS (SELECT *, b1 * a + b2 * b AS r2 FROM k) SELECT n, round(b1, 9) AS b1, round(b2, 9) AS b2, round(b1 / sqrt((1 - r2) / (n - 3) / (1 - c * c)), 9) AS t1, round(b2 / sqrt((1 - r2) / (n - 3) / (1 - c * c)), 9) AS t2, round((r2 / 2) / ((1 - r2) / (n - 3)), 9) AS f, round(r2, 9) AS r2 FROM q")
def mmrr_observed(t):
    return models.ols_moments(_nation_pairs(t), "y", "geo", "phylo")


def _matrices(t: _Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = _nation_pairs(t).persist()
    out = []
    for c in ("y", "geo", "phylo"):
        m = models.matrix(p.select("i", "j", F.col(c).alias("v")))[1]
        np.fill_diagonal(m, 0)
        out.append(m)
    p.unpersist()
    return tuple(out)


@_query()
def mmrr_perm(t):
    y, geo, phylo = _matrices(t)
    return models.mmrr(t.spark, y, [geo, phylo], nperm=999)


@_query(_NATION_PAIRS + ", f AS (SELECT regr_slope(y, phylo) AS sy, regr_intercept(y, phylo) AS iy, regr_slope(geo, phylo) AS sx, regr_intercept(geo, phylo) AS ix FROM np) SELECT i, j, round(geo - ix - sx * phylo, 6) AS rx, round(y - iy - sy * phylo, 6) AS ry FROM np, f")
def partial_residuals(t):
    return models.partial_residuals(_nation_pairs(t), ["i", "j"], "y", "geo", "phylo").withColumn("rx", F.round("rx", 6)).withColumn("ry", F.round("ry", 6))


@_query(_NATION_PAIRS + " SELECT round(corr(geo, phylo), 9) AS r, count(*) AS n FROM np")
def pair_corr(t):
    return _nation_pairs(t).agg(F.corr("geo", "phylo").alias("r"), F.count(F.lit(1)).alias("n"))


def _tip_data(t: _Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("y"), F.count(F.lit(1)).alias("x")).orderBy("c_nationkey").collect()
    names, cov = models.matrix(tree.shared_depth(_tree(t), _tips(t)))
    keep = [names.index(r["c_nationkey"]) for r in rows]
    return np.array([r["y"] for r in rows]) / 1e4, np.array([float(r["x"]) for r in rows]), cov[np.ix_(keep, keep)]


@_query()
def pgls(t):
    y, x, cov = _tip_data(t)
    rows = [models.pgls(y, x, cov, lam) for lam in (1e-6, None)]
    return t.spark.createDataFrame([{k: float(v) for k, v in r.items()} for r in rows])


_LL = "SELECT l_linenumber::BIGINT AS obs, -(l_quantity - 25.0) * (l_quantity - 25.0) / 200 AS ll FROM lineitem"


@_query(f"WITH l AS ({_LL}), m AS (SELECT obs, max(ll) AS top, var_samp(ll) AS p FROM l GROUP BY obs), e AS (SELECT top + ln(avg(exp(ll - top))) AS lppd, p FROM l JOIN m USING (obs) GROUP BY obs, top, p) SELECT round(-2 * sum(lppd - p), 9) AS waic, round(sum(p), 9) AS p_waic, round(sqrt(count(*) * var_samp(-2 * (lppd - p))), 9) AS se FROM e")
def waic_from_loglik(t):
    return models.waic(t.lineitem.select(F.col("l_linenumber").cast("long").alias("obs"), (-(F.col("l_quantity") - 25.0) * (F.col("l_quantity") - 25.0) / 200).alias("ll")))


@_query("WITH g AS (SELECT i * 0.1 AS x FROM (SELECT unnest(range(11)) AS i)), m AS (SELECT x::DOUBLE AS x, p_retailprice / 1000 + p_size / 100.0::DOUBLE * x::DOUBLE AS mu FROM part, g) SELECT round(x, 9) AS x, round(avg(mu), 9) AS mean, round(quantile_cont(mu, 0.025), 9) AS lower, round(quantile_cont(mu, 0.975), 9) AS upper FROM m GROUP BY x")
def posterior_grid(t):
    return models.posterior_grid(t.part.select((F.col("p_retailprice") / 1000).alias("a"), (F.col("p_size") / 100.0).alias("b")), 0.0, 1.0, 11)


@_query()
def bayes_waic(t):
    y, x, cov = _tip_data(t)
    d = np.sqrt(np.diag(cov))
    draws = models.bayes(t.spark, "linear", y, (x - x.mean()) / x.std(), cov / np.outer(d, d) * 0.5 + 0.5 * np.eye(len(y)), chains=2, draws=200, warm=500)
    ll = draws.where(F.col("param").startswith("ll_")).select("draw", "chain", F.substring("param", 4, 9).cast("long").alias("obs"), F.col("value").alias("ll"))
    return models.waic(ll).crossJoin(models.psis_loo(ll))


# --- vectors, clusters, surfaces -------------------------------------------------------------------------------------------

# Two directions over all components: signs that alternate by one and by two places.
_PTS = "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * embedding[i]::DOUBLE)) / 8, 6) AS x, round(list_sum(list_transform(range(1, 65), lambda i: (CASE WHEN (i - 1) // 2 % 2 = 0 THEN 1 ELSE -1 END) * embedding[i]::DOUBLE)) / 8, 6) AS y FROM embeddings"


def _points(t: _Tables) -> DataFrame:
    along = lambda sign: F.round(F.aggregate(F.transform("embedding", lambda x, i: F.when(sign(i), 1).otherwise(-1) * x.cast("double")), F.lit(0.0), lambda a, x: a + x) / 8, 6)
    return t.embeddings.select(F.col("vec_id").alias("entity"), F.col("vec_id").alias("ord"), along(lambda i: i % 2 == 0).alias("x"), along(lambda i: F.floor(i / 2) % 2 == 0).alias("y"))


@_query()
def pca_scores(t):
    return cluster.pca(t.embeddings.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v")), 2, "vec_id", "v")[0]


@_query(f"WITH p AS ({_PTS}), d AS (SELECT a.vec_id AS entity, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) AS r FROM d) SELECT entity, round(d, 9) AS d FROM r WHERE r = 4")
def knn_distance(t):
    return cluster.knn_distance(_points(t), 4)


_KNEE = f"""p AS ({_PTS}), d AS (SELECT a.vec_id AS entity, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id),
kd AS (SELECT d FROM d QUALIFY row_number() OVER (PARTITION BY entity ORDER BY d) = 4), s AS (SELECT d, row_number() OVER (ORDER BY d) AS rank FROM kd), e AS (SELECT min(d) AS lo, max(d) AS hi, max(rank) AS n FROM s),
knee AS (SELECT rank, d AS value FROM s, e ORDER BY round(abs((rank - 1) / (n - 1) - (d - lo) / (hi - lo)), 12) DESC, rank LIMIT 1)"""


@_query(f"WITH {_KNEE} SELECT rank, round(value, 9) AS value FROM knee")
def knee_eps(t):
    return cluster.knee(cluster.knn_distance(_points(t), 4), "d")


@_query(f"""WITH RECURSIVE {_KNEE}, near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= (SELECT value * value FROM knee)),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 4), link AS (SELECT a, b FROM near SEMI JOIN core USING (a) WHERE b IN (SELECT a FROM core)),
reach AS (SELECT a, a AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
num AS (SELECT a, dense_rank() OVER (ORDER BY c) AS cluster FROM comp), edge AS (SELECT near.a, min(cluster) AS cluster FROM near JOIN num ON num.a = near.b WHERE near.a NOT IN (SELECT a FROM core) GROUP BY near.a)
SELECT vec_id AS entity, coalesce(num.cluster, edge.cluster, 0) AS cluster, (SELECT round(value, 9) FROM knee) AS eps FROM p LEFT JOIN num ON num.a = vec_id LEFT JOIN edge ON edge.a = vec_id""")
def dbscan(t):
    return cluster.clustered(_points(t), 4)


@_query("WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT a.label::BIGINT AS i, b.label::BIGINT AS j, round(sum(a.x * b.x) / (max(p.n) * max(q.n) + 1e-9), 9) AS v FROM m a JOIN m b ON a.i = b.i JOIN n p ON p.label = a.label JOIN n q ON q.label = b.label GROUP BY ALL")
def embedding_cosine(t):
    v = t.embeddings.select("label", F.posexplode("embedding").alias("feature", "x")).groupBy(F.col("label").cast("long").alias("entity"), "feature").agg(F.avg(F.col("x").cast("double")).alias("v"))
    return similarity.cosine(v)


_WEDGES = "WITH e AS (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, avg(l_discount) + 0.01 AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey < c_nationkey GROUP BY ALL), r AS (SELECT src, dst, w, log10(w / (SELECT avg(w) FROM e)) AS lr FROM e)"


def _ratios(t: _Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_discount").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    e = rows.where("s_nationkey < c_nationkey").groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg((F.avg("l_discount") + 0.01).alias("w"))
    return surface.log_ratio(e)


@_query(_WEDGES + " SELECT src, dst, round(w, 9) AS w, round(lr, 9) AS log10_ratio FROM r")
def edge_log_ratio(t):
    return _ratios(t)


@_query(_WEDGES + " SELECT n_nationkey::BIGINT AS id, round(v, 9) AS value FROM nation LEFT JOIN (SELECT id, avg(lr) AS v FROM (SELECT src AS id, lr FROM r UNION ALL SELECT dst, lr FROM r) GROUP BY id) ON id = n_nationkey")
def node_value(t):
    return surface.node_values(_ratios(t), _nodes(t))


@_query()
def surface_cv(t):
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).orderBy("label").select("v.x").collect()
    data = np.array([r["x"] for r in rows]) * 4
    side = max(2, int(np.ceil(np.sqrt(2 * len(data)))))  # every other node is observed
    _, edges = surface.lattice(t.spark, side, side)
    pairs = np.array([(r["src"], r["dst"]) for r in edges.orderBy("src", "dst").collect()])
    return surface.cross_validate(t.spark, pairs, side * side, np.arange(len(data)) * 2, data, [0.01, 1.0, 100.0])


@_query(_PENALISED + f""", mseg AS (SELECT id, lon AS lon1, lat AS lat1, 121.0::DOUBLE AS lon2, 14.6::DOUBLE AS lat2 FROM sup), {_sql_cost("mc", "mseg")}
SELECT id, round(land, 6) AS land, round(cost - 4.44 * land, 6) AS sea FROM mc""")
def land_sea_lengths(t):
    lines = _suppliers(t).select("id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lit(121.0).alias("lon2"), F.lit(14.6).alias("lat2"))
    return surface.land_lengths(lines, _land(t)).select("id", F.round("land", 6).alias("land"), F.round("sea", 6).alias("sea"))


# --- text, relational verbs, figure data ------------------------------------------------------------------------------------


@_query("WITH w AS (SELECT DISTINCT doc_id, lang, unnest(string_split(lower(text), ' ')) AS feature FROM documents), n AS (SELECT lang, count(*) AS t FROM documents GROUP BY lang) SELECT lang, feature, count(*) AS n, round(ln((t + 1) / (count(*) + 1)), 9) AS idf FROM w JOIN n USING (lang) WHERE feature <> '' GROUP BY lang, feature, t")
def token_document_frequency(t):
    d = t.documents.select("doc_id", "lang", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("feature")).where("feature <> ''")
    n = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("t"))
    c = d.groupBy("lang", "feature").agg(F.count(F.lit(1)).alias("n")).join(n, "lang")
    return c.select("lang", "feature", "n", F.log((F.col("t") + 1) / (F.col("n") + 1)).alias("idf"))


@_query("WITH a AS (SELECT l_suppkey AS k, count(*) AS hi FROM lineitem WHERE l_quantity > 49 GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS lo FROM lineitem WHERE l_quantity < 2 GROUP BY 1) SELECT k, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM a FULL JOIN b USING (k)")
def full_join(t):
    a = t.lineitem.where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("hi"))
    b = t.lineitem.where("l_quantity < 2").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("lo"))
    return a.join(b, "k", "full").na.fill(0, ["hi", "lo"])


@_query("SELECT c_mktsegment AS segment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS buyers, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS others FROM customer GROUP BY 1")
def semi_anti_join(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    side = lambda how, name: t.customer.join(o, "c_custkey", how).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias(name))
    return side("left_semi", "buyers").join(side("left_anti", "others"), "segment", "full").na.fill(0)


@_query("SELECT s_suppkey AS id, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def union_by_name(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")).unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@_query(f"SELECT entity, feature, value FROM {_PART}")
def unpivot(t):
    return _part_long(t)


@_query("SELECT p_brand AS brand, " + ", ".join(f"count(*) FILTER (p_size = {k}) AS s{k}" for k in (1, 2, 3)) + " FROM part WHERE p_size IN (1, 2, 3) GROUP BY 1")
def pivot(t):
    return t.part.where("p_size in (1, 2, 3)").groupBy(F.col("p_brand").alias("brand")).pivot("p_size", [1, 2, 3]).agg(F.count(F.lit(1))).select("brand", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"s{k}") for k in (1, 2, 3)])


@_query("WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS pick, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey, p_retailprice, pick FROM r WHERE pick IN (1, round_even(1 + (n - 1) * 0.5, 0), n)")
def quantile_picks(t):
    return stats.quantile_picks(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], ["p_retailprice", "p_partkey"], [0.0, 0.5, 1.0])


@_query("SELECT p_partkey, ntile(3) OVER (ORDER BY p_retailprice, p_partkey) AS tier FROM part")
def tertiles(t):
    return stats.tiles(t.part.select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], 3, "tier").select("p_partkey", "tier")


@_query("WITH a AS (SELECT *, (lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus OR row_number() OVER w = 1)::BIGINT AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), b AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM a) SELECT o_custkey, run, min(o_orderstatus) AS o_orderstatus, count(*) AS length, min(o_orderkey) AS first, max(o_orderkey) AS last FROM b GROUP BY o_custkey, run")
def run_lengths(t):
    return stats.runs(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", "o_orderstatus")


@_query("SELECT p_brand, p_partkey, p_size::BIGINT AS p_size, rank FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank FROM part) WHERE rank <= 3")
def top_with_ties(t):
    return stats.top_with_ties(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], F.col("p_size"), 3)


@_query("(SELECT DISTINCT c_nationkey::BIGINT AS k FROM customer WHERE c_acctbal > 9900) EXCEPT (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def set_difference(t):
    return t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")))


@_query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 9) AS scaled, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 9) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def scaled_values(t):
    return t.customer.select("c_custkey", stats.min_max("c_acctbal", ["c_mktsegment"]).alias("scaled"), stats.standardise("c_acctbal", ["c_mktsegment"]).alias("z"))


@_query("SELECT c_mktsegment AS segment, count(*) AS n, round(quantile_cont(c_acctbal, 0.25), 9) AS q1, round(median(c_acctbal), 9) AS q2, round(quantile_cont(c_acctbal, 0.75), 9) AS q3, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY 1")
def box_summary(t):
    q = lambda p: F.percentile("c_acctbal", F.lit(p))
    return t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.round(F.stddev_samp("c_acctbal"), 6).alias("sd"))


@_query("WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT least(29, floor((c_acctbal - lo) / ((hi - lo) / 30)))::BIGINT AS bin, count(*) AS n FROM customer, e GROUP BY 1")
def histogram(t):
    e = t.customer.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    bin_ = F.least(F.lit(29), F.floor((F.col("c_acctbal") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 30)))
    return t.customer.crossJoin(F.broadcast(e)).groupBy(bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH q AS (SELECT c_mktsegment AS g, count(*) AS n, stddev_samp(c_acctbal) AS sd, (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) / 1.34 AS iqr, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1), h AS (SELECT *, 0.9 * least(sd, iqr) * pow(n::DOUBLE, -0.2) AS h FROM q),
x AS (SELECT *, lo - 3 * h + k * (hi - lo + 6 * h) / 15 AS x FROM h, (SELECT unnest(range(16)) AS k)) SELECT g, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - c_acctbal) / h) * ((x - c_acctbal) / h))) / max(n * h * sqrt(2 * pi())), 9) AS y FROM x JOIN customer ON c_mktsegment = g GROUP BY g, x""")
def density_grid(t):
    return stats.density(t.customer.select(F.col("c_mktsegment").alias("g"), "c_acctbal"), "g", "c_acctbal", 16).withColumn("x", F.round("x", 6))
