"""Filters, picks, guards and reshapes over entity tables: one function for each rule, nulls and ties stated."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithmesh.functions import dist
from kithmesh.operators.staging import fresh, ranked


def strict_box(points: DataFrame, south: float, north: float, west: float, east: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points strictly inside a box; a null coordinate is outside."""
    return points.where((F.col(lat) > south) & (F.col(lat) < north) & (F.col(lon) > west) & (F.col(lon) < east))


def keep_unless(df: DataFrame, *all_of: list[Column]) -> DataFrame:
    """Rows for which none of the conjunctions holds. A conjunction that is null keeps no row, as a filter on its negation does."""
    return reduce(lambda d, terms: d.where(~reduce(Column.__and__, terms)), all_of, df)


def within_sd(df: DataFrame, value: str, sds: float = 1.0) -> DataFrame:
    """Rows whose value lies within `sds` sample deviations of the mean, bounds included; nulls go."""
    low, high = fresh(df, "low"), fresh(df, "high")
    b = df.agg((F.avg(value) - sds * F.stddev_samp(value)).alias(low), (F.avg(value) + sds * F.stddev_samp(value)).alias(high))
    return df.crossJoin(F.broadcast(b)).where(F.col(value).between(F.col(low), F.col(high))).drop(low, high)


def columns_like(df: DataFrame, pattern: str, always: tuple[str, ...] = (), kinds: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `always`, then those whose name has the pattern and, if given, whose type is one of `kinds`; order as in the table."""
    chosen = [c for c, kind in df.dtypes if c not in always and re.search(pattern, c) and (not kinds or kind in kinds)]
    return df.select(*always, *chosen)


def require(df: DataFrame, rule: Column, message: str, most: int = 0) -> DataFrame:
    """`df` itself if at most `most` rows break the rule (a null breaks it); else an error with the message and their number."""
    bad = df.where(~F.coalesce(rule, F.lit(False))).limit(most + 1).count()
    if bad > most:
        raise ValueError(f"{message}: more than {most} rows")
    return df


def impute_one(cells: DataFrame, value: str, fill: float = 0.0, permitted: int = 1) -> DataFrame:
    """Null cells filled, if there are at most `permitted`; more are an error."""
    require(cells, F.col(value).isNotNull(), "null cells", permitted)
    return cells.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def first_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per group: the first in the given order, which should have no ties."""
    n = fresh(df, "n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(n) == 1).drop(n)


def top_per_group(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The row with the largest value of each group, nulls last, ties to the smallest `tie`."""
    return first_per_group(df, by, [F.col(value).desc_nulls_last(), F.col(tie)])


def column_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, variance (sample) of each column; null with fewer than two values."""
    v = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    return v.unpivot([], columns, "column", "variance")


def smallest_group(df: DataFrame, by: str) -> DataFrame:
    """n: the smallest group size over 1 (null without any), as it serves for DBSCAN's minimum."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.min("n").alias("n"))


def in_all(*tables: DataFrame) -> DataFrame:
    """The distinct rows that every table has."""
    return reduce(DataFrame.intersect, tables)


def in_any(*tables: DataFrame) -> DataFrame:
    """The distinct rows of all tables."""
    return reduce(DataFrame.unionByName, tables).distinct()


def level_order(df: DataFrame, level: str, stat: Column) -> DataFrame:
    """level, stat, ord: the levels' places from 1 by a statistic of their rows, ties by name."""
    s = df.groupBy(level).agg(stat.alias("stat"))
    return s.withColumn("ord", F.row_number().over(Window.orderBy("stat", level)).cast("long"))  # one row per level


def appearance_order(df: DataFrame, level: str, order: list[str]) -> DataFrame:
    """level, ord: the levels' places from 1 by their first row in the given order, which names rows without ties; a null level is one."""
    key = F.struct(*order)
    return ranked(df.groupBy(level).agg(F.min(key).alias("first")), ["first"], "ord").select(level, "ord")


def head(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """The first n rows in the given order; of rows that tie at the end any."""
    return df.orderBy(*order).limit(n)


def fold_back(scores: DataFrame, flags: DataFrame, key: str, name: str, value: str, names: list[str], suffix: str) -> DataFrame:
    """The score table with one column `<name>_<suffix>` for each name: the flag of (key, name), null where there is none."""
    wide = flags.groupBy(key).pivot(name, names).agg(F.first(value)).select(key, *[F.col(n).alias(f"{n}_{suffix}") for n in names])
    return scores.join(wide, key, "left")


def frequency_table(inventories: DataFrame, wanted: DataFrame, subset: Column | None = None) -> DataFrame:
    """feature, n, n_total, freq, n_subset, idf of the wanted features over inventories (code, inventory, feature, marginal): each code counts by its
    smallest inventory, marginal entries don't count; features that no inventory attests have n 0 and a null idf."""
    one = inventories.join(inventories.groupBy("code").agg(F.min("inventory").alias("inventory")), ["code", "inventory"], "left_semi")
    kept = one.where(~F.coalesce("marginal", F.lit(False))).select("code", "feature", (F.lit(False) if subset is None else F.coalesce(subset, F.lit(False))).alias("_in")).distinct()
    total = inventories.agg(F.count_distinct("code").alias("n_total"))
    n = kept.groupBy("feature").agg(F.count_distinct("code").alias("n"), F.count_distinct(F.when(F.col("_in"), F.col("code"))).alias("n_subset"))
    t = wanted.select("feature").distinct().join(n, "feature", "left").crossJoin(F.broadcast(total)).fillna(0, ["n", "n_subset"])
    return t.select("feature", "n", "n_total", (F.col("n") / F.col("n_total")).alias("freq"), "n_subset", F.when(F.col("n") > 0, F.log((F.col("n_total") + 1) / (F.col("n") + 1))).alias("idf"))


def idf_shift(ours: DataFrame, theirs: DataFrame, crosswalk: DataFrame, name: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """feature, idf, other, shift, direction: idf of features in two inventories, each scaled to 0..1 over the features that both have, the second minus
    the first and its sign as `rarer`, `commoner` or `same`. crosswalk: feature and symbol; theirs: symbol and idf; `name` normalises symbols on
    both sides (of symbols that become equal, the smallest idf counts)."""
    x = crosswalk.select("feature", name(F.col("symbol")).alias("symbol"))
    t = theirs.select(name(F.col("symbol")).alias("symbol"), "idf").groupBy("symbol").agg(F.min("idf").alias("other"))
    both = ours.select("feature", "idf").join(x, "feature").join(t, "symbol").where("idf is not null and other is not null").select("feature", "idf", "other")
    r = both.agg(*[f(c).alias(f"{k}_{c}") for c in ("idf", "other") for k, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c: (F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0))
    s = both.crossJoin(F.broadcast(r)).withColumn("shift", F.round(scaled("other") - scaled("idf"), 12))
    return s.select("feature", "idf", "other", "shift", F.when(F.col("shift") > 0, "rarer").when(F.col("shift") < 0, "commoner").when(F.col("shift") == 0, "same").alias("direction"))


def compared_tallies(raw: DataFrame, weighted: DataFrame, families: DataFrame) -> DataFrame:
    """entity, n_raw, n_weighted, family, size, delta: two tallies (j, n_exceed) side by side with the size of the entity's family; an entity
    that one lacks counts 0 there."""
    f = families.select(F.col("entity").alias("j"), "family", F.count(F.lit(1)).over(Window.partitionBy("family")).alias("size"))
    both = raw.select("j", F.col("n_exceed").alias("n_raw")).join(weighted.select("j", F.col("n_exceed").alias("n_weighted")), "j", "full").fillna(0, ["n_raw", "n_weighted"])
    return both.join(f, "j", "left").select(F.col("j").alias("entity"), "n_raw", "n_weighted", "family", "size", (F.col("n_weighted") - F.col("n_raw")).alias("delta"))


def named(keys: Column, names: dict) -> Column:
    """The value of each key in a fixed table of names; null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), keys)


def qq_points(values: DataFrame, by: str, value: str) -> DataFrame:
    """by, rank, value, theoretical: normal quantiles of (rank - a) / (n + 1 - 2a), a = 3/8 up to ten values, else 1/2; nulls go."""
    v = values.where(F.col(value).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    r = v.select(by, F.col(value).alias("value"), F.row_number().over(Window.partitionBy(by).orderBy(value)).cast("long").alias("rank"), n.alias("_n"))
    a = F.when(F.col("_n") <= 10, 0.375).otherwise(0.5)
    return r.select(by, "rank", "value", _normal_quantile((F.col("rank") - a) / (F.col("_n") + 1 - 2 * a)).alias("theoretical"))


@F.pandas_udf(T.DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series([dist.normal_quantile(x) for x in p], dtype=float)


def symmetric_limits(df: DataFrame, value: str) -> DataFrame:
    """low, high: -m and m for the largest absolute value m, for a scale around 0."""
    m = df.agg(F.max(F.abs(value)).alias("high"))
    return m.select((-F.col("high")).alias("low"), "high")


def segments(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, lon1, lat1, lon2, lat2 of each edge, for drawing."""
    a = nodes.select(F.col("id").alias("src"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = nodes.select(F.col("id").alias("dst"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", "lon1", "lat1", "lon2", "lat2")


def drawn_network(edges: DataFrame, nodes: DataFrame, points: DataFrame, near: DataFrame, group: str) -> DataFrame:
    """kind, src, dst, lon1, lat1, lon2, lat2, arrow, grp: the lines of a network's figure: its edges, plain, and a connector from each point (id, lon, lat, `group`) to its node (of near: id, node), with an
    arrow there and the point's group. Points without a node, and edges without a place, have no line."""
    main = segments(edges, nodes).select(F.lit("main").alias("kind"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "lon1", "lat1", "lon2", "lat2", F.lit(False).alias("arrow"), F.lit(None).cast("string").alias("grp"))
    at = nodes.select(F.col("id").alias("node"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    lines = points.select("id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col(group).cast("string").alias("grp")).join(near.select("id", "node"), "id").join(at, "node")
    return main.unionByName(lines.select(F.lit("connector").alias("kind"), F.col("id").cast("string").alias("src"), F.col("node").cast("string").alias("dst"), "lon1", "lat1", "lon2", "lat2", F.lit(True).alias("arrow"), "grp"))


def per_node(samples: DataFrame, near: DataFrame, value: str) -> DataFrame:
    """node, n, mean: how many samples (id, value) each node took, and their mean (nulls left out of the mean)."""
    return samples.join(near.select("id", "node"), "id").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def pseudo_genotypes(present: DataFrame, weights: DataFrame) -> DataFrame:
    """entity, feature, value: 2 times the weight where an entity has the feature. A feature without a weight is an error."""
    w = present.join(weights.select("feature", "idf"), "feature", "left")
    require(w, F.col("idf").isNotNull(), "features without a weight")
    return w.select("entity", "feature", (2 * F.col("idf")).alias("value"))
