"""Feature tables and weights: document frequency, one-hot, coverage, zero variance. Tables are long: entity, feature, value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithmesh.operators.staging import cut


def presence(rows: DataFrame, entity: str, feature: str) -> DataFrame:
    """Distinct (entity, feature) pairs without nulls."""
    return rows.select(F.col(entity).alias("entity"), F.col(feature).alias("feature")).dropna().distinct()


def idf(present: DataFrame, smoothing: str = "laplace", dictionary: DataFrame | None = None, n_total: int | None = None) -> DataFrame:
    """feature, n, n_total, freq, idf. laplace: ln((N + 1) / (n + 1)); none: ln(1 / freq), null where n is 0. Features of the
    dictionary that nothing has are kept with n 0. N: distinct entities, unless n_total says otherwise."""
    counts = present.groupBy("feature").agg(F.count_distinct("entity").alias("n"))
    if dictionary is not None:
        counts = dictionary.select("feature").distinct().join(counts, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"))
    if n_total is None:
        counts = counts.crossJoin(F.broadcast(present.agg(F.count_distinct("entity").alias("n_total"))))
    else:
        counts = counts.withColumn("n_total", F.lit(n_total).cast("long"))
    freq = F.col("n") / F.col("n_total")
    weight = F.log((F.col("n_total") + 1) / (F.col("n") + 1)) if smoothing == "laplace" else F.when(F.col("n") > 0, F.log(1 / freq))
    return counts.select("feature", "n", "n_total", freq.alias("freq"), weight.alias("idf"))


def idf_by_value(long: DataFrame, n_total: int | None = None) -> DataFrame:
    """feature, value, n, freq, idf = ln(1 / freq); a null value is a group of its own."""
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    if n_total is None:
        counts = counts.join(long.groupBy("feature").agg(F.count(F.lit(1)).alias("_t")), "feature")
    else:
        counts = counts.withColumn("_t", F.lit(n_total))
    freq = F.col("n") / F.col("_t")
    return counts.select("feature", "value", "n", freq.alias("freq"), F.log(1 / freq).alias("idf"))


def coverage(long: DataFrame, by: str) -> DataFrame:
    """Non-null values of each `by` (feature or entity)."""
    return long.groupBy(by).agg(F.count("value").alias("n"))


def coverage_prune(long: DataFrame, least_entities: int = 80, least_features: int = 50, rounds: int = 2) -> DataFrame:
    """Each round keeps features with enough non-null entities, then entities with enough non-null features."""
    for _ in range(rounds):
        long = long.join(coverage(long, "feature").where(F.col("n") >= least_entities).select("feature"), "feature", "left_semi")
        long = long.join(coverage(long, "entity").where(F.col("n") >= least_features).select("entity"), "entity", "left_semi")
    return long


def prune_until_stable(long: DataFrame, least_entities: int = 80, least_features: int = 50) -> DataFrame:
    """The rows (entity, feature, value) of the largest part of the table in which every feature has `least_entities` non-null entities and every entity `least_features`
    non-null features; rows with a null value stay if their feature and entity do. Empty if there is no such part.

    Counts are taken once. In each round the features, then the entities, that fell below their bound go, and only their own cells are read to lower the counts on the other side, until
    no count is too low: the work of all rounds together is bounded by the cells that go. Repeated cells count once; a null entity or feature is none."""
    cells = cut(long.where("value is not null and entity is not null and feature is not null").select("entity", "feature").distinct())
    held = {"feature": cells.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "entity": cells.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))}
    least = {"feature": least_entities, "entity": least_features}
    named = long.select("feature", "entity").where("entity is not null and feature is not null")
    # Those that have rows, but no value at all, have a count of 0.
    held = {c: cut(named.select(c).distinct().join(n, c, "left").na.fill(0, ["n"])) for c, n in held.items()}
    quiet, side, other = 0, "feature", "entity"
    while quiet < 2:
        gone = cut(held[side].where(F.col("n") < least[side]).select(side))
        if gone.isEmpty():
            quiet += 1
        else:
            quiet = 0
            held[side] = cut(held[side].join(gone, side, "left_anti"))
            fewer = cells.join(gone, side, "left_semi").groupBy(other).agg(F.count(F.lit(1)).alias("less"))
            held[other] = cut(held[other].join(fewer, other, "left").select(other, (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")))
            cells = cut(cells.join(gone, side, "left_anti"))
        side, other = other, side
    return long.join(held["feature"].select("feature"), "feature", "left_semi").join(held["entity"].select("entity"), "entity", "left_semi").select(*long.columns)


def one_hot(long: DataFrame, least_levels: int = 3) -> DataFrame:
    """Features with at least `least_levels` observed values become one 0/1 feature per value, named feature_value; a null
    value stays null in each of them. Other features stay as they are, their value as a number."""
    levels = long.where("value is not null").select("feature", "value").distinct()
    many = levels.groupBy("feature").agg(F.collect_set("value").alias("levels")).where(F.size("levels") >= least_levels)
    joined = long.join(many, "feature", "left")
    wide = joined.where("levels is not null").select("entity", "feature", "value", F.explode("levels").alias("level"))
    dummies = wide.select("entity", F.concat_ws("_", "feature", "level").alias("feature"), (F.col("value") == F.col("level")).cast("int").alias("value"))
    rest = joined.where("levels is null").select("entity", "feature", F.expr("try_cast(value as int)").alias("value"))
    return dummies.unionByName(rest)


def drop_zero_variance(long: DataFrame) -> DataFrame:
    """Only features whose values differ."""
    varied = long.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a <> b")
    return long.join(varied.select("feature"), "feature", "left_semi")


def group_weights(rows: DataFrame, group: str, out: str = "weight") -> DataFrame:
    """Adds 1 / size of each row's group."""
    return rows.withColumn(out, 1 / F.count(F.lit(1)).over(Window.partitionBy(group)))
