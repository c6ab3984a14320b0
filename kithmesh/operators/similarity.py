"""Weighted cosine similarity over long tables, scores by role, contributions, driver and null tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithmesh.operators.staging import fresh, ranked

EPS = 1e-9


def weighted(present: DataFrame, weights: DataFrame) -> DataFrame:
    """entity, feature, v: presence times weight. Weights of 0 add nothing to a product and are left out: a feature that
    everything has would make the self-join quadratic for nothing."""
    return present.join(weights.where("idf <> 0").select("feature", F.col("idf").alias("v")), "feature").select("entity", "feature", "v")


def cosine(vectors: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None, eps: float = EPS, dense: bool = True) -> DataFrame:
    """i, j, v for every pair of an entity of `left` and one of `right` (all by default): dot / (|i| |j| + eps). Pairs that share no feature have 0; they are listed by
    crossing the entities, as the result has a row for every pair. Not `dense`: only pairs that share a feature, which meet in the join on features alone."""
    norms = vectors.groupBy("entity").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    a = norms if left is None else norms.join(left.select("entity"), "entity", "left_semi")
    b = norms if right is None else norms.join(right.select("entity"), "entity", "left_semi")
    va = vectors if left is None else vectors.join(left.select("entity"), "entity", "left_semi")
    vb = vectors if right is None else vectors.join(right.select("entity"), "entity", "left_semi")
    dots = va.select(F.col("entity").alias("i"), "feature", F.col("v").alias("x")).join(vb.select(F.col("entity").alias("j"), "feature", F.col("v").alias("y")), "feature")
    dots = dots.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    a, b = a.select(F.col("entity").alias("i"), F.col("norm").alias("ni")), b.select(F.col("entity").alias("j"), F.col("norm").alias("nj"))
    if not dense:
        return dots.join(a, "i").join(b, "j").select("i", "j", (F.col("dot") / (F.col("ni") * F.col("nj") + eps)).alias("v"))
    pairs = a.crossJoin(b)
    return pairs.join(dots, ["i", "j"], "left").select("i", "j", (F.coalesce("dot", F.lit(0.0)) / (F.col("ni") * F.col("nj") + eps)).alias("v"))


def cosine_pairwise(vectors: DataFrame, eps: float = EPS, dense: bool = True) -> DataFrame:
    """i <= j, v: cosine over the features that both entities have non-null; null if there are none, or no row if not `dense`. Norms belong to the pair."""
    a = vectors.where("v is not null").select(F.col("entity").alias("i"), "feature", F.col("v").alias("x"))
    b = vectors.where("v is not null").select(F.col("entity").alias("j"), "feature", F.col("v").alias("y"))
    sums = a.join(b, "feature").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("p"), F.sum(F.col("y") * F.col("y")).alias("q"))
    value = (F.col("d") / (F.sqrt("p") * F.sqrt("q") + eps)).alias("v")
    if not dense:
        return sums.select("i", "j", value)
    e = vectors.select("entity").distinct()
    pairs = e.select(F.col("entity").alias("i")).join(e.select(F.col("entity").alias("j")), F.col("i") <= F.col("j"))
    return pairs.join(sums, ["i", "j"], "left").select("i", "j", value)


def substitute(long: DataFrame, by_value: DataFrame) -> DataFrame:
    """entity, feature, v: each value is replaced by the weight of its (feature, value); null stays null."""
    return long.join(by_value.select("feature", "value", F.col("idf").alias("w")), ["feature", "value"], "left").select("entity", "feature", F.when(F.col("value").isNotNull(), F.col("w")).alias("v"))


def role_scores(pairs: DataFrame, roles: DataFrame) -> DataFrame:
    """study, baseline, score: similarity to each interest entity, and as baseline `control` the mean over the controls (null
    if one of them is null)."""
    r = roles.select("entity", "role")
    p = pairs.join(r.where("role = 'study'").select(F.col("entity").alias("i")), "i", "left_semi").join(r.select(F.col("entity").alias("j"), "role"), "j")
    interest = p.where("role = 'interest'").select(F.col("i").alias("study"), F.col("j").alias("baseline"), F.col("v").alias("score"))
    control = p.where("role = 'control'").groupBy(F.col("i").alias("study")).agg(F.when(F.count("v") == F.count(F.lit(1)), F.avg("v")).alias("score")).select("study", F.lit("control").alias("baseline"), "score")
    return interest.unionByName(control)


def over_control(scores: DataFrame) -> DataFrame:
    """study, baseline, delta: each interest's score less the control mean of the same study entity."""
    c = scores.where("baseline = 'control'").select("study", F.col("score").alias("c"))
    return scores.where("baseline <> 'control'").join(c, "study").select("study", "baseline", (F.col("score") - F.col("c")).alias("delta"))


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors of length 1; entities of norm 0 are left out."""
    norms = vectors.groupBy("entity").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n")).where("n > 0")
    return vectors.join(norms, "entity").select("entity", "feature", (F.col("v") / F.col("n")).alias("u"))


def centroid(units: DataFrame, core: DataFrame) -> DataFrame:
    """feature, c: mean of the unit vectors of the core's entities; where an entity lacks a feature it counts 0. Sums are of decimals, so that they don't depend on the order of
    rows: features that the same entities have equally have equal means."""
    n = core.agg(F.count(F.lit(1)).alias("n_core"))
    nan = F.isnan("u")
    s = F.sum(F.when(~nan, F.col("u")).cast("decimal(38,28)")).cast("double")
    s = F.when(F.count_if(nan) > 0, F.lit(float("nan"))).otherwise(s)
    return units.join(core.select("entity"), "entity", "left_semi").groupBy("feature").agg(s.alias("s")).crossJoin(F.broadcast(n)).select("feature", (F.col("s") / F.col("n_core")).alias("c"))


def contributions(vectors: DataFrame, core: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, feature, contribution, share, rank: what each feature adds to the mean similarity of each of `entities` to the core's entities, its share of the
    entity's whole, and its place among the entity's features."""
    u = unit(vectors)
    one = u.join(entities.select("entity"), "entity", "left_semi").join(centroid(u, core), "feature").select("entity", "feature", (F.col("u") * F.col("c")).alias("contribution"))
    total = one.groupBy("entity").agg(F.sum("contribution").alias("t"))
    rows = one.join(total, "entity").select("entity", "feature", "contribution", (F.col("contribution") / F.col("t")).alias("share"))
    return ranked(rows, [F.col("contribution").desc(), "feature"], "rank", ["entity"])


def core_within(pairs: DataFrame, core: DataFrame, sds: float = 1.0) -> DataFrame:
    """entity: those of the core whose mean similarity (over their rows i of pairs) lies within `sds` sample deviations of the mean of these means, bounds
    included. One entity alone stays."""
    m = pairs.join(core.select(F.col("entity").alias("i")), "i", "left_semi").groupBy(F.col("i").alias("entity")).agg(F.avg("v").alias("m"))
    b = m.agg(F.avg("m").alias("mid"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd"))
    return m.crossJoin(F.broadcast(b)).where(F.col("m").between(F.col("mid") - sds * F.col("sd"), F.col("mid") + sds * F.col("sd"))).select("entity")


def compared_decompositions(vectors: DataFrame, pairs: DataFrame, core: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, feature, centre, centre_share, partner, most, most_share: side by side what each feature adds to an entity's mean similarity to the core, and to its similarity to
    its partner, the row i of pairs (i, j: the entity) that it is most similar to, ties to the smaller name.

    Features that add something to one of the two are listed, with 0 for the other; shares are of each sum. All entities are done in the same joins on features. An entity
    without a partner (no pair, or only null ones) has a null one and zeros; one that isn't in `vectors` has no row."""
    u = unit(vectors)
    of = u.join(entities.select("entity"), "entity", "left_semi")
    best = pairs.where("v is not null").join(entities.select(F.col("entity").alias("j")), "j", "left_semi").groupBy(F.col("j").alias("entity")).agg(F.min(F.struct((-F.col("v")).alias("v"), "i")).alias("b")).select("entity", F.col("b.i").alias("partner"))
    central = of.join(centroid(u, core), "feature").select("entity", "feature", (F.col("u") * F.col("c")).alias("centre")).where("centre > 0")
    theirs = best.join(u.withColumnRenamed("entity", "partner").withColumnRenamed("u", "w"), "partner").select("entity", "feature", "w")
    paired = of.join(theirs, ["entity", "feature"]).select("entity", "feature", (F.col("u") * F.col("w")).alias("most")).where("most > 0")
    both = central.join(paired, ["entity", "feature"], "full").na.fill(0.0, ["centre", "most"])
    sums = both.groupBy("entity").agg(F.sum("centre").alias("tc"), F.sum("most").alias("tm"))
    share = lambda x, t: F.coalesce(F.col(x) / F.nullif(F.col(t), F.lit(0.0)), F.lit(0.0))
    return both.join(sums, "entity").join(best, "entity", "left").select("entity", "feature", "centre", share("centre", "tc").alias("centre_share"), "partner", "most", share("most", "tm").alias("most_share"))


def core_rank(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """j, mean, rank: entities by their mean similarity to the core (i of pairs)."""
    m = pairs.join(core.select(F.col("entity").alias("i")), "i", "left_semi").groupBy("j").agg(F.avg("v").alias("mean"))
    return m.select("j", "mean", F.rank().over(Window.orderBy(F.desc("mean"))).cast("long").alias("rank"))


def drivers(present: DataFrame, roles: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per feature: prevalence among study, interest and control entities, variance p (1 - p), how many interests have it where a
    control has it too (else 0), whether controls but no interest have it, the null-skew leverage idf^6 q (1 - q) (1 - 2q) of control
    prevalence q (0 where no study entity has it), whether that reaches the top decile of the features that study and control entities
    have, and the flag: `both`, `control tail`, `interest` or `neither`."""
    sizes = roles.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    size = lambda r: F.broadcast(sizes.where(F.col("role") == r).select(F.col("n").alias(f"n_{r}")))
    has = present.join(roles.select("entity", "role"), "entity").groupBy("feature").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("study", "interest", "control")])
    t = has.crossJoin(size("study")).crossJoin(size("interest")).crossJoin(size("control")).join(weights.select("feature", "idf"), "feature")
    p, q, n = F.col("study") / F.col("n_study"), F.col("control") / F.col("n_control"), F.col("interest")
    leverage = F.when(p > 0, F.pow("idf", F.lit(6.0)) * q * (1 - q) * (1 - 2 * q)).otherwise(0.0)
    t = t.select("feature", "idf", p.alias("p_study"), (n / F.col("n_interest")).alias("p_interest"), q.alias("p_control"), (p * (1 - p)).alias("variance"), F.when(q > 0, n).otherwise(0).alias("n_shared"), ((q > 0) & (n == 0)).alias("control_only"), leverage.alias("leverage"))
    cut = t.where("p_study > 0 and p_control > 0").agg(F.percentile("leverage", F.lit(0.9)).alias("cut"))
    t = t.crossJoin(F.broadcast(cut)).withColumn("high", F.coalesce(F.col("leverage") >= F.col("cut"), F.lit(False))).drop("cut")
    any_ = F.col("p_interest") > 0
    return t.withColumn("flag", F.when(F.col("high") & any_, "both").when(F.col("high"), "control tail").when(any_, "interest").otherwise("neither"))


def driver_profile(present: DataFrame, sets: DataFrame, weights: DataFrame, study: str, control: str, interests: dict[str, str], share: float = 0.9) -> DataFrame:
    """One row per feature of `weights` (feature, idf): for each reference set of `sets` (set, entity) its prevalence p_<set> and Bernoulli variance var_<set>; for each interest
    (name: entity) whether it has the feature, has_<name>; control_only (a control has it and no interest), n_shared (interests that have it if a control does), the null-skew
    leverage idf^6 q (1 - q) (1 - 2q) of the prevalence q in the set `control` (0 where `study` has none), high: whether that reaches the quantile `share` of the features that both
    sets have, and the flag `both`, `control tail`, `interest` or `neither`.

    A feature that nobody has keeps its row, with prevalences of 0; an entity may be in many sets and counts once in each. The names of sets and interests become columns, so they are few."""
    member = sets.select("set", "entity").distinct()
    sizes = {r["set"]: r["n"] for r in member.groupBy("set").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each set
    named = lambda x: F.count_if(x)
    has = present.select("entity", "feature").distinct()
    inside = has.join(member, "entity").groupBy("feature").agg(*[named(F.col("set") == s).alias(f"n_{s}") for s in sizes])
    marks = has.where(F.col("entity").isin(list(interests.values()))).groupBy("feature").agg(*[F.max(F.col("entity") == e).alias(f"has_{n}") for n, e in interests.items()])
    t = weights.select("feature", "idf").join(inside, "feature", "left").join(marks, "feature", "left")
    p = {s: F.coalesce(F.col(f"n_{s}"), F.lit(0)) / float(n) for s, n in sizes.items()}
    t = t.select("feature", "idf", *[x.alias(f"p_{s}") for s, x in p.items()], *[F.coalesce(f"has_{n}", F.lit(False)).alias(f"has_{n}") for n in interests])
    t = t.select("*", *[(F.col(f"p_{s}") * (1 - F.col(f"p_{s}"))).alias(f"var_{s}") for s in sizes])
    q, own = F.col(f"p_{control}"), F.col(f"p_{study}") > 0
    shared = sum((F.col(f"has_{n}").cast("long") for n in interests), F.lit(0).cast("long"))
    t = t.withColumn("control_only", (q > 0) & (shared == 0)).withColumn("n_shared", F.when(q > 0, shared).otherwise(0)).withColumn("leverage", F.when(own, F.pow("idf", F.lit(6.0)) * q * (1 - q) * (1 - 2 * q)).otherwise(0.0))
    cut = t.where(own & (q > 0)).agg(F.percentile("leverage", F.lit(share)).alias("cut"))
    at = fresh(t, "cut")
    t = t.crossJoin(F.broadcast(cut.withColumnRenamed("cut", at))).withColumn("high", F.coalesce(F.col("leverage") >= F.col(at), F.lit(False))).drop(at)
    return t.withColumn("flag", F.when(F.col("high") & (shared > 0), "both").when(F.col("high"), "control tail").when(shared > 0, "interest").otherwise("neither"))


def skew_outliers(nulls: DataFrame, sds: float = 2.0) -> DataFrame:
    """j, n_exceed: for how many rows i the control j lies above the row's median + sds standard deviations."""
    cut = nulls.groupBy("i").agg((F.median("v") + sds * F.stddev_samp("v")).alias("cut"))
    return nulls.join(cut, "i").groupBy("j").agg(F.count_if(F.col("v") > F.col("cut")).alias("n_exceed"))


def weighted_null(nulls: DataFrame, weights: DataFrame, sds: float = 2.0) -> DataFrame:
    """j, n_exceed: as skew_outliers with a weighted median (the first value with half of the weight) and reliability-weighted deviation."""
    w = nulls.join(weights.select(F.col("entity").alias("j"), "weight"), "j")
    order = Window.partitionBy("i").orderBy("v", "j")
    share = w.withColumn("w", F.col("weight") / F.sum("weight").over(Window.partitionBy("i"))).withColumn("upto", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    share = share.withColumn("mean", F.sum(F.col("w") * F.col("v")).over(Window.partitionBy("i")))
    stats = share.groupBy("i").agg(F.min(F.when(F.col("upto") >= 0.5 - 1e-12, F.col("v"))).alias("m"), F.sum(F.col("w") * F.pow(F.col("v") - F.col("mean"), F.lit(2))).alias("sq"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    cut = stats.select("i", (F.col("m") + sds * F.sqrt(F.col("sq") / (1 - F.col("w2")))).alias("cut"))
    return nulls.join(cut, "i").groupBy("j").agg(F.count_if(F.col("v") > F.col("cut")).alias("n_exceed"))
