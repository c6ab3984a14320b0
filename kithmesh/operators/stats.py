"""Rank, variance-component and empirical tests, multiplicity, mixtures; window statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithmesh.functions import dist
from kithmesh.operators.staging import fresh, ranked


def bh(df: DataFrame, p: str, family: list[str], out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg within each family: min over larger p of p * n / rank, at most 1; ties take their largest rank."""
    up = Window.partitionBy(*family).orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*family).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(p).over(Window.partitionBy(*family))
    rank, raw = fresh(df, "rank"), fresh(df, "raw")
    return df.withColumn(rank, F.count(p).over(up)).withColumn(raw, F.col(p) * n / F.col(rank)).withColumn(out, F.least(F.lit(1.0), F.min(raw).over(down))).drop(rank, raw)


def empirical_upper(nulls: DataFrame, observed: DataFrame, alpha: float = 0.05) -> DataFrame:
    """i, baseline, score, p, z, percentile, p_adj, significant: p = (1 + #{null >= observed}) / (m + 1) against the row's own
    null values; BH within each baseline; z is descriptive."""
    j = observed.join(nulls.select("i", F.col("v").alias("u")), "i")
    t = j.groupBy("i", "baseline").agg(F.max("score").alias("score"), F.count_if(F.col("u") >= F.col("score")).alias("k"), F.count("u").alias("m"), F.avg("u").alias("mu"), F.stddev_samp("u").alias("sd"))
    t = t.select("i", "baseline", "score", ((F.col("k") + 1) / (F.col("m") + 1)).alias("p"), ((F.col("score") - F.col("mu")) / F.col("sd")).alias("z"))
    t = bh(t.withColumn("percentile", 1 - F.col("p")), "p", ["baseline"])
    return t.withColumn("significant", F.col("p_adj") < alpha)


def mid_rank(by: list[str], value: str) -> Column:
    """Average rank of ties within a group."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def friedman(block: DataFrame) -> DataFrame:
    """n, k, chi2, w, p of a long block (entity, treatment, value), every entity having every treatment; chi2 is corrected for ties,
    w is Kendall's coefficient."""
    r = block.withColumn("r", mid_rank(["entity"], "value"))
    ties = r.groupBy("entity", "value").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = r.groupBy("treatment").agg(F.sum("r").alias("s"))
    s = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count(F.lit(1)).alias("k")).crossJoin(r.agg(F.count_distinct("entity").alias("n"))).crossJoin(ties)
    n, k = F.col("n"), F.col("k")
    chi2 = (12 * F.col("ss") / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - F.col("ties") / (n * k * (k * k - 1)))
    s = s.select("n", "k", chi2.alias("chi2"), (chi2 / (n * (k - 1))).alias("w"))
    return s.withColumn("p", _chi2_sf("chi2", "k"))


@F.pandas_udf(T.DoubleType())
def _chi2_sf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([dist.chi2_sf(a, b - 1) for a, b in zip(x, k, strict=True)])


def signed_rank(deltas: DataFrame, by: str = "baseline", value: str = "delta") -> DataFrame:
    """by, n, v, r, p, p_adj: one-sample signed-rank statistic (zeros left out) and rank-biserial correlation, with the upper-tail p, exact for under
    50 values without ties or zeros, else normal with continuity and tie correction, and adjusted by Benjamini-Hochberg over all of them."""
    all_ = deltas.groupBy(by).agg(F.count_if(F.col(value) == 0).alias("zeros"))
    d = deltas.where((F.col(value) != 0) & F.col(value).isNotNull()).withColumn("_a", F.abs(value)).withColumn("r", mid_rank([by], "_a"))
    ties = d.groupBy(by, "_a").agg(F.count(F.lit(1)).alias("t")).groupBy(by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    t = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(value) > 0, F.col("r")).otherwise(0.0)).alias("v"))
    t = t.join(ties, by).join(all_, by)
    t = t.withColumn("r", 2 * F.col("v") / (F.col("n") * (F.col("n") + 1) / 2) - 1).withColumn("p", _signed_rank_p("n", "v", "ties", "zeros"))
    every = fresh(t, "every")  # one family: a row for each value of `by`
    return bh(t.withColumn(every, F.lit(1)), "p", [every]).select(by, "n", "v", "r", "p", "p_adj")


@F.pandas_udf(T.DoubleType())
def _signed_rank_p(n: pd.Series, v: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    out = []
    for a, b, t, z in zip(n, v, ties, zeros, strict=True):
        if a < 50 and t == 0 and z == 0:
            out.append(dist.signed_rank_sf(b, int(a)))
        else:
            sd = math.sqrt(a * (a + 1) * (2 * a + 1) / 24 - t / 48)
            out.append(dist.normal_cdf(-(b - a * (a + 1) / 4 - 0.5) / sd))
    return pd.Series(out)


def _sums(block: DataFrame) -> DataFrame:
    """One row of sums of the balanced two-way block (entity, treatment, value)."""
    g = block.agg(F.avg("value").alias("gm"), F.count_distinct("entity").alias("n"), F.count_distinct("treatment").alias("k"))
    e = block.groupBy("entity").agg(F.avg("value").alias("em")).crossJoin(g.select("gm")).agg(F.sum(F.pow(F.col("em") - F.col("gm"), F.lit(2))).alias("se"))
    t = block.groupBy("treatment").agg(F.avg("value").alias("tm")).crossJoin(g.select("gm")).agg(F.sum(F.pow(F.col("tm") - F.col("gm"), F.lit(2))).alias("st"))
    a = block.crossJoin(g.select("gm")).agg(F.sum(F.pow(F.col("value") - F.col("gm"), F.lit(2))).alias("sa"))
    n, k = F.col("n"), F.col("k")
    return g.crossJoin(e).crossJoin(t).crossJoin(a).withColumn("ss_e", k * F.col("se")).withColumn("ss_r", F.col("sa") - k * F.col("se") - n * F.col("st"))


def _anova(block: DataFrame) -> DataFrame:
    """One row with the variances of the balanced block: n, k, gm, s2, su2."""
    s, n, k = _sums(block), F.col("n"), F.col("k")
    ms_e, ms_r = F.col("ss_e") / (n - 1), F.col("ss_r") / ((n - 1) * (k - 1))
    low = ms_e <= ms_r  # at the boundary the entity variance is 0 and the sums are pooled
    s2 = F.when(low, (F.col("ss_e") + F.col("ss_r")) / ((n - 1) * k)).otherwise(ms_r)
    return s.select("n", "k", "gm", s2.alias("s2"), F.when(low, F.lit(0.0)).otherwise((ms_e - ms_r) / k).alias("su2"))


def mixed_model(block: DataFrame, reference: str, alpha: float = 0.05) -> DataFrame:
    """treatment, estimate, se, df, t, p, p_adj, reject, d, icc, s2, su2: random entity intercepts on a balanced block by REML in closed form;
    contrasts with the reference treatment, two-sided p, BH over the contrasts; d is the estimate over the residual deviation."""
    a = _anova(block)
    m = block.groupBy("treatment").agg(F.avg("value").alias("m"))
    ref = m.where(F.col("treatment") == reference).select(F.col("m").alias("m0"))
    t = m.where(F.col("treatment") != reference).crossJoin(F.broadcast(ref)).crossJoin(F.broadcast(a))
    est, se = F.col("m") - F.col("m0"), F.sqrt(2 * F.col("s2") / F.col("n"))
    t = t.select("treatment", est.alias("estimate"), se.alias("se"), ((F.col("n") - 1) * (F.col("k") - 1)).alias("df"), (est / se).alias("t"), (est / F.sqrt("s2")).alias("d"), (F.col("su2") / (F.col("s2") + F.col("su2"))).alias("icc"), "s2", "su2")
    t = bh(t.withColumn("p", _t_two_sided("t", "df")).withColumn("_all", F.lit(1)), "p", ["_all"]).drop("_all")
    return t.withColumn("reject", F.col("p_adj") < alpha)


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([2 * dist.t_sf(abs(a), b) for a, b in zip(t, df, strict=True)], dtype=float)


_STEPS = 60  # halvings of an interval: more than a double can tell apart


def _root(low: Column, high: Column, above: Callable[[Column], Column]) -> Column:
    """Where `above` turns from false (at low) to true (at high), by halving the interval in a fold."""
    start = F.struct(low.alias("a"), high.alias("b"))

    def half(x: Column, _: Column) -> Column:
        m = (x["a"] + x["b"]) / 2
        up = above(m)
        return F.struct(F.when(up, x["a"]).otherwise(m).alias("a"), F.when(up, m).otherwise(x["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, half, lambda x: (x["a"] + x["b"]) / 2)


def profile_intervals(block: DataFrame, reference: str, level: float = 0.95) -> DataFrame:
    """term, estimate, low, high: profile-likelihood intervals of the mixed model on a balanced block (entity, treatment, value): for each treatment's contrast with the
    reference, and for the deviations `entity` (never below 0) and `residual`. The profile is of the maximum likelihood, as is usual also after a fit by REML; the deviations'
    estimates are those of maximum likelihood.

    With SW the sum of squares within entities, SE that between them, n entities and k treatments, minus twice the log likelihood is n (k - 1) log s + SW / s + n log w + SE / w but for a
    constant, w being s + k u >= s for residual variance s and entity variance u. A contrast fixed d away from its estimate adds n d^2 / 2 to SW; s and w
    then have closed forms, pooled where w would be below s. With s fixed, w has one; along the profile of u, s is a closed function of w. Bounds are where the profile has risen by the
    quantile of chi-squared with one degree of freedom, found by halving an interval in a fold, inside the engine. No row if there are fewer than two
    entities or treatments, or nothing varies within entities."""
    rise = F.lit(float(dist.normal_quantile((1 + level) / 2)) ** 2)
    n, k, sw, se, best = (F.col(c) for c in ("n", "k", "sw", "se", "best"))
    inner = n * (k - 1)

    def deviance(s: Column, w: Column, sw_: Column = sw) -> Column:
        return inner * F.ln(s) + sw_ / s + n * F.ln(w) + se / w

    def least(sw_: Column) -> Column:
        """The smallest deviance with this sum within."""
        pooled, s, w = (sw_ + se) / (n * k), sw_ / inner, se / n
        return F.when(w > s, deviance(s, w, sw_)).otherwise(deviance(pooled, pooled, sw_))

    def along(w: Column) -> Column:
        """s on the profile of the entity variance: the root of c s^2 + n (k - 1) s - SW, c = (n - SE / w) / w."""
        return 2 * sw / (inner + F.sqrt(F.greatest(inner * inner + 4 * (n - se / w) / w * sw, F.lit(0.0))))

    a = _sums(block).where("n > 1 and k > 1 and ss_r > 0").select(F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k"), F.col("ss_r").alias("sw"), F.greatest("ss_e", F.lit(0.0)).alias("se"))
    a = a.withColumn("best", least(sw) + rise).withColumn("pooled", (sw + se) / (n * k)).withColumn("apart", se / n > sw / inner)
    a = a.withColumn("s", F.when(F.col("apart"), sw / inner).otherwise(F.col("pooled"))).withColumn("w", F.when(F.col("apart"), se / n).otherwise(F.col("pooled")))
    half = _root(F.lit(0.0), F.sqrt(2 * (sw + se) * F.exp(F.least(rise / inner, F.lit(600.0)) + 1)), lambda d: least(sw + n * d * d / 2) > best)
    at_s = lambda x: deviance(F.exp(x), F.greatest(F.exp(x), se / n)) > best
    at_w = lambda x: deviance(along(F.exp(x)), F.exp(x)) > best
    s_hat, w_hat = F.ln("s"), F.ln("w")
    spread = lambda x: F.sqrt(F.greatest((F.exp(x) - along(F.exp(x))) / k, F.lit(0.0)))
    found = a.select(
        half.alias("half"),
        F.sqrt("s").alias("s"),
        F.exp(_root(s_hat, s_hat - rise - 1, at_s) / 2).alias("s0"),
        F.exp(_root(s_hat, s_hat + rise + 2, at_s) / 2).alias("s1"),
        F.sqrt((F.col("w") - F.col("s")) / k).alias("u"),
        F.when(deviance(F.col("pooled"), F.col("pooled")) <= best, F.lit(0.0)).otherwise(spread(_root(w_hat, F.ln("pooled"), at_w))).alias("u0"),
        spread(_root(w_hat, w_hat + rise / n + 1.1, at_w)).alias("u1"),
    )
    m = block.groupBy("treatment").agg(F.avg("value").alias("m"))
    ref = m.where(F.col("treatment") == reference).select(F.col("m").alias("m0"))
    fixed = m.where(F.col("treatment") != reference).crossJoin(F.broadcast(ref)).crossJoin(F.broadcast(found.select("half")))
    est = F.col("m") - F.col("m0")
    fixed = fixed.select(F.col("treatment").alias("term"), est.alias("estimate"), (est - F.col("half")).alias("low"), (est + F.col("half")).alias("high"))
    row = lambda name, c: F.struct(F.lit(name).alias("term"), F.col(c).alias("estimate"), F.col(f"{c}0").alias("low"), F.col(f"{c}1").alias("high"))
    return fixed.unionByName(found.select(F.explode(F.array(row("entity", "u"), row("residual", "s"))).alias("x")).select("x.*"))


def random_intercepts(block: DataFrame) -> DataFrame:
    """entity, blup: k su2 / (k su2 + s2) times the entity's deviation."""
    a = _anova(block)
    e = block.groupBy("entity").agg(F.avg("value").alias("em")).crossJoin(F.broadcast(a))
    return e.select("entity", (F.col("k") * F.col("su2") / (F.col("k") * F.col("su2") + F.col("s2")) * (F.col("em") - F.col("gm"))).alias("blup"))


def regions(flags: DataFrame, names: list[str]) -> DataFrame:
    """region, n, members: entities by the combination of their boolean flags, joined by '&', `none` without any."""
    label = F.array_join(F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in names]), lambda x: x.isNotNull()), "&")
    t = flags.withColumn("region", F.when(label == "", "none").otherwise(label))
    return t.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("entity")), ", ").alias("members"))


def mixtures(values: DataFrame, by: str, value: str, most: int = 3) -> DataFrame:
    """by, entity, k, component, posterior, influenced: one-dimensional Gaussian mixture of 1 to `most` components per group, equal or unequal variances,
    by BIC; component is the likeliest one (0 has the lowest mean), influenced tells that it is the one with the highest mean, whose posterior is
    given; with k 1 nothing is influenced and the posterior is null. A group is one task's input."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = best_mixture(pdf[value].to_numpy(dtype=float), most)
        likeliest = m.posterior.argmax(axis=1)
        return pd.DataFrame({by: pdf[by], "entity": pdf["entity"], "k": np.full(len(pdf), m.k, np.int64), "component": likeliest.astype(np.int64), "posterior": m.posterior[:, -1] if m.k > 1 else np.nan, "influenced": (likeliest == m.k - 1) & (m.k > 1)})

    kind = dict(values.dtypes)[by]
    out = values.select(by, "entity", value).dropna().groupBy(by).applyInPandas(fit, f"{by} {kind}, entity string, k long, component long, posterior double, influenced boolean")
    return out.withColumn("posterior", F.nanvl("posterior", F.lit(None)))


def mixture_summary(values: DataFrame, by: str, value: str, most: int = 3) -> DataFrame:
    """by, k, bic, n_influenced, share_influenced, mean_low, mean_high of each group's mixture; means are those of the outermost components."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = best_mixture(pdf[value].to_numpy(dtype=float), most)
        hit = (m.posterior.argmax(axis=1) == m.k - 1) & (m.k > 1)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "k": [m.k], "bic": [m.bic], "n_influenced": [int(hit.sum())], "share_influenced": [float(hit.mean())], "mean_low": [m.means[0]], "mean_high": [m.means[-1]]})

    kind = dict(values.dtypes)[by]
    return values.select(by, value).dropna().groupBy(by).applyInPandas(fit, f"{by} {kind}, k long, bic double, n_influenced long, share_influenced double, mean_low double, mean_high double")


@dataclass
class Mixture:
    k: int
    bic: float
    means: np.ndarray  # ascending
    posterior: np.ndarray  # values x components


def best_mixture(x: np.ndarray, most: int = 3) -> Mixture:
    """The model with the largest BIC."""
    n, best = len(x), Mixture(1, -math.inf, np.array([np.nan]), np.ones((len(x), 1)))
    floor = max(x.var() * 1e-6, 1e-300) if n else 1.0
    for k in range(1, min(most, n) + 1):
        for equal in (True, False):
            cuts = np.array_split(np.sort(x), k)
            mu, var, pi = np.array([c.mean() for c in cuts]), np.full(k, max(x.var() / k**2, floor)), np.full(k, 1 / k)
            last = -math.inf
            for _ in range(500):
                logp = np.log(pi) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mu) ** 2 / (2 * var)
                top = logp.max(axis=1, keepdims=True)
                like = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
                r = np.exp(logp - like[:, None])
                total = like.sum()
                if total - last < 1e-9 * abs(total):
                    break
                last = total
                nk = r.sum(axis=0) + 1e-12
                pi, mu = nk / nk.sum(), (r * x[:, None]).sum(axis=0) / nk
                var = (r * (x[:, None] - mu) ** 2).sum(axis=0) / nk
                var = np.maximum(np.full(k, (var * nk).sum() / n) if equal else var, floor)
            free = (k - 1) + k + (1 if equal else k)
            bic = 2 * total - free * math.log(n)
            if bic > best.bic + 1e-9:
                order = np.argsort(mu, kind="stable")
                best = Mixture(k, bic, mu[order], r[:, order])
            if k == 1:
                break
    return best


def shapiro(values: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, w, p, p_adj, level: Shapiro-Wilk of the values that aren't null, by Royston's approximation (3 <= n <= 5000, values not all equal, else
    null); BH over the groups; level is the third of the groups by p: `least normal`, `mid`, `most normal` (null p: no level)."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].dropna().to_numpy(dtype=float)
        w, p = shapiro_wilk(x)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(x)], "w": [w], "p": [p]})

    got = values.select(by, value).groupBy(by).applyInPandas(test, f"{by} {dict(values.dtypes)[by]}, n long, w double, p double").withColumn("_all", F.col("p").isNotNull())
    third = F.ntile(3).over(Window.partitionBy("_all").orderBy("p", by))  # one row per group
    level = F.when(F.col("_all"), F.element_at(F.array(F.lit("least normal"), F.lit("mid"), F.lit("most normal")), third))
    return bh(got, "p", ["_all"]).withColumn("level", level).select(by, "n", "w", "p", "p_adj", "level")


def shapiro_wilk(x: np.ndarray) -> tuple[float | None, float | None]:
    n = len(x)
    if n < 3 or n > 5000 or np.ptp(x) == 0:
        return None, None
    x = np.sort(x)
    m = np.array([dist.normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, norm = 1 / math.sqrt(n), float(m @ m)
    a = m / math.sqrt(norm)
    if n > 3:
        # Royston's polynomials for the outermost weights (fixed values).
        an = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(norm)], u)
        a1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(norm)], u)
        if n > 5:
            phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * a1**2)
            a = m / math.sqrt(phi)
            a[[0, -1, 1, -2]] = -an, an, -a1, a1
        else:
            phi = (norm - 2 * m[-1] ** 2) / (1 - 2 * an**2)
            a = m / math.sqrt(phi)
            a[[0, -1]] = -an, an
    else:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = math.log1p(-w) if w < 1 else -50.0, math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 0.0
        y, mu, sd = -math.log(g - y), np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, dist.normal_cdf(-(y - mu) / sd)


def weighted_stats(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, w_mean, w_sd (denominator 1 - sum of squared shares), w_median (the first value with half of the weight)."""
    total = F.sum(weight).over(Window.partitionBy(*by))
    w = rows.withColumn("_w", F.col(weight) / total).withColumn("_c", F.sum(F.col(weight) / total).over(Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)))
    w = w.withColumn("_m", F.sum(F.col("_w") * F.col(value)).over(Window.partitionBy(*by)))
    s = w.groupBy(*by).agg(F.max("_m").alias("w_mean"), F.sum(F.col("_w") * F.pow(F.col(value) - F.col("_m"), F.lit(2))).alias("_q"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"), F.min(F.when(F.col("_c") >= 0.5 - 1e-12, F.col(value))).alias("w_median"))
    return s.select(*by, "w_mean", F.sqrt(F.col("_q") / (1 - F.col("_w2"))).alias("w_sd"), "w_median")


def quantile_picks(rows: DataFrame, by: list[str], order: list[str], probs: list[float]) -> DataFrame:
    """Rows at the positions round(1 + (n - 1) p), halves to even, of each group; a row is given once."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("pick", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    hits = [F.col("pick") == F.bround(1 + (F.col("_n") - 1) * p).cast("long") for p in probs]
    cond = hits[0]
    for h in hits[1:]:
        cond = cond | h
    return r.where(cond).drop("_n")


def runs(rows: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """by, run, label, length, first, last: maximal runs of equal labels in the given order."""
    w = Window.partitionBy(*by).orderBy(order)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    r = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*by, "run").agg(F.min(label).alias(label), F.count(F.lit(1)).alias("length"), F.min(order).alias("first"), F.max(order).alias("last"))


def top_with_ties(rows: DataFrame, by: list[str], score: Column, n: int) -> DataFrame:
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(score.desc())).cast("long")).where(F.col("rank") <= n)


def min_max(col: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return (F.col(col) - F.min(col).over(w)) / (F.max(col).over(w) - F.min(col).over(w))


def standardise(col: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return (F.col(col) - F.avg(col).over(w)) / F.stddev_samp(col).over(w)


def density(values: DataFrame, by: str, value: str, points: int = 64) -> DataFrame:
    """by, x, y: Gaussian kernel density on a grid from 3 bandwidths below the minimum to 3 above the maximum; bandwidth
    0.9 min(sd, IQR / 1.34) n^-0.2."""
    q = values.where(F.col(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"), F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    q = q.withColumn("h", 0.9 * F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd")) * F.pow(F.col("n").cast("double"), F.lit(-0.2))).where("h > 0")
    grid = q.select(by, "h", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("lo") - 3 * F.col("h") + k * (F.col("hi") - F.col("lo") + 6 * F.col("h")) / (points - 1))).alias("x"))
    z = (F.col("x") - F.col(value)) / F.col("h")
    return values.select(by, value).join(grid, by).groupBy(by, "x").agg((F.sum(F.exp(-0.5 * z * z)) / F.max(F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("y"))


def tiles(df: DataFrame, order: list, n: int, out: str) -> DataFrame:
    """Adds `out`, the number from 1 to n of the row's part of the whole table in the given order; parts differ by one row at most, larger ones first. Rows are
    numbered by ranges, not in one task."""
    rank, size = fresh(df, "rank"), fresh(df, "size")
    t = ranked(df, order, rank).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(size))))
    least, more = F.floor(F.col(size) / n), F.col(size) % n
    early = more * (least + 1)
    part = F.when(F.col(rank) <= early, F.ceil(F.col(rank) / (least + 1))).otherwise(more + F.ceil((F.col(rank) - early) / F.greatest(least, F.lit(1))))
    return t.select(*df.columns, part.cast("long").alias(out))
