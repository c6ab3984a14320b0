"""Regression on distance matrices and trees: MMRR, PGLS, Bayesian fits, WAIC, LOO, posterior grids, residuals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithmesh.functions import dist


def ols_moments(rows: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """n, b1, b2, t1, t2, f, r2 of y on two predictors, all standardised (sd n - 1), from correlations alone."""
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.corr(y, x1).alias("a"), F.corr(y, x2).alias("b"), F.corr(x1, x2).alias("c"))
    det = 1 - F.col("c") * F.col("c")
    m = m.withColumn("b1", (F.col("a") - F.col("b") * F.col("c")) / det).withColumn("b2", (F.col("b") - F.col("a") * F.col("c")) / det)
    m = m.withColumn("r2", F.col("b1") * F.col("a") + F.col("b2") * F.col("b"))
    se = F.sqrt((1 - F.col("r2")) / (F.col("n") - 3) / det)
    return m.select("n", "b1", "b2", (F.col("b1") / se).alias("t1"), (F.col("b2") / se).alias("t2"), ((F.col("r2") / 2) / ((1 - F.col("r2")) / (F.col("n") - 3))).alias("f"), "r2")


def mmrr(spark: SparkSession, y: np.ndarray, xs: list[np.ndarray], nperm: int = 9999, seed: int = 1, slices: int = 64) -> DataFrame:
    """term, estimate, statistic, p: multiple matrix regression with randomisation. y and xs: symmetric matrices of the same entities. Rows and columns
    of y are permuted together; the hat matrix is made once; two-sided p for terms, upper for F. Each permutation has its own seed, so the
    result doesn't depend on the number of tasks."""
    n = len(y)
    low = np.tril_indices(n, -1)
    z = lambda m: (m[low] - m[low].mean()) / m[low].std(ddof=1)
    x = np.column_stack([np.ones(len(low[0])), *[z(m) for m in xs]])
    inv = np.linalg.inv(x.T @ x)
    hat, df = inv @ x.T, len(low[0]) - x.shape[1]

    def stats(v: np.ndarray) -> np.ndarray:
        b = hat @ v
        r = v - x @ b
        s2 = r @ r / df
        t = b / np.sqrt(s2 * np.diag(inv))
        f = ((v @ v - len(v) * v.mean() ** 2 - r @ r) / (x.shape[1] - 1)) / s2
        return np.concatenate([t[1:], [f]])

    seen, v0 = stats(z(y)), z(y)
    limit = np.abs(seen)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = np.zeros(len(limit), dtype=np.int64)
            for k in pdf["id"]:
                order = np.random.default_rng([seed, int(k)]).permutation(n)
                hits += np.abs(stats(z(y[np.ix_(order, order)]))) >= limit - 1e-12
            yield pd.DataFrame({"term": np.arange(len(limit)), "hits": hits})

    hits = spark.range(0, nperm, 1, slices).mapInPandas(count, "term long, hits long").groupBy("term").agg(F.sum("hits").alias("hits"))
    b = hat @ v0
    r2 = 1 - float(((v0 - x @ b) ** 2).sum() / ((v0 - v0.mean()) ** 2).sum())
    est = spark.createDataFrame([(k, f"x{k + 1}" if k < len(xs) else "model", float(b[k + 1]) if k < len(xs) else r2, float(seen[k])) for k in range(len(limit))], "k long, term string, estimate double, statistic double")
    return est.join(hits.withColumnRenamed("term", "k"), "k").select("term", "estimate", "statistic", ((F.col("hits") + 1) / (nperm + 1)).alias("p"))


def pgls(y: np.ndarray, x: np.ndarray, cov: np.ndarray, lam: float | None = None) -> dict:
    """Generalised least squares y = a + b x with covariance s2 C(lambda): off-diagonal entries times lambda. None: lambda by maximum
    likelihood in [1e-6, 1]. n is at most a few hundred, so it is solved where it is called."""
    n = len(y)
    design = np.column_stack([np.ones(n), x])

    def at(value: float) -> tuple[float, np.ndarray, float, np.ndarray]:
        c = cov * value
        np.fill_diagonal(c, np.diag(cov))
        low = np.linalg.cholesky(c + 1e-12 * np.eye(n) * np.diag(cov).mean())
        wx, wy = np.linalg.solve(low, design), np.linalg.solve(low, y)
        b, *_ = np.linalg.lstsq(wx, wy, rcond=None)
        rss = float(((wy - wx @ b) ** 2).sum())
        like = -0.5 * (n * math.log(2 * math.pi * rss / n) + 2 * float(np.log(np.diag(low)).sum()) + n)
        w1 = np.linalg.solve(low, np.ones(n))
        null = float(((wy - w1 * (w1 @ wy) / (w1 @ w1)) ** 2).sum())
        return like, b, rss, np.array([null, *np.sqrt(np.diag(np.linalg.inv(wx.T @ wx)) * rss / (n - 2))])

    if lam is None:
        grid = [1e-6, *np.linspace(0.02, 1, 50)]
        best = int(np.argmax([at(g)[0] for g in grid]))
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
        for _ in range(60):
            a, b = lo + 0.382 * (hi - lo), hi - 0.382 * (hi - lo)
            lo, hi = (lo, b) if at(a)[0] >= at(b)[0] else (a, hi)
        lam = max([lo, hi, (lo + hi) / 2, grid[best]], key=lambda g: at(g)[0])
    like, b, rss, rest = at(lam)
    r2 = 1 - rss / rest[0]
    t = b[1] / rest[2]
    return {"lambda": lam, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - 2), "aic": 4 - 2 * like, "n": n, "intercept": b[0], "slope": b[1], "se": rest[2], "t": t, "p": 2 * dist.t_sf(abs(t), n - 2)}


def waic(loglik: DataFrame) -> DataFrame:
    """waic, p_waic, se from pointwise log-likelihoods (draw, obs, ll): -2 sum (log mean exp - variance)."""
    m = loglik.groupBy("obs").agg(F.max("ll").alias("top"), F.var_samp("ll").alias("p"))
    e = loglik.join(m, "obs").groupBy("obs", "top", "p").agg(F.avg(F.exp(F.col("ll") - F.col("top"))).alias("e"))
    e = e.select((F.col("top") + F.log("e")).alias("lppd"), "p")
    return e.agg((-2 * F.sum(F.col("lppd") - F.col("p"))).alias("waic"), F.sum("p").alias("p_waic"), F.sqrt(F.count(F.lit(1)) * F.var_samp(-2 * (F.col("lppd") - F.col("p")))).alias("se"))


def compared_fits(loglik: DataFrame, fitted: DataFrame, seen: DataFrame) -> DataFrame:
    """model, waic, d_waic (over the smallest), p_waic, se, nrmse, the best model first by waic: from pointwise log-likelihoods (model, draw, obs, ll), draws of the fitted means (model, draw, obs, mu) and the
    observations (obs, y). nrmse is the root mean square of y less the mean over the draws, over the range of y; null where y doesn't vary."""
    top = loglik.groupBy("model", "obs").agg(F.max("ll").alias("top"), F.var_samp("ll").alias("p"))
    e = loglik.join(top, ["model", "obs"]).groupBy("model", "obs", "top", "p").agg(F.avg(F.exp(F.col("ll") - F.col("top"))).alias("e")).withColumn("lppd", F.col("top") + F.log("e"))
    w = e.groupBy("model").agg((-2 * F.sum(F.col("lppd") - F.col("p"))).alias("waic"), F.sum("p").alias("p_waic"), F.sqrt(F.count(F.lit(1)) * F.var_samp(-2 * (F.col("lppd") - F.col("p")))).alias("se"))
    span = seen.agg((F.max("y") - F.min("y")).alias("span"))
    error = fitted.groupBy("model", "obs").agg(F.avg("mu").alias("mu")).join(seen.select("obs", "y"), "obs").groupBy("model").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("mu"), F.lit(2)))).alias("rmse"))
    t = w.join(error, "model", "left").crossJoin(F.broadcast(span)).crossJoin(F.broadcast(w.agg(F.min("waic").alias("best"))))
    return t.select("model", "waic", (F.col("waic") - F.col("best")).alias("d_waic"), "p_waic", "se", (F.col("rmse") / F.nullif("span", F.lit(0.0))).alias("nrmse"))


def psis_loo(loglik: DataFrame) -> DataFrame:
    """looic, p_loo, and the largest Pareto k: importance weights 1 / likelihood, their upper tail smoothed by a generalised Pareto fit."""

    def point(pdf: pd.DataFrame) -> pd.DataFrame:
        ll = pdf["ll"].to_numpy()
        lw, k = smoothed_weights(-ll)
        top = ll.max()
        lppd = top + math.log(np.exp(ll - top).mean())
        z = lw + ll
        loo = z.max() + math.log(np.exp(z - z.max()).sum()) - (lw.max() + math.log(np.exp(lw - lw.max()).sum()))
        return pd.DataFrame({"loo": [loo], "lppd": [lppd], "k": [k]})

    t = loglik.groupBy("obs").applyInPandas(point, "loo double, lppd double, k double")
    return t.agg((-2 * F.sum("loo")).alias("looic"), F.sum(F.col("lppd") - F.col("loo")).alias("p_loo"), F.max("k").alias("max_k"))


def smoothed_weights(lw: np.ndarray) -> tuple[np.ndarray, float]:
    """Log weights with the largest min(n / 5, 3 sqrt(n)) ones replaced by Pareto quantiles (Zhang and Stephens' fit), and its shape."""
    n = len(lw)
    lw = lw - lw.max()
    m = int(min(n / 5, 3 * math.sqrt(n)))
    if m < 5:
        return lw, math.inf
    order = np.argsort(lw, kind="stable")
    tail, cut = order[-m:], math.exp(lw[order[-m - 1]])
    x = np.exp(lw[tail]) - cut
    if x[-1] <= 0 or x[0] == x[-1]:
        return lw, math.inf
    x = np.maximum(x, 1e-300)
    grid = 30 + int(math.sqrt(m))
    q1 = x[int(m / 4 + 0.5) - 1]
    b = 1 / x[-1] + (1 - np.sqrt(grid / (np.arange(1, grid + 1) - 0.5))) / (3 * q1)
    k = np.log1p(-b[:, None] * x).mean(axis=1)
    like = m * (np.log(-b / k) - k - 1)
    w = 1 / np.exp(like[None, :] - like[:, None]).sum(axis=1)
    bb = float((b * w).sum() / w.sum())
    shape = float(np.log1p(-bb * x).mean())
    sigma, shape = -shape / bb, (shape * m + 5) / (m + 10)
    p = (np.arange(1, m + 1) - 0.5) / m
    q = sigma * np.expm1(-shape * np.log1p(-p)) / shape if abs(shape) > 1e-12 else -sigma * np.log1p(-p)
    out = lw.copy()
    out[tail] = np.minimum(np.log(q + cut), 0)
    return out, shape


#: Log prior densities and means by model; x is in units of its own choice, y near 0.15. Fixed values of the priors.
PRIORS = {"linear": [(0.15, 0.1), (0.0, 0.1)], "decay": [(0.2, 0.1)], "spline": [(0.15, 0.1)] + [(0.0, 0.1)] * 5}
SIGMA_RATE = 20.0


def spline_basis(x: np.ndarray, df: int = 5) -> np.ndarray:
    """Cubic B-splines with inner knots at quantiles, without the first one (df columns)."""
    inner = np.quantile(x, np.linspace(0, 1, df - 1)[1:-1])
    lo, hi = x.min(), x.max()
    t = np.concatenate([[lo] * 4, inner, [hi] * 4])
    b = np.array([(x >= t[i]) & (x < t[i + 1]) for i in range(len(t) - 1)], dtype=float).T
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    b[x == hi] = 0
    b[x == hi, last] = 1
    for d in range(1, 4):
        for i in range(len(t) - 1 - d):
            left = (x - t[i]) / (t[i + d] - t[i]) * b[:, i] if t[i + d] > t[i] else 0
            right = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * b[:, i + 1] if t[i + d + 1] > t[i + 1] else 0
            b[:, i] = left + right
    return b[:, 1 : df + 1]


def bayes(spark: SparkSession, kind: str, y: np.ndarray, x: np.ndarray, corr: np.ndarray, chains: int = 4, draws: int = 1000, warm: int = 2000) -> DataFrame:
    """chain, draw, param, value: adaptive Metropolis draws of y ~ N(mu(x), sigma^2 corr), one chain per task. kind: linear a + b x; decay
    a exp(-b x) with b ~ Exp(1); spline a + basis w. sigma ~ Exp(20). Whitened pointwise log-likelihoods come as params ll_0, ll_1, ..."""
    low = np.linalg.cholesky(corr)
    half = float(np.log(np.diag(low)).sum()) / len(y)
    basis = spline_basis(x) if kind == "spline" else None
    prior = PRIORS[kind]
    names = {"linear": ["a", "b"], "decay": ["a", "b"], "spline": ["a", *[f"w{k}" for k in range(1, 6)]]}[kind] + ["sigma"]

    def mu(p: np.ndarray) -> np.ndarray:
        return p[0] + p[1] * x if kind == "linear" else p[0] * np.exp(-np.exp(p[1]) * x) if kind == "decay" else p[0] + basis @ p[1:6]

    def pointwise(p: np.ndarray) -> np.ndarray:
        r = np.linalg.solve(low, y - mu(p)) / math.exp(p[-1])
        return -0.5 * r * r - 0.5 * math.log(2 * math.pi) - p[-1] - half

    def target(p: np.ndarray) -> float:
        lp = pointwise(p).sum() - SIGMA_RATE * math.exp(p[-1]) + p[-1]
        lp += sum(-0.5 * ((p[k] - m) / s) ** 2 for k, (m, s) in enumerate(prior))
        return lp + (p[1] - math.exp(p[1]) if kind == "decay" else 0.0)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["id"].iloc[0])
        rng = np.random.default_rng([11, c])
        d = len(names)
        p = np.array([m for m, _ in prior] + ([0.0] if kind == "decay" else []) + [math.log(max(y.std(), 1e-3))]) + rng.normal(0, 0.01, d)
        now, cov, mean, scale, out = target(p), np.eye(d) * 1e-3, p.copy(), 2.4**2 / d, []
        for k in range(warm + 4 * draws):
            step = rng.multivariate_normal(np.zeros(d), scale * cov + 1e-10 * np.eye(d), method="cholesky")
            new = target(p + step)
            ok = math.log(rng.random() + 1e-300) < new - now
            if ok:
                p, now = p + step, new
            if k < warm:
                g = 1 / (k + 20) ** 0.7
                scale *= math.exp(g * (ok - 0.3))
                cov = cov + g * (np.outer(p - mean, p - mean) - cov)
                mean = mean + g * (p - mean)
            elif (k - warm) % 4 == 3:
                v = p.copy()
                v[-1] = math.exp(v[-1])
                if kind == "decay":
                    v[1] = math.exp(v[1])
                out.append(np.concatenate([v, pointwise(p)]))
        m, params = np.array(out), [*names, *[f"ll_{i}" for i in range(len(y))]]
        return pd.DataFrame({"chain": c, "draw": np.repeat(np.arange(len(m)), len(params)), "param": params * len(m), "value": m.ravel()})

    return spark.range(0, chains, 1, chains).groupBy("id").applyInPandas(chain, "chain long, draw long, param string, value double")


def posterior_grid(draws: DataFrame, lo: float, hi: float, points: int = 100) -> DataFrame:
    """x, mean, lower, upper of a + b x over the draws (a, b), on a grid of points."""
    grid = draws.sparkSession.range(points).select((F.lit(lo) + F.col("id") * ((hi - lo) / (points - 1))).alias("x"))
    mu = F.col("a") + F.col("b") * F.col("x")
    return draws.crossJoin(F.broadcast(grid)).groupBy("x").agg(F.avg(mu).alias("mean"), F.percentile(mu, F.lit(0.025)).alias("lower"), F.percentile(mu, F.lit(0.975)).alias("upper"))


def partial_residuals(rows: DataFrame, key: list[str], y: str, x: str, other: str) -> DataFrame:
    """key, rx, ry: what `other` leaves of x and of y (added-variable plot)."""
    f = rows.agg(F.regr_slope(y, other).alias("sy"), F.regr_intercept(y, other).alias("iy"), F.regr_slope(x, other).alias("sx"), F.regr_intercept(x, other).alias("ix"))
    r = rows.crossJoin(F.broadcast(f))
    return r.select(*key, (F.col(x) - F.col("ix") - F.col("sx") * F.col(other)).alias("rx"), (F.col(y) - F.col("iy") - F.col("sy") * F.col(other)).alias("ry"))


def matrix(pairs: DataFrame) -> tuple[list, np.ndarray]:
    """A small symmetric matrix (i, j, v) on the driver: its entities, at most 5,000, in order, and values; missing ones are NaN."""
    pdf = pairs.limit(25_000_001).toPandas()
    names = sorted(set(pdf["i"]) | set(pdf["j"]))
    if len(names) > 5000:
        raise ValueError("a dense matrix is for at most 5,000 entities")
    at = {x: k for k, x in enumerate(names)}
    m = np.full((len(names), len(names)), np.nan)
    i, j = pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()
    m[i, j] = m[j, i] = pdf["v"].to_numpy()
    return names, m
