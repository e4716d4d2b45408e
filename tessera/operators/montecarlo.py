"""Calibration, simulation and scoring of return paths.

Paths are simulated in chunks of one (symbol, chunk), seeded by (seed, symbol, chunk), so results do not
depend on partitions; only the horizons asked for leave the simulator."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import corr, normal_cdf, ordered
from tessera.functions.special import minimise
from tessera.operators.calibration import uniformity

DAYS = 252
ENGINES = {"gbm": 0.15, "merton": 0.15, "heston": 0.15, "garch": 0.25, "bootstrap": 0.30}


def log_returns(panel: DataFrame, last: int | None = None) -> DataFrame:
    """(symbol, date, i, x): log returns with their place; `last` keeps the latest prices only."""
    if last:
        panel = panel.withColumn("_d", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("_d") <= last)
    before = F.lag("close").over(ordered())
    made = panel.select("symbol", "date", F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before)).alias("x")).where("x is not null")
    return made.withColumn("i", F.row_number().over(ordered()) - 1)


def gbm_params(x: DataFrame) -> DataFrame:
    return x.groupBy("symbol").agg((F.avg("x") * DAYS).alias("mu"), (F.stddev_samp("x") * math.sqrt(DAYS)).alias("sigma"))


def merton_params(x: DataFrame, z: float = 3.0) -> DataFrame:
    """Jumps are returns beyond z deviations; below three of them their law is (0, 2 sigma)."""
    first = x.groupBy("symbol").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count(F.lit(1)).alias("n"))
    j = F.abs(F.col("x") - F.col("m")) > z * F.col("s")
    out = x.join(first, "symbol").groupBy("symbol").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.sum(j.cast("int")).alias("jumps"), F.avg(F.when(j, F.col("x"))).alias("jm"), F.stddev_samp(F.when(j, F.col("x"))).alias("js"), F.avg(F.when(~j, F.col("x"))).alias("dm"), F.stddev_samp(F.when(~j, F.col("x"))).alias("ds"))
    few = F.col("jumps") < 3
    return out.select("symbol", "jumps", (F.col("jumps") / F.col("n") * DAYS).alias("lam"), F.when(few, 0.0).otherwise(F.col("jm")).alias("jump_mean"), F.when(few, 2 * F.col("s")).otherwise(F.col("js")).alias("jump_std"), (F.col("dm") * DAYS).alias("mu"), (F.col("ds") * math.sqrt(DAYS)).alias("sigma"))


def heston_params(x: DataFrame) -> DataFrame:
    """Moments: persistence of squared returns, long-run and recent variance, correlation of returns with variance moves."""
    y = x.withColumns({"q": F.col("x") * F.col("x"), "back": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i")))}).withColumns({"q1": F.lead("q").over(Window.partitionBy("symbol").orderBy("i"))})
    one = y.groupBy("symbol").agg((F.avg("x") * DAYS).alias("mu"), F.var_pop("x").alias("theta"), F.var_pop(F.when(F.col("back") <= 20, F.col("x"))).alias("v0"), F.regr_slope("q1", "q").alias("slope"), corr(F.when(F.col("q1").isNotNull(), F.col("x")), F.col("q1") - F.col("q")).alias("rho"))
    one = one.withColumn("phi", F.greatest(F.lit(-0.98), F.least(F.lit(0.98), F.col("slope"))))
    resid = y.join(one.select("symbol", "phi"), "symbol").groupBy("symbol").agg(F.stddev_pop(F.col("q1") - F.col("phi") * F.col("q")).alias("rs"))
    return one.join(resid, "symbol").select("symbol", "mu", F.greatest(-F.log(F.greatest(F.col("phi"), F.lit(1e-4))) * DAYS, F.lit(1.0)).alias("kappa"), (F.col("theta") * DAYS).alias("theta"), F.greatest(F.lit(0.05), F.least(F.lit(3.0), F.col("rs") * math.sqrt(DAYS))).alias("xi"), F.greatest(F.lit(-0.95), F.least(F.lit(0.0), F.col("rho"))).alias("rho"), (F.col("v0") * DAYS).alias("v0"))


def garch_filter(x: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    e, h = (x - x.mean()).tolist(), np.empty(len(x))
    h0 = float(np.var(x))
    for i in range(len(x)):
        h[i] = h0 = h0 if i == 0 else omega + alpha * e[i - 1] ** 2 + beta * h0
    return h


def garch_fit(x: np.ndarray) -> tuple[float, float, float, float]:
    """(omega, alpha, beta, nu) of a GARCH(1,1) with Student errors, by maximum likelihood."""
    var = float(np.var(x)) + 1e-12
    if len(x) < 60:
        return 0.05 * var, 0.08, 0.85, 8.0

    def loss(p: np.ndarray) -> float:
        w, a, b, nu = math.exp(p[0]) * var, *(1 / (1 + np.exp(-p[1:3]))), 2.1 + math.exp(min(p[3], 6))
        if a + b >= 0.999:
            return 1e10
        h = np.maximum(garch_filter(x, w, a, b), 1e-12)
        e2 = (x - x.mean()) ** 2
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        return float(-(c - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(e2 / (h * (nu - 2)))).sum())

    best = minimise(loss, [math.log(0.05), math.log(0.08 / 0.92), math.log(0.85 / 0.15), math.log(5.9)], rounds=150)
    if not math.isfinite(loss(best)) or loss(best) >= 1e10:
        return 0.05 * var, 0.08, 0.85, 8.0
    return math.exp(best[0]) * var, *(float(v) for v in 1 / (1 + np.exp(-best[1:3]))), 2.1 + math.exp(min(best[3], 6))


def simulate(engine: str, x: np.ndarray, days: int, paths: int, rng: np.random.Generator) -> np.ndarray:
    """[paths, days] log returns of one engine calibrated on x; unknown names raise."""
    m, s = float(x.mean()), float(x.std(ddof=1))
    if engine == "ensemble":
        split = rng.multinomial(paths, list(ENGINES.values()))
        return np.concatenate([simulate(e, x, days, int(k), rng) for e, k in zip(ENGINES, split, strict=True)])
    if engine == "gbm":
        return m + s * rng.standard_normal((paths, days))
    if engine == "merton":
        jump = np.abs(x - m) > 3 * s
        calm = x[~jump] if (~jump).sum() >= 30 else x
        jm, js = (x[jump].mean(), x[jump].std(ddof=1)) if jump.sum() >= 3 else (0.0, 2 * s)
        n = rng.poisson(jump.mean(), (paths, days))
        return calm.mean() + calm.std(ddof=1) * rng.standard_normal((paths, days)) + n * jm + np.sqrt(n) * js * rng.standard_normal((paths, days))
    if engine == "heston":
        q = x * x
        phi = float(np.clip(np.corrcoef(q[:-1], q[1:])[0, 1] if q.std() > 0 else 0.9, 1e-4, 0.98))
        theta, kappa = float(x.var()), max(-math.log(phi), 1 / DAYS)
        xi = float(np.clip(np.std(q[1:] - phi * q[:-1]), 1e-6, 0.2))
        rho = float(np.clip(np.corrcoef(x[:-1], np.diff(q))[0, 1] if q.std() > 0 else -0.4, -0.95, 0.0))
        v, out = np.full(paths, float(x[-20:].var())), np.empty((paths, days))
        for d in range(days):
            a, b = rng.standard_normal((2, paths))
            vp = np.maximum(v, 0)
            out[:, d] = np.clip(m - 0.5 * (vp - theta) + np.sqrt(vp) * a, -0.2, 0.2)
            v = np.minimum(vp + kappa * (theta - vp) + xi * np.sqrt(vp / max(theta, 1e-12)) * (rho * a + math.sqrt(1 - rho * rho) * b), max(8 * theta, 0.01))
        return out
    if engine == "garch":
        w, a, b, nu = garch_fit(x)
        h, out = np.full(paths, w / max(1 - a - b, 1e-3)), np.empty((paths, days))
        for d in range(days):
            h = np.minimum(h, 0.01)
            e = np.clip(np.sqrt(h) * rng.standard_t(nu, paths) * math.sqrt((nu - 2) / nu), -0.2, 0.2)
            out[:, d] = m + e
            h = w + a * e * e + b * h
        return out
    if engine == "bootstrap":
        block = 20
        start = rng.integers(len(x), size=(paths, -(-days // block)))
        at = (start[:, :, None] + np.arange(block)).reshape(paths, -1)[:, :days] % len(x)
        return x[at]
    raise ValueError(f"unknown engine {engine}")


def terminal_returns(x: DataFrame, engine: str = "ensemble", horizons: tuple[int, ...] = (1, 5, 10, 21, 63, 126, 252), chunks: int = 20, paths: int = 250, seed: int = 11) -> DataFrame:
    """(symbol, path, horizon, ret): simple return of each path at each horizon."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sym, chunk, series = pdf.symbol.iloc[0], int(pdf.chunk.iloc[0]), pdf.sort_values("i").x.to_numpy(float)
        rng = np.random.default_rng([seed, zlib.crc32(sym.encode()), chunk])
        steps = np.clip(simulate(engine, series, max(horizons), paths, rng), -0.5, 0.5).cumsum(1)
        return pd.concat([pd.DataFrame({"symbol": sym, "path": chunk * paths + np.arange(paths), "horizon": h, "ret": np.expm1(steps[:, h - 1])}) for h in horizons])

    dealt = x.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return dealt.groupBy("symbol", "chunk").applyInPandas(run, "symbol string, path int, horizon int, ret double")


def horizon_summary(sims: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Moments, chance of a gain, VaR and CVaR by symbol and horizon."""
    key = ["symbol", "horizon"]
    cut = sims.groupBy(*key).agg(F.percentile("ret", F.lit(alpha)).alias("var"), F.percentile("ret", F.lit(0.5)).alias("median"))
    r = F.col("ret")
    return sims.join(cut, key).groupBy(*key).agg(F.avg(r).alias("mean"), F.first("median").alias("median"), F.stddev_samp(r).alias("std"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"), F.avg((r > 0).cast("double")).alias("p_up"), F.first("var").alias("var"), F.avg(F.when(r <= F.col("var"), r)).alias("cvar"))


def var_cvar(x: DataFrame, alpha: float = 0.05) -> DataFrame:
    cut = x.groupBy("symbol").agg(F.percentile("x", F.lit(alpha)).alias("var"))
    return x.join(cut, "symbol").groupBy("symbol").agg(F.first("var").alias("var"), F.avg(F.when(F.col("x") <= F.col("var"), F.col("x"))).alias("cvar"))


def ljung_box(x: DataFrame, lags: int = 10) -> DataFrame:
    """Q of the first lags; the p-value is the even-degree chi-square tail."""
    w = Window.partitionBy("symbol").orderBy("i")
    m = x.groupBy("symbol").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    d = x.join(m, "symbol").withColumn("d", F.col("x") - F.col("m"))
    d = d.withColumns({f"_{k}": F.col("d") * F.lag("d", k).over(w) for k in range(1, lags + 1)})
    s = d.groupBy("symbol").agg(F.first("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("v"), *(F.sum(f"_{k}").alias(f"a{k}") for k in range(1, lags + 1)))
    q = sum((F.pow(F.col(f"a{k}") / F.col("v"), 2) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0)) * F.col("n") * (F.col("n") + 2)
    half = F.col("q") / 2
    p = F.exp(-half) * sum((F.pow(half, i) / math.factorial(i) for i in range(lags // 2)), F.lit(0.0))
    return s.select("symbol", q.alias("q")).withColumn("p_value", p)


def hurst_lag(x: DataFrame, most: int = 20) -> DataFrame:
    """Slope of log deviation of lagged differences of the cumulated returns on log lag."""
    w = Window.partitionBy("symbol").orderBy("i")
    c = x.withColumn("c", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumns({f"_{k}": F.col("c") - F.lag("c", k).over(w) for k in range(2, most)})
    s = c.groupBy("symbol").agg(*(F.stddev_pop(f"_{k}").alias(f"s{k}") for k in range(2, most)))
    long = s.select("symbol", F.explode(F.array(*(F.struct(F.lit(math.log(k)).alias("lk"), F.log(F.col(f"s{k}") + 1e-12).alias("ls")) for k in range(2, most)))).alias("z"))
    return long.groupBy("symbol").agg(F.regr_slope("z.ls", "z.lk").alias("hurst"))


def crps(samples: DataFrame, y: str, value: str, *by: str) -> DataFrame:
    """E|X - y| - E|X - X'| / 2 of each group's samples, by ranks instead of pairs."""
    w = Window.partitionBy(*by).orderBy(value)
    r = samples.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    return r.groupBy(*by).agg((F.avg(F.abs(F.col(value) - F.col(y))) - F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col(value) / (F.col("_n") * F.col("_n")))).alias("crps"))


def kupiec(breaches: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Likelihood ratio of the breach share (columns n, x) against alpha, with its chi-square p-value."""
    n, x = F.col("n").cast("double"), F.col("x").cast("double")
    pi = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x / n))
    lr = -2 * ((n - x) * math.log(1 - alpha) + x * math.log(alpha) - (n - x) * F.log(1 - pi) - x * F.log(pi))
    ratio = F.greatest(lr, F.lit(0.0))
    return breaches.withColumns({"lr": ratio, "p_value": 2 * (1 - normal_cdf(F.sqrt(ratio)))})


def rolling_backtest(x: DataFrame, engine: str = "ensemble", first: int = 252, step: int = 10, origins: int = 40, lookback: int = 756, horizons: tuple[int, ...] = (5, 21, 63), paths: int = 1000, alpha: float = 0.05, seed: int = 11) -> DataFrame:
    """(symbol, origin, horizon, pit, breach, crps, bias): a forecast from each of the last origins, calibrated on what lies before it.

    Each origin's slice is its own group, so a symbol's origins run side by side."""
    n = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    at = n.where(F.col("n") > first + max(horizons)).select("symbol", F.explode(F.sequence(F.lit(first), (F.col("n") - max(horizons)).cast("int"), F.lit(step))).alias("origin"))
    at = at.withColumn("_d", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("origin")))).where(F.col("_d") <= origins).drop("_d")
    part = x.join(at, "symbol").where((F.col("i") >= F.col("origin") - lookback) & (F.col("i") < F.col("origin") + max(horizons)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        sym, origin = pdf.symbol.iloc[0], int(pdf.origin.iloc[0])
        past, future = pdf[pdf.i < origin].x.to_numpy(float), pdf[pdf.i >= origin].x.to_numpy(float)
        sims = simulate(engine, past, max(horizons), paths, np.random.default_rng([seed, zlib.crc32(sym.encode()), origin])).cumsum(1)
        rows = []
        for h in horizons:
            s, y = np.sort(np.expm1(sims[:, h - 1])), math.expm1(future[:h].sum())
            spread = float(((2 * np.arange(1, len(s) + 1) - len(s) - 1) * s).sum()) / len(s) ** 2
            rows.append((sym, origin, h, float((s <= y).mean()), int(y < np.quantile(s, alpha)), float(np.abs(s - y).mean()) - spread, float(s.mean()) - y))
        return pd.DataFrame(rows, columns=["symbol", "origin", "horizon", "pit", "breach", "crps", "bias"])

    return part.groupBy("symbol", "origin").applyInPandas(run, "symbol string, origin int, horizon int, pit double, breach int, crps double, bias double")


def backtest_report(scores: DataFrame) -> DataFrame:
    """By horizon: n, breaches, mean CRPS and bias, Kolmogorov-Smirnov of the PITs, Kupiec p-value."""

    agg = kupiec(scores.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("breach").alias("x"), F.avg("crps").alias("crps"), F.avg("bias").alias("bias")))
    return agg.withColumnRenamed("p_value", "kupiec_p").join(uniformity(scores, ("horizon",), "pit").select("horizon", "ks", F.col("p").alias("ks_p")), "horizon")
