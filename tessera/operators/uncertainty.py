"""Predictive uncertainty and calibration: conformal, quantile regression, bootstrap, ensembles, model averaging, GARCH bands, scores.

Tables: (key, y, p) for point forecasts; (key, q, value) for quantiles; `split` marks calibration and test rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import group_quantiles
from tessera.functions.special import minimise, t_ppf

LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)


def conformal_quantile(df: DataFrame, score: Column, alpha: float, by: str) -> DataFrame:
    """(by, n_cal, cut): the interpolated quantile of a score at level ceil((n + 1)(1 - alpha)) / n, 1 at most."""
    level = F.least(F.ceil((F.col("n") + 1) * F.lit(1 - alpha)) / F.col("n"), F.lit(1.0))
    return group_quantiles(df.withColumn("_r", score), (by,), "_r", {"cut": level}).withColumnRenamed("n", "n_cal")


def split_conformal(df: DataFrame, alpha: float = 0.1, by: str = "horizon") -> DataFrame:
    """(by, n_cal, width, coverage): the calibration quantile of |y - p| as half width, and its coverage on test rows."""
    r = F.abs(F.col("y") - F.col("p"))
    width = conformal_quantile(df.where("split = 'cal'"), r, alpha, by)
    return df.where("split = 'test'").join(width, by).groupBy(by).agg(F.first("n_cal").alias("n_cal"), F.first("cut").alias("width"), F.avg((r <= F.col("cut")).cast("double")).alias("coverage"))


def cqr(df: DataFrame, alpha: float = 0.1, by: str = "horizon") -> DataFrame:
    """(by, shift, coverage): conformalised bands (lo, hi), widened by the conformal quantile of max(lo - y, y - hi)."""
    s = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi"))
    shift = conformal_quantile(df.where("split = 'cal'"), s, alpha, by)
    return df.where("split = 'test'").join(shift, by).groupBy(by).agg(F.first("cut").alias("shift"), F.avg((s <= F.col("cut")).cast("double")).alias("coverage"))


def pinball(df: DataFrame, *by: str) -> DataFrame:
    d = F.col("y") - F.col("value")
    return df.groupBy(*by).agg(F.avg(F.greatest(F.col("q") * d, (F.col("q") - 1) * d)).alias("loss"))


def interval_scores(df: DataFrame, *by: str) -> DataFrame:
    """Coverage and mean width of (lo, hi) around y."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("sharpness"))


def interval(quantiles: DataFrame, alpha: float = 0.1, nearest: bool = False) -> DataFrame:
    """(key, lo, hi) of the central interval; levels that are missing raise unless the nearest may stand in."""
    lo, hi = alpha / 2, 1 - alpha / 2
    if not nearest and quantiles.where((F.abs(F.col("q") - lo) < 1e-9) | (F.abs(F.col("q") - hi) < 1e-9)).select("q").distinct().count() < 2:
        raise ValueError(f"quantiles {lo} and {hi} are not there")
    return quantiles.groupBy("key").agg(F.min_by("value", F.abs(F.col("q") - lo)).alias("lo"), F.min_by("value", F.abs(F.col("q") - hi)).alias("hi"))


def ensemble_variance(preds: DataFrame) -> DataFrame:
    """(key, mean, epistemic, aleatoric, total) of members' (key, p, s2)."""
    out = preds.groupBy("key").agg(F.avg("p").alias("mean"), F.coalesce(F.var_samp("p"), F.lit(0.0)).alias("epistemic"), F.avg("s2").alias("aleatoric"))
    return out.withColumn("total", F.col("epistemic") + F.col("aleatoric"))


def bma_weights(models: DataFrame, *by: str) -> DataFrame:
    """Weights in proportion to exp(-delta BIC / 2) of (by, model, n, sse, k)."""
    m = models.withColumn("bic", F.col("n") * F.log(F.col("sse") / F.col("n")) + F.col("k") * F.log("n"))
    e = F.exp(-0.5 * (F.col("bic") - F.min("bic").over(Window.partitionBy(*by))))
    return m.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(Window.partitionBy(*by))).drop("_e")


def garch_variance_path(params: DataFrame, days: int = 126) -> DataFrame:
    """(symbol, day, variance, cumulative): mean-reverting forecast of (symbol, omega, alpha, beta, h0, e0)."""
    p = params.withColumns({"ab": F.col("alpha") + F.col("beta"), "h1": F.col("omega") + F.col("alpha") * F.col("e0") + F.col("beta") * F.col("h0")}).withColumn("far", F.col("omega") / (1 - F.col("ab")))
    d = p.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days)))).withColumn("variance", F.col("far") + F.pow("ab", F.col("day") - 1) * (F.col("h1") - F.col("far")))
    return d.select("symbol", "day", "variance", F.sum("variance").over(Window.partitionBy("symbol").orderBy("day")).alias("cumulative"))


def garch_bands(path: DataFrame, nu: float, horizons: tuple[int, ...] = (1, 5, 21, 63, 126), levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(symbol, day, q, value): Student bands of the cumulated return, scaled to unit variance; path has the daily mean mu."""
    z = [F.struct(F.lit(q).alias("q"), F.lit(t_ppf(q, nu) * math.sqrt((nu - 2) / nu)).alias("z")) for q in levels]
    rows = path.where(F.col("day").isin(*horizons)).withColumn("x", F.explode(F.array(*z)))
    return rows.select("symbol", "day", "x.q", (F.col("mu") * F.col("day") + F.sqrt("cumulative") * F.col("x.z")).alias("value"))


def pit(samples: DataFrame, *key: str) -> DataFrame:
    """Share of samples (value) not above y."""
    return samples.groupBy(*key).agg(F.avg((F.col("value") <= F.col("y")).cast("double")).alias("pit"))


def bootstrap_fit(rows: DataFrame, degree: int = 3, resamples: int = 500, block: int = 1, seed: int = 9) -> DataFrame:
    """(symbol, b, coef): least squares of y on powers of f in each (block) resample; failed fits are left out."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        pdf = pdf.sort_values("i")
        sym, b, n = pdf.symbol.iloc[0], int(pdf.b.iloc[0]), len(pdf)
        rng = np.random.default_rng([seed, zlib.crc32(sym.encode()), b])
        at = (rng.integers(n, size=(-(-n // block), 1)) + np.arange(block)).ravel()[:n] % n
        z = np.vander(pdf.f.to_numpy(float)[at], degree + 1)
        coef, *_ = np.linalg.lstsq(z, pdf.y.to_numpy(float)[at], rcond=None)
        ok = np.isfinite(coef).all()
        return pd.DataFrame([(sym, b, coef.tolist())] if ok else [], columns=["symbol", "b", "coef"])

    dealt = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    return dealt.groupBy("symbol", "b").applyInPandas(fit, "symbol string, b int, coef array<double>")


def quantile_regression(rows: DataFrame, levels: tuple[float, ...] = LEVELS, ridge: float = 1e-3) -> DataFrame:
    """(symbol, q, intercept, slope) of y on f; levels are groups of their own."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, f, q = pdf.y.to_numpy(float), pdf.f.to_numpy(float), float(pdf.q.iloc[0])
        sy, sf = y.std() + 1e-12, f.std() + 1e-12

        def loss(c: np.ndarray) -> float:
            d = y / sy - c[0] - c[1] * f / sf
            return float(np.maximum(q * d, (q - 1) * d).mean()) + ridge * c[1] ** 2

        c = minimise(loss, [np.quantile(y / sy, q), 0.0])
        return pd.DataFrame([(pdf.symbol.iloc[0], q, float(c[0] * sy), float(c[1] * sy / sf))], columns=["symbol", "q", "intercept", "slope"])

    dealt = rows.withColumn("q", F.explode(F.array(*map(F.lit, levels))))
    return dealt.groupBy("symbol", "q").applyInPandas(fit, "symbol string, q double, intercept double, slope double")


def rearranged(quantiles: DataFrame) -> DataFrame:
    """Sorted values per key, so that quantiles do not cross."""
    s = quantiles.groupBy("key").agg(F.array_sort(F.collect_list("q")).alias("q"), F.array_sort(F.collect_list("value")).alias("v"))
    return s.select("key", F.explode(F.arrays_zip("q", "v")).alias("x")).select("key", "x.q", F.col("x.v").alias("value"))
