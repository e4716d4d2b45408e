"""Goodness of fit of predictive laws, calibration reports, mixtures of models, summaries of draws.

Everything is an aggregation: a horizon may hold a sixth of all rows, so ranks and quantiles come from prefix sums over
parts of the values (functions.exprs.cells) and no group is ever held by one task."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import cells, group_quantiles, normal_cdf, weighted_quantiles

LEVELS = (0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975)
COVERAGE = (0.5, 0.8, 0.9, 0.95)
#: A coverage may be so far off, and the p-value of the fit must exceed this, for a forecast to count as calibrated.
TOLERANCE, LEAST_P = 0.07, 0.05


def tag(level: float) -> str:
    """0.025 as 2_5."""
    return f"{level * 100:g}".replace(".", "_")


def normal_quantile(level: float, mean: Column, sd: Column) -> Column:
    return mean + F.lit(NormalDist().inv_cdf(level)) * sd


def normal_crps(y: Column, mean: Column, sd: Column) -> Column:
    """Continuous ranked probability score of an outcome under a normal law; NULL without spread."""
    z = (y - mean) / sd
    return F.when(sd > 0, sd * (z * (2 * normal_cdf(z) - 1) + 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi)))


def kolmogorov_tail(x: Column) -> Column:
    """Probability that the limit of a scaled Kolmogorov-Smirnov distance exceeds x: of two equal series the one that converges at x."""
    low = 1 - math.sqrt(2 * math.pi) / x * sum((F.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(2, 5)), F.exp(-(math.pi**2) / (8 * x * x)))
    high = 2 * sum(((-1) ** (k - 1) * F.exp(-2 * k * k * x * x) for k in range(2, 6)), F.exp(-2 * x * x))
    return F.when(x < 0.1, F.lit(1.0)).when(x < 1.18, low).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), high)))


def uniformity(df: DataFrame, by: tuple[str, ...], u: str) -> DataFrame:
    """(by, n, ks, p): Kolmogorov-Smirnov distance of u from the uniform law, with its asymptotic p-value; null u do not count."""
    n = df.groupBy(*by).agg(F.count(u).alias("n"))
    rows = cells(df, by, u).join(n, list(by))
    gap = F.greatest(F.col("_upto") / F.col("n") - F.col(u), F.col(u) - (F.col("_upto") - F.col("_w")) / F.col("n"))
    d = rows.groupBy(*by).agg(F.first("n").alias("n"), F.max(gap).alias("ks"))
    root = F.sqrt(F.col("n").cast("double"))
    return d.withColumn("p", kolmogorov_tail((root + 0.12 + 0.11 / root) * F.col("ks")))


def calibration_report(
    df: DataFrame, by: tuple[str, ...], y: str, quantiles: dict[float, Column], pit: str | None = None, crps: Column | None = None, coverage: tuple[float, ...] = COVERAGE,
    tolerance: float = TOLERANCE, least_p: float = LEAST_P,
) -> DataFrame:
    """One row a group: n; coverage and mean width of each central interval; pinball loss of each quantile; mean CRPS; ks and p of the
    PIT values; calibrated, whether every coverage is within the tolerance and (with PIT values) the fit is not rejected.

    An interval takes the given quantiles that are nearest to its ends. All levels are scored in one aggregation."""

    def nearest(level: float) -> Column:
        return quantiles[min(quantiles, key=lambda q: (abs(q - level), q))]

    out, inside = [F.count(F.lit(1)).alias("n")], {}
    for c in coverage:
        lo, hi = nearest((1 - c) / 2), nearest((1 + c) / 2)
        inside[c] = f"coverage_{tag(c)}"
        out += [F.avg(((F.col(y) >= lo) & (F.col(y) <= hi)).cast("double")).alias(inside[c]), F.avg(hi - lo).alias(f"width_{tag(c)}")]
    for q, x in quantiles.items():
        d = F.col(y) - x
        out.append(F.avg(F.greatest(q * d, (q - 1) * d)).alias(f"pinball_{tag(q)}"))
    if crps is not None:
        out.append(F.avg(crps).alias("crps"))
    report = df.groupBy(*by).agg(*out)
    good = [F.abs(F.col(name) - c) <= tolerance for c, name in inside.items()]
    if pit:
        report = report.join(uniformity(df, by, pit).drop("n"), list(by))
        good.append(F.col("p") > least_p)
    verdict = good[0]
    for g in good[1:]:
        verdict = verdict & g
    return report.withColumn("calibrated", verdict)


def bma_mixture(samples: DataFrame, weights: DataFrame, by: tuple[str, ...], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """One row a group: mean, std, shares of the variance within and between the models, quantiles of the mixture.

    samples: (by, model, value), the predictive draws of each model; weights: (by, model, weight), their posterior probabilities.
    A draw counts with its model's weight over the number of the model's draws, so quantiles are those of the mixture itself."""
    models = samples.groupBy(*by, "model").agg(F.count("value").alias("_n"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v")).join(weights, [*by, "model"])
    share = F.col("weight") / F.col("_all")
    models = models.join(models.groupBy(*by).agg(F.sum("weight").alias("_all")), list(by)).withColumn("_share", share)
    mean = models.groupBy(*by).agg(F.sum(F.col("_share") * F.col("_m")).alias("mean"))
    parts = models.join(mean, list(by)).groupBy(*by).agg(F.first("mean").alias("mean"), F.sum(F.col("_share") * F.col("_v")).alias("_within"), F.sum(F.col("_share") * (F.col("_m") - F.col("mean")) * (F.col("_m") - F.col("mean"))).alias("_between"))
    total = F.col("_within") + F.col("_between")
    moments = parts.select(*by, "mean", F.sqrt(total).alias("std"), *((F.when(total > 0, F.col(f"_{k}") / total).otherwise(0.0)).alias(f"{k}_share") for k in ("within", "between")))
    drawn = samples.join(models.select(*by, "model", (F.col("_share") / F.col("_n")).alias("_each")), [*by, "model"])
    return moments.join(weighted_quantiles(drawn, by, "value", "_each", {f"q_{tag(q)}": q for q in levels}), list(by))


def simulation_summary(draws: DataFrame, by: tuple[str, ...], value: str = "value", levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """One row a group: n_draws, point (mean), std, skew, excess_kurtosis and interpolated quantiles of the draws."""
    moments = draws.groupBy(*by).agg(F.count(value).alias("n_draws"), F.avg(value).alias("point"), F.stddev_samp(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("excess_kurtosis"))
    return moments.join(group_quantiles(draws, by, value, {f"q_{tag(q)}": q for q in levels}).drop("n"), list(by))


def blended_summary(draws: DataFrame, forecasts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row for each symbol and horizon: the law of the draws (symbol, horizon, value), moved by the shift of its forecast.

    forecasts: see sources.panel.with_predictions. Spread and shape stay; mean, median, VaR, CVaR and the share of gains move."""
    key = ("symbol", "horizon")
    moved = draws.join(forecasts.select(*key, "shift"), list(key), "left").withColumn("_x", F.col("value") + F.coalesce("shift", F.lit(0.0)))
    cuts = group_quantiles(moved, key, "_x", {"median_return": 0.5, "var": alpha})
    law = moved.join(cuts.select(*key, "var"), list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean_return"), F.stddev_samp("_x").alias("std_return"), F.avg((F.col("_x") > 0).cast("double")).alias("prob_positive"), F.avg(F.when(F.col("_x") <= F.col("var"), F.col("_x"))).alias("cvar"))
    return law.join(cuts.select(*key, "median_return", "var"), list(key)).join(forecasts.select(*key, "predicted", "source"), list(key), "left")


def quantile_shares(df: DataFrame, by: tuple[str, ...], y: str, quantiles: dict[float, Column]) -> DataFrame:
    """(by, q, observed): the share of outcomes below each predicted quantile."""
    one = df.groupBy(*by).agg(*(F.avg((F.col(y) < x).cast("double")).alias(f"_{i}") for i, x in enumerate(quantiles.values())))
    return one.select(*by, F.inline(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"_{i}").alias("observed")) for i, q in enumerate(quantiles)))))
