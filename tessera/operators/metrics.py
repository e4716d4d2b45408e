"""Forecast quality of a table (symbol, date, horizon, p, t): forecast p, outcome t; `by` names the groups."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import corr, group_quantiles, group_rank, group_row, in_parts
from tessera.sources.storage import stored

YEAR = math.sqrt(252)


def zero(x):
    return F.coalesce(x, F.lit(0.0))


def errors(df: DataFrame, *by: str) -> DataFrame:
    """n, MSE, MAE, IC, direction accuracy."""
    p, t = F.col("p"), F.col("t")
    flat = (F.stddev_pop(p) < 1e-12) | (F.stddev_pop(t) < 1e-12) | (F.count(F.lit(1)) <= 2)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((p - t) * (p - t)).alias("mse"), F.avg(F.abs(p - t)).alias("mae"), F.when(flat, 0.0).otherwise(zero(corr(p, t))).alias("ic"), F.avg((F.signum(p) == F.signum(t)).cast("double")).alias("da"))


def rank_ic(df: DataFrame, *by: str) -> DataFrame:
    ranked = group_rank(stored(group_rank(df, by, "p", "_p")), by, "t", "_t")
    return ranked.groupBy(*by).agg(zero(corr("_p", "_t")).alias("rank_ic"))


def with_long_short(df: DataFrame, *by: str) -> DataFrame:
    """Adds ls: the outcome where the forecast lies above its group's median, its negative elsewhere."""
    mid = group_quantiles(df, by, "p", {"_mid": 0.5}).drop("n")
    return df.join(F.broadcast(mid), list(by)).withColumn("ls", F.when(F.col("p") > F.col("_mid"), F.col("t")).otherwise(-F.col("t"))).drop("_mid")


def equity(df: DataFrame, *by: str) -> DataFrame:
    """Adds the compounded curve of ls in order of (date, symbol), its peak so far and its drawdown.

    In logarithms, as a long curve of losses would underflow; by parts of the dates, as a group may hold most rows."""
    step = F.log1p(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("ls"))))
    w = Window.partitionBy(*by, "_part").orderBy("date", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    rows = in_parts(df.withColumn("_step", step), by, "date", sums={"step": F.col("_step")})
    rows = rows.withColumn("log_equity", F.col("_before_step") + F.sum("_step").over(w))
    lower = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    peaks = rows.groupBy(*by, "_part").agg(F.max("log_equity").alias("_peak")).select(*by, "_part", F.max("_peak").over(lower).alias("_top"))
    made = rows.join(F.broadcast(peaks), [*by, "_part"]).withColumn("log_peak", F.greatest(F.max("log_equity").over(w), "_top"))
    made = made.withColumn("drawdown", 1 - F.exp(F.col("log_equity") - F.col("log_peak")))
    return made.withColumn("equity", F.exp("log_equity")).drop("_part", "_before", "_before_step", "_step", "_top")


def long_short(df: DataFrame, *by: str) -> DataFrame:
    """Mean, Sharpe, largest drawdown and Calmar of the long-short outcome."""
    made = equity(stored(with_long_short(df, *by)), *by)
    out = made.groupBy(*by).agg(F.avg("ls").alias("ls_mean"), F.stddev_pop("ls").alias("_sd"), F.max("drawdown").alias("max_dd"))
    return out.withColumns({"sharpe": F.when(F.col("_sd") > 1e-12, F.col("ls_mean") / F.col("_sd") * YEAR).otherwise(0.0), "calmar": F.when(F.col("max_dd") > 1e-12, F.col("ls_mean") * 252 / F.col("max_dd")).otherwise(0.0)}).drop("_sd")


def stitched(df: DataFrame, window: str = "window_id") -> DataFrame:
    """Adds the curve of ls over all windows one behind another, each in order of (date, symbol), and its drawdown.

    Windows are compounded by themselves and then moved to where the ones before them end; they are few."""
    made = stored(equity(df, window))
    ends = made.groupBy(window).agg(F.max_by("log_equity", F.struct("date", "symbol")).alias("_end"), F.max("log_equity").alias("_peak"))
    before = Window.orderBy(window).rowsBetween(Window.unboundedPreceding, -1)  # a row for each window
    ends = ends.withColumn("_at", zero(F.sum("_end").over(before))).withColumn("_top", F.max(F.col("_at") + F.col("_peak")).over(before))
    rows = made.join(F.broadcast(ends.select(window, "_at", "_top")), window)
    rows = rows.withColumns({"log_peak": F.greatest(F.col("log_peak") + F.col("_at"), "_top"), "log_equity": F.col("log_equity") + F.col("_at")})
    rows = rows.withColumn("drawdown", 1 - F.exp(F.col("log_equity") - F.col("log_peak")))
    return rows.withColumn("equity", F.exp("log_equity")).drop("_at", "_top")


def quartile_spread(df: DataFrame, *by: str) -> DataFrame:
    """Mean outcome of the top quarter of forecasts less that of the bottom quarter."""
    cuts = group_quantiles(df, by, "p", {"_a": 0.25, "_b": 0.75}).drop("n")
    return df.join(F.broadcast(cuts), list(by)).groupBy(*by).agg((zero(F.avg(F.when(F.col("p") >= F.col("_b"), F.col("t")))) - zero(F.avg(F.when(F.col("p") <= F.col("_a"), F.col("t"))))).alias("spread"))


def decile_returns(df: DataFrame, *by: str) -> DataFrame:
    """Mean outcome by tenth of the forecast, ties in order of (date, symbol)."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = group_row(df, by, "p", "date", "symbol").join(F.broadcast(n), list(by))
    return rows.withColumn("decile", F.floor((F.col("_row") - 1) * 10 / F.col("_n")).cast("int")).groupBy(*by, "decile").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("mean_t"), F.avg("p").alias("mean_p"))


def rolling_ic(df: DataFrame, *by: str, most: int = 500) -> DataFrame:
    """IC of consecutive windows of min(most, n / 5) rows, half overlapping, in order of (date, symbol)."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = group_row(df, by, "date", "symbol").join(F.broadcast(n), list(by))
    rows = rows.withColumns({"_i": F.col("_row") - 1, "_w": F.greatest(F.least(F.lit(most), F.floor(F.col("_n") / 5)), F.lit(2))})
    rows = rows.withColumn("_h", F.greatest(F.floor(F.col("_w") / 2), F.lit(1)))
    lo, hi = F.greatest(F.ceil((F.col("_i") - F.col("_w") + 1) / F.col("_h")), F.lit(0)), F.floor(F.col("_i") / F.col("_h"))
    rows = rows.where(hi >= lo).withColumn("window", F.explode(F.sequence(lo, hi))).where("window * _h + _w <= _n")
    return rows.groupBy(*by, "window").agg(F.count(F.lit(1)).alias("n"), zero(corr("p", "t")).alias("ic"))


def regime_ic(df: DataFrame, *by: str) -> DataFrame:
    """IC and direction accuracy by third of `vol` (quantiles of the group)."""
    cuts = group_quantiles(df, by, "vol", {"_a": 1 / 3, "_b": 2 / 3}).drop("n")
    at = F.when(F.col("vol") <= F.col("_a"), "calm").when(F.col("vol") <= F.col("_b"), "normal").otherwise("stormy")
    return errors(df.join(F.broadcast(cuts), list(by)).withColumn("regime", at), *by, "regime").select(*by, "regime", "n", "ic", "da")


def window_metrics(df: DataFrame, *by: str) -> DataFrame:
    """IC, RankIC, direction accuracy, long-short Sharpe, largest drawdown and quartile spread of each group."""
    parts = (errors(df, *by).select(*by, "n", "ic", "da"), rank_ic(df, *by), long_short(df, *by).select(*by, "sharpe", "max_dd"), quartile_spread(df, *by))
    return reduce(lambda a, b: a.join(b, list(by)), parts)


def horizon_means(scores: DataFrame, *by: str) -> DataFrame:
    """Means over the horizons of each window."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("horizons"), *(F.avg(c).alias(f"{c}_mean") for c in ("ic", "rank_ic", "da", "sharpe")))


def wf_summary(scores: DataFrame) -> DataFrame:
    """Across windows (window_id, ic): mean, deviation, share above 0, best and worst window."""
    return scores.agg(F.count(F.lit(1)).alias("windows"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.max_by("window_id", F.struct("ic", "window_id")).alias("best"), F.min_by("window_id", F.struct("ic", "window_id")).alias("worst"))
