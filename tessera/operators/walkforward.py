"""The compact feature block of walk-forward runs: short causal frames, clipped by what the training rows show."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import BY, ORDER, backfilled, div, group_quantiles
from tessera.functions.rolling import Rolling

FRAMES = (5, 10, 20, 60)
COMPACT = sorted([*(f"mom_{w}" for w in FRAMES), *(f"rvol_{w}" for w in FRAMES), "px_to_ma20", "px_to_ma50", "rsi14", "hl_spread", "close_pos", "vol_z", "ret1", "dow_sin", "dow_cos"])
EPS = 1e-9


def compact_features(df: DataFrame) -> DataFrame:
    """Adds the columns COMPACT to bars; missing values are 0. Frames give values from a part of their rows on, averages reach back to the first row."""
    k, close = Rolling(), F.col("close")
    before = k.lag("close")
    df = df.withColumn("_range", F.greatest(F.col("high") - F.col("low"), F.lit(1e-6)))
    # The first row has no row before it: its changes are 0.
    ret = k.derived("ret1", lambda c, p: np.where(np.abs(p) > 1e-12, (c - p) / np.where(np.abs(p) > 1e-12, p, 1), 0.0), "close", before)
    step = k.derived("step", lambda c, p: np.nan_to_num(c - p), "close", before)
    gain, loss = k.mean(k.derived("gain", lambda d: np.maximum(d, 0), step), 14, 5), k.mean(k.derived("loss", lambda d: np.maximum(-d, 0), step), 14, 5)
    averages = {"_ma20": k.mean("close", 20, 5), "_ma50": k.mean("close", 50, 10), "_mv20": k.mean("volume", 20, 5)}
    out = {f"mom_{w}": k.change(w) for w in FRAMES} | {f"rvol_{w}": k.std_samp(ret, w, max(2, w // 2)) for w in FRAMES}
    out |= {"_gain": gain, "_loss": loss, "ret1": ret, **averages}
    df = k.over(df).withColumns(out)
    df = df.withColumns({c: backfilled(c) for c in averages})
    day, ratio = F.weekday(ORDER), div(F.coalesce("_gain", F.lit(0.0)), F.coalesce("_loss", F.lit(0.0)) + EPS)
    df = df.withColumns({
        "px_to_ma20": div(close - F.col("_ma20"), "_ma20"), "px_to_ma50": div(close - F.col("_ma50"), "_ma50"), "rsi14": 1 - 1 / (1 + ratio), "hl_spread": div(F.col("high") - F.col("low"), "close"),
        "close_pos": div(close - F.col("low"), "_range"), "vol_z": div(F.col("volume") - F.col("_mv20"), F.col("_mv20") + EPS), "dow_sin": F.sin(2 * math.pi * day / 5), "dow_cos": F.cos(2 * math.pi * day / 5),
    })
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in COMPACT})


def training_cuts(df: DataFrame, names: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(symbol, cuts): for each name its interpolated quantiles lo and hi over the rows with `train`, as map<name, struct<lo, hi>>."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in names))
    long = df.where("train").select(BY, F.explode(pairs).alias("f")).select(BY, "f.feature", "f.x")
    cuts = group_quantiles(long, (BY, "feature"), "x", {"lo": lo, "hi": hi})
    return cuts.groupBy(BY).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi")))).alias("cuts"))  # one entry a name


def clipped_by_training(df: DataFrame, names: list[str], share: float = 0.35, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clips features at quantiles of the first `share` of a symbol's rows (rn from 1), which later rows do not move."""
    n = df.groupBy(BY).agg(F.count(F.lit(1)).alias("_n"))
    marked = df.join(n, BY).withColumn("train", F.col("rn") <= F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(1))).drop("_n")
    cuts = training_cuts(marked, names, lo, hi)
    return marked.join(cuts, BY).withColumns({c: F.greatest(F.col("cuts")[F.lit(c)]["lo"], F.least(F.col("cuts")[F.lit(c)]["hi"], F.col(c))) for c in names}).drop("cuts", "train")
