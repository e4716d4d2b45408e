"""Labels, sequence windows, purged splits, normalisation and walk-forward geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import frame, ordered

HORIZONS = (1, 3, 5, 7, 14, 28)
SEQUENCE, STRIDE, PURGE = 180, 5, 28


def forward_labels(panel: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(symbol, date, horizon, target): log return over the next rows, where both prices are positive."""
    ahead = panel.select("symbol", "date", "close", *(F.lead("close", h).over(ordered()).alias(f"_{h}") for h in horizons))
    long = ahead.select("symbol", "date", "close", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}").alias("ahead")) for h in horizons))).alias("x"))
    return long.where((F.col("close") > 0) & (F.col("x.ahead") > 0)).select("symbol", "date", "x.horizon", F.log(F.col("x.ahead") / F.col("close")).alias("target"))


def sequence_index(panel: DataFrame, length: int = SEQUENCE, stride: int = STRIDE) -> DataFrame:
    """(symbol, sample, end_idx, date) of every window of `length` rows; the windows themselves are not stored."""
    at = panel.select("symbol", "date", (F.row_number().over(ordered()) - 1).alias("end_idx"))
    return at.where((F.col("end_idx") >= length - 1) & ((F.col("end_idx") - (length - 1)) % stride == 0)).withColumn("sample", ((F.col("end_idx") - (length - 1)) / stride).cast("int"))


def sequences(features: DataFrame, names: list[str], length: int = SEQUENCE, stride: int = STRIDE, limit: float = 65504.0) -> DataFrame:
    """The windows as arrays of feature arrays, clipped to the range of half precision; missing values stay NULL."""
    row = F.array(*(F.when(F.col(c).isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(c)))).cast("float") for c in names))
    at = features.select("symbol", "date", F.row_number().over(ordered()).alias("_n"), F.collect_list(row).over(frame(length)).alias("window"))
    return at.where((F.col("_n") >= length) & ((F.col("_n") - length) % stride == 0)).drop("_n")


def purged_split(index: DataFrame, train: float = 0.75, test: float = 0.9, purge: int = PURGE) -> DataFrame:
    """Adds split (train, val, test or purged) by a sample's place in its symbol, `purge` samples off each border."""
    n, s = F.count(F.lit(1)).over(Window.partitionBy("symbol")), F.col("sample")
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(test))
    return index.withColumn("split", F.when(s < a - purge, "train").when((s >= a + purge) & (s < b - purge), "val").when(s >= b + purge, "test").otherwise("purged"))


def norm_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mu, sigma) over all rows in one aggregation; a deviation of 0 counts as 1."""
    wide = df.agg(*(f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mu"), F.when(F.col(f"s_{c}") < 1e-9, F.lit(1.0)).otherwise(F.col(f"s_{c}")).alias("sigma")) for c in names]
    return wide.select(F.inline(F.array(*rows)))


def normalised(df: DataFrame, stats: DataFrame, names: list[str], limit: float = 5.0) -> DataFrame:
    """z-scores clipped to +-limit; the statistics are one row, one entry a feature."""
    one = stats.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mu", "sigma")))).alias("_st"))
    def z(c: str):
        st = F.col("_st")[F.lit(c)]
        return F.greatest(F.lit(-limit), F.least(F.lit(limit), (F.col(c) - st["mu"]) / st["sigma"])).alias(c)
    return df.join(F.broadcast(one)).select("symbol", "date", *(z(c) for c in names))  # broadcasts one row


def wf_windows(panel: DataFrame, initial: float = 0.35, test: float = 0.08, step: float = 0.08, max_h: int = 28, most: int = 40, mode: str = "expanding") -> DataFrame:
    """(window_id, train_start, val_cut, train_end, test_start, test_end) over the shortest symbol's length; purge is max_h + 2."""
    n = panel.groupBy("symbol").count().agg(F.min("count").alias("n"))
    g = n.select("n", F.floor(F.col("n") * F.lit(initial)).alias("i"), F.greatest(F.floor(F.col("n") * F.lit(test)), F.lit(1)).alias("t"), F.greatest(F.floor(F.col("n") * F.lit(step)), F.lit(1)).alias("s"))
    w = g.where("n is not null").select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("window_id"))
    w = w.withColumns({"train_end": F.col("i") + F.col("window_id") * F.col("s")}).withColumns({"test_start": F.col("train_end") + max_h + 2})
    w = w.withColumns({"test_end": F.least(F.col("test_start") + F.col("t"), F.col("n")), "train_start": F.lit(0).cast("long") if mode == "expanding" else F.col("window_id") * F.col("s")}).where("test_start + t <= n")
    return w.select("window_id", "train_start", (F.col("train_start") + F.floor((F.col("train_end") - F.col("train_start")) * F.lit(0.85))).alias("val_cut"), "train_end", "test_start", "test_end")


def aligned(panel: DataFrame) -> DataFrame:
    """The last rows of every symbol, as many as the shortest has; idx counts from 0."""
    counts = panel.groupBy("symbol").count()
    n = counts.agg(F.min("count").alias("_min"))
    at = panel.withColumn("_n", F.row_number().over(ordered())).join(counts, "symbol").join(F.broadcast(n))  # one row
    return at.withColumn("idx", F.col("_n") - 1 - (F.col("count") - F.col("_min"))).where("idx >= 0").drop("_n", "count", "_min")


def in_windows(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows of each window with their part (train, val, test); the specs are at most 40 rows."""
    i = F.col("idx")
    part = F.when((i >= F.col("train_start")) & (i < F.col("val_cut")), "train").when((i >= F.col("val_cut")) & (i < F.col("train_end")), "val").when((i >= F.col("test_start")) & (i < F.col("test_end")), "test")
    return rows.join(F.broadcast(specs), (i >= F.col("train_start")) & (i < F.col("test_end"))).withColumn("part", part).where("part is not null")


def wf_norm_stats(rows: DataFrame, specs: DataFrame, names: list[str]) -> DataFrame:
    """Mean and deviation of each window's training rows by symbol."""
    sd = {c: F.stddev_pop(c) for c in names}
    return in_windows(rows, specs).where("part = 'train'").groupBy("window_id", "symbol").agg(*(x for c in names for x in (F.avg(c).alias(f"mu_{c}"), F.when(sd[c] < 1e-9, 1.0).otherwise(sd[c]).alias(f"sd_{c}"))))
