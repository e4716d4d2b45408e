"""A store of sequence windows, and the samples that a training loop fetches from it.

Windows lie in folders by symbol and block of samples, sorted by sample within. A lookup by keys joins a broadcast list of
keys with the scan: folders without a wanted key are pruned when the query runs, and the store itself is never shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import BY
from tessera.operators.datasets import ENCODED
from tessera.operators.windows import SEQUENCE, STRIDE, sequences

#: Consecutive samples of a symbol in one folder.
BLOCK = 64
#: Keys of one lookup that are broadcast (some 40 bytes each); of more, both sides are dealt out by key.
MOST_KEYS = 1_000_000
STATIC = ("mean_size", "deviation", "annual_mean")


def write_sequences(features: DataFrame, names: list[str], targets: DataFrame, path: str, length: int = SEQUENCE, stride: int = STRIDE, block: int = BLOCK) -> None:
    """Writes every window of `length` rows, `stride` apart, with its targets (symbol, date, target array) at the last row."""
    windows = sequences(features, names, length, stride).withColumnRenamed("date", "end")
    at = features.select(BY, F.col("date").alias("end"), (F.col("rn") - length).alias("_n"))
    rows = windows.join(at, [BY, "end"]).withColumn("sample", (F.col("_n") / stride).cast("int")).drop("_n")
    rows = rows.join(targets.withColumnRenamed("date", "end"), [BY, "end"], "left").withColumn("block", F.floor(F.col("sample") / block).cast("int"))
    dealt = rows.repartition(BY, "block").sortWithinPartitions(BY, "block", "sample")
    dealt.write.partitionBy(BY, "block").parquet(path)


def lookup(spark: SparkSession, path: str, keys: DataFrame, block: int = BLOCK, most_keys: int = MOST_KEYS) -> DataFrame:
    """The stored windows of keys (symbol, sample); a key that is not there gives no row, a repeated one gives one."""
    wanted = keys.select(BY, F.col("sample").cast("int").alias("sample")).distinct().where("sample >= 0").withColumn("block", F.floor(F.col("sample") / block).cast("int"))
    if wanted.limit(most_keys + 1).count() <= most_keys:
        wanted = F.broadcast(wanted)
    return spark.read.parquet(path).join(wanted, [BY, "block", "sample"])


def samples(windows: DataFrame, stats: DataFrame, names: list[str], of: str = "r", encoded: int = ENCODED, limit: float = 5.0) -> DataFrame:
    """(symbol, sample, encoder, target, static): the first `encoded` rows of a window as clipped z-scores, missing values 0; the targets,
    missing ones 0; and of the encoded column `of` its mean size, deviation and mean of a year, clipped.

    stats: (feature, mu, sigma), see operators.datasets; one entry a feature, broadcast as one row."""
    one = stats.where(F.col("feature").isin(names)).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mu", "sigma")))).alias("_st"))
    mu, sigma = (F.array(*(F.col("_st")[F.lit(c)][k] for c in names)) for k in ("mu", "sigma"))

    def finite(x: Column) -> Column:
        return F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(F.lit(0.0))

    def scaled(row: Column) -> Column:
        z = F.zip_with(F.zip_with(row, F.col("_mu"), lambda x, m: x.cast("double") - m), F.col("_sigma"), lambda d, s: F.when(d.isNotNull() & ~F.isnan(d), F.greatest(F.lit(-limit), F.least(F.lit(limit), d / s))))
        return F.transform(z, finite)

    made = windows.join(F.broadcast(one)).withColumns({"_mu": mu, "_sigma": sigma}).withColumn("encoder", F.transform(F.slice("window", 1, encoded), scaled))
    x = F.transform("encoder", lambda row: row[names.index(of)])
    n = F.size("_x").cast("double")

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n

    made = made.withColumn("_x", x).withColumn("_mean", mean(F.col("_x")))
    spread = F.sqrt(mean(F.transform("_x", lambda v: (v - F.col("_mean")) * (v - F.col("_mean")))))
    static = [F.greatest(F.lit(-limit), F.least(F.lit(limit), v)) for v in (mean(F.transform("_x", F.abs)), spread, F.col("_mean") * 252)]
    return made.select(BY, "sample", "encoder", F.transform("target", finite).alias("target"), F.struct(*(v.alias(k) for k, v in zip(STATIC, static, strict=True))).alias("static"))
