"""Sources: panels of daily bars from parquet, market and sector series, JSON predictions, generators, sinks."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import average_rank, clip, div, lag

#: Fewest rows of a symbol that take part in feature work.
MIN_HISTORY = 218
PANEL = T.StructType([T.StructField(c, T.StringType()) for c in ("symbol", "sector")] + [T.StructField("date", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "dollar_volume")])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items: symbol is the supplier's nation, sector its region, price the unit price.

    A first pass finds each bar's least and largest order, a second takes the first and last line of those orders alone: Spark
    can only sort, not hash, rows for the least of a whole key, and nearly all lines are no candidates."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    items = read(spark, sf_dir, "lineitem").select(*key, F.to_date("l_shipdate").alias("date"))
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    dims = read(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))  # at most 25 nations
    px, at, order = F.col("l_extendedprice") / F.col("l_quantity"), F.struct(*key), F.col("l_orderkey")
    lines, bar = items.join(dims, F.col("l_suppkey") == F.col("s_suppkey")), ["symbol", "sector", "date"]
    least = F.when(F.count(order) == F.count(F.lit(1)), F.min(order))  # a missing order is the least
    whole = lines.groupBy(*bar).agg(least.alias("_first"), F.max(order).alias("_last"), F.max(px).alias("high"), F.min(px).alias("low"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("dollar_volume"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"e.{c}")) for c in bar]
    edge = order.eqNullSafe(F.col("_first")) | order.eqNullSafe(F.col("_last"))
    ends = lines.alias("l").join(whole.select(*bar, "_first", "_last").alias("e"), [*same, edge]).select(*(f"l.{c}" for c in (*bar, *key)))
    ends = ends.groupBy(*bar).agg(F.min_by(px, at).alias("open"), F.max_by(px, at).alias("close"))
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"n.{c}")) for c in bar]
    return whole.alias("w").join(ends.alias("n"), same).select(*(f"w.{c}" for c in bar), "open", "high", "low", "close", "volume", "dollar_volume")


def validated(df: DataFrame) -> DataFrame:
    """The panel columns with their types; optional ones that are absent become NULL, required ones raise."""
    missing = [f.name for f in PANEL if f.name not in df.columns and f.name != "sector"]
    if missing:
        raise ValueError(f"panel lacks {missing}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PANEL))


def distinct_first(df: DataFrame, *order: str) -> DataFrame:
    """The first row of each (symbol, date) in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "date").orderBy(*order))).where("_n = 1").drop("_n")


def with_history(df: DataFrame, least: int = MIN_HISTORY) -> DataFrame:
    """Rows of symbols with at least so many."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("_n") >= least).drop("_n")


def with_returns(df: DataFrame) -> DataFrame:
    return df.withColumns({"rn": F.row_number().over(Window.partitionBy("symbol").orderBy("date")), "r": div("close", lag("close"), None) - 1})


def market_series(panel: DataFrame) -> DataFrame:
    """(date, mr, mv, mb): mean and deviation of the day's returns, share of risers."""
    r = F.col("r")
    return panel.groupBy("date").agg(F.coalesce(F.avg(r), F.lit(0.0)).alias("mr"), F.coalesce(F.stddev_pop(r), F.lit(0.0)).alias("mv"), F.coalesce(F.avg((r > 0).cast("double")), F.lit(0.0)).alias("mb"))


def sector_returns(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date", "sector").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("sr"))


def coded(panel: DataFrame, name: str = "sector") -> DataFrame:
    """(symbol, code): lexicographic codes of a dimension, -1 where it is missing; ranks the few distinct values only."""
    first = panel.groupBy("symbol").agg(F.min_by(name, "date").alias(name))
    codes = first.where(F.col(name).isNotNull()).select(name).distinct().withColumn("code", F.row_number().over(Window.orderBy(name)) - 1)
    return first.join(codes, name, "left").select("symbol", F.coalesce("code", F.lit(-1)).alias("code"))


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with returns, market, sector and cross-sectional columns.

    A day's bars meet once: what `market_series` and `sector_returns` give by date comes from frames over the day here."""
    base = with_returns(with_history(bars(spark, sf_dir)))
    r, day, by_sector = F.col("r"), Window.partitionBy("date"), Window.partitionBy("date", "sector")
    parts = {"mr": F.avg(r).over(day), "mv": F.stddev_pop(r).over(day), "mb": F.avg((r > 0).cast("double")).over(day), "sr": F.avg(r).over(by_sector)}
    series = {name: F.coalesce(x, F.lit(0.0)) for name, x in parts.items()}
    return base.withColumns({"cs_return_rank": average_rank("r", "date") / F.count("r").over(day), **series})


def model_predictions(spark: SparkSession, text: str) -> DataFrame:
    """(symbol, horizon, predicted) of a JSON object {symbol: {horizon: return}}; anything else gives no rows."""
    parsed = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", "map<string,map<string,double>>").alias("m"))
    return parsed.select(F.explode("m").alias("symbol", "by")).select("symbol", F.explode("by").alias("h", "predicted")).select("symbol", F.expr("try_cast(h as int)").alias("horizon"), "predicted").where("horizon is not null and predicted is not null")


def with_predictions(forecasts: DataFrame, predictions: DataFrame, weight: float = 0.5) -> DataFrame:
    """Forecasts (symbol, horizon, mean_return) with the model's view where there is one.

    blend goes from the mean return to the view by `weight` (0 to 1, clipped), shift is how far that is, source says which it is."""
    w = min(1.0, max(0.0, weight))
    both = forecasts.join(predictions, ["symbol", "horizon"], "left")
    known = F.col("predicted").isNotNull() & F.lit(w > 0)
    blend = F.when(known, (1 - w) * F.col("mean_return") + w * F.col("predicted")).otherwise(F.col("mean_return"))
    return both.withColumns({"blend": blend, "shift": blend - F.col("mean_return"), "source": F.when(known, "MODEL+MC").otherwise("PURE MC")})


def top_symbols(panel: DataFrame, k: int = 5, by: str = "dollar_volume") -> DataFrame:
    """The k symbols with the largest sum of a column, ties by name."""
    return panel.groupBy("symbol").agg(F.sum(by).alias("total")).orderBy(F.desc("total"), "symbol").limit(k)


def shared_symbols(a: DataFrame, b: DataFrame) -> DataFrame:
    """(symbol, side): in both panels, or in one only."""
    a, b = a.select("symbol"), b.select("symbol")
    parts = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a)}
    return reduce(DataFrame.unionByName, (rows.withColumn("side", F.lit(side)) for side, rows in parts.items()))


def sector_pivot(returns: DataFrame, sectors: list[str]) -> DataFrame:
    """(date, one column a sector): sector returns side by side, 0 where a sector has no bar that day."""
    return returns.groupBy("date").pivot("sector", sectors).agg(F.first("sr")).na.fill(0.0)


def cross_sectional_z(panel: DataFrame, x: str = "r", limit: float = 5.0) -> DataFrame:
    """(symbol, date, cs_z): a value's z-score among the day's values, clipped."""
    by_day = Window.partitionBy("date")
    z = (F.col(x) - F.avg(x).over(by_day)) / (F.stddev_pop(x).over(by_day) + 1e-8)
    return panel.select("symbol", "date", clip(z, -limit, limit).alias("cs_z")).where("cs_z is not null")


def symbol_list(text: str) -> list[str]:
    """Upper-case names of a comma-separated list, in order, without repeats."""
    return list(dict.fromkeys(x for x in (p.strip().upper() for p in text.split(",")) if x))


def synthetic_panel(spark: SparkSession, symbols: int = 8, days: int = 2600, seed: int = 7, start: str = "2012-01-02") -> DataFrame:
    """Business-day bars whose drift and volatility follow a three-state chain; one task a symbol, seeded by its number."""
    import numpy as np

    def make(batches):
        for pdf in batches:
            for k in pdf.id:
                rng = np.random.default_rng([seed, int(k)])
                stay, state = rng.random(days) < 0.97, np.zeros(days, int)
                for i in range(1, days):
                    state[i] = state[i - 1] if stay[i] else rng.integers(3)
                mu, sd = np.array([0.0004, 0.001, -0.0015])[state], np.array([0.008, 0.012, 0.025])[state]
                close = 100 * np.exp(np.cumsum(mu + sd * rng.standard_t(5, days) * np.sqrt(0.6)))
                open_ = np.r_[100.0, close[:-1]] * np.exp(0.2 * sd * rng.standard_normal(days))
                wide = np.abs(sd * rng.standard_normal(days))
                volume = np.round(1e6 * np.exp(0.3 * rng.standard_normal(days)))
                yield pd.DataFrame({"symbol": f"SYN{int(k):03d}", "sector": f"S{int(k) % 4}", "date": pd.bdate_range(start, periods=days).date, "open": open_, "high": np.maximum(open_, close) * (1 + wide), "low": np.minimum(open_, close) * (1 - wide), "close": close, "volume": volume, "dollar_volume": volume * close})

    return spark.range(0, symbols, 1, symbols).mapInPandas(make, PANEL)


def read_or_generate(spark: SparkSession, path: str | None, **how) -> DataFrame:
    """A parquet panel, or a synthetic one where the path is absent or holds none."""
    from pyspark.errors import AnalysisException

    if path:
        try:
            return validated(spark.read.option("mergeSchema", True).parquet(path))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return synthetic_panel(spark, **how)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON, CSV (with header) or parquet by symbol."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.partitionBy("symbol").parquet(path)


def todo_only(specs: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Specs without a stored result: a run that was cut short goes on from there."""
    return specs.join(done.select(*key), list(key), "left_anti")
