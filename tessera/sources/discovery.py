"""Panels that lie in folders by symbol: finding the symbols, reading some of them from several folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def found_symbols(spark: SparkSession, folders: list[str], most: int | None = None) -> DataFrame:
    """(symbol) that every folder holds, in order of name, the first `most` of them.

    Only the names of partitions are asked for: no column is read from a file."""
    each = [spark.read.parquet(f).select(F.col("symbol").cast("string").alias("symbol")).where("symbol is not null").distinct() for f in folders]
    both = reduce(lambda a, b: a.join(b, "symbol", "left_semi"), each).orderBy("symbol")
    return both if most is None else both.limit(most)


def load_panel(spark: SparkSession, folders: list[str], most: int | None = None, symbols: list[str] | None = None) -> DataFrame:
    """The rows of all folders together for the given symbols, or for those that `found_symbols` names (`most` of them, 12 as a rule).

    Folders may differ in their columns: what one lacks is NULL, a column has the widest type of its numbers. The names go into
    the scan as a filter of partitions, so other symbols' folders are never opened."""
    if symbols is None and most is not None:
        symbols = [r.symbol for r in found_symbols(spark, folders, most).collect()]  # bounded by `most`
    parts = []
    for f in folders:
        rows = spark.read.option("mergeSchema", True).parquet(f)
        parts.append(rows.where(F.col("symbol").isin(symbols)) if symbols is not None else rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def last_rows(windows: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, date, features) of windowed rows (symbol, date, window): each window's last row, the newest that it may know."""
    last = F.element_at("window", -1)
    return windows.select("symbol", "date", *(last[i].alias(n) for i, n in enumerate(names)))
