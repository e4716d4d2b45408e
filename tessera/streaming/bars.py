"""Streaming: watermarked bars of an event stream, and an online mean with CUSUM alarms kept as state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_bars(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(event_type, start, open, high, low, close, n) of tumbling windows; runs on a stream or a table."""
    at = F.struct("ts", "event_id")
    made = events.where("value is not null").withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = made.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select("event_type", F.col("window.start").alias("start"), "open", "high", "low", "close", "n")


def online_alarms(events: DataFrame, span: int = 20, threshold: float = 5.0, drift: float = 0.5) -> DataFrame:
    """(event_type, ts, ema, alarm) of each event: running mean and deviation feed a two-sided CUSUM that resets at an alarm.

    The state of a key is seven numbers, so it does not grow with the stream; events of a batch are taken in order of time."""
    a = 2 / (span + 1)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2, ema, up, down = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        rows = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            sd = (m2 / n) ** 0.5 if n > 1 else 0.0
            z = (r.value - mean) / sd if sd > 1e-12 else 0.0
            up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
            alarm = up > threshold or down > threshold
            if alarm:
                up = down = 0.0
            n += 1
            delta = r.value - mean
            mean += delta / n
            m2 += delta * (r.value - mean)
            ema = r.value if n == 1 else ema + a * (r.value - ema)
            rows.append((key[0], r.ts, ema, alarm))
        state.update((n, mean, m2, ema, up, down))
        yield pd.DataFrame(rows, columns=["event_type", "ts", "ema", "alarm"])

    rows = events.where("value is not null and event_type is not null").select("event_type", "ts", "event_id", "value")
    return rows.groupBy("event_type").applyInPandasWithState(update, "event_type string, ts timestamp, ema double, alarm boolean", "n long, mean double, m2 double, ema double, up double, down double", "append", "NoTimeout")
