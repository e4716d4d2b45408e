"""Change points of a stream: Bayesian online detection whose beliefs are keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.regimes import RunLengths

BELIEF = "r int, p double, mu double, kappa double, alpha double, beta double"
FOUND = "event_type string, ts timestamp, event_id long, cp_prob double, run_length int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Changes(StatefulProcessor):
    """A key's beliefs are a list state, one entry for each run length that still has mass."""

    def __init__(self, hazard: float, most: int, scale: float, least: float, ttl_ms: int | None):
        self.how, self.ttl_ms = (hazard, most, scale, least), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.beliefs = handle.getListState("beliefs", BELIEF, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = RunLengths(*self.how)
        if self.beliefs.exists():
            runs.restore([tuple(b) for b in self.beliefs.get()])
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        p, r = runs.steps(batch.value.to_numpy(float))
        self.beliefs.put(runs.beliefs())
        yield pd.DataFrame({"event_type": key[0], "ts": batch.ts, "event_id": batch.event_id, "cp_prob": p, "run_length": r})

    def close(self) -> None:
        pass


def online_changes(events: DataFrame, hazard: float = 1 / 100, most: int = 300, scale: float = 1.0, least: float = 1e-9, ttl_ms: int | None = None) -> DataFrame:
    """(event_type, ts, event_id, cp_prob, run_length) of each event of a stream; a change shows as a fall of the run length.

    Needs the RocksDB state store (`PROVIDER`). State of a key: at most `most` run lengths, those below a posterior of `least` are
    given up; with `ttl_ms` a key that is silent for so long starts afresh (such a
    stream looks at the clock again and again: stop it, as it does not end by itself). Within a micro-batch events are taken in order of (ts,
    event_id); batches are taken as they come. Events without type or value are left out."""
    if events.sparkSession.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    rows = events.where("value is not null and event_type is not null").select("event_type", "ts", "event_id", "value")
    how = _Changes(hazard, most, scale, least, ttl_ms)
    return rows.groupBy("event_type").transformWithStateInPandas(how, FOUND, "append", "ProcessingTime" if ttl_ms else "None")


def rocksdb_state(spark: SparkSession) -> None:
    """Keeps streaming state in RocksDB from now on, for the whole session."""
    spark.conf.set(PROVIDER, ROCKSDB)
