"""Online change points on a stream against the batch run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.regimes import RunLengths, bocpd
from tessera.streaming import bars
from tessera.streaming.changes import online_changes, rocksdb_state


def test_pruning_follows_the_mass():
    """Giving up run lengths without mass changes nothing that is seen, and holds far fewer of them after a change."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 250), rng.normal(9, 1, 60), rng.normal(-4, 0.3, 60)])
    full, lean = RunLengths(scale=1.0), RunLengths(scale=1.0, least=1e-9)
    for i, v in enumerate(x):
        a, b = full.step(v), lean.step(v)
        assert abs(a[0] - b[0]) < 1e-6 and a[1] == b[1]
        if i in (280, 369):
            assert len(lean.p) < len(full.p) / 3
    assert b[1] in (59, 60)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of state is a Python worker of its own in each micro-batch."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    value = np.concatenate([rng.normal(0, 1, 80), rng.normal(6, 1, 80)])
    rows = [(i, int(i), kind, None if i % 37 == 5 else float(v + shift)) for i, v in enumerate(value) for kind, shift in (("a", 0.0), ("b", 3.0))]
    rows = [(2 * k + (kind == "b"), t, kind, v) for k, t, kind, v in rows] + [(9999, 3, None, 1.0)]
    events = spark.createDataFrame(rows, "event_id long, t long, event_type string, value double").select("event_id", F.timestamp_seconds("t").alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", "value", F.lit("").alias("props"))
    folder = tmp_path / "in"

    def add(lo, hi):
        events.where((F.col("ts") >= F.timestamp_seconds(F.lit(lo))) & (F.col("ts") < F.timestamp_seconds(F.lit(hi)))).coalesce(1).write.mode("append").parquet(str(folder))

    return events, str(folder), add


def test_stream_equals_batch_after_a_restart(spark, batches, tmp_path):
    """Micro-batches, then a second run from the checkpoint, as one batch run over the whole series."""
    events, folder, add = batches
    rocksdb_state(spark)

    def run():
        found = online_changes(bars.event_stream(spark, folder))
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None

    for lo, hi in ((0, 30), (30, 90), (90, 160)):
        add(lo, hi)
        run()  # each time from the checkpoint
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["event_type", "ts", "event_id"])
    rows = events.where("value is not null and event_type is not null").withColumns({"symbol": F.col("event_type"), "x": F.col("value"), "i": F.col("event_id").cast("int")})
    want = bocpd(rows.select("symbol", "i", "x"), scale=1.0, least=1e-9).toPandas().sort_values(["symbol", "i"])
    assert len(got) == len(want) > 300
    assert got.event_id.tolist() == want.i.tolist() and got.run_length.tolist() == want.run_length.tolist()
    assert np.allclose(got.cp_prob, want.cp_prob, rtol=1e-12, atol=1e-15)


def test_silent_keys_start_afresh(spark, batches, tmp_path):
    """With a time to live, what comes after a silence is seen as a new series."""
    import time

    events, folder, add = batches
    rocksdb_state(spark)
    for lo, hi in ((0, 60), (60, 100)):
        add(lo, hi)
        found = online_changes(bars.event_stream(spark, folder), ttl_ms=1000)
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        for _ in range(120):  # with a time to live a run does not end by itself
            if sum(p["numInputRows"] for p in query.recentProgress):
                break
            time.sleep(0.5)
        query.stop()
        time.sleep(2)
    got = spark.read.parquet(str(tmp_path / "out")).where("ts >= timestamp_seconds(60)")
    first = got.groupBy("event_type").agg(F.min_by("run_length", "ts").alias("first"), F.max("run_length").alias("longest"), F.count("*").alias("n")).collect()
    assert len(first) == 2 and all(r.first <= 1 and r.longest <= r.n for r in first)


def test_other_stores_are_refused(spark, batches):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            online_changes(batches[0])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
