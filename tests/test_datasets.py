"""Window statistics, carried labels, correlations, the window store, the panel cache, discovery and keyed runs."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import datasets as D
from tessera.operators import walkforward as WF
from tessera.operators.runner import run_keyed
from tessera.sources import sequences as SQ
from tessera.sources.cache import PanelCache, load_from, missing_ranges
from tessera.sources.discovery import found_symbols, last_rows, load_panel


@pytest.fixture(scope="module")
def history(spark):
    rng = np.random.default_rng(1)
    rows = [(s, d.date(), i + 1, i, None if i % 29 == 3 else float(rng.normal()), float(1e9 + rng.normal())) for s, n in (("A", 260), ("B", 60), ("C", 20)) for i, d in enumerate(pd.bdate_range("2003-01-01", periods=n))]
    return spark.createDataFrame(rows, "symbol string, date date, rn long, idx long, r double, close double").cache()


def test_sampled_windows(spark):
    """The same draw however rows are dealt, of the size that was asked for, all where there are fewer."""
    index = spark.createDataFrame([(s, i) for s in "AB" for i in range(300)], "symbol string, sample int")
    draws = [sorted(map(tuple, D.sampled_windows(index.repartition(n), 50, 3).select("symbol", "sample").collect())) for n in (1, 7)]
    assert draws[0] == draws[1] and len(set(draws[0])) == 50 and len({s for s, _ in draws[0]}) == 2
    assert draws[0] != sorted(map(tuple, D.sampled_windows(index, 50, 4).select("symbol", "sample").collect()))
    assert D.sampled_windows(index, 10_000).count() == 600


@pytest.mark.parametrize("part", [13, D.PART])
def test_dataset_norm_stats(spark, history, part):
    """Overlapping windows count a row as often as they hold it; a large level loses no digits; parts of a history agree."""
    length, encoded = 12, 7
    windows = [("A", 11), ("A", 13), ("A", 40), ("A", 259), ("B", 30), ("B", 31)]
    targets = [("A", 13, 0.5), ("A", 40, -1.0), ("B", 30, None), ("A", 12, 99.0)]
    got = {r.feature: r for r in D.dataset_norm_stats(history, spark.createDataFrame(windows, "symbol string, end_idx int"), spark.createDataFrame(targets, "symbol string, end_idx int, target double"), ["r", "close"], length, encoded, part).collect()}
    pdf = history.toPandas().sort_values(["symbol", "idx"])
    rows = pd.concat([pdf[(pdf.symbol == s) & pdf.idx.between(e - length + 1, e - length + encoded)] for s, e in windows])
    for c in ("r", "close"):
        v = rows[c].fillna(0.0).to_numpy()
        assert len(v) == 42 and np.isclose(got[c].mu, v.mean(), rtol=1e-12, atol=1e-12) and np.isclose(got[c].sigma, v.std(), rtol=1e-6)
    assert np.isclose(got["target"].mu, -0.25) and np.isclose(got["target"].sigma, 0.75)
    none = spark.createDataFrame([], "symbol string, end_idx int")
    assert D.dataset_norm_stats(history, none, spark.createDataFrame([], "symbol string, end_idx int, target double"), ["r"], length, encoded).count() == 0


@pytest.mark.parametrize("part", [4, D.PART])
def test_filled_forward(spark, part):
    known = {"A": [None, None, 1, None, None, None, None, None, None, 2, None], "B": [None] * 6, "C": [3, None, 4], "D": [None] * 9 + [7]}
    want = {"A": [1] * 9 + [2, 2], "B": [None] * 6, "C": [3, 3, 4], "D": [7] * 10}
    rows = spark.createDataFrame([(s, i, v) for s, vs in known.items() for i, v in enumerate(vs)], "symbol string, i long, known int").repartition(3)
    got = D.filled_forward(rows, "known", "i", "state", part).orderBy("symbol", "i").collect()
    assert {s: [r.state for r in got if r.symbol == s] for s in known} == want and all(r.known == known[r.symbol][r.i] for r in got)


def test_correlation_matrix(spark):
    """Large levels, a constant, rows with gaps; few numbers leave a task."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5)) @ rng.normal(size=(5, 5)) + 1e7
    x[:, 3] = 4.0
    rows = [tuple(map(float, r)) for r in x]
    rows[10] = (None, *rows[10][1:])
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(7)
    got = {(r.a, r.b): r for r in D.correlation_matrix(df, list("abcde")).collect()}
    want = np.corrcoef(np.delete(np.delete(x, 10, axis=0), 3, axis=1).T)
    keep = "abce"
    assert len(got) == 15 and all(r.n == 2999 for r in got.values())
    assert all(np.isclose(got[p, q]["corr"], want[i, j], atol=1e-8) for i, p in enumerate(keep) for j, q in enumerate(keep) if i <= j)
    assert got["d", "d"]["corr"] == 0.0 and got["a", "d"]["corr"] == 0.0


@pytest.fixture(scope="module")
def store(spark, history, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "windows")
    targets = history.select("symbol", "date", F.array(F.col("r"), F.lit(float("nan"))).alias("target"))
    SQ.write_sequences(history, ["r", "close"], targets, path, length=20, stride=3, block=8)
    return path


def test_sample_fetch(spark, history, store):
    stats = spark.createDataFrame([("r", 0.1, 0.5), ("close", 1e9, 2.0), ("other", 0.0, 1.0)], "feature string, mu double, sigma double")
    keys = spark.createDataFrame([("A", 0), ("A", 79), ("B", 4), ("B", 4), ("C", 0), ("C", 5), ("Z", 0), ("A", -1)], "symbol string, sample int")
    got = {(r.symbol, r.sample): r for r in SQ.samples(SQ.lookup(spark, store, keys, block=8), stats, ["r", "close"], encoded=12).collect()}
    assert set(got) == {("A", 0), ("A", 79), ("B", 4), ("C", 0)}
    pdf = history.toPandas().sort_values(["symbol", "idx"])
    for (s, k), r in got.items():
        rows = pdf[(pdf.symbol == s) & pdf.idx.between(3 * k, 3 * k + 11)]
        z = np.nan_to_num(np.clip((rows.r.astype(np.float32).astype(float) - 0.1) / 0.5, -5, 5)).astype(float)
        assert len(r.encoder) == 12 and np.allclose([e[0] for e in r.encoder], z)
        assert np.allclose(list(r.static), np.clip([np.abs(z).mean(), z.std(), z.mean() * 252], -5, 5))
        end = pdf[(pdf.symbol == s) & (pdf.idx == 3 * k + 19)].r.iloc[0]
        assert np.isclose(r.target[0], 0.0 if np.isnan(end) else end) and r.target[1] == 0.0


def test_lookup_prunes_folders_and_leaves_the_store_in_place(spark, store):
    keys = spark.createDataFrame([("B", 2)], "symbol string, sample int")
    df = SQ.lookup(spark, store, keys, block=8)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("Initial Plan")] if "Initial Plan" in plan else plan
    assert "dynamicpruning" in final and "BroadcastHashJoin" in final
    side = [line for line in final.split("\n") if "Exchange hashpartitioning" in line]
    assert not any("window" in line for line in side) and "SortMergeJoin" not in final
    shuffled = SQ.lookup(spark, store, keys, block=8, most_keys=0)  # beyond the bound: dealt out by key, with the same rows
    assert [r.sample for r in shuffled.collect()] == [r.sample for r in df.collect()] == [2]


# The cache


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def test_missing_ranges():
    rng = np.random.default_rng(4)
    assert missing_ranges((day(1), day(9)), [(day(3), day(4)), (day(5), day(6))]) == [(day(1), day(2)), (day(7), day(9))]
    for _ in range(300):
        held = [tuple(sorted((day(int(a)), day(int(b))))) for a, b in rng.integers(0, 40, (rng.integers(0, 5), 2))]
        lo, hi = sorted(rng.integers(0, 40, 2))
        got = missing_ranges((day(int(lo)), day(int(hi))), held)
        days = [d for a, b in got for d in range((a - day(0)).days, (b - day(0)).days + 1)]
        assert days == [d for d in range(lo, hi + 1) if not any(a <= day(d) <= b for a, b in held)]


@pytest.fixture
def cached(spark, tmp_path):
    source = spark.createDataFrame([(s, day(i), float(i)) for s in "ABC" for i in range(200) if s != "C" or i < 5], "symbol string, date date, close double").cache()
    asked = []

    def load(ranges):
        asked.append(sorted(map(tuple, ranges.collect())))
        return load_from(source)(ranges)

    return PanelCache(spark, str(tmp_path / "cache"), load, least_rows=9), asked


def days_of(df):
    return sorted((r.symbol, (r.date - day(0)).days) for r in df.collect())


def test_cache_loads_what_is_missing(cached):
    """Overlapping, adjoining and disjoint requests; too few rows are given but asked for again."""
    cache, asked = cached
    assert days_of(cache.fetch(["A"], day(20), day(40))) == [("A", i) for i in range(20, 41)]
    assert days_of(cache.fetch(["A", "B"], day(30), day(60))) == [(s, i) for s in "AB" for i in range(30, 61)]
    assert asked[-1] == [("A", day(41), day(60)), ("B", day(30), day(60))]
    cache.fetch(["A"], day(61), day(80))
    cache.fetch(["A"], day(120), day(150))
    n = len(asked)
    assert days_of(cache.fetch(["A"], day(25), day(75))) == [("A", i) for i in range(25, 76)] and len(asked) == n
    assert days_of(cache.fetch(["A"], day(10), day(160))) == [("A", i) for i in range(10, 161)]
    assert asked[-1] == [("A", day(10), day(19)), ("A", day(81), day(119)), ("A", day(151), day(160))]
    for _ in range(2):
        assert days_of(cache.fetch(["C", "A"], day(0), day(12))) == [("A", i) for i in range(13)] + [("C", i) for i in range(5)]
        assert ("C", day(0), day(12)) in asked[-1]


def test_cache_survives_writers(spark, cached):
    """A writer that dies before its manifest leaves nothing that counts; the second of two starts over."""
    cache, asked = cached
    cache.fetch(["A"], day(0), day(20))
    publish, cache._publish = cache._publish, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        cache.fetch(["A"], day(0), day(50))
    cache._publish = publish
    assert days_of(cache.fetch(["A"], day(0), day(30))) == [("A", i) for i in range(31)]
    other = PanelCache(spark, cache.path, cache.load, 9)

    def late(version, held):
        cache._publish = publish
        other.fetch(["B"], day(0), day(40))  # takes the version that this one was about to take
        return publish(version, held)

    cache._publish = late
    assert days_of(cache.fetch(["B"], day(10), day(60))) == [("B", i) for i in range(10, 61)]
    assert asked[-1] == [("B", day(41), day(60))]
    assert json.dumps(sorted(cache.manifest()[1])) == '["A", "B"]'


# Discovery


def test_discovery(spark, tmp_path):
    """Folders of unlike columns; symbols of all folders, the first of them; the limit prunes the scan."""
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.createDataFrame([(s, i, 1.5) for s in "DCBA" for i in range(3)], "symbol string, i int, x double").write.partitionBy("symbol").parquet(one)
    spark.createDataFrame([(s, i, 7) for s in "BDCE" for i in range(3, 5)], "symbol string, i long, y int").write.partitionBy("symbol").parquet(two)
    assert [r.symbol for r in found_symbols(spark, [one, two]).collect()] == ["B", "C", "D"]
    got = load_panel(spark, [one, two], most=2)
    assert sorted(map(tuple, got.select("symbol", "i", "x", "y").collect()), key=str) == sorted([(s, i, 1.5 if i < 3 else None, None if i < 3 else 7) for s in "BC" for i in range(5)], key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(symbol") + plan.count("PartitionFilters: [symbol") == 2
    assert "ReadSchema: struct<>" in found_symbols(spark, [one])._jdf.queryExecution().executedPlan().toString()
    assert load_panel(spark, [one, two]).count() == 20 and load_panel(spark, [one], symbols=["A", "Q"]).count() == 3


def test_last_rows(spark, history):
    from tessera.operators.windows import sequences

    got = last_rows(sequences(history, ["r", "close"], 20, 3), ["r", "close"]).where("symbol = 'B'").orderBy("date").collect()
    want = history.where("symbol = 'B' and idx >= 19 and (idx - 19) % 3 = 0").orderBy("date").collect()
    assert [g.date for g in got] == [w.date for w in want] and all(g.r is None or np.isclose(g.r, w.r) for g, w in zip(got, want, strict=True))


# Keyed runs


def fit(train):
    if train["k"].iloc[0] == "bad":
        raise ZeroDivisionError("no fit")
    return train["x"].mean()


def predict(model, target):
    if target["k"].iloc[0] == "short":
        return target.head(1).assign(p=model, n=1)
    if target["k"].iloc[0] == "words":
        return target.assign(p="nothing", n=1)
    return target.assign(p=model + target["x"], n=len(target))


def test_keyed_runs_go_on(spark):
    rows = [(k, p, float(i)) for k in ("a", "b", "bad", "short", "words") for p, n in (("train", 4), ("target", 3)) for i in range(n)] + [("only", "train", 1.0)]
    df = spark.createDataFrame(rows, "k string, part string, x double")
    out = run_keyed(df, "k", fit, predict, "p double, n int").cache()
    status = {r.k: (r.status, r.error) for r in out.select("k", "status", "error").distinct().collect()}
    assert status["a"] == status["b"] == ("ok", None) and status["only"] == ("empty", None)
    assert status["bad"] == ("failed", "ZeroDivisionError: no fit") and status["short"][0] == status["words"][0] == "failed"
    assert sorted(r.p for r in out.where("k = 'a'").collect()) == [1.5, 2.5, 3.5] and out.where("k = 'short'").collect()[0].p is None
    again = run_keyed(df, "k", lambda t: 0.0, lambda m, t: t.assign(p=m, n=0), "p double, n int", done=out)
    assert {r.k for r in again.collect()} == {"bad", "short", "words"} and {r.status for r in again.collect()} == {"ok"}


def test_training_clip_ignores_what_comes_later(spark):
    """Later rows, however wild, do not move a symbol's cuts."""
    calm = [("A", i + 1, float(i % 10)) for i in range(40)]
    wild = [("A", i + 41, 1e9 if i % 2 else -1e9) for i in range(60)]
    got = WF.clipped_by_training(spark.createDataFrame(calm + wild, "symbol string, rn long, v double"), ["v"], 0.4, 0.0, 1.0).agg(F.min("v"), F.max("v")).first()
    assert tuple(got) == (0.0, 9.0)
