"""The rolling kernel against plain frames: values, nulls, large levels, constant frames, chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import rolling
from tessera.functions.rolling import Rolling, co_moments, counted, quantiles, rolled


def frames(x, n):
    return [(lambda w: w[~np.isnan(w)])(x[max(0, i - n + 1) : i + 1]) for i in range(len(x))]


@pytest.mark.parametrize("seed", range(12))
def test_frames_with_gaps(seed):
    rng = np.random.default_rng(seed)
    size, n = int(rng.integers(1, 400)), int(rng.integers(1, 60))
    x, y = rng.normal(size=size), rng.normal(size=size)
    x[rng.random(size) < 0.15] = np.nan
    c, mx, my, vx, vy, xy = co_moments(x, y, n)
    high, low, total, middle, seen = rolled(x, n, np.maximum, -np.inf), rolled(x, n, np.minimum, np.inf), rolled(x, n, np.add, 0.0), quantiles(x, n, 0.3), counted(x, n)
    for i, w in enumerate(frames(x, n)):
        v = y[max(0, i - n + 1) : i + 1][~np.isnan(x[max(0, i - n + 1) : i + 1])]
        assert c[i] == seen[i] == len(w)
        if len(w):
            assert np.allclose([mx[i], my[i], vx[i], vy[i], xy[i]], [w.mean(), v.mean(), ((w - w.mean()) ** 2).sum(), ((v - v.mean()) ** 2).sum(), ((w - w.mean()) * (v - v.mean())).sum()], rtol=1e-9, atol=1e-12)
            assert (high[i], low[i]) == (w.max(), w.min()) and np.isclose(total[i], w.sum()) and np.isclose(middle[i], np.quantile(w, 0.3))


def test_large_prices_do_not_cancel():
    """Cents on a price of a hundred million after a history of huge values: running sums would lose every digit."""
    rng = np.random.default_rng(1)
    cents = rng.normal(0, 0.01, 3000)
    x = np.concatenate([rng.normal(1e15, 1e14, 500), 1e8 + cents])
    c, _, _, v, _, _ = co_moments(x, x, 20)
    got, want = np.sqrt(v / c)[520:], np.array([w.std() for w in frames(x, 20)[520:]])
    assert np.allclose(got, want, rtol=1e-6) and np.abs(got - 0.01).max() < 0.01
    whole = np.cumsum(x * x)
    lost = np.sqrt(np.maximum((whole[520:] - whole[500:-20]) / 20 - ((np.cumsum(x)[520:] - np.cumsum(x)[500:-20]) / 20) ** 2, 0))
    assert np.abs(lost - want).min() > 0.5 * np.abs(want).min()  # what subtracted running sums give: no digit is right


def test_constant_frames_have_no_spread():
    x = np.concatenate([[5.0, -3.0, 1e6], np.full(30, 0.1), [7.0]])
    c, _, _, v, _, cov = co_moments(x, x, 8)
    assert (v[10:33] == 0).all() and (cov[10:33] == 0).all() and v[33] > 0


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, n in (("A", 700), ("B", 90), ("C", 3), ("D", 1)):
        x = np.where(rng.random(n) < 0.1, np.nan, rng.normal(50, 5, n))
        rows += [(s, d.date(), None if np.isnan(v) else float(v), float(w), "extra") for d, v, w in zip(pd.bdate_range("2001-01-01", periods=n), x, rng.normal(size=n), strict=True)]
    return spark.createDataFrame(rows, "symbol string, date date, x double, y double, note string").cache()


@pytest.mark.parametrize("chunk", [40, rolling.CHUNK])
def test_chunks_equal_sliding_frames(panel, chunk):
    """Histories in chunks of some rows, chained aggregates included, as Spark's own frames give them."""
    k = Rolling()
    sd = k.std("x", 9, 4)
    want_of = {"mean": (k.mean("x", 7), F.avg("x"), 7, 7), "sd": (sd, F.stddev_pop("x"), 9, 4), "samp": (k.std_samp("x", 5, 2), F.stddev_samp("x"), 5, 2), "total": (k.total(F.col("x") * 2, 6, 1), F.sum(F.col("x") * 2), 6, 1), "most": (k.most("x", 10, 3), F.max("x"), 10, 3), "least": (k.least("x", 10), F.min("x"), 10, 10), "mid": (k.quantile("x", 0.5, 6, 1), F.percentile("x", F.lit(0.5)), 6, 1)}
    chained, before = k.mean(sd, 6, 2), k.lag(sd, 3)
    got = k.over(panel, chunk).select("symbol", "date", "note", *(v[0].alias(n) for n, v in want_of.items()), chained.alias("chained"), before.alias("before"))
    w = Window.partitionBy("symbol").orderBy("date")
    plain = panel.select("*", *(F.when(F.count("x").over(w.rowsBetween(1 - n, 0)) >= least, f.over(w.rowsBetween(1 - n, 0))).alias(name) for name, (_, f, n, least) in want_of.items()))
    plain = plain.select("*", F.when(F.count("sd").over(w.rowsBetween(-5, 0)) >= 2, F.avg("sd").over(w.rowsBetween(-5, 0))).alias("chained"), F.lag("sd", 3).over(w).alias("before")).select(got.columns)
    a, b = (d.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True) for d in (got, plain))
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-12)


def test_groups_are_bounded(panel):
    """No group holds more than a chunk and the rows that its frames reach back to."""
    k = Rolling()
    k.mean("x", 11)
    plan = k.over(panel, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "_at" in plan
    assert k.over(panel, 40).count() == panel.count()
