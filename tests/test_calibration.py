"""Goodness of fit, calibration reports, weighted quantiles, mixtures and blended laws against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.exprs import cells, group_quantiles, group_rank, normal_cdf, weighted_quantiles
from tessera.functions.special import ks_uniform
from tessera.operators import calibration as C
from tessera.sources.panel import with_predictions


def frame(spark, groups, name="u"):
    return spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], f"g int, {name} double").repartition(5)


def test_uniformity(spark):
    """Ties, a hot value, few rows; the p-value of both series."""
    rng = np.random.default_rng(1)
    groups = {0: rng.random(3000), 1: np.round(rng.random(500), 2), 2: np.r_[np.full(900, 0.5), rng.random(300)], 3: [0.2], 4: rng.beta(2, 2, 800), 5: (np.arange(400) + 0.5) / 400}
    got = {r.g: r for r in C.uniformity(frame(spark, groups), ("g",), "u").collect()}
    for g, v in groups.items():
        d, p = ks_uniform(v)
        assert got[g].n == len(v) and math.isclose(got[g].ks, d, abs_tol=1e-12) and math.isclose(got[g].p, p, abs_tol=1e-6)
    assert got[0].p > 0.01 and got[4].p < 1e-6 and got[5].p > 0.999


def test_kolmogorov_tail(spark):
    got = spark.createDataFrame([(x,) for x in (0.05, 0.5, 1.0, 1.1799, 1.1801, 1.36, 2.0, 5.0)], "x double").select("x", C.kolmogorov_tail(F.col("x")).alias("p")).collect()
    for x, p in got:
        exact = 1.0 if x < 0.2 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 200))
        assert math.isclose(p, exact, abs_tol=1e-9)


def report(spark, sd):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(int(i % 2), float(y)) for i, y in enumerate(rng.normal(size=4000))], "g int, y double").withColumn("pit", normal_cdf(F.col("y") / sd))
    z = {q: C.normal_quantile(q, F.lit(0.0), F.lit(sd)) for q in C.LEVELS}
    return C.calibration_report(rows, ("g",), "y", z, "pit", C.normal_crps(F.col("y"), F.lit(0.0), F.lit(sd))).collect(), rows.toPandas()


def test_calibration_report(spark):
    """The right law passes; laws that are too narrow or too wide fail, and score worse."""
    good, rows = report(spark, 1.0)
    narrow, wide = report(spark, 0.6)[0], report(spark, 1.6)[0]
    assert all(r.calibrated for r in good) and not any(r.calibrated for r in narrow + wide)
    assert good[0].crps < min(narrow[0].crps, wide[0].crps) and narrow[0].coverage_95 < 0.88 < wide[0].coverage_80
    for r in good:
        y = rows.y[rows.g == r.g].to_numpy()
        assert r.n == len(y) and math.isclose(r.coverage_80, np.mean(np.abs(y) <= 1.2815515655446004), abs_tol=1e-12) and math.isclose(r.width_95, 2 * 1.959963984540054, rel_tol=1e-9)
        d = y + 1.2815515655446004
        assert math.isclose(r.pinball_10, np.maximum(0.1 * d, -0.9 * d).mean(), rel_tol=1e-9)
        draws = np.random.default_rng(0).normal(size=2000)
        sampled = np.mean([np.abs(draws - v).mean() for v in y[:300]]) - np.abs(draws[:, None] - draws[None, :1000]).mean() / 2
        assert math.isclose(C_mean(spark, y[:300]), sampled, rel_tol=0.05)


def C_mean(spark, y):
    return spark.createDataFrame([(float(v),) for v in y], "y double").agg(F.avg(C.normal_crps(F.col("y"), F.lit(0.0), F.lit(1.0)))).first()[0]


def test_nearest_quantile_stands_in(spark):
    rows = spark.createDataFrame([(1, 0.3), (1, 3.0)], "g int, y double")
    got = C.calibration_report(rows, ("g",), "y", {0.1: F.lit(-1.0), 0.9: F.lit(1.0)}, coverage=(0.95,)).first()
    assert got.coverage_95 == 0.5 and got.width_95 == 2.0 and got.calibrated is False


@pytest.mark.parametrize("parts", ["8", "200"])
def test_weighted_quantiles(spark, parts):
    rng = np.random.default_rng(7)
    levels = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    rows = [(g, float(np.round(rng.normal(), 1)), float(w)) for g in range(3) for w in rng.integers(0, 9, 700)] + [(9, 4.0, 0.0), (8, 1.5, 2.0), (0, 1.0, None)]
    got = {r.g: r for r in weighted_quantiles(spark.createDataFrame(rows, "g int, x double, w double").repartition(int(parts) // 8), ("g",), "x", "w", levels).collect()}
    assert 9 not in got and got[8].c == 1.5
    for g in range(3):
        v, w = (np.array(c, float) for c in zip(*[(x, k) for i, x, k in rows if i == g and k], strict=True))
        for name, q in levels.items():
            assert got[g][name] == np.quantile(v, q, weights=w, method="inverted_cdf")


def test_ranks_and_quantiles_with_a_hot_value(spark):
    """Half of a group is one value: it is one row by the time anything is put in order."""
    rng = np.random.default_rng(3)
    v = np.r_[np.zeros(4000), rng.normal(size=3999)]
    df = frame(spark, {0: v, 1: [2.0]}, "x")
    assert cells(df, ("g",), "x").count() == 4001
    got = group_quantiles(df, ("g",), "x", {"lo": 0.03, "mid": 0.5, "hi": 0.971}).orderBy("g").collect()
    assert np.allclose(got[0][2:], np.quantile(v, [0.03, 0.5, 0.971])) and got[1].mid == 2.0
    ranks = group_rank(df, ("g",), "x", "k").where("g = 0").toPandas()
    want = {x: (v < x).sum() + ((v == x).sum() + 1) / 2 for x in np.unique(v)}
    assert (ranks.k == ranks.x.map(want)).all()


def test_mixture(spark):
    """Two models that disagree: the total variance holds the distance between them; quantiles are those of weighted draws."""
    rng = np.random.default_rng(2)
    draws = {"a": rng.normal(0, 1, 907), "b": rng.normal(4, 0.5, 301)}
    w = {"a": 1.5, "b": 0.5}  # need not sum to 1
    samples = spark.createDataFrame([(1, m, float(x)) for m, v in draws.items() for x in v], "g int, model string, value double")
    got = C.bma_mixture(samples, spark.createDataFrame([(1, m, x) for m, x in w.items()], "g int, model string, weight double"), ("g",)).first()
    share = {"a": 0.75, "b": 0.25}
    mean = sum(share[m] * draws[m].mean() for m in w)
    within, between = sum(share[m] * draws[m].var() for m in w), sum(share[m] * (draws[m].mean() - mean) ** 2 for m in w)
    assert np.allclose([got.mean, got.std, got.within_share, got.between_share], [mean, math.sqrt(within + between), within / (within + between), between / (within + between)])
    values, weights = np.concatenate([draws["a"], draws["b"]]), np.r_[np.full(907, 0.75 / 907), np.full(301, 0.25 / 301)]
    for q in C.LEVELS:
        assert math.isclose(got[f"q_{C.tag(q)}"], np.quantile(values, q, weights=weights, method="inverted_cdf"), abs_tol=1e-12)


def test_summary_and_blend(spark):
    rng = np.random.default_rng(4)
    x = rng.gamma(2, 1, 500) - 1
    rows = [("A", 5, float(v)) for v in x] + [("B", 5, float(v)) for v in x]
    draws = spark.createDataFrame(rows, "symbol string, horizon int, value double")
    got = C.simulation_summary(draws, ("symbol", "horizon")).where("symbol = 'A'").first()
    m = x.mean()
    assert np.allclose([got.point, got.std, got["skew"], got.excess_kurtosis, got.q_2_5], [m, x.std(ddof=1), ((x - m) ** 3).mean() / x.var() ** 1.5, ((x - m) ** 4).mean() / x.var() ** 2 - 3, np.percentile(x, 2.5)])
    views = spark.createDataFrame([("A", 5, 2.0)], "symbol string, horizon int, predicted double")
    means = draws.groupBy("symbol", "horizon").agg(F.avg("value").alias("mean_return"))
    for weight, w in ((0.25, 0.25), (3.0, 1.0), (-1.0, 0.0)):
        out = {r.symbol: r for r in C.blended_summary(draws, with_predictions(means, views, weight)).collect()}
        shift = w * (2.0 - m)
        y = x + shift
        cut = np.quantile(y, 0.05)
        assert np.allclose([out["A"].mean_return, out["A"].median_return, out["A"]["var"], out["A"].cvar, out["A"].prob_positive, out["A"].std_return], [y.mean(), np.median(y), cut, y[y <= cut].mean(), (y > 0).mean(), x.std(ddof=1)])
        assert math.isclose(out["B"].mean_return, m) and out["B"].source == "PURE MC" and out["A"].source == ("MODEL+MC" if w else "PURE MC")
