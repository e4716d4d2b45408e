"""The time-series engine: queries against DuckDB, generators and fits against known truth, causality, streaming."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import special as S
from tessera.operators import calibration, features, regimes, uncertainty, windows
from tessera.operators import montecarlo as MC
from tessera.plans.oracle import ORACLE_SQL
from tessera.plans.queries import QUERIES
from tessera.sources import panel as P
from tessera.streaming import bars as ST

SF = "/root/testdata/sf0.001"
CHECKED = ["panel_bars", "market_series", "feat_volatility", "feat_sector", "feat_calendar", "feat_complexity", "recurrences", "forward_labels", "purged_split", "wf_norm_stats", "rank_ic", "merton_params", "ljung_box", "crps", "rolling_fingerprint", "spell_durations", "adjusted_rand", "split_conformal", "cqr", "event_bars", "feat_volume", "window_metrics", "ensemble_variance", "symbol_overlap", "sector_pivot", "blended_forecast", "cross_sectional_z", "calibration_report", "quantile_calibration", "pit_uniformity", "bma_mixture", "simulation_summary", "cusum_segments", "garch_bands", "panel_cache", "panel_discovery", "keyed_forecasts", "wf_features"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, duck, name):
    a, o = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(o.columns) and len(a) == len(o) > 0
    keys = [c for c in sorted(a.columns) if a[c].dtype.kind != "f" or c == "q"]
    for d in (a, o):
        for c in keys:
            d[c] = d[c].astype(str).str.replace(" 00:00:00", "")
    if keys:
        a, o = a.sort_values(keys).reset_index(drop=True), o.sort_values(keys).reset_index(drop=True)
    for c in a.columns:
        if a[c].dtype.kind == "f" and c not in keys:
            assert np.allclose(a[c].astype(float), o[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert (a[c] == o[c]).all(), c


def test_every_query_has_a_callable_and_sql_names_exist():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_causal(spark):
    """A changed last day leaves the features of all days before as they were."""
    base = P.synthetic_panel(spark, 1, 300).toPandas()
    later = base.copy()
    later.loc[later.index[-1], ["close", "high", "volume"]] *= 1.5
    def run(pdf):
        df = P.with_returns(P.validated(spark.createDataFrame(pdf, P.PANEL)))
        return features.volatility(df).select("date", "realized_vol_20", "skew20", "vol_breakout").toPandas().sort_values("date")
    a, b = run(base), run(later)
    assert a.iloc[:-1].equals(b.iloc[:-1]) and not a.iloc[-1:].equals(b.iloc[-1:])


def test_sources(spark, tmp_path):
    made = P.read_or_generate(spark, str(tmp_path / "absent"), symbols=2, days=30)
    assert made.count() == 60 and made.where("high < low").count() == 0
    P.write_report(made, str(tmp_path / "p"), "parquet")
    assert P.read_or_generate(spark, str(tmp_path / "p")).count() == 60
    with pytest.raises(ValueError):
        P.validated(spark.range(1).withColumn("symbol", F.lit("a")))
    got = {(r.symbol, r.horizon): r.predicted for r in P.model_predictions(spark, '{"A": {"1": 0.5, "x": 1}, "B": {"5": -0.1}}').collect()}
    assert got == {("A", 1): 0.5, ("B", 5): -0.1} and P.model_predictions(spark, "nonsense").count() == 0
    assert P.symbol_list(" a, B,,a ") == ["A", "B"]
    twice = made.unionByName(made)
    assert P.distinct_first(twice, "close").count() == 60 and P.with_history(made, 31).count() == 0


def test_special_functions():
    assert S.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-6) and S.norm_cdf([0.0])[0] == 0.5
    assert S.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5) and S.t_ppf(0.95, 5) == pytest.approx(2.015048, abs=1e-5)
    assert S.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and S.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert S.ks_uniform((np.arange(100) + 0.5) / 100)[1] > 0.99 and S.ks_uniform(np.linspace(0, 0.3, 100))[1] < 1e-6
    assert S.minimise(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, [0.0, 0.0]) == pytest.approx([3, -1], abs=1e-3)


def test_known_regimes(spark):
    rng = np.random.default_rng(0)
    state = np.repeat([0, 2, 1, 0, 2], 160)
    x = np.array([-0.01, 0.0, 0.02])[state] + np.array([0.01, 0.004, 0.02])[state] * 0.5 * rng.standard_normal(800)
    m = regimes.fit_hmm(x, 3)
    assert (regimes.viterbi_path(x, m) == state).mean() > 0.9
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "i": range(800), "x": x}))
    changes = [r.i for r in regimes.cusum_changes(df).orderBy("i").collect()]
    assert changes and min(abs(c - 160) for c in changes) < 30
    runs = regimes.bocpd(df).orderBy("i").toPandas()
    assert runs.run_length[155] > 100 and runs.run_length[200] < 60


def test_known_slopes(spark):
    rng = np.random.default_rng(1)
    f, s = rng.standard_normal(600), np.repeat([0, 1, 0], 200)
    y = np.where(s == 1, 1.8, 0.4) * f + 0.3 * rng.standard_normal(600)
    rows = spark.createDataFrame(pd.DataFrame({"symbol": "A", "i": range(600), "f": f, "y": y}))
    out = regimes.switching_regression(rows).orderBy("state").toPandas()
    assert out.slope.tolist() == pytest.approx([0.4, 1.8], abs=0.15)
    q = uncertainty.quantile_regression(rows, (0.1, 0.9)).orderBy("q").toPandas()
    assert q.intercept[0] < q.intercept[1]
    b = uncertainty.bootstrap_fit(rows, 1, 20).toPandas()
    assert len(b) == 20 and np.std([c[0] for c in b.coef]) < 0.2


@pytest.mark.parametrize("engine", [*MC.ENGINES, "ensemble"])
def test_engines(engine):
    x = np.random.default_rng(2).standard_t(6, 700) * 0.01 + 0.0005
    sims = MC.simulate(engine, x, 20, 400, np.random.default_rng(3))
    assert sims.shape == (400, 20) and np.isfinite(sims).all()
    assert 0.4 < sims.std() / x.std() < 2.5


def test_unknown_engine():
    with pytest.raises(ValueError):
        MC.simulate("none", np.zeros(50), 5, 5, np.random.default_rng(0))


def test_paths_do_not_depend_on_partitions(spark):
    x = MC.log_returns(P.synthetic_panel(spark, 2, 260))
    a, b = (MC.terminal_returns(d, "bootstrap", (5,), 2, 50).orderBy("symbol", "path").toPandas() for d in (x, x.repartition(5)))
    assert a.equals(b)


def test_sequences(spark):
    df = P.with_returns(P.synthetic_panel(spark, 1, 200)).na.fill(0.0, ["r"])
    out = windows.sequences(df, ["close", "r"]).collect()
    assert len(out) == 5 and all(len(r.window) == 180 and len(r.window[0]) == 2 for r in out)
    stats = windows.norm_stats(df, ["close"])
    z = windows.normalised(df, stats, ["close"]).agg(F.avg("close"), F.max(F.abs("close"))).first()
    assert abs(z[0]) < 0.05 and z[1] <= 5


def test_quantile_tables(spark):
    q = spark.createDataFrame([(1, 0.05, 2.0), (1, 0.95, 1.0), (1, 0.5, 0.0)], "key long, q double, value double")
    assert [r.value for r in uncertainty.rearranged(q).orderBy("q").collect()] == [0.0, 1.0, 2.0]
    assert tuple(uncertainty.interval(q).select("lo", "hi").first()) == (2.0, 1.0)
    with pytest.raises(ValueError):
        uncertainty.interval(q, 0.5)


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(*(c.split()[0] for c in ST.EVENT.split(", ")))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, plan, mode in (("bars", ST.stream_bars, "complete"), ("alarms", ST.online_alarms, "append")):
        run = plan(ST.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
    want = {tuple(r) for r in ST.stream_bars(events).collect()}
    assert {tuple(r) for r in spark.table("bars").collect()} == want
    assert spark.table("alarms").count() == events.where("value is not null and event_type is not null").count()


def test_resume(spark):
    specs = spark.range(5).withColumnRenamed("id", "window_id")
    assert P.todo_only(specs, specs.where("window_id < 3"), "window_id").count() == 2


def test_registered_sizes(spark, monkeypatch):
    """The registered simulations and resamples are as large as the reference's, over the whole series."""
    import inspect

    from tessera.operators import regimes as RG
    from tessera.operators import uncertainty as U
    from tessera.plans import queries

    default = {k: v.default for k, v in inspect.signature(MC.rolling_backtest).parameters.items()}
    assert [default[k] for k in ("engine", "step", "origins", "horizons", "paths")] == ["ensemble", 10, 40, (5, 21, 63), 1000]
    assert inspect.signature(RG.hmm_stability).parameters["resamples"].default == 8
    sizes = {}

    def spy(module, name, measure):
        real = getattr(module, name)

        def run(*a, **b):
            out = real(*a, **b)
            sizes[name] = measure(a[0], out)
            return out

        monkeypatch.setattr(module, name, run)

    spy(MC, "terminal_returns", lambda x, out: {tuple(r) for r in out.groupBy("symbol").agg(F.countDistinct("path"), F.sort_array(F.collect_set("horizon"))).drop("symbol").distinct().rdd.map(lambda r: (r[0], tuple(r[1]))).collect()})
    queries.horizon_summary(spark, SF)
    assert sizes["terminal_returns"] == {(5000, (1, 5, 10, 21, 63, 126, 252))}
    assert inspect.signature(U.bootstrap_fit).parameters["resamples"].default == 500
    assert {r.n for r in queries.bootstrap_fit(spark, SF).collect()} == {500}
    monkeypatch.setattr(RG, "hmm_stability", lambda x, **b: (x, b))
    series, how = queries.hmm_stability(spark, SF)
    whole = MC.log_returns(queries.P.with_history(queries.P.bars(spark, SF)))
    assert series.count() == whole.count() and not how


def test_correlation_of_constant_and_short_frames(spark):
    """NULL where a column does not move, two equal rows and a frame of one row included; nothing divides by zero."""
    from tessera.functions.exprs import corr, frame, pair_corr

    rows = [("a", 1, 5.0, 1.0), ("a", 2, 5.0, 2.0), ("a", 3, 6.0, 4.0), ("b", 1, 2.0, None), ("b", 2, 2.0, 2.0), ("b", 3, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, date int, y double, x double")
    got = df.select("symbol", "date", corr("y", "x", frame(3)).alias("c"), pair_corr("y", "x", 2).alias("p")).orderBy("symbol", "date").toPandas()
    assert got.c.round(3).tolist()[2] == 0.945 and got.c.isna().tolist() == [True, True, False, True, True, False]
    assert got.p.round(3).tolist()[2] == 1.0 and got.p.isna().tolist() == [True, True, False, True, True, False]
    assert [round(r.c, 3) if r.c is not None else None for r in df.groupBy("symbol").agg(corr("y", "x").alias("c")).orderBy("symbol").collect()] == [0.945, 1.0]


def test_ordered_work_in_parts(spark):
    """Ranks, row numbers and quantiles by parts against pandas, with ties and one group that holds most rows."""
    from tessera.functions.exprs import group_quantiles, group_rank, group_row

    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": ["a"] * 900 + ["b"] * 50 + ["c"], "x": np.r_[rng.integers(0, 40, 900), rng.random(50), 7.0], "i": np.arange(951)})
    df = spark.createDataFrame(pdf)
    got = group_rank(group_row(df, ("g",), "x", "i"), ("g",), "x", "rank").toPandas().sort_values("i")
    assert (got["rank"].to_numpy() == pdf.groupby("g").x.rank().to_numpy()).all()
    assert (got["_row"].to_numpy() == pdf.sort_values(["x", "i"]).groupby("g").cumcount().sort_index().to_numpy() + 1).all()
    q = group_quantiles(df, ("g",), "x", {"lo": 0.1, "mid": 0.5}).toPandas().set_index("g")
    assert np.allclose(q.lo.sort_index(), pdf.groupby("g").x.quantile(0.1)) and np.allclose(q.mid.sort_index(), pdf.groupby("g").x.quantile(0.5))


def test_spectral_entropy():
    """A pure wave has nearly no spectral entropy, noise nearly all of it, a flat series none."""
    from tessera.operators.recurrence import spectral_entropy

    t = np.arange(200)
    wave, noise = spectral_entropy(np.sin(2 * np.pi * t / 6)), spectral_entropy(np.random.default_rng(1).normal(size=200))
    assert (wave[:59] == 0).all() and wave[60:].max() < 1.1 < 1.9 < noise[60:].min() and (spectral_entropy(np.ones(200)) == 0).all()


def test_garch_bands(spark):
    """The median lies on the drift, bands are symmetric about it and widen with the cumulated variance."""
    made = uncertainty.garch_variance_path(spark.createDataFrame([("B", 1e-5, 0.08, 0.88, 2e-4, 3e-4)], "symbol string, omega double, alpha double, beta double, h0 double, e0 double"))
    got = uncertainty.garch_bands(made.withColumn("mu", F.lit(0.0003)), 7.0).toPandas().pivot(index="day", columns="q", values="value")
    path = made.toPandas().set_index("day")
    assert np.allclose(got[0.5], 0.0003 * got.index, atol=1e-9) and np.allclose(got[0.05] + got[0.95], 2 * got[0.5], atol=1e-6)
    wide = (got[0.95] - got[0.05]) / np.sqrt(path.cumulative.loc[got.index])
    assert np.allclose(wide, wide.iloc[0], rtol=1e-4)


def test_cusum_resets_and_uses_the_sample_deviation():
    from tessera.operators.recurrence import cusum

    x = np.r_[np.zeros(50), np.ones(50)]
    z, up, down, want = (x - x.mean()) / (x.std(ddof=1) + 1e-12), 0.0, 0.0, []
    for i, v in enumerate(z):
        up, down = max(0.0, up + v), max(0.0, down - v)
        if max(up, down) > 5:
            want.append(i)
            up = down = 0.0
    assert cusum(x) == want and want[0] == 5


def test_pit_uniformity(spark):
    rng = np.random.default_rng(3)
    rows = [("flat", float(v)) for v in rng.random(400)] + [("low", float(v) ** 3) for v in rng.random(400)]
    got = calibration.uniformity(spark.createDataFrame(rows, "k string, pit double"), ("k",), "pit").toPandas().set_index("k")
    assert got.p["flat"] > 0.05 and got.p["low"] < 1e-6 and got.ks["low"] > got.ks["flat"]
