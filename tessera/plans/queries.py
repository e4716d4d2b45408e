"""The registered queries of the time-series operators: each takes (spark, sf_dir) and returns a small, stable schema."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import NUDGE, clipped_tails, div, normal_cdf, tidy
from tessera.operators import calibration as C
from tessera.operators import datasets as D
from tessera.operators import metrics as M
from tessera.operators import montecarlo as MC
from tessera.operators import recurrence as RC
from tessera.operators import regimes as RG
from tessera.operators import runner as RN
from tessera.operators import uncertainty as U
from tessera.operators import walkforward as WF
from tessera.operators import windows as WN
from tessera.operators.features import FAMILIES, change
from tessera.sources import panel as P
from tessera.sources import cache as CA
from tessera.sources import discovery as DI
from tessera.sources import sequences as SQ
from tessera.sources.storage import new_folder, stored, written
from tessera.streaming import changes as CH
from tessera.streaming.bars import event_stream, stream_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
Q = Callable[[SparkSession, str], DataFrame]


def query(f: Q) -> Q:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, no negative zero; dates as they are."""
    return df.select(*((F.round(F.col(c) + NUDGE, places) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def family(name: str) -> Q:
    add, names = FAMILIES[name]
    return lambda spark, sf: tidy(add(P.full_panel(spark, sf)), names)


for _name in FAMILIES:
    QUERIES[f"feat_{_name}"] = family(_name)


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_returns(P.with_history(P.bars(spark, sf)))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return MC.log_returns(P.with_history(P.bars(spark, sf)), 756)


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in forecast, the five-row momentum, against the forward log return; stored, as the scores read it several times."""
    base = returns(spark, sf)
    p = base.select("symbol", "date", change(5).alias("p"), F.when(F.count("r").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-19, 0)) == 20, F.stddev_pop("r").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-19, 0))).alias("vol"))
    return stored(WN.forward_labels(base).withColumnRenamed("target", "t").join(p, ["symbol", "date"]).where("p is not null and vol is not null"))


@query
def panel_bars(spark, sf):
    return rounded(P.bars(spark, sf).select("symbol", "sector", "date", "open", "high", "low", "close", "volume", "dollar_volume"))


@query
def daily_return(spark, sf):
    return tidy(returns(spark, sf), ["r"], 6)


@query
def market_series(spark, sf):
    return rounded(P.market_series(returns(spark, sf)))


@query
def sector_return(spark, sf):
    return rounded(P.sector_returns(returns(spark, sf)))


@query
def sector_codes(spark, sf):
    return P.coded(P.bars(spark, sf))


@query
def distinct_on_first(spark, sf):
    items = P.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return P.distinct_first(items, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").select("symbol", "date", "l_orderkey", "l_extendedprice")


@query
def min_history_filter(spark, sf):
    return P.with_history(P.bars(spark, sf), 540).groupBy("symbol").count()


@query
def recurrences(spark, sf):
    return tidy(RC.recurrences(returns(spark, sf)), [c for c in RC.COLUMNS if c != "spectral_entropy"])


@query
def spectral_entropy(spark, sf):
    return tidy(RC.recurrences(returns(spark, sf)), ["spectral_entropy"])


@query
def trend(spark, sf):
    base = returns(spark, sf)
    df = RC.recurrences(base).join(base.select("symbol", "date", "close"), ["symbol", "date"])
    side = F.col("ema_20") - F.col("ema_50")
    df = df.withColumns({"trend_strength": div(F.col("ema_20") - F.col("ema_100"), "atr_14"), "ema_ratio_20_50": F.col("ema_20") / F.col("ema_50") - 1, "ema_ratio_50_100": F.col("ema_50") / F.col("ema_100") - 1, "atr_ratio": F.col("atr_14") / F.col("close"), "true_range": F.col("atr_14") / F.col("close"), **{f"close_to_ema{n}": div(F.col("close") - F.col(f"ema_{n}"), "atr_14") for n in (20, 50, 100)}, "adx_strength": (F.col("adx14") > 0.25).cast("double"), "_side": side})
    df = df.withColumn("trend_flip", F.coalesce((F.col("_side") * F.lag("_side").over(Window.partitionBy("symbol").orderBy("date")) < 0).cast("double"), F.lit(0.0)))
    return tidy(df, ["trend_strength", "ema_ratio_20_50", "ema_ratio_50_100", "atr_ratio", "true_range", "close_to_ema20", "close_to_ema50", "close_to_ema100", "adx_strength", "trend_flip"])


@query
def feature_postprocess(spark, sf):
    add, _ = FAMILIES["price_action"]
    names = ["body", "close_pos", "drawdown"]
    return tidy(clipped_tails(add(P.full_panel(spark, sf)).na.fill(0.0, names), names), names)


@query
def forward_labels(spark, sf):
    return rounded(WN.forward_labels(returns(spark, sf)))


@query
def sequence_index(spark, sf):
    return WN.sequence_index(returns(spark, sf)).select("symbol", "sample", "end_idx", "date")


@query
def purged_split(spark, sf):
    return WN.purged_split(WN.sequence_index(returns(spark, sf))).groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("first"), F.max("sample").alias("last"))


@query
def norm_stats(spark, sf):
    return rounded(WN.norm_stats(returns(spark, sf), ["r", "close", "volume"]), 5)


@query
def dataset_norm_stats(spark, sf):
    """Statistics of 8,000 windows drawn from the training part, and of the forward returns at their ends."""
    rows = returns(spark, sf).withColumn("idx", (F.col("rn") - 1).cast("long"))
    train = WN.purged_split(WN.sequence_index(rows)).where("split = 'train'")
    drawn = stored(D.sampled_windows(train))
    targets = WN.forward_labels(rows).join(rows.select("symbol", "date", F.col("idx").cast("int").alias("end_idx")), ["symbol", "date"]).select("symbol", "end_idx", "target")
    return rounded(D.dataset_norm_stats(rows, drawn, targets, ["r", "close", "volume"], WN.SEQUENCE), 5)


@query
def panel_cache(spark, sf):
    """Three overlapping requests of all symbols; the last one's rows, a part of them loaded by each request."""
    bars = stored(P.bars(spark, sf).select("symbol", "date", "close"))
    symbols = [r.symbol for r in bars.select("symbol").distinct().orderBy("symbol").collect()]  # the few nations
    cache = CA.PanelCache(spark, new_folder(spark, "cache"), CA.load_from(bars), least_rows=5)
    cache.fetch(symbols, date(1993, 1, 1), date(1994, 6, 30))
    cache.fetch(symbols[::2], date(1995, 3, 1), date(1996, 3, 31))
    got = cache.fetch(symbols, date(1994, 1, 1), date(1996, 12, 31))
    return rounded(got.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("close").alias("total")), 4)


@query
def panel_discovery(spark, sf):
    """Bars written to two folders by symbol, the second with a column of its own; the first twelve symbols of both are read back."""
    bars = stored(P.bars(spark, sf))
    old, new = new_folder(spark, "old"), new_folder(spark, "new")
    bars.where("date < '1995-06-17'").select("symbol", "date", "close").write.partitionBy("symbol").parquet(old)
    bars.where("date >= '1995-06-17'").select("symbol", "date", "close", "volume").write.partitionBy("symbol").parquet(new)
    got = DI.load_panel(spark, [old, new], most=12)
    return rounded(got.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("volume").alias("with_volume"), F.sum("close").alias("total")), 4)


@query
def keyed_forecasts(spark, sf):
    """A line through the last hundred log returns of each symbol, fitted by the caller's own functions; symbols whose name ends in 7 make them raise."""
    import numpy as np

    def fit(train):
        if train["symbol"].iloc[0].endswith("7"):
            raise ValueError("no model for this symbol")
        return np.polyfit(train["i"].to_numpy(float), train["x"].to_numpy(float), 1)

    def predict(model, target):
        return target.assign(predicted=np.polyval(model, target["i"].to_numpy(float)))

    x = logs(spark, sf)
    last = x.groupBy("symbol").agg(F.max("i").alias("_n"))
    rows = x.join(last, "symbol").where("i > _n - 110").select("symbol", "i", "x", F.when(F.col("i") > F.col("_n") - 10, "target").otherwise("train").alias("part"))
    return rounded(RN.run_keyed(rows, "symbol", fit, predict, "i long, predicted double"))


@query
def sample_fetch(spark, sf):
    """The last training sample of each symbol, fetched from a store of all windows and scaled by the statistics of the training part."""
    names = ["r", "close", "volume"]
    rows = stored(returns(spark, sf).withColumn("idx", (F.col("rn") - 1).cast("long")))
    index = WN.purged_split(WN.sequence_index(rows))
    labels = WN.forward_labels(rows).groupBy("symbol", "date").pivot("horizon", list(WN.HORIZONS)).agg(F.first("target"))
    targets = labels.select("symbol", "date", F.array(*(F.col(str(h)) for h in WN.HORIZONS)).alias("target"))
    SQ.write_sequences(rows, names, targets, path := new_folder(spark, "sequences"))
    ends = WN.forward_labels(rows).join(rows.select("symbol", "date", F.col("idx").cast("int").alias("end_idx")), ["symbol", "date"]).select("symbol", "end_idx", "target")
    stats = stored(D.dataset_norm_stats(rows, D.sampled_windows(index.where("split = 'train'")), ends, names, WN.SEQUENCE))
    keys = index.where("split = 'train'").groupBy("symbol").agg(F.max("sample").alias("sample"))
    got = SQ.samples(SQ.lookup(spark, path, keys), stats, names)
    return rounded(got.select("symbol", "sample", F.size("encoder").alias("n"), F.element_at("encoder", -1)[0].alias("last_r"), F.element_at("encoder", 1)[1].alias("first_close"), "static.*", F.col("target")[0].alias("target_1"), F.col("target")[5].alias("target_28")), 4)


@query
def feature_correlation(spark, sf):
    """Thirty features against each other over all rows."""
    add, names = FAMILIES["volatility"]
    more, others = FAMILIES["risk"]
    chosen = [*names, *others][:30]
    return rounded(D.correlation_matrix(stored(tidy(more(add(P.full_panel(spark, sf))), chosen)), chosen), 5)


@query
def wf_windows(spark, sf):
    return WN.wf_windows(returns(spark, sf))


@query
def wf_features(spark, sf):
    made = stored(WF.compact_features(returns(spark, sf)).select("symbol", "date", "rn", *WF.COMPACT))
    return tidy(WF.clipped_by_training(made, WF.COMPACT), WF.COMPACT)


@query
def wf_norm_stats(spark, sf):
    base = returns(spark, sf)
    return rounded(WN.wf_norm_stats(WN.aligned(base), WN.wf_windows(base), ["close"]), 5)


@query
def forecast_errors(spark, sf):
    return rounded(M.errors(forecasts(spark, sf), "horizon"))


@query
def rank_ic(spark, sf):
    return rounded(M.rank_ic(forecasts(spark, sf), "horizon"))


@query
def long_short(spark, sf):
    return rounded(M.long_short(forecasts(spark, sf), "horizon"), 5)


@query
def equity_curve(spark, sf):
    made = M.equity(M.with_long_short(forecasts(spark, sf).where("horizon = 1"), "horizon"), "horizon")
    return made.groupBy("date").agg(F.round(F.max_by("log_equity", "symbol") + NUDGE, 5).alias("log_equity"), F.round(F.max("drawdown") + NUDGE, 5).alias("drawdown"))


@query
def stitched_equity(spark, sf):
    """The out-of-sample curve of the shortest horizon over all test windows, one behind another."""
    base = returns(spark, sf)
    rows = WN.in_windows(WN.aligned(base), WN.wf_windows(base)).where("part = 'test'").select("symbol", "date", "window_id")
    tested = forecasts(spark, sf).where("horizon = 1").join(rows, ["symbol", "date"])
    made = M.stitched(stored(M.with_long_short(tested, "horizon")))
    return rounded(made.groupBy("window_id", "date").agg(F.max_by("log_equity", "symbol").alias("log_equity"), F.max("drawdown").alias("drawdown")), 5)


@query
def quartile_spread(spark, sf):
    return rounded(M.quartile_spread(forecasts(spark, sf), "horizon"))


@query
def decile_returns(spark, sf):
    return rounded(M.decile_returns(forecasts(spark, sf), "horizon"))


@query
def rolling_ic(spark, sf):
    return rounded(M.rolling_ic(forecasts(spark, sf), "horizon"))


@query
def regime_ic(spark, sf):
    return rounded(M.regime_ic(forecasts(spark, sf), "horizon"))


@query
def wf_summary(spark, sf):
    base = returns(spark, sf)
    rows = WN.in_windows(WN.aligned(base), WN.wf_windows(base)).where("part = 'test'").select("symbol", "date", "window_id")
    scored = M.errors(forecasts(spark, sf).where("horizon = 5").join(rows, ["symbol", "date"]), "window_id")
    return rounded(M.wf_summary(scored))


def scored_windows(spark, sf):
    base = returns(spark, sf)
    rows = WN.in_windows(WN.aligned(base), WN.wf_windows(base)).where("part = 'test'").select("symbol", "date", "window_id")
    return M.window_metrics(stored(forecasts(spark, sf).join(rows, ["symbol", "date"])), "window_id", "horizon")


@query
def window_metrics(spark, sf):
    return rounded(scored_windows(spark, sf), 5)


@query
def window_horizon_means(spark, sf):
    return rounded(M.horizon_means(scored_windows(spark, sf), "window_id"), 5)


@query
def cross_sectional_z(spark, sf):
    return rounded(P.cross_sectional_z(returns(spark, sf)), 5)


@query
def top_symbols(spark, sf):
    return rounded(P.top_symbols(P.bars(spark, sf)), 2)


@query
def symbol_overlap(spark, sf):
    """Symbols with bars before and after the middle of 1995."""
    bars = P.bars(spark, sf)
    return P.shared_symbols(bars.where("date < '1995-06-17'"), bars.where("date >= '1995-06-17' and volume > 60"))


@query
def sector_pivot(spark, sf):
    names = [r.r_name for r in P.read(spark, sf, "region").select("r_name").distinct().orderBy("r_name").collect()]  # the few regions
    return rounded(P.sector_pivot(P.sector_returns(returns(spark, sf)), names))


def window_draws(spark: SparkSession, sf: str, horizons: tuple[int, ...] = (1, 5, 21)) -> DataFrame:
    """(symbol, horizon, value): log returns over every window of the last 756 rows, as draws of a horizon's return."""
    run = logs(spark, sf).withColumn("_c", F.sum("x").over(Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    by = Window.partitionBy("symbol").orderBy("i")
    ends = [F.struct(F.lit(h).alias("horizon"), F.when(F.row_number().over(by) >= h, F.col("_c") - F.coalesce(F.lag("_c", h).over(by), F.lit(0.0))).alias("value")) for h in horizons]
    return run.select("symbol", F.array(*ends).alias("e")).select("symbol", F.explode("e").alias("e")).select("symbol", "e.horizon", "e.value").where("value is not null")


@query
def blended_forecast(spark, sf):
    """The law of returns over each horizon, moved halfway towards the view of a model where it has one."""
    views = P.model_predictions(spark, '{"CHINA": {"1": 0.001, "5": 0.004}, "FRANCE": {"21": -0.01}, "NOWHERE": {"1": 0.5}}')
    draws = stored(window_draws(spark, sf).withColumn("value", F.expm1("value")))
    means = draws.groupBy("symbol", "horizon").agg(F.avg("value").alias("mean_return"))
    return rounded(C.blended_summary(draws, P.with_predictions(means, views)), 5)


@query
def simulation_summary(spark, sf):
    return rounded(C.simulation_summary(stored(window_draws(spark, sf, (5, 21, 63))), ("symbol", "horizon")), 5)


@query
def gbm_params(spark, sf):
    return rounded(MC.gbm_params(logs(spark, sf)))


@query
def merton_params(spark, sf):
    return rounded(MC.merton_params(logs(spark, sf)))


@query
def heston_params(spark, sf):
    return rounded(MC.heston_params(logs(spark, sf)), 5)


@query
def var_cvar(spark, sf):
    return rounded(MC.var_cvar(logs(spark, sf)))


@query
def ljung_box(spark, sf):
    return rounded(MC.ljung_box(logs(spark, sf)), 5)


@query
def hurst_lag(spark, sf):
    return rounded(MC.hurst_lag(logs(spark, sf)))


@query
def crps(spark, sf):
    x = logs(spark, sf)
    y = x.groupBy("symbol").agg(F.max_by("x", "i").alias("y"))
    return rounded(MC.crps(x.join(y, "symbol"), "y", "x", "symbol"))


def breaches(spark, sf):
    x = logs(spark, sf)
    return x.join(MC.var_cvar(x), "symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x") < F.col("var") / 2).cast("int")).alias("x"))


@query
def kupiec(spark, sf):
    return rounded(MC.kupiec(breaches(spark, sf)), 5)


@query
def horizon_summary(spark, sf):
    return MC.horizon_summary(MC.terminal_returns(logs(spark, sf)))


@query
def rolling_backtest(spark, sf):
    x = written(MC.log_returns(P.with_history(P.bars(spark, sf))), "returns")
    return MC.backtest_report(written(MC.rolling_backtest(x), "backtest"))  # the report reads the scores more than once


def prices(spark, sf):
    """Returns as column x, without the first row of a symbol."""
    return returns(spark, sf).where("r is not null").withColumn("x", F.col("r"))


@query
def rolling_fingerprint(spark, sf):
    return tidy(RG.fingerprint(prices(spark, sf)), RG.FINGERPRINT)


@query
def spell_durations(spark, sf):
    return RG.spells(RG.vol_state(returns(spark, sf))).select("symbol", "spell", "state", "first", "last", "n")


@query
def forward_filled_labels(spark, sf):
    """Volatility states known at every fifth row of a symbol, carried to all its rows."""
    base = returns(spark, sf)
    rows = base.select("symbol", "date", F.col("rn").cast("long").alias("i")).join(RG.vol_state(base).select("symbol", "date", "state"), ["symbol", "date"], "left")
    known = rows.select("symbol", "date", "i", F.when(F.col("i") % 5 == 0, F.col("state")).alias("known"))
    return D.filled_forward(known, "known", "i", "state").select("symbol", "date", "known", "state")


@query
def state_transitions(spark, sf):
    return rounded(RG.transitions(RG.vol_state(returns(spark, sf))))


@query
def transition_entropy(spark, sf):
    return rounded(RG.transition_entropy(RG.transitions(RG.vol_state(returns(spark, sf)))))


@query
def adjusted_rand(spark, sf):
    labels = RG.vol_state(returns(spark, sf)).withColumn("up", (F.col("r") > 0).cast("int"))
    return rounded(RG.adjusted_rand(labels, "state", "up"))


@query
def cusum_segments(spark, sf):
    x = logs(spark, sf)
    return RG.segments(x, RG.cusum_changes(x)).groupBy("symbol", "segment").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))


@query
def hmm_order(spark, sf):
    return RG.best_order(RG.hmm_order(logs(spark, sf)))


@query
def hmm_states(spark, sf):
    return RG.hmm_states(logs(spark, sf)).groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"), F.avg("posterior").alias("posterior"))


@query
def hmm_stability(spark, sf):
    return RG.hmm_stability(MC.log_returns(P.with_history(P.bars(spark, sf))))


@query
def gaussian_mixture(spark, sf):
    return RG.mixture(logs(spark, sf))


@query
def rolling_regimes(spark, sf):
    return RG.rolling_regimes(prices(spark, sf)).groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"), F.avg("fp_std").alias("fp_std"))


@query
def silhouette(spark, sf):
    return RG.silhouette(RG.rolling_regimes(prices(spark, sf)), RG.FINGERPRINT)


@query
def bocpd(spark, sf):
    return RG.bocpd(logs(spark, sf)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("run_length").alias("longest"))


@query
def switching_regression(spark, sf):
    full = P.full_panel(spark, sf).where("r is not null")
    return RG.switching_regression(full.select("symbol", F.col("rn").alias("i"), F.col("mr").alias("f"), F.col("r").alias("y")))


def points(spark, sf):
    """Forecast rows; even days calibrate, odd days test."""
    mark = F.pmod(F.datediff("date", F.lit("1970-01-01")), F.lit(2))
    return forecasts(spark, sf).select("symbol", "date", "horizon", F.col("t").alias("y"), "p", "vol", F.when(mark == 0, "cal").otherwise("test").alias("split"))


def bands(spark, sf, z: float = 1.0):
    wide = z * F.col("vol") * F.sqrt(F.col("horizon").cast("double"))
    return points(spark, sf).withColumns({"lo": -wide, "hi": wide})


@query
def split_conformal(spark, sf):
    return rounded(U.split_conformal(points(spark, sf)))


@query
def cqr(spark, sf):
    return rounded(U.cqr(bands(spark, sf)))


@query
def pinball(spark, sf):
    rows = bands(spark, sf)
    long = rows.select("horizon", "y", F.lit(0.1).alias("q"), F.col("lo").alias("value")).unionByName(rows.select("horizon", "y", F.lit(0.9).alias("q"), F.col("hi").alias("value")))
    return rounded(U.pinball(long, "horizon", "q"))


@query
def interval_coverage(spark, sf):
    return rounded(U.interval_scores(bands(spark, sf), "horizon"))


@query
def ensemble_variance(spark, sf):
    """Three momentum forecasts of a day's return as members."""
    members = [F.when(change(k).isNotNull(), change(k) / k) for k in (5, 10, 20)]
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-19, 0)
    rows = returns(spark, sf).select("symbol", "date", F.var_pop("r").over(w).alias("s2"), F.array(*members).alias("m"), F.row_number().over(Window.partitionBy("symbol").orderBy("date")).alias("n")).where("n > 20")
    return rounded(U.ensemble_variance(rows.select(F.concat_ws("|", "symbol", F.col("date").cast("string")).alias("key"), "s2", F.explode("m").alias("p"))))


@query
def bma_weights(spark, sf):
    f = forecasts(spark, sf)
    sse = f.groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("t") - F.col("p")) * (F.col("t") - F.col("p"))).alias("a"), F.sum(F.col("t") * F.col("t")).alias("b"))
    models = sse.select("symbol", "horizon", "n", F.explode(F.array(F.struct(F.lit("momentum").alias("model"), F.col("a").alias("sse"), F.lit(2).alias("k")), F.struct(F.lit("zero").alias("model"), F.col("b").alias("sse"), F.lit(1).alias("k")))).alias("m")).select("symbol", "horizon", "n", "m.*")
    return rounded(U.bma_weights(models, "symbol", "horizon").select("symbol", "horizon", "model", "bic", "weight"), 4)


def garch_paths(spark: SparkSession, sf: str) -> DataFrame:
    v = logs(spark, sf).groupBy("symbol").agg(F.var_pop("x").alias("v"), F.max_by("x", "i").alias("l"))
    return U.garch_variance_path(v.select("symbol", (F.col("v") * 0.04).alias("omega"), F.lit(0.08).alias("alpha"), F.lit(0.88).alias("beta"), F.col("v").alias("h0"), (F.col("l") * F.col("l")).alias("e0")))


@query
def garch_variance_path(spark, sf):
    return rounded(garch_paths(spark, sf), 8)


@query
def garch_bands(spark, sf):
    mean = logs(spark, sf).groupBy("symbol").agg(F.avg("x").alias("mu"))
    return rounded(U.garch_bands(garch_paths(spark, sf).join(mean, "symbol"), 7.0))


@query
def bma_mixture(spark, sf):
    """Three forecasts of a symbol's return over a horizon: momentum, nothing, the mean. Their residuals on calibration rows, around each
    one's last forecast, are its draws; BIC on the same rows gives the weights."""
    rows = stored(points(spark, sf).where("split = 'cal'").select("symbol", "date", "horizon", "y", "p"))
    key = ["symbol", "horizon"]
    stats = rows.groupBy(*key).agg(F.avg("y").alias("m"), F.max_by("p", "date").alias("last"))
    made = [F.struct(F.lit(name).alias("model"), F.lit(k).alias("k"), forecast.alias("f"), last.alias("at")) for name, k, forecast, last in (("mean", 2, F.col("m"), F.col("m")), ("momentum", 2, F.col("p"), F.col("last")), ("zero", 1, F.lit(0.0), F.lit(0.0)))]
    each = rows.join(stats, key).select(*key, "y", F.explode(F.array(*made)).alias("x")).select(*key, "x.model", "x.k", (F.col("y") - F.col("x.f")).alias("e"), F.col("x.at").alias("at"))
    fits = each.groupBy(*key, "model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("sse"), F.first("k").alias("k"))
    return rounded(C.bma_mixture(each.select(*key, "model", (F.col("at") + F.col("e")).alias("value")), U.bma_weights(fits, *key).select(*key, "model", "weight"), tuple(key)), 5)


@query
def pit(spark, sf):
    x = logs(spark, sf)
    y = x.groupBy("symbol").agg(F.max_by("x", "i").alias("y"))
    return rounded(U.pit(x.join(y, "symbol").withColumn("value", F.col("x")), "symbol"))


def normal_laws(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of the test rows, the deviation of their normal predictive law (mean 0, the recent volatility over the horizon) and their PIT."""
    rows = points(spark, sf).where("split = 'test' and vol > 0").withColumn("sd", F.col("vol") * F.sqrt(F.col("horizon").cast("double")))
    return stored(rows.withColumn("pit", normal_cdf(F.col("y") / F.col("sd"))))


@query
def pit_uniformity(spark, sf):
    """Kolmogorov-Smirnov distance of the outcomes' PIT values under their predictive law from the uniform law."""
    return rounded(C.uniformity(normal_laws(spark, sf), ("horizon",), "pit"))


@query
def calibration_report(spark, sf):
    laws, sd = normal_laws(spark, sf), F.col("sd")
    return rounded(C.calibration_report(laws, ("horizon",), "y", {q: C.normal_quantile(q, F.lit(0.0), sd) for q in C.LEVELS}, "pit", C.normal_crps(F.col("y"), F.lit(0.0), sd)))


@query
def quantile_calibration(spark, sf):
    return rounded(C.quantile_shares(normal_laws(spark, sf), ("horizon",), "y", {q: C.normal_quantile(q, F.lit(0.0), F.col("sd")) for q in C.LEVELS}))


def regression_rows(spark, sf):
    return P.full_panel(spark, sf).where("r is not null").select("symbol", F.col("rn").alias("i"), F.col("mr").alias("f"), F.col("r").alias("y"))


@query
def bootstrap_fit(spark, sf):
    fits = U.bootstrap_fit(regression_rows(spark, sf), 1)
    return fits.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("coef")[0]).alias("slope"), F.stddev_samp(F.col("coef")[0]).alias("slope_sd"))


@query
def quantile_regression(spark, sf):
    return U.quantile_regression(regression_rows(spark, sf), (0.1, 0.5, 0.9))


@query
def event_bars(spark, sf):
    return rounded(stream_bars(P.read(spark, sf, "events")))


@query
def online_change_points(spark, sf):
    """The event table as a stream through keyed change-point state; change: the most probable run length falls by more than half."""
    CH.rocksdb_state(spark)
    folder = new_folder(spark, "changes")  # a stream's path is a pattern, so that it may be a file or a folder of files
    found = CH.online_changes(event_stream(spark, f"{sf}/event[s].parquet"), scale=1.0)
    run = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    seen = spark.read.schema(CH.FOUND).parquet(f"{folder}/out")
    before = F.lag("run_length").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return seen.withColumn("_fell", (F.col("run_length") < before / 2).cast("int")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("run_length").alias("longest"), F.coalesce(F.sum("_fell"), F.lit(0)).alias("changes"))


@query
def stock_status(spark, sf):
    add, _ = FAMILIES["momentum"]
    df = add(P.full_panel(spark, sf))
    last = df.groupBy("symbol").agg(F.max_by("close", "date").alias("close"), F.min_by("close", "date").alias("first"), F.max_by("rsi14", "date").alias("rsi"))
    return rounded(last.select("symbol", "close", (F.col("close") / F.col("first") - 1).alias("total_return"), F.when(F.col("rsi") > 0.7, "overbought").when(F.col("rsi") < 0.3, "oversold").otherwise("neutral").alias("signal")))

