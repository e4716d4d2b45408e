"""DuckDB SQL of the registered queries, written apart from the DataFrame plans."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

from tessera.functions.exprs import _TAIL_DOWN, _TAIL_UP
from tessera.functions.special import t_ppf

BARS = """bars AS (
SELECT symbol, sector, date, first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS open, max(px) AS high, min(px) AS low,
 last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS dollar_volume
FROM (SELECT n_name AS symbol, r_name AS sector, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l.* FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
GROUP BY ALL)"""
HIST = BARS + ", hist AS (SELECT * FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 218))"
O = "PARTITION BY symbol ORDER BY date"  # noqa: E741
RET = HIST + f", ret AS (SELECT *, row_number() OVER ({O}) AS rn, CASE WHEN abs(lag(close) OVER ({O})) > 1e-12 THEN close / lag(close) OVER ({O}) END - 1 AS r FROM hist)"
MKT = "SELECT date, coalesce(avg(r), 0) AS mr, coalesce(stddev_pop(r), 0) AS mv, coalesce(avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END), 0) AS mb FROM ret GROUP BY date"
SEC = "SELECT date, sector, coalesce(avg(r), 0) AS sr FROM ret GROUP BY ALL"
RANK = "CASE WHEN r IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY r NULLS LAST) + (count(*) OVER (PARTITION BY date, r) - 1) / 2.0) / count(r) OVER (PARTITION BY date) END"
FULL = RET + f", mkt AS ({MKT}), sec AS ({SEC}), ranked AS (SELECT *, {RANK} AS cs_return_rank FROM ret), panel AS (SELECT ranked.*, mr, mv, mb, sr, coalesce(r, 0) AS rz FROM ranked JOIN mkt USING (date) JOIN sec USING (date, sector))"
LOGS = HIST + f""", recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM hist) WHERE back <= 756),
lx AS (SELECT *, row_number() OVER ({O}) - 1 AS i FROM (SELECT symbol, date, ln(close / lag(close) OVER ({O})) AS x FROM recent) WHERE x IS NOT NULL)"""


def w(n: int) -> str:
    return f"OVER ({O} ROWS {n - 1} PRECEDING)"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    """agg has {x} for the column."""
    return f"(CASE WHEN count({x}) {w(n)} >= {least or n} THEN {agg.replace('{x}', x)} {w(n)} END)"


def avg(x, n, least=None):
    return roll("avg({x})", x, n, least)


def sd(x, n):
    return roll("stddev_pop({x})", x, n)


def hi(x, n):
    return roll("max({x})", x, n)


def lo(x, n):
    return roll("min({x})", x, n)


def tot(x, n):
    return roll("sum({x})", x, n)


def both(f: str, y: str, x: str, n: int) -> str:
    return f"(CASE WHEN count(({y}) + ({x})) {w(n)} >= {n} THEN {f}({y}, {x}) {w(n)} END)"


def lag(x, k=1):
    return f"lag({x}, {k}) OVER ({O})"


def div(a, b, fill: float | None = 0.0):
    return f"(CASE WHEN abs({b}) > 1e-12 THEN ({a}) / ({b}) {'' if fill is None else f'ELSE {fill}'} END)"


def chg(k, x="close"):
    return div(f"{x} - {lag(x, k)}", lag(x, k), None)


def clip(x, a, b):
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({a}, least({b}, {x})) END)"


def chain(base: str, source: str, *layers: dict[str, str]) -> tuple[str, str]:
    """(WITH list, last name): each layer adds columns."""
    for k, layer in enumerate(layers):
        name = f"layer{k}"
        base += f", {name} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in layer.items()) + f" FROM {source})"
        source = name
    return base, source


def tidy(base: str, source: str, names, places: int = 4, where: str = "") -> str:
    return f"WITH {base} SELECT symbol, date, " + ", ".join(f"round(coalesce({c}, 0) + 1e-10, {places}) + 0.0 AS {c}" for c in names) + f" FROM {source} {where}"


def rsi(d: str, n: int) -> str:
    up, down = avg(f"greatest({d}, 0)", n), avg(f"greatest(-{d}, 0)", n)
    # greatest() of DuckDB skips nulls: the guard looks at the difference itself.
    return f"(CASE WHEN count({d}) {w(n)} >= {n} THEN CASE WHEN {down} < 1e-12 THEN 1.0 ELSE {up} / ({up} + {down}) END END)"


def momentum() -> str:
    one = {f"return_{k}d": chg(k) for k in (1, 2, 3, 5, 7, 10, 14, 20, 28, 50, 60, 100)} | {f"mom_{k}": chg(k) for k in (5, 10, 20, 60)}
    one |= {f"rsi{n}": rsi("dc", n) for n in (14, 7, 21)} | {f"price_to_ma{n}": f"tanh({div(f'close - {avg('close', n, 1)}', f'abs({avg('close', n, 1)})')})" for n in (5, 10, 20, 50, 100, 200)}
    one |= {"price_pct_52w": div(f"close - {lo('close', 252)}", f"{hi('close', 252)} - {lo('close', 252)}"), "price_to_sma200": div("close", avg("close", 200), None) + " - 1", "rv60": sd("r", 60)}
    one["volume_weighted_mom"] = f"tanh({div(avg('rz * volume', 20, 10), avg('volume', 20, 10))})"
    one["momentum_quality"] = f"tanh({clip(f'{avg("sign(rz)", 20, 10)} * {avg("abs(rz)", 20, 10)} * 100', -5, 5)})"
    two = {"price_accel": "mom_5 - mom_10", "momentum_decay": "mom_5 / (abs(mom_20) + 1e-9)", "vol_adjusted_mom_20": "tanh(mom_20 / (rv60 + 1e-9))", "rsi_divergence": "rsi14 - rsi21", "vwm_fast": "volume_weighted_mom"}
    return tidy(*chain(FULL, "panel", {"dc": f"close - {lag('close')}"}, one, two), [c for c in [*one, *two] if c != "rv60"])


def power(x, n, least):
    c = f"count({x}) {w(n)}"
    s = [f"sum(({x}) ** {k}) {w(n)}" for k in (1, 2, 3, 4)]
    return {"c": f"(CASE WHEN {c} >= {least} THEN CAST({c} AS DOUBLE) END)", **{f"s{k + 1}": v for k, v in enumerate(s)}}


def moments(tag: str) -> dict[str, str]:
    c, s1, s2, s3, s4 = (f"{tag}_{k}" for k in ("c", "s1", "s2", "s3", "s4"))
    m = f"({s1} / {c})"
    return {f"{tag}_m2": f"{s2} - {c} * {m} * {m}", f"{tag}_m3": f"{s3} - 3 * {m} * {s2} + 2 * {c} * {m} * {m} * {m}", f"{tag}_m4": f"{s4} - 4 * {m} * {s3} + 6 * {m} * {m} * {s2} - 3 * {c} * {m} * {m} * {m} * {m}"}


def skew(tag: str) -> str:
    return f"CASE WHEN {tag}_m2 > 1e-14 THEN {tag}_c * sqrt({tag}_c - 1) / ({tag}_c - 2) * {tag}_m3 / {tag}_m2 ** 1.5 END"


def volatility() -> str:
    hl, co = f"ln(greatest({div('high', 'low', 1.0)}, 1e-9))", f"ln(greatest({div('close', 'open', 1.0)}, 1e-9))"
    zero = {"hl2": f"{hl} * {hl}", "co2": f"{co} * {co}", "dn": "least(rz, 0)", "up": "greatest(rz, 0)", **{f"a_{k}": v for k, v in power("r", 20, 15).items()}, **{f"b_{k}": v for k, v in power("r", 60, 30).items()}}
    one = {f"realized_vol_{n}": sd("r", n) for n in (5, 10, 20, 60, 120, 252)} | moments("a") | moments("b")
    one |= {"parkinson_vol": f"sqrt({tot('hl2', 20)} / {4 * 20 * math.log(2)})", "garman_klass_vol": f"sqrt(greatest({tot(f'(0.5 * hl2 - {2 * math.log(2) - 1} * co2)', 20)} / 20, 0.0))", "downside_dev20": sd("dn", 20), "upside_dev20": sd("up", 20), "range_expansion": div("high - low", avg("close", 20)), "q5": roll("stddev_samp({x})", "rz", 5, 2), "q20": roll("stddev_samp({x})", "rz", 20, 10)}
    one["garman_klass_vol"] = f"CASE WHEN rn >= 20 THEN {one['garman_klass_vol']} END"
    two = {"vol_regime": div("realized_vol_20", "realized_vol_120"), "vol_of_vol": sd("realized_vol_20", 20), "vol_ratio_5_20": div("realized_vol_5", "realized_vol_20"), "vol_ratio_20_60": div("realized_vol_20", "realized_vol_60"), "vol_ratio_60_120": div("realized_vol_60", "realized_vol_120"), "vol_skew_proxy": f"tanh({div('upside_dev20', 'downside_dev20')} - 1)", "skew20": skew("a"), "skew60": skew("b"), "kurt20": "CASE WHEN a_m2 > 1e-14 THEN a_c * (a_c + 1) * (a_c - 1) / ((a_c - 2) * (a_c - 3)) * a_m4 / (a_m2 * a_m2) - 3 * (a_c - 1) * (a_c - 1) / ((a_c - 2) * (a_c - 3)) END", "vol_breakout": div("realized_vol_20", avg("realized_vol_20", 50)), "shock": div("abs(r)", "realized_vol_20"), "jump_intensity": avg("CASE WHEN realized_vol_60 IS NOT NULL THEN CASE WHEN abs(r) > 2 * realized_vol_60 THEN 1.0 ELSE 0.0 END END", 60), "var_ratio": f"tanh({div('q5 * q5 * 4', 'q20 * q20')} - 1)"}
    return tidy(*chain(FULL, "panel", zero, one, two), [c for c in [*one, *two] if not c.startswith(("a_", "b_")) and c not in ("q5", "q20")])


def normal_cdf(x: str) -> str:
    up, down = (functools.reduce(lambda y, c: f"({y} * least(abs({x}), 7.0) + {c!r})", k[1:], repr(k[0])) for k in (_TAIL_UP, _TAIL_DOWN))
    tail = f"(CASE WHEN abs({x}) >= 7 THEN 0 ELSE exp(-({x}) * ({x}) / 2) * {up} / {down} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def backfill(x: str) -> str:
    return f"coalesce(first_value({x} IGNORE NULLS) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value({x} IGNORE NULLS) OVER ({O} ROWS UNBOUNDED PRECEDING), 0)"


def robust(named: dict[str, str], n: int = 60) -> list[dict[str, str]]:
    def back(x):
        return f"coalesce(first_value({x} IGNORE NULLS) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value({x} IGNORE NULLS) OVER ({O} ROWS UNBOUNDED PRECEDING), 0)"
    a = {f"m_{o}": avg(c, n, n // 2) for o, c in named.items()} | {f"s_{o}": roll("stddev_samp({x})", c, n, n // 2) for o, c in named.items()}
    b = {f"bm_{o}": back(f"m_{o}") for o in named} | {f"bs_{o}": back(f"s_{o}") for o in named}
    return [a, b, {o: f"tanh(tanh({clip(f'({c} - bm_{o}) / (bs_{o} + 1e-9)', -10, 10)}))" for o, c in named.items()}]


def volume() -> str:
    clv = "CASE WHEN high - low > 1e-12 THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END"
    zero = {"dc": f"close - {lag('close')}", "tp": "(high + low + close) / 3", "lv": "ln(1 + volume)", "med": f"quantile_cont(volume, 0.5) {w(252)}", "cv": f"({clv}) * volume", "buy": "CASE WHEN close >= open THEN volume ELSE 0 END", "sell": "CASE WHEN close < open THEN volume ELSE 0 END"}
    half = {"flow": "tp * volume", "upflow": f"CASE WHEN tp > {lag('tp')} THEN tp * volume ELSE 0 END", "sgn": "coalesce(sign(dc), 0) * volume", "adv": "CASE WHEN rn > 1 THEN cv ELSE 0 END", "arz": "abs(rz)", "sqv": "sqrt(volume)", "imp": div("abs(rz)", "sqrt(volume)")}
    run = f"OVER ({O} ROWS UNBOUNDED PRECEDING)"
    one = {"vol_z20": div(f"volume - {avg('volume', 20)}", sd("volume", 20)), "vol_surprise": div("volume", avg("volume", 20), 1.0), "relative_volume60": div("volume", avg("volume", 60), 1.0), "volume_trend": div(avg("volume", 5), avg("volume", 20)), "turnover_ratio": div("volume", avg("volume", 252)), "average_daily_volume": avg("volume", 252), "dollar_flow": chg(5, "dollar_volume"), "volume_percentile252": div("volume", "med", 1.0), "liq_trend": avg("lv", 20), "liq_accel": f"lv - {lag('lv', 5)}", "chaikin_money_flow": div(tot("cv", 20), tot("volume", 20)), "money_flow_index": f"CASE WHEN rn > 14 THEN {div(tot('upflow', 14), tot('flow', 14), 0.5)} END - 0.5", "orderflow_imbalance": div(f"{avg('buy', 20, 10)} - {avg('sell', 20, 10)}", f"{avg('buy', 20, 10)} + {avg('sell', 20, 10)}"), "cum": f"sum(flow) {run} / sum(volume) {run}", "x_amihud": f"coalesce({div(tot('arz', 20), tot('dollar_volume', 20))}, 0)", "x_kyle": f"coalesce({both('regr_slope', 'rz', 'sqv', 20)}, 0)", "x_obv": f"first_value(volume) {run} + sum(sgn) {run}", "x_ad": f"sum(adv) {run}", "x_vpt": clip("volume * rz", -1e6, 1e6), "informed_trading_proxy": f"tanh(coalesce({both('corr', 'arz', 'volume', 20)}, 0))", "x_imp": avg("imp", 10)}
    two = {"vwap_deviation": f"tanh({clip(div('close - cum', 'cum'), -3, 3)})", "volume_zscore20": "vol_z20", "relative_volume20": "vol_surprise", "liq_dryness": div("1.0", "vol_surprise"), "obv_slope": f"tanh({chg(5, 'x_obv')})", "price_impact_persistence": chg(5, "x_imp")}
    sign = f"volume * (2 * {normal_cdf('rz / (g50 + 1e-8)')} - 1)"
    vp = [{"x_g": roll("stddev_samp({x})", "rz", 50, 25), "x_nz": div("abs(coalesce(dc, 0))", "high - low + 1e-8")}, {"g50": backfill("x_g"), "x_nm": avg("x_nz", 20, 10)}, {"x_sv": sign}, {"x_bs": avg("x_sv", 50, 25), "x_vm": avg("volume", 50, 25), "x_noise": backfill("x_nm")}, {"x_vpin": div(f"abs({backfill('x_bs')})", f"{backfill('x_vm')} + 1e-8")}]
    late = [*vp, *robust({"flow_toxicity_vpin": "x_vpin"}, 100), *robust({"microstructure_noise": "x_noise"}, 60)]
    two["liquidity_shock"] = f"vol_surprise * coalesce({div('abs(r)', sd('r', 20))}, 0)"
    z = robust({"amihud": "x_amihud", "kyle_lambda": "x_kyle", "obv": "x_obv", "accumulation_distribution": "x_ad", "volume_price_trend": "x_vpt"})
    names = [c for c in [*one, *two, *z[2]] if not c.startswith("x_") and c != "cum"] + ["flow_toxicity_vpin", "microstructure_noise"]
    return tidy(*chain(FULL, "panel", zero, half, one, two, *z, *late), names)


def price_action() -> str:
    hl, body, up, dn = "(high - low)", "abs(close - open)", "(high - greatest(open, close))", "(least(open, close) - low)"
    one = {"bid_ask_proxy": div(hl, "close"), "hl_spread": div(hl, "close"), "oc_return": div("close - open", "open"), "body": div("close - open", hl), "close_pos": div("close - low", hl), "upper_shadow": div(up, hl), "lower_shadow": div(dn, hl), "gap": div(f"open - {lag('close')}", lag("close"), None), "wick_ratio": f"({up} + {dn}) / ({body} + 1e-9)", "inside_bar": f"CASE WHEN high < {lag('high')} AND low > {lag('low')} THEN 1.0 ELSE 0.0 END", "outside_bar": f"CASE WHEN high > {lag('high')} AND low < {lag('low')} THEN 1.0 ELSE 0.0 END", "body_percentile": f"CASE WHEN rn >= 20 THEN least({body} / ({roll('quantile_cont({x}, 0.5)', body, 20)} + 1e-9), 1e6) END", "breakout": div("close", hi("high", 20)), "support": div("close", lo("low", 20)), "drawdown": div("close", hi("close", 20), None) + " - 1", "k14": div(f"close - {lo('low', 14)}", f"{hi('high', 14)} - {lo('low', 14)}", 0.5), "intraday_range_efficiency": div(f"abs(close - {lag('close', 19)})", tot(hl, 20))}
    two = {"overnight_gap_ma": avg("gap", 10), "recovery": avg("drawdown", 20), "pain_index": avg("abs(drawdown)", 60), "stoch_d": f"{avg('k14', 3)} - 0.5", "williams_r": "k14 - 0.5", "stoch_k": "k14 - 0.5"}
    return tidy(*chain(FULL, "panel", one, two, {"stoch_kd_diff": "stoch_k - stoch_d"}), [c for c in [*one, *two, "stoch_kd_diff"] if c != "k14"])


def risk() -> str:
    y = math.sqrt(252)
    zero = {"dc": f"abs(close - {lag('close')})", "neg": "CASE WHEN rz < 0 THEN rz END", "pk": hi("close", 14), "gain": "greatest(rz, 0)", "loss": "greatest(-rz, 0)", "lr": "least(rz, 0)", "arz": "abs(rz)", "c2": "close * close", "xr": "CAST(rn AS DOUBLE)", **{f"a_{k}": v for k, v in power("rz", 60, 60).items()}}
    down = f"CASE WHEN count(rz) {w(60)} >= 60 THEN CASE WHEN count(neg) {w(60)} >= 2 THEN stddev_pop(neg) {w(60)} ELSE 0 END END"
    one = {"sharpe_60": clip(f"{avg('rz', 60)} / ({sd('rz', 60)} + 1e-9) * {y}", -5, 5) + " / 5", "sortino_60": clip(f"{avg('rz', 60)} / (({down}) + 1e-9) * {y}", -5, 5) + " / 5", "om": f"CASE WHEN {tot('loss', 20)} < 1e-12 THEN 10.0 ELSE {tot('gain', 20)} / {tot('loss', 20)} END", "ulcer_index": f"sqrt(greatest(({avg('c2', 14)} - 2 * pk * {avg('close', 14)} + pk * pk) / (pk * pk) * 1e4, 0.0))", "tail_ratio": div(roll("quantile_cont({x}, 0.95)", "arz", 60), roll("quantile_cont({x}, 0.05)", "arz", 60)), "ret_pos_frac_20": avg("CASE WHEN rz > 0 THEN 1.0 ELSE 0.0 END", 20), "fractal_dimension": f"1 + ln({div(tot('dc', 29), f'{hi("close", 30)} - {lo("close", 30)}', 1.0)}) / {math.log(29)} - 1.5", **{f"lr_slope_{n}": clip(f"{both('regr_slope', 'close', 'xr', n)} / ({sd('close', n)} + 1e-9)", -5, 5) for n in (20, 5)}, **moments("a")}
    for c, n in (("sharpe_60", 60), ("sortino_60", 60), ("lr_slope_20", 20), ("lr_slope_5", 5), ("ulcer_index", 14)):  # least() and greatest() skip nulls
        one[c] = f"CASE WHEN rn >= {n} THEN {one[c]} END"
    third, fall = y / 3, f"{div('close', hi('close', 20), None)} - 1"
    one |= {"sharpe_proxy": f"tanh({div(avg('r', 60), sd('r', 60))} * {third})", "sortino_proxy": f"tanh({div(avg('r', 60), f'coalesce({sd('lr', 20)}, 0) + 1e-9')} * {third})", "calmar_proxy": f"tanh({div(f'coalesce({chg(20)}, 0)', f'abs({fall}) + 1e-9')} / 2)"}
    two = {"omega_ratio": "tanh((om - 1) / 2)", "realized_skew_risk": f"CASE WHEN a_m2 > 1e-14 AND a_c IS NOT NULL THEN {clip('sqrt(a_c) * a_m3 / a_m2 ** 1.5', -5, 5)} END"}
    return tidy(*chain(FULL, "panel", zero, one, two), ["sharpe_proxy", "sortino_proxy", "calmar_proxy", "sharpe_60", "sortino_60", "omega_ratio", "ulcer_index", "tail_ratio", "ret_pos_frac_20", "lr_slope_20", "lr_slope_5", "realized_skew_risk", "fractal_dimension"])


def market() -> str:
    zero = {"dm": f"mr - {lag('mr')}", **{f"cov{n}": both("covar_samp", "rz", "mr", n) for n in (10, 20, 60)}, **{f"vm{n}": roll("var_pop({x})", "mr", n) for n in (20, 60)}, "diff": "rz - mr"}
    beta = {"b20": div("cov20", "vm20"), "b60": div("cov60", "vm60")}
    res = {"res": "rz - b20 * mr"}
    one = {"market_regime": f"CASE WHEN mv > {avg('mv', 50)} AND mr > 0 THEN 1.0 ELSE 0.0 END", "regime_strength": "mr * mv", "market_trend": avg("mr", 20), "market_vol_trend": avg("mv", 20), "breadth_adj_market": "mr * mb", "spy_return": "mr", "spy_volatility": "mv", "spy_drawdown": f"(mr - {hi('mr', 20)}) / (abs({hi('mr', 20)}) + 1e-9)", "spy_rsi": rsi("dm", 14), "market_breadth": "mb", "advance_decline_ratio": "least(greatest(mb, 0) / greatest(1 - mb, 1e-9), 1e6)", "correlation_spy20": f"coalesce({both('corr', 'rz', 'mr', 20)}, 0)", "correlation_spy60": f"coalesce({both('corr', 'rz', 'mr', 60)}, 0)", "return_vs_spy20": f"{chg(20)} - 20 * {avg('mr', 20)}", **{f"cov_spy_{n}": f"tanh(100 * cov{n})" for n in (10, 20, 60)}, "residual_volatility": sd("res", 20), "rolling_alpha": avg("res", 20), "tracking_error": sd("diff", 20), "beta_decay": f"tanh({clip(div('b20 - b60', 'abs(b60)'), -3, 3)})"}
    return tidy(*chain(FULL, "panel", zero, beta, res, one), [*one])


def sector() -> str:
    base = FULL + ", codes AS (SELECT sector, row_number() OVER (ORDER BY sector) - 1 AS code FROM (SELECT DISTINCT sector FROM panel WHERE sector IS NOT NULL)), coded AS (SELECT panel.*, coalesce(code, -1) / 20.0 AS sector_code FROM panel LEFT JOIN codes USING (sector))"
    one = {"market_percentile_return": "cs_return_rank", "return_vs_sector20": f"{chg(20)} - {avg('sr', 20)}", "sector_momentum_60": avg("sr", 60), "exchange_code": "0.0"}
    return tidy(*chain(base, "coded", one), ["cs_return_rank", *one, "sector_code"])


def calendar() -> str:
    t = 2 * math.pi
    parts = {"day_of_week": ("isodow(date) - 1", 5.0), "month": ("month(date)", 12.0), "week": ("week(date)", 52.0)}
    one = {f"{k}_{f}": f"{f}({t} * ({e}) / {n})" for k, (e, n) in parts.items() for f in ("sin", "cos")}
    one |= {"month_end": "CASE WHEN date = last_day(date) THEN 1.0 ELSE 0.0 END", "month_start": "CASE WHEN day(date) = 1 THEN 1.0 ELSE 0.0 END", "quarter": "(quarter(date) - 1) / 3.0", "dom_norm": "(day(date) - 1) / 30.0"}
    names = ["day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos", "week_sin", "week_cos", "month_end", "month_start", "quarter", "dom_norm"]
    return f"WITH {RET} SELECT symbol, date, " + ", ".join(f"round({one[c]} + 1e-10, 4) + 0.0 AS {c}" for c in names) + " FROM ret"


def recurrence() -> str:
    """One recursive step a row: all smoothed values and the Kalman state go on together."""
    state = {"e12": 12, "e26": 26, "e20": 20, "e50": 50, "e100": 100}
    s = "prev"
    emas = {k: f"{s}.{k} + {2 / (n + 1)} * (t.close - {s}.{k})" for k, n in state.items()}
    a = 1 / 14
    tr = f"greatest(t.high - t.low, abs(t.high - {s}.close), abs(t.low - {s}.close))"
    up, dn = f"(t.high - {s}.high)", f"({s}.low - t.low)"
    kx, kp = f"({s}.lvl + {s}.vel)", f"({s}.p + 0.01)"
    lvl = f"({kx} + {kp} / ({kp} + 1.0) * (t.close - {kx}))"
    return f"""WITH RECURSIVE {RET}, step AS (
 SELECT symbol, date, rn, close, high, low, {', '.join(f'close AS {k}' for k in state)}, high - low AS atr, 0.0::DOUBLE AS trs, 0.0::DOUBLE AS pdm, 0.0::DOUBLE AS ndm, 0.0::DOUBLE AS adx, 0.0::DOUBLE AS line9, 0.0::DOUBLE AS ppo9, close AS lvl, 0.0::DOUBLE AS vel, (1 - 1.01 / 2.01) * 1.01 AS p FROM ret WHERE rn = 1
 UNION ALL
 SELECT symbol, date, rn, close, high, low, e12, e26, e20, e50, e100, atr, trs, pdm, ndm, adx0 + {a} * (CASE WHEN pdi + ndi > 1e-12 THEN abs(pdi - ndi) / (pdi + ndi) ELSE 0 END - adx0), l9 + 0.2 * (e12 - e26 - l9), p9 + 0.2 * (CASE WHEN abs(e26) > 1e-12 THEN 100 * (e12 - e26) / abs(e26) ELSE 0 END - p9), lvl, vel, p FROM (
  SELECT *, CASE WHEN trs > 1e-12 THEN pdm / trs ELSE 0 END AS pdi, CASE WHEN trs > 1e-12 THEN ndm / trs ELSE 0 END AS ndi FROM (
   SELECT t.symbol, t.date, t.rn, t.close, t.high, t.low, {', '.join(f'{e} AS {k}' for k, e in emas.items())}, {s}.atr + {a} * ({tr} - {s}.atr) AS atr, {s}.trs + {a} * ({tr} - {s}.trs) AS trs,
    {s}.pdm + {a} * (CASE WHEN {up} > {dn} AND {up} > 0 THEN {up} ELSE 0 END - {s}.pdm) AS pdm, {s}.ndm + {a} * (CASE WHEN {dn} > {up} AND {dn} > 0 THEN {dn} ELSE 0 END - {s}.ndm) AS ndm,
    {s}.adx AS adx0, {s}.line9 AS l9, {s}.ppo9 AS p9, {lvl} AS lvl, 0.8 * {s}.vel + 0.2 * ({lvl} - {s}.lvl) AS vel, (1 - {kp} / ({kp} + 1.0)) * {kp} AS p
   FROM step {s} JOIN ret t ON t.symbol = {s}.symbol AND t.rn = {s}.rn + 1)))"""


def recurrences() -> str:
    cols = {"ema_20": "e20", "ema_50": "e50", "ema_100": "e100", "atr_14": "atr", "adx14": "adx", "plus_di14": "CASE WHEN trs > 1e-12 THEN pdm / trs ELSE 0 END", "minus_di14": "CASE WHEN trs > 1e-12 THEN ndm / trs ELSE 0 END", "macd_line": "tanh((e12 - e26) / close)", "macd_hist": "e12 - e26 - line9", "pmo": "tanh((CASE WHEN abs(e26) > 1e-12 THEN 100 * (e12 - e26) / abs(e26) ELSE 0 END - ppo9) / 5)", "kalman_filtered_price": "tanh((close - lvl) / greatest(abs(lvl), 1e-12))", "kalman_velocity": "tanh(100 * vel)"}
    return recurrence() + " SELECT symbol, date, " + ", ".join(f"round({e} + 1e-10, 4) + 0.0 AS {c}" for c, e in cols.items()) + " FROM step"


def trend() -> str:
    cols = {"trend_strength": div("e20 - e100", "atr"), "ema_ratio_20_50": "e20 / e50 - 1", "ema_ratio_50_100": "e50 / e100 - 1", "atr_ratio": "atr / close", "true_range": "atr / close", **{f"close_to_ema{n}": div(f"close - e{n}", "atr") for n in (20, 50, 100)}, "adx_strength": "CASE WHEN adx > 0.25 THEN 1.0 ELSE 0.0 END", "trend_flip": f"CASE WHEN (e20 - e50) * lag(e20 - e50) OVER ({O}) < 0 THEN 1.0 ELSE 0.0 END"}
    return recurrence() + " SELECT symbol, date, " + ", ".join(f"round(coalesce({e}, 0) + 1e-10, 4) + 0.0 AS {c}" for c, e in cols.items()) + " FROM step"


FC = RET + f""", base AS (SELECT symbol, date, close, {chg(5)} AS p, {sd('r', 20)} AS vol, {', '.join(f'lead(close, {h}) OVER ({O}) AS a{h}' for h in (1, 3, 5, 7, 14, 28))} FROM ret),
fc AS (SELECT symbol, date, p, vol, horizon, ln(ahead / close) AS t FROM ({' UNION ALL '.join(f'SELECT symbol, date, close, p, vol, {h} AS horizon, a{h} AS ahead FROM base' for h in (1, 3, 5, 7, 14, 28))}) WHERE close > 0 AND ahead > 0 AND p IS NOT NULL AND vol IS NOT NULL)"""
LS = FC + ", ls AS (SELECT fc.*, CASE WHEN p > mid THEN t ELSE -t END AS ls FROM fc JOIN (SELECT horizon, quantile_cont(p, 0.5) AS mid FROM fc GROUP BY horizon) USING (horizon)), eq AS (SELECT *, sum(ln(1 + greatest(-0.5, least(0.5, ls)))) OVER k AS lq FROM ls WINDOW k AS (PARTITION BY horizon ORDER BY date, symbol ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, 1 - exp(lq - max(lq) OVER (PARTITION BY horizon ORDER BY date, symbol ROWS UNBOUNDED PRECEDING)) AS drawdown FROM eq)"
ERR = "count(*) AS n, avg((p - t) * (p - t)) AS mse, avg(abs(p - t)) AS mae, CASE WHEN stddev_pop(p) < 1e-12 OR stddev_pop(t) < 1e-12 OR count(*) <= 2 THEN 0 ELSE coalesce(corr(p, t), 0) END AS ic, avg(CASE WHEN sign(p) = sign(t) THEN 1.0 ELSE 0.0 END) AS da"
WF = "g AS (SELECT n, CAST(floor(n * 0.35) AS BIGINT) AS i, greatest(CAST(floor(n * 0.08) AS BIGINT), 1) AS t FROM (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM ret GROUP BY symbol))), spec AS (SELECT CAST(k AS INTEGER) AS window_id, 0::BIGINT AS train_start, CAST(floor((i + k * t) * 0.85) AS BIGINT) AS val_cut, i + k * t AS train_end, i + k * t + 30 AS test_start, least(i + k * t + 30 + t, n) AS test_end FROM g, range(40) r(k) WHERE i + k * t + 30 + t <= n)"
AL = "al AS (SELECT * FROM (SELECT ret.*, rn - 1 - (c - (SELECT n FROM g)) AS idx FROM ret JOIN (SELECT symbol, count(*) AS c FROM ret GROUP BY symbol) USING (symbol)) WHERE idx >= 0)"
WIN = f"{FC}, {WF}, {AL}, f AS (SELECT fc.*, window_id FROM fc JOIN al USING (symbol, date) JOIN spec ON idx >= test_start AND idx < test_end)"
_K = "window_id, horizon"
WM = f"""WITH {WIN}, e AS (SELECT {_K}, {ERR} FROM f GROUP BY ALL),
k AS (SELECT {_K}, rank() OVER (PARTITION BY {_K} ORDER BY p) + (count(*) OVER (PARTITION BY {_K}, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY {_K} ORDER BY t) + (count(*) OVER (PARTITION BY {_K}, t) - 1) / 2.0 AS b FROM f),
ri AS (SELECT {_K}, coalesce(corr(a, b), 0) AS rank_ic FROM k GROUP BY ALL),
q AS (SELECT {_K}, quantile_cont(p, 0.5) AS mid, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM f GROUP BY ALL),
l AS (SELECT f.*, q1, q3, CASE WHEN p > mid THEN t ELSE -t END AS ls FROM f JOIN q USING ({_K})),
c AS (SELECT *, sum(ln(1 + greatest(-0.5, least(0.5, ls)))) OVER (PARTITION BY {_K} ORDER BY date, symbol ROWS UNBOUNDED PRECEDING) AS lq FROM l),
d AS (SELECT *, 1 - exp(lq - max(lq) OVER (PARTITION BY {_K} ORDER BY date, symbol ROWS UNBOUNDED PRECEDING)) AS dd FROM c),
g2 AS (SELECT {_K}, CASE WHEN stddev_pop(ls) > 1e-12 THEN avg(ls) / stddev_pop(ls) * {math.sqrt(252)} ELSE 0 END AS sharpe, max(dd) AS max_dd, coalesce(avg(t) FILTER (p >= q3), 0) - coalesce(avg(t) FILTER (p <= q1), 0) AS spread FROM d GROUP BY ALL),
wm AS (SELECT * FROM e JOIN ri USING ({_K}) JOIN g2 USING ({_K}))"""
VS = RET + f", v AS (SELECT * FROM (SELECT *, {sd('r', 20)} AS vol FROM ret) WHERE vol IS NOT NULL), vs AS (SELECT symbol, date, r, CASE WHEN vol <= a THEN 0 WHEN vol <= b THEN 1 ELSE 2 END AS state FROM v JOIN (SELECT symbol, quantile_cont(vol, {1 / 3}) AS a, quantile_cont(vol, {2 / 3}) AS b FROM v GROUP BY symbol) USING (symbol))"
TR = VS + f", tr AS (SELECT state, next, n, n / sum(n) OVER (PARTITION BY state) AS p FROM (SELECT state, next, count(*) AS n FROM (SELECT state, lead(state) OVER ({O}) AS next FROM vs) WHERE next IS NOT NULL GROUP BY ALL))"
PT = FC + ", pt AS (SELECT symbol, date, horizon, t AS y, p, vol, CASE WHEN (date - DATE '1970-01-01') % 2 = 0 THEN 'cal' ELSE 'test' END AS split, -vol * sqrt(horizon) AS lo, vol * sqrt(horizon) AS hi FROM fc)"
P10 = " + ".join(f"(a{k} / v) ** 2 / (n - {k})" for k in range(1, 11))


def r(places: int = 6, **cols: str) -> str:
    return ", ".join(f"round({e} + 1e-10, {places}) + 0.0 AS {c}" for c, e in cols.items())


def fingerprint() -> str:
    base = RET + ", px AS (SELECT *, r AS x FROM ret WHERE r IS NOT NULL)"
    zero = {"lx": lag("x"), "ng": "CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END", **{f"a_{k}": v for k, v in power("x", 21, 21).items()}}
    one = {"fp_mean": avg("x", 21), "fp_std": roll("stddev_samp({x})", "x", 21), "fp_neg": avg("ng", 21), "fp_ac1": f"CASE WHEN a_c = 21 THEN coalesce({both('corr', 'x', 'lx', 20)}, 0) END", **moments("a")}
    two = {"fp_skew": "CASE WHEN a_m2 / 21 > 1e-14 THEN (a_m3 / 21) / (a_m2 / 21) ** 1.5 END", "fp_kurt": "CASE WHEN a_m2 / 21 > 1e-14 THEN (a_m4 / 21) / (a_m2 / 21) ** 2 - 3 END"}
    return tidy(*chain(base, "px", zero, one, two), ["fp_mean", "fp_std", "fp_skew", "fp_kurt", "fp_ac1", "fp_neg"])


def complexity() -> str:
    """Lists of the frames, taken apart with list functions."""
    def ent(n):
        b = f"list_transform(l{n}, lambda x: least(floor((x - list_min(l{n})) / (list_max(l{n}) - list_min(l{n})) * 10), 9))"
        return f"CASE WHEN rn < {n} THEN NULL WHEN list_max(l{n}) - list_min(l{n}) < 1e-12 THEN 0 ELSE list_sum(list_transform(range(10), lambda k: CASE WHEN len(list_filter(b{n}, lambda x: x = k)) > 0 THEN -(len(list_filter(b{n}, lambda x: x = k)) / {n}.0) * ln(len(list_filter(b{n}, lambda x: x = k)) / {n}.0) ELSE 0 END)) END", b
    zero = {f"l{n}": f"list(rz) {w(n)}" for n in (5, 20, 60)}
    one = {f"b{n}": ent(n)[1] for n in (5, 20, 60)} | {"mu": "list_avg(l60)"}
    two = {f"entropy_{n}": ent(n)[0] for n in (5, 20, 60)} | {"dv": "list_transform(range(1, 61), lambda k: list_sum(l60[1:k]) - k * mu)", "cv": "list_transform(range(0, 61), lambda k: CASE WHEN k = 0 THEN 1.0 ELSE list_product(list_transform(l60[1:k], lambda x: 1 + x)) END)", "sdv": "sqrt(list_avg(list_transform(l60, lambda x: (x - mu) * (x - mu))))"}
    three = {"entropy_diff": "entropy_60 - entropy_5", "rolling_entropy": "entropy_60", "hurst_exponent": "CASE WHEN rn >= 60 THEN CASE WHEN sdv < 1e-12 OR list_max(dv) - list_min(dv) <= 0 THEN 0.5 ELSE ln((list_max(dv) - list_min(dv)) / sdv) / ln(60.0) END END - 0.5", "mdd": "list_max(list_transform(range(1, 62), lambda k: 1 - cv[k] / list_max(cv[1:k])))"}
    four = {"calmar_60": f"CASE WHEN rn >= 60 THEN {clip(div(avg('rz', 60) + ' * 252', 'mdd'), -10, 10)} / 10 END"}
    return tidy(*chain(FULL, "panel", zero, one, two, three, four), ["entropy_5", "entropy_20", "entropy_60", "entropy_diff", "rolling_entropy", "hurst_exponent", "calmar_60"])


ORACLE_SQL: dict[str, str] = {
    "feat_momentum": momentum(), "feat_volatility": volatility(), "feat_volume": volume(), "feat_price_action": price_action(), "feat_risk": risk(), "feat_market": market(), "feat_sector": sector(), "feat_calendar": calendar(), "feat_complexity": complexity(), "recurrences": recurrences(), "trend": trend(), "rolling_fingerprint": fingerprint(),
    "panel_bars": f"WITH {BARS} SELECT symbol, sector, date, {r(open='open', high='high', low='low', close='close', volume='volume', dollar_volume='dollar_volume')} FROM bars",
    "daily_return": tidy(RET, "ret", ["r"], 6),
    "market_series": f"WITH {RET} SELECT date, {r(mr='mr', mv='mv', mb='mb')} FROM ({MKT})",
    "sector_return": f"WITH {RET} SELECT date, sector, {r(sr='sr')} FROM ({SEC})",
    "sector_codes": f"WITH {BARS} SELECT symbol, CAST(dense_rank() OVER (ORDER BY sector) - 1 AS INTEGER) AS code FROM (SELECT symbol, min_by(sector, date) AS sector FROM bars GROUP BY symbol)",
    "distinct_on_first": "SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1",
    "min_history_filter": f"WITH {BARS} SELECT symbol, count(*) AS count FROM bars GROUP BY symbol HAVING count(*) >= 540",
    "feature_postprocess": f"WITH {HIST}, f AS (SELECT symbol, date, coalesce({div('close - open', 'high - low')}, 0) AS body, coalesce({div('close - low', 'high - low')}, 0) AS close_pos, coalesce({div('close', hi('close', 20), None)} - 1, 0) AS drawdown FROM hist), q AS (SELECT symbol, {', '.join(f'quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}' for c in ('body', 'close_pos', 'drawdown'))} FROM f GROUP BY symbol) SELECT symbol, date, {', '.join(f'round(greatest(lo_{c}, least(hi_{c}, {c})) + 1e-10, 4) + 0.0 AS {c}' for c in ('body', 'close_pos', 'drawdown'))} FROM f JOIN q USING (symbol)",
    "forward_labels": f"WITH {RET}, b AS (SELECT symbol, date, close, {', '.join(f'lead(close, {h}) OVER ({O}) AS a{h}' for h in (1, 3, 5, 7, 14, 28))} FROM ret) SELECT symbol, date, horizon, round(ln(ahead / close) + 1e-10, 6) + 0.0 AS target FROM ({' UNION ALL '.join(f'SELECT symbol, date, close, {h} AS horizon, a{h} AS ahead FROM b' for h in (1, 3, 5, 7, 14, 28))}) WHERE close > 0 AND ahead > 0",
    "sequence_index": f"WITH {RET} SELECT symbol, CAST((rn - 180) // 5 AS INTEGER) AS sample, CAST(rn - 1 AS INTEGER) AS end_idx, date FROM ret WHERE rn >= 180 AND (rn - 180) % 5 = 0",
    "purged_split": f"WITH {RET}, s AS (SELECT symbol, (rn - 180) // 5 AS sample, count(*) OVER (PARTITION BY symbol) AS n FROM ret WHERE rn >= 180 AND (rn - 180) % 5 = 0), c AS (SELECT *, floor(n * 0.75) AS a, floor(n * 0.9) AS b FROM s) SELECT symbol, CASE WHEN sample < a - 28 THEN 'train' WHEN sample >= a + 28 AND sample < b - 28 THEN 'val' WHEN sample >= b + 28 THEN 'test' ELSE 'purged' END AS split, count(*) AS n, CAST(min(sample) AS INTEGER) AS first, CAST(max(sample) AS INTEGER) AS last FROM c GROUP BY ALL",
    "norm_stats": f"WITH {RET} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}) + 1e-10, 5) + 0.0 AS mu, round(CASE WHEN stddev_pop({c}) < 1e-9 THEN 1 ELSE stddev_pop({c}) END + 1e-10, 5) + 0.0 AS sigma FROM ret" for c in ("r", "close", "volume")),
    "wf_windows": f"WITH {RET}, {WF} SELECT * FROM spec",
    "wf_norm_stats": f"WITH {RET}, {WF}, {AL} SELECT window_id, symbol, {r(5, mu_close='avg(close)', sd_close='CASE WHEN stddev_pop(close) < 1e-9 THEN 1 ELSE stddev_pop(close) END')} FROM al JOIN spec ON idx >= train_start AND idx < val_cut GROUP BY window_id, symbol",
    "forecast_errors": f"WITH {FC} SELECT horizon, n, {r(mse='mse', mae='mae', ic='ic', da='da')} FROM (SELECT horizon, {ERR} FROM fc GROUP BY horizon)",
    "rank_ic": f"WITH {FC}, k AS (SELECT horizon, rank() OVER (PARTITION BY horizon ORDER BY p) + (count(*) OVER (PARTITION BY horizon, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY horizon ORDER BY t) + (count(*) OVER (PARTITION BY horizon, t) - 1) / 2.0 AS b FROM fc) SELECT horizon, round(coalesce(corr(a, b), 0) + 1e-10, 6) + 0.0 AS rank_ic FROM k GROUP BY horizon",
    "long_short": f"WITH {LS} SELECT horizon, {r(5, ls_mean='m', max_dd='d', sharpe=f'CASE WHEN s > 1e-12 THEN m / s * {math.sqrt(252)} ELSE 0 END', calmar='CASE WHEN d > 1e-12 THEN m * 252 / d ELSE 0 END')} FROM (SELECT horizon, avg(ls) AS m, stddev_pop(ls) AS s, max(drawdown) AS d FROM dd GROUP BY horizon)",
    "equity_curve": f"WITH {LS} SELECT date, round(max_by(lq, symbol) + 1e-10, 5) AS log_equity, round(max(drawdown) + 1e-10, 5) AS drawdown FROM dd WHERE horizon = 1 GROUP BY date",
    "quartile_spread": f"WITH {FC}, c AS (SELECT horizon, quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.75) AS b FROM fc GROUP BY horizon) SELECT horizon, round(coalesce(avg(t) FILTER (p >= b), 0) - coalesce(avg(t) FILTER (p <= a), 0) + 1e-10, 6) + 0.0 AS spread FROM fc JOIN c USING (horizon) GROUP BY horizon",
    "decile_returns": f"WITH {FC}, d AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY horizon ORDER BY p, date, symbol) - 1) * 10 / count(*) OVER (PARTITION BY horizon)) AS INTEGER) AS decile FROM fc) SELECT horizon, decile, count(*) AS n, {r(mean_t='avg(t)', mean_p='avg(p)')} FROM d GROUP BY horizon, decile",
    "rolling_ic": f"WITH {FC}, i AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY date, symbol) - 1 AS i, count(*) OVER (PARTITION BY horizon) AS c FROM fc), k AS (SELECT *, greatest(least(500, c // 5), 2) AS w FROM i), s AS (SELECT *, greatest(w // 2, 1) AS h FROM k), j AS (SELECT s.*, unnest(range(0, i // h + 1)) AS win FROM s) SELECT horizon, win AS \"window\", count(*) AS n, round(coalesce(corr(p, t), 0) + 1e-10, 6) + 0.0 AS ic FROM j WHERE i < win * h + w AND win * h + w <= c GROUP BY horizon, win",
    "regime_ic": f"WITH {FC}, c AS (SELECT horizon, quantile_cont(vol, {1 / 3}) AS a, quantile_cont(vol, {2 / 3}) AS b FROM fc GROUP BY horizon), k AS (SELECT fc.*, CASE WHEN vol <= a THEN 'calm' WHEN vol <= b THEN 'normal' ELSE 'stormy' END AS regime FROM fc JOIN c USING (horizon)) SELECT horizon, regime, n, {r(ic='ic', da='da')} FROM (SELECT horizon, regime, {ERR} FROM k GROUP BY horizon, regime)",
    "wf_summary": f"WITH {FC}, {WF}, {AL}, s AS (SELECT window_id, {ERR} FROM fc JOIN al USING (symbol, date) JOIN spec ON idx >= test_start AND idx < test_end WHERE horizon = 5 GROUP BY window_id) SELECT count(*) AS windows, {r(ic_mean='avg(ic)', ic_std='stddev_samp(ic)', positive='avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')}, max_by(window_id, ic) AS best, min_by(window_id, ic) AS worst FROM s",
    "window_metrics": f"{WM} SELECT window_id, horizon, n, {r(5, ic='ic', da='da', rank_ic='rank_ic', sharpe='sharpe', max_dd='max_dd', spread='spread')} FROM wm",
    "window_horizon_means": f"{WM} SELECT window_id, count(*) AS horizons, {r(5, ic_mean='avg(ic)', rank_ic_mean='avg(rank_ic)', da_mean='avg(da)', sharpe_mean='avg(sharpe)')} FROM wm GROUP BY window_id",
    "cross_sectional_z": f"WITH {RET} SELECT symbol, date, {r(5, cs_z='greatest(-5.0, least(5.0, (r - m) / (s + 1e-8)))')} FROM ret JOIN (SELECT date, avg(r) AS m, stddev_pop(r) AS s FROM ret GROUP BY date) USING (date) WHERE r IS NOT NULL",
    "top_symbols": f"WITH {BARS} SELECT symbol, {r(2, total='sum(dollar_volume)')} FROM bars GROUP BY symbol ORDER BY sum(dollar_volume) DESC, symbol LIMIT 5",
    "symbol_overlap": f"WITH {BARS}, a AS (SELECT DISTINCT symbol FROM bars WHERE date < DATE '1995-06-17'), b AS (SELECT DISTINCT symbol FROM bars WHERE date >= DATE '1995-06-17' AND volume > 60) SELECT symbol, CASE WHEN a.symbol IS NOT NULL AND b.symbol IS NOT NULL THEN 'both' WHEN a.symbol IS NOT NULL THEN 'first' ELSE 'second' END AS side FROM a FULL JOIN b USING (symbol)",
    "sector_pivot": f"WITH {RET}, s AS ({SEC}) SELECT date, {r(**{x: f"coalesce(max(sr) FILTER (sector = '{x.replace('_', ' ')}'), 0)" for x in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')})}, round(coalesce(max(sr) FILTER (sector = 'MIDDLE EAST'), 0) + 1e-10, 6) + 0.0 AS \"MIDDLE EAST\" FROM s GROUP BY date",
    "gbm_params": f"WITH {LOGS} SELECT symbol, {r(mu='avg(x) * 252', sigma=f'stddev_samp(x) * {math.sqrt(252)}')} FROM lx GROUP BY symbol",
    "merton_params": f"WITH {LOGS}, m AS (SELECT symbol, avg(x) AS m, stddev_samp(x) AS s, count(*) AS n FROM lx GROUP BY symbol), j AS (SELECT symbol, x, abs(x - m) > 3 * s AS jump, s, n FROM lx JOIN m USING (symbol)) SELECT symbol, count(*) FILTER (jump) AS jumps, {r(lam='count(*) FILTER (jump) / max(n) * 252', jump_mean='CASE WHEN count(*) FILTER (jump) < 3 THEN 0 ELSE avg(x) FILTER (jump) END', jump_std='CASE WHEN count(*) FILTER (jump) < 3 THEN 2 * max(s) ELSE stddev_samp(x) FILTER (jump) END', mu='avg(x) FILTER (NOT jump) * 252', sigma=f'stddev_samp(x) FILTER (NOT jump) * {math.sqrt(252)}')} FROM j GROUP BY symbol",
    "heston_params": f"WITH {LOGS}, q AS (SELECT symbol, x, x * x AS q, lead(x * x) OVER (PARTITION BY symbol ORDER BY i) AS q1, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS back FROM lx), o AS (SELECT symbol, avg(x) * 252 AS mu, var_pop(x) * 252 AS theta, var_pop(x) FILTER (back <= 20) * 252 AS v0, greatest(-0.98, least(0.98, regr_slope(q1, q))) AS phi, corr(x, q1 - q) FILTER (q1 IS NOT NULL) AS rho FROM q GROUP BY symbol), e AS (SELECT symbol, stddev_pop(q1 - phi * q) AS rs FROM q JOIN o USING (symbol) GROUP BY symbol) SELECT symbol, {r(5, mu='mu', kappa='greatest(-ln(greatest(phi, 1e-4)) * 252, 1.0)', theta='theta', xi=f'greatest(0.05, least(3.0, rs * {math.sqrt(252)}))', rho='greatest(-0.95, least(0.0, rho))', v0='v0')} FROM o JOIN e USING (symbol)",
    "var_cvar": f"WITH {LOGS}, c AS (SELECT symbol, quantile_cont(x, 0.05) AS v FROM lx GROUP BY symbol) SELECT symbol, {r(var='max(v)', cvar='avg(x) FILTER (x <= v)')} FROM lx JOIN c USING (symbol) GROUP BY symbol",
    "ljung_box": f"WITH {LOGS}, d AS (SELECT symbol, i, x - avg(x) OVER (PARTITION BY symbol) AS d FROM lx), k AS (SELECT symbol, d, {', '.join(f'd * lag(d, {k}) OVER (PARTITION BY symbol ORDER BY i) AS b{k}' for k in range(1, 11))} FROM d), s AS (SELECT symbol, count(*) AS n, sum(d * d) AS v, {', '.join(f'sum(b{k}) AS a{k}' for k in range(1, 11))} FROM k GROUP BY symbol), q AS (SELECT symbol, ({P10}) * n * (n + 2) AS q FROM s) SELECT symbol, {r(5, q='q', p_value='exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24)')} FROM q",
    "hurst_lag": f"WITH {LOGS}, c AS (SELECT symbol, i, sum(x) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM lx), s AS ({' UNION ALL '.join(f'SELECT symbol, {math.log(k)} AS lk, ln(stddev_pop(d) + 1e-12) AS ls FROM (SELECT symbol, c - lag(c, {k}) OVER (PARTITION BY symbol ORDER BY i) AS d FROM c) GROUP BY symbol' for k in range(2, 20))}) SELECT symbol, round(regr_slope(ls, lk) + 1e-10, 6) + 0.0 AS hurst FROM s GROUP BY symbol",
    "crps": f"WITH {LOGS}, y AS (SELECT symbol, max_by(x, i) AS y FROM lx GROUP BY symbol), a AS (SELECT symbol, avg(abs(x - y)) AS a FROM lx JOIN y USING (symbol) GROUP BY symbol), b AS (SELECT l.symbol, avg(abs(l.x - k.x)) AS b FROM lx l JOIN lx k ON l.symbol = k.symbol GROUP BY l.symbol) SELECT symbol, round(a - b / 2 + 1e-10, 6) + 0.0 AS crps FROM a JOIN b USING (symbol)",
    "kupiec": f"WITH {LOGS}, c AS (SELECT symbol, quantile_cont(x, 0.05) AS v FROM lx GROUP BY symbol), b AS (SELECT symbol, count(*) AS n, count(*) FILTER (x < v / 2) AS x FROM lx JOIN c USING (symbol) GROUP BY symbol), p AS (SELECT *, greatest(1e-6, least(1 - 1e-6, x / n)) AS pi FROM b), q AS (SELECT symbol, n, x, greatest(-2 * ((n - x) * ln(0.95) + x * ln(0.05) - (n - x) * ln(1 - pi) - x * ln(pi)), 0.0) AS lr FROM p) SELECT symbol, n, x, {r(5, lr='lr', p_value='2 * (1 - ' + normal_cdf('sqrt(lr)') + ')')} FROM q",
    "spell_durations": f"WITH {VS}, c AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER ({O}) THEN 0 ELSE 1 END AS c FROM vs), s AS (SELECT *, sum(c) OVER ({O} ROWS UNBOUNDED PRECEDING) AS spell FROM c) SELECT symbol, CAST(spell AS BIGINT) AS spell, any_value(state) AS state, min(date) AS first, max(date) AS last, count(*) AS n FROM s GROUP BY symbol, spell",
    "state_transitions": f"WITH {TR} SELECT state, next, n, round(p + 1e-10, 6) + 0.0 AS p FROM tr",
    "transition_entropy": f"WITH {TR} SELECT round(avg(h) + 1e-10, 6) + 0.0 AS entropy FROM (SELECT state, -sum(p * ln(p)) AS h FROM tr GROUP BY state)",
    "adjusted_rand": f"WITH {VS}, k AS (SELECT state AS a, CAST(r > 0 AS INTEGER) AS b, count(*) AS c FROM vs GROUP BY ALL), s AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM k) AS ij, (SELECT sum(c) FROM k) AS n, (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) AS c FROM k GROUP BY a)) AS i, (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) AS c FROM k GROUP BY b)) AS j) SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)) + 1e-10, 6) + 0.0 AS ari FROM s",
    "split_conformal": f"WITH {PT}, c AS (SELECT horizon, count(*) AS n_cal, quantile_cont(abs(y - p), 0.9) AS unused, list(abs(y - p) ORDER BY abs(y - p)) AS l FROM pt WHERE split = 'cal' GROUP BY horizon), q AS (SELECT horizon, n_cal, l, least(ceil((n_cal + 1) * 0.9) / n_cal, 1.0) * (n_cal - 1) + 1 AS pos FROM c), z AS (SELECT horizon, n_cal, l[CAST(floor(pos) AS BIGINT)] * (1 - pos + floor(pos)) + coalesce(l[CAST(floor(pos) AS BIGINT) + 1], 0) * (pos - floor(pos)) AS width FROM q) SELECT horizon, n_cal, {r(width='width', coverage='cov')} FROM (SELECT horizon, n_cal, width, avg(CASE WHEN abs(y - p) <= width THEN 1.0 ELSE 0.0 END) AS cov FROM pt JOIN z USING (horizon) WHERE split = 'test' GROUP BY ALL)",
    "cqr": f"WITH {PT}, c AS (SELECT horizon, count(*) AS n, list(greatest(lo - y, y - hi) ORDER BY greatest(lo - y, y - hi)) AS l FROM pt WHERE split = 'cal' GROUP BY horizon), q AS (SELECT horizon, l, least(ceil((n + 1) * 0.9) / n, 1.0) * (n - 1) + 1 AS pos FROM c), z AS (SELECT horizon, l[CAST(floor(pos) AS BIGINT)] * (1 - pos + floor(pos)) + coalesce(l[CAST(floor(pos) AS BIGINT) + 1], 0) * (pos - floor(pos)) AS shift FROM q) SELECT horizon, {r(shift='shift', coverage='cov')} FROM (SELECT horizon, shift, avg(CASE WHEN greatest(lo - y, y - hi) <= shift THEN 1.0 ELSE 0.0 END) AS cov FROM pt JOIN z USING (horizon) WHERE split = 'test' GROUP BY ALL)",
    "pinball": f"WITH {PT} SELECT horizon, q, round(avg(greatest(q * (y - v), (q - 1) * (y - v))) + 1e-10, 6) + 0.0 AS loss FROM (SELECT horizon, y, 0.1::DOUBLE AS q, lo AS v FROM pt UNION ALL SELECT horizon, y, 0.9::DOUBLE, hi FROM pt) GROUP BY horizon, q",
    "interval_coverage": f"WITH {PT} SELECT horizon, count(*) AS n, {r(coverage='avg(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END)', sharpness='avg(hi - lo)')} FROM pt GROUP BY horizon",
    "ensemble_variance": f"WITH {RET}, b AS (SELECT symbol, date, rn, var_pop(r) {w(20)} AS s2, {', '.join(f'({chg(k)}) / {k} AS m{k}' for k in (5, 10, 20))} FROM ret), e AS (SELECT symbol || '|' || CAST(date AS VARCHAR) AS key, avg(p) AS mean, coalesce(var_samp(p), 0) AS epistemic, avg(s2) AS aleatoric FROM ({' UNION ALL '.join(f'SELECT symbol, date, s2, m{k} AS p FROM b WHERE rn > 20' for k in (5, 10, 20))}) GROUP BY ALL) SELECT key, {r(mean='mean', epistemic='epistemic', aleatoric='aleatoric', total='epistemic + aleatoric')} FROM e",
    "bma_weights": f"WITH {FC}, s AS (SELECT symbol, horizon, count(*) AS n, sum((t - p) * (t - p)) AS a, sum(t * t) AS b FROM fc GROUP BY ALL), m AS (SELECT symbol, horizon, 'momentum' AS model, n * ln(a / n) + 2 * ln(n) AS bic FROM s UNION ALL SELECT symbol, horizon, 'zero', n * ln(b / n) + ln(n) FROM s), e AS (SELECT *, exp(-0.5 * (bic - min(bic) OVER (PARTITION BY symbol, horizon))) AS e FROM m) SELECT symbol, horizon, model, {r(4, bic='bic', weight='e / sum(e) OVER (PARTITION BY symbol, horizon)')} FROM e",
    "garch_variance_path": f"WITH {LOGS}, v AS (SELECT symbol, var_pop(x) AS v, max_by(x, i) AS l FROM lx GROUP BY symbol), p AS (SELECT symbol, day, 0.04 * v / (1 - 0.96) + 0.96 ** (day - 1) * (0.04 * v + 0.08 * l * l + 0.88 * v - 0.04 * v / (1 - 0.96)) AS variance FROM v, range(1, 127) d(day)) SELECT symbol, CAST(day AS INTEGER) AS day, {r(8, variance='variance', cumulative='sum(variance) OVER (PARTITION BY symbol ORDER BY day)')} FROM p",
    "pit": f"WITH {LOGS}, y AS (SELECT symbol, max_by(x, i) AS y FROM lx GROUP BY symbol) SELECT symbol, round(avg(CASE WHEN x <= y THEN 1.0 ELSE 0.0 END) + 1e-10, 6) + 0.0 AS pit FROM lx JOIN y USING (symbol) GROUP BY symbol",
    "event_bars": f"SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, {r(open='first(value ORDER BY ts, event_id)', high='max(value)', low='min(value)', close='last(value ORDER BY ts, event_id)')}, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
    "stock_status": f"WITH {RET}, d AS (SELECT *, close - {lag('close')} AS dc FROM ret), s AS (SELECT *, {rsi('dc', 14)} AS rsi FROM d) SELECT symbol, {r(close='max_by(close, date)', total_return='max_by(close, date) / min_by(close, date) - 1')}, CASE WHEN max_by(rsi, date) > 0.7 THEN 'overbought' WHEN max_by(rsi, date) < 0.3 THEN 'oversold' ELSE 'neutral' END AS signal FROM s GROUP BY symbol",
}


# Calibration, mixtures, summaries of draws

LEVELS = (0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975)


def tag(q: float) -> str:
    return f"{q * 100:g}".replace(".", "_")


def draws(*horizons: int) -> str:
    """(symbol, horizon, value): log returns over windows of the last 756 rows."""
    run = "cs AS (SELECT symbol, i, sum(x) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM lx)"
    one = " UNION ALL ".join(f"SELECT symbol, {h} AS horizon, c - coalesce(lag(c, {h}) OVER (PARTITION BY symbol ORDER BY i), 0) AS value, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM cs" for h in horizons)
    return f"{LOGS}, {run}, dr AS (SELECT symbol, horizon, value FROM ({one}) WHERE k >= horizon)"


def kolmogorov(x: str) -> str:
    low = " + ".join(f"exp(-{(2 * k - 1) ** 2} * pi() * pi() / (8 * {x} * {x}))" for k in range(1, 5))
    high = " + ".join(f"{(-1) ** (k - 1)} * exp(-{2 * k * k} * {x} * {x})" for k in range(1, 6))
    return f"CASE WHEN {x} < 0.1 THEN 1.0 WHEN {x} < 1.18 THEN 1 - sqrt(2 * pi()) / {x} * ({low}) ELSE greatest(0.0, least(1.0, 2 * ({high}))) END"


LAW = f"{PT}, law AS (SELECT horizon, y, vol * sqrt(horizon) AS sd, {normal_cdf('(y / (vol * sqrt(horizon)))')} AS pit FROM pt WHERE split = 'test' AND vol > 0)"
KS = f"ks AS (SELECT horizon, n, d, {kolmogorov('((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d)')} AS p FROM (SELECT horizon, max(n) AS n, max(greatest(i / n - pit, pit - (i - 1) / n)) AS d FROM (SELECT horizon, pit, row_number() OVER (PARTITION BY horizon ORDER BY pit) AS i, count(*) OVER (PARTITION BY horizon) AS n FROM law) GROUP BY horizon))"


def report() -> str:
    z = {q: NormalDist().inv_cdf(q) for q in LEVELS}
    cols = {}
    for c in (0.5, 0.8, 0.9, 0.95):
        a, b = (min(LEVELS, key=lambda q, e=e: abs(q - e)) for e in ((1 - c) / 2, (1 + c) / 2))
        cols |= {f"coverage_{tag(c)}": f"avg(CASE WHEN y >= {z[a]!r} * sd AND y <= {z[b]!r} * sd THEN 1.0 ELSE 0.0 END)", f"width_{tag(c)}": f"avg({z[b]!r} * sd - {z[a]!r} * sd)"}
    cols |= {f"pinball_{tag(q)}": f"avg(greatest({q} * (y - {x!r} * sd), ({q} - 1) * (y - {x!r} * sd)))" for q, x in z.items()}
    cols["crps"] = f"avg(sd * (y / sd * (2 * pit - 1) + 2 * exp(-y * y / sd / sd / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))"
    good = " AND ".join(f"abs(coverage_{tag(c)} - {c}) <= 0.07" for c in (0.5, 0.8, 0.9, 0.95))
    return f"WITH {LAW}, {KS}, s AS (SELECT horizon, count(*) AS m, {', '.join(f'{e} AS {k}' for k, e in cols.items())} FROM law GROUP BY horizon) SELECT horizon, m AS n, {r(**{k: k for k in cols}, ks='d', p='p')}, {good} AND p > 0.05 AS calibrated FROM s JOIN ks USING (horizon)"


def mixture() -> str:
    base = f"""{PT}, cal AS (SELECT * FROM pt WHERE split = 'cal'), st AS (SELECT symbol, horizon, avg(y) AS m, max_by(p, date) AS last FROM cal GROUP BY ALL),
ea AS (SELECT symbol, horizon, 'mean' AS model, 2 AS k, y - m AS e, m AS base FROM cal JOIN st USING (symbol, horizon) UNION ALL SELECT symbol, horizon, 'momentum', 2, y - p, last FROM cal JOIN st USING (symbol, horizon) UNION ALL SELECT symbol, horizon, 'zero', 1, y, 0 FROM cal),
fi AS (SELECT symbol, horizon, model, count(*) AS n, avg(base + e) AS mu, var_pop(base + e) AS v, count(*) * ln(sum(e * e) / count(*)) + max(k) * ln(count(*)) AS bic FROM ea GROUP BY ALL),
we AS (SELECT *, exp(-0.5 * (bic - min(bic) OVER g)) AS raw FROM fi WINDOW g AS (PARTITION BY symbol, horizon)), sh AS (SELECT *, raw / sum(raw) OVER (PARTITION BY symbol, horizon) AS w FROM we),
mo AS (SELECT symbol, horizon, sum(w * mu) AS mean, sum(w * v) AS within_v, sum(w * mu * mu) - sum(w * mu) ** 2 AS between_v FROM sh GROUP BY ALL),
dw AS (SELECT symbol, horizon, base + e AS value, w / n AS each FROM ea JOIN sh USING (symbol, horizon, model)),
cu AS (SELECT *, sum(each) OVER (PARTITION BY symbol, horizon ORDER BY value RANGE UNBOUNDED PRECEDING) AS upto FROM dw),
qu AS (SELECT symbol, horizon, {', '.join(f'min(value) FILTER (upto >= {q - 1e-12!r} * whole) AS q_{tag(q)}' for q in LEVELS)} FROM (SELECT *, max(upto) OVER (PARTITION BY symbol, horizon) AS whole FROM cu) GROUP BY ALL)"""
    return f"WITH {base} SELECT symbol, horizon, {r(5, mean='mean', std='sqrt(within_v + between_v)', within_share='within_v / (within_v + between_v)', between_share='between_v / (within_v + between_v)', **{f'q_{tag(q)}': f'q_{tag(q)}' for q in LEVELS})} FROM mo JOIN qu USING (symbol, horizon)"


def summary() -> str:
    moments = "count(*) AS n_draws, avg(value) AS point, stddev_samp(value) AS std, avg((value - m) ** 3) / avg((value - m) ** 2) ** 1.5 AS skew, avg((value - m) ** 4) / avg((value - m) ** 2) ** 2 - 3 AS excess_kurtosis"
    q = {f"q_{tag(x)}": f"quantile_cont(value, {x})" for x in LEVELS}
    return f"WITH {draws(5, 21, 63)}, c AS (SELECT *, avg(value) OVER (PARTITION BY symbol, horizon) AS m FROM dr), s AS (SELECT symbol, horizon, {moments}, {', '.join(f'{e} AS {k}' for k, e in q.items())} FROM c GROUP BY ALL) SELECT symbol, horizon, n_draws, {r(5, point='point', std='std', skew='skew', excess_kurtosis='excess_kurtosis', **{k: k for k in q})} FROM s"


def blended() -> str:
    base = f"""{draws(1, 5, 21)}, sr AS (SELECT symbol, horizon, exp(value) - 1 AS value FROM dr), v AS (SELECT * FROM (VALUES ('CHINA', 1, 0.001), ('CHINA', 5, 0.004), ('FRANCE', 21, -0.01), ('NOWHERE', 1, 0.5)) t(symbol, horizon, predicted)),
mm AS (SELECT symbol, horizon, avg(value) AS m FROM sr GROUP BY ALL), sf AS (SELECT symbol, horizon, predicted, coalesce(0.5 * (predicted - m), 0) AS shift FROM mm LEFT JOIN v USING (symbol, horizon)),
mv AS (SELECT symbol, horizon, predicted, value + shift AS x FROM sr JOIN sf USING (symbol, horizon)), cu AS (SELECT symbol, horizon, quantile_cont(x, 0.05) AS v5, quantile_cont(x, 0.5) AS med FROM mv GROUP BY ALL)"""
    return f"WITH {base} SELECT symbol, horizon, count(*) AS n, {r(5, mean_return='avg(x)', std_return='stddev_samp(x)', prob_positive='avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)', cvar='avg(x) FILTER (x <= v5)', median_return='max(med)', var='max(v5)', predicted='max(predicted)')}, CASE WHEN max(predicted) IS NULL THEN 'PURE MC' ELSE 'MODEL+MC' END AS source FROM mv JOIN cu USING (symbol, horizon) GROUP BY symbol, horizon"


def change_segments() -> str:
    """The two-sided sums row after row."""
    z = f"{LOGS}, z AS (SELECT symbol, i, (x - avg(x) OVER (PARTITION BY symbol)) / (stddev_samp(x) OVER (PARTITION BY symbol) + 1e-12) AS z FROM lx)"
    up, down = "greatest(0.0, up + z.z)", "greatest(0.0, down - z.z)"
    hit = f"({up} > 5 OR {down} > 5)"
    run = f"run AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS hit FROM (SELECT DISTINCT symbol FROM z) UNION ALL SELECT z.symbol, z.i, CASE WHEN {hit} THEN 0.0 ELSE {up} END, CASE WHEN {hit} THEN 0.0 ELSE {down} END, CAST({hit} AS INTEGER) FROM run JOIN z ON z.symbol = run.symbol AND z.i = run.i + 1)"
    return f"WITH RECURSIVE {z}, {run}, sg AS (SELECT symbol, i, sum(hit) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS segment FROM run WHERE i >= 0) SELECT symbol, CAST(segment AS BIGINT) AS segment, CAST(min(i) AS INTEGER) AS first, count(*) AS n FROM sg GROUP BY symbol, segment"


def bands() -> str:
    path = ORACLE_SQL["garch_variance_path"].split(" SELECT symbol, CAST(day AS INTEGER)")[0]
    z = ", ".join(f"({q}, {t_ppf(q, 7.0) * math.sqrt(5 / 7)!r})" for q in (0.05, 0.25, 0.5, 0.75, 0.95))
    return f"{path}, cu AS (SELECT symbol, day, sum(variance) OVER (PARTITION BY symbol ORDER BY day) AS c FROM p), mu AS (SELECT symbol, avg(x) AS mu FROM lx GROUP BY symbol) SELECT symbol, CAST(day AS INTEGER) AS day, q::DOUBLE AS q, {r(value='mu * day + sqrt(c) * z')} FROM cu JOIN mu USING (symbol), (VALUES {z}) t(q, z) WHERE day IN (1, 5, 21, 63, 126)"


ORACLE_SQL |= {
    "pit_uniformity": f"WITH {LAW}, {KS} SELECT horizon, n, {r(ks='d', p='p')} FROM ks",
    "calibration_report": report(),
    "quantile_calibration": f"WITH {LAW} SELECT horizon, q::DOUBLE AS q, round(avg(CASE WHEN y < z * sd THEN 1.0 ELSE 0.0 END) + 1e-10, 6) + 0.0 AS observed FROM law, (VALUES {', '.join(f'({q}, {NormalDist().inv_cdf(q)!r})' for q in LEVELS)}) t(q, z) GROUP BY horizon, q",
    "bma_mixture": mixture(),
    "simulation_summary": summary(),
    "blended_forecast": blended(),
    "cusum_segments": change_segments(),
    "garch_bands": bands(),
}


# Training sets


def window_stats() -> str:
    base = f"""{RET}, ix AS (SELECT symbol, (rn - 180) // 5 AS sample, rn - 1 AS end_idx, count(*) OVER (PARTITION BY symbol) AS n FROM ret WHERE rn >= 180 AND (rn - 180) % 5 = 0),
dw AS (SELECT symbol, end_idx FROM ix WHERE sample < floor(n * 0.75) - 28 ORDER BY md5('0|' || symbol || '|' || CAST(sample AS VARCHAR)), symbol, sample LIMIT 8000),
en AS (SELECT ret.* FROM dw JOIN ret ON ret.symbol = dw.symbol AND rn - 1 BETWEEN end_idx - 179 AND end_idx - 60),
tg AS (SELECT {', '.join(f'CASE WHEN close > 0 AND lead(close, {h}) OVER ({O}) > 0 THEN ln(lead(close, {h}) OVER ({O}) / close) END AS t{h}' for h in (1, 3, 5, 7, 14, 28))}, symbol, rn - 1 AS end_idx FROM ret),
tt AS (SELECT unnest([t1, t3, t5, t7, t14, t28]) AS t FROM tg SEMI JOIN dw USING (symbol, end_idx))"""
    one = [f"SELECT '{c}' AS feature, avg(coalesce({c}, 0)) AS mu, stddev_pop(coalesce({c}, 0)) AS sd FROM en" for c in ("r", "close", "volume")] + ["SELECT 'target', avg(t), stddev_pop(t) FROM tt"]
    return f"WITH {base}, al AS ({' UNION ALL '.join(one)}) SELECT feature, {r(5, mu='mu', sigma='CASE WHEN sd < 1e-9 THEN 1 ELSE sd END')} FROM al WHERE mu IS NOT NULL"


def correlations() -> str:
    from tessera.operators.features import FAMILIES

    names = [*FAMILIES["volatility"][1], *FAMILIES["risk"][1]][:30]
    pairs = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'c': " + (f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 ELSE 0.0 END" if a == b else f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) ELSE 0.0 END") + "}" for k, a in enumerate(names) for b in names[k:])
    return f"WITH vo AS ({volatility()}), ri AS ({risk()}), ft AS (SELECT * FROM vo JOIN ri USING (symbol, date)), un AS (SELECT count(*) AS n, unnest([{pairs}]) AS x FROM ft) SELECT x.a AS a, x.b AS b, n, round(x.c + 1e-10, 5) + 0.0 AS corr FROM un"


def filled() -> str:
    return f"""WITH {VS}, kn AS (SELECT ret.symbol, ret.date, CASE WHEN rn % 5 = 0 THEN state END AS known FROM ret LEFT JOIN vs ON vs.symbol = ret.symbol AND vs.date = ret.date)
SELECT symbol, date, known, coalesce(last_value(known IGNORE NULLS) OVER ({O} ROWS UNBOUNDED PRECEDING), first_value(known IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS state FROM kn"""


ORACLE_SQL |= {"dataset_norm_stats": window_stats(), "feature_correlation": correlations(), "forward_filled_labels": filled()}


def fetched() -> str:
    head = window_stats().split(", al AS (")[0]
    stats = " UNION ALL ".join(f"SELECT '{c}' AS f, avg(coalesce({c}, 0)) AS mu, CASE WHEN stddev_pop(coalesce({c}, 0)) < 1e-9 THEN 1 ELSE stddev_pop(coalesce({c}, 0)) END AS sd FROM en" for c in ("r", "close", "volume"))
    z = {c: f"coalesce(greatest(-5.0, least(5.0, ({c}::FLOAT::DOUBLE - (SELECT mu FROM st WHERE f = '{c}')) / (SELECT sd FROM st WHERE f = '{c}'))), 0)" for c in ("r", "close")}
    return f"""{head}, st AS ({stats}), ky AS (SELECT symbol, max(sample) AS sample, max(end_idx) AS end_idx FROM ix WHERE sample < floor(n * 0.75) - 28 GROUP BY symbol),
wi AS (SELECT ky.symbol, sample, rn - 1 - (ky.end_idx - 179) AS place, CASE WHEN r IS NULL THEN 0 ELSE {z['r']} END AS zr, {z['close']} AS zc FROM ky JOIN ret ON ret.symbol = ky.symbol AND rn - 1 BETWEEN ky.end_idx - 179 AND ky.end_idx - 60),
ag AS (SELECT symbol, sample, count(*) AS n, max(zr) FILTER (place = 119) AS last_r, max(zc) FILTER (place = 0) AS first_close, least(5.0, avg(abs(zr))) AS mean_size, least(5.0, stddev_pop(zr)) AS deviation, greatest(-5.0, least(5.0, avg(zr) * 252)) AS annual_mean FROM wi GROUP BY ALL)
SELECT ag.symbol, CAST(ag.sample AS INTEGER) AS sample, CAST(n AS INTEGER) AS n, {r(4, last_r='last_r', first_close='first_close', mean_size='mean_size', deviation='deviation', annual_mean='annual_mean', target_1='coalesce(t1, 0)', target_28='coalesce(t28, 0)')} FROM ag JOIN ky ON ky.symbol = ag.symbol JOIN tg ON tg.symbol = ky.symbol AND tg.end_idx = ky.end_idx"""


ORACLE_SQL |= {"sample_fetch": fetched()}


#: Keyed sources, caches and runs.
ORACLE_SQL |= {
    "panel_cache": f"WITH {BARS} SELECT symbol, count(*) AS n, min(date) AS first, max(date) AS last, {r(4, total='sum(close)')} FROM bars WHERE date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' GROUP BY symbol",
    "panel_discovery": f"WITH {BARS} SELECT symbol, count(*) AS n, count(*) FILTER (date >= DATE '1995-06-17') AS with_volume, {r(4, total='sum(close)')} FROM bars WHERE symbol IN (SELECT symbol FROM bars WHERE date < DATE '1995-06-17' INTERSECT SELECT symbol FROM bars WHERE date >= DATE '1995-06-17' ORDER BY symbol LIMIT 12) GROUP BY symbol",
    "keyed_forecasts": f"WITH {LOGS}, m AS (SELECT symbol, max(i) AS n FROM lx GROUP BY symbol), f AS (SELECT symbol, regr_slope(x, i) AS b, regr_intercept(x, i) AS a FROM lx JOIN m USING (symbol) WHERE i > n - 110 AND i <= n - 10 GROUP BY symbol) SELECT symbol, 'ok' AS status, NULL::VARCHAR AS error, i, {r(predicted='a + b * i')} FROM lx JOIN m USING (symbol) JOIN f USING (symbol) WHERE i > n - 10 AND NOT ends_with(symbol, '7') UNION ALL SELECT DISTINCT symbol, 'failed', 'ValueError: no model for this symbol', NULL, NULL FROM lx WHERE ends_with(symbol, '7')",
}


def compact() -> str:
    frames = (5, 10, 20, 60)
    one = {"step": f"coalesce(close - {lag('close')}, 0)", "ret1": div(f"close - {lag('close')}", lag("close")), **{f"mom_{n}": f"coalesce({chg(n)}, 0)" for n in frames}}
    two = {f"rvol_{n}": f"coalesce({roll('stddev_samp({x})', 'ret1', n, max(2, n // 2))}, 0)" for n in frames}
    two |= {"a20": avg("close", 20, 5), "a50": avg("close", 50, 10), "v20": avg("volume", 20, 5), "up": f"coalesce({avg('greatest(step, 0)', 14, 5)}, 0)", "dn": f"coalesce({avg('greatest(-step, 0)', 14, 5)}, 0)"}
    three = {"b20": backfill("a20"), "b50": backfill("a50"), "bv": backfill("v20")}
    four = {"px_to_ma20": div("close - b20", "b20"), "px_to_ma50": div("close - b50", "b50"), "rsi14": "1 - 1 / (1 + " + div("up", "dn + 1e-9") + ")", "hl_spread": div("high - low", "close"), "close_pos": div("close - low", "greatest(high - low, 1e-6)"), "vol_z": div("volume - bv", "bv + 1e-9"), "dow_sin": "sin(2 * pi() * (isodow(date) - 1) / 5)", "dow_cos": "cos(2 * pi() * (isodow(date) - 1) / 5)"}
    names = ["ret1", *(f"mom_{n}" for n in frames), *(f"rvol_{n}" for n in frames), *four]
    base, source = chain(RET, "ret", one, two, three, four)
    cuts = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in names)
    base += f", nn AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM {source}), cu AS (SELECT symbol, {cuts} FROM nn WHERE rn <= greatest(floor(n * 0.35), 1) GROUP BY symbol)"
    return f"WITH {base} SELECT symbol, date, {', '.join(f'round(greatest(lo_{c}, least(hi_{c}, {c})) + 1e-10, 4) + 0.0 AS {c}' for c in names)} FROM nn JOIN cu USING (symbol)"


ORACLE_SQL |= {"wf_features": compact()}


ORACLE_SQL["stitched_equity"] = f"""WITH {WIN}, l AS (SELECT window_id, date, symbol, CASE WHEN p > (SELECT quantile_cont(p, 0.5) FROM f WHERE horizon = 1) THEN t ELSE -t END AS ls FROM f WHERE horizon = 1),
c AS (SELECT *, sum(ln(1 + greatest(-0.5, least(0.5, ls)))) OVER k AS lq FROM l WINDOW k AS (ORDER BY window_id, date, symbol ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, 1 - exp(lq - max(lq) OVER (ORDER BY window_id, date, symbol ROWS UNBOUNDED PRECEDING)) AS dd FROM c)
SELECT window_id, date, {r(5, log_equity='max_by(lq, symbol)', drawdown='max(dd)')} FROM d GROUP BY window_id, date"""
