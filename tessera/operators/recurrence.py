"""First-order recurrences of each symbol in one grouped pass: EMAs, Wilder's directional index, MACD, PMO, Kalman level.

They have no window-function form. One group is one symbol's history, whose length is bounded by its number of days."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = ["ema_20", "ema_50", "ema_100", "atr_14", "adx14", "plus_di14", "minus_di14", "macd_line", "macd_hist", "pmo", "kalman_filtered_price", "kalman_velocity", "spectral_entropy"]


def kalman(x: np.ndarray, q: float = 0.01, r: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Level with a damped velocity: predict, correct, then let 0.2 of the level's move enter the velocity."""
    level, velocity, spread = float(x[0]) if len(x) else 0.0, 0.0, 1.0
    levels, velocities = np.empty(len(x)), np.empty(len(x))
    for i, seen in enumerate(x.tolist()):
        ahead, spread = level + velocity, spread + q
        gain = spread / (spread + r)
        new, spread = ahead + gain * (seen - ahead), (1 - gain) * spread
        if i:
            velocity = 0.8 * velocity + 0.2 * (new - level)
        level = levels[i] = new
        velocities[i] = velocity
    return levels, velocities


def spectral_entropy(r: np.ndarray, w: int = 60, segment: int = 30) -> np.ndarray:
    """Entropy of the averaged spectrum (Hann segments, half overlapping, mean removed) of each full window."""
    out = np.zeros(len(r))
    if len(r) < w:
        return out
    frames = np.lib.stride_tricks.sliding_window_view(r, w)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    power = np.zeros((len(frames), segment // 2 + 1))
    for at in range(0, w - segment + 1, segment // 2):
        part = frames[:, at : at + segment]
        p = np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * hann, axis=1)) ** 2
        p[:, 1:-1] *= 2
        power += p
    share = power / np.maximum(power.sum(1, keepdims=True), 1e-300)
    found = -(share * np.log(np.maximum(share, 1e-300))).sum(1)
    out[w - 1 :] = np.where(frames.std(1) < 1e-10, 0.0, found)
    return out


def _ewm(x: pd.Series, alpha: float) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False).mean()


def one_symbol(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("date").reset_index(drop=True)
    c, h, low = pdf.close, pdf.high, pdf.low
    ema = {n: _ewm(c, 2 / (n + 1)) for n in (12, 20, 26, 50, 100)}
    before = c.shift(1)
    tr = np.fmax(np.fmax(h - low, (h - before).abs()), (low - before).abs())
    up, down = h - h.shift(1), low.shift(1) - low
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    zero = tr.copy()
    zero.iloc[0] = 0.0
    smooth = _ewm(zero, 1 / 14)
    pdi, mdi = ((_ewm(x, 1 / 14) / smooth).where(smooth > 1e-12, 0.0) for x in (plus, minus))
    both = pdi + mdi
    dx = ((pdi - mdi).abs() / both).where(both > 1e-12, 0.0)
    line = ema[12] - ema[26]
    ppo = (100 * line / ema[26].abs()).where(ema[26].abs() > 1e-12, 0.0)
    level, velocity = kalman(c.to_numpy())
    return pd.DataFrame({
        "symbol": pdf.symbol, "date": pdf.date, "ema_20": ema[20], "ema_50": ema[50], "ema_100": ema[100], "atr_14": _ewm(tr, 1 / 14), "adx14": _ewm(dx, 1 / 14), "plus_di14": pdi, "minus_di14": mdi,
        "macd_line": np.tanh(line / c), "macd_hist": line - _ewm(line, 0.2), "pmo": np.tanh((ppo - _ewm(ppo, 0.2)) / 5), "kalman_filtered_price": np.tanh((c - level) / np.maximum(np.abs(level), 1e-12)),
        "kalman_velocity": np.tanh(100 * velocity), "spectral_entropy": spectral_entropy(pdf.r.fillna(0.0).to_numpy(float)),
    })


def recurrences(panel: DataFrame) -> DataFrame:
    """(symbol, date, COLUMNS) of a panel with r."""
    schema = "symbol string, date date, " + ", ".join(f"{c} double" for c in COLUMNS)
    return panel.select("symbol", "date", "open", "high", "low", "close", "r").groupBy("symbol").applyInPandas(one_symbol, schema)


def cusum(x: np.ndarray, threshold: float = 5.0, drift: float = 0.0) -> list[int]:
    """Places where a two-sided cumulative sum of standardised values passes the threshold; it starts afresh there."""
    z = (x - x.mean()) / ((x.std(ddof=1) if len(x) > 1 else 0.0) + 1e-12) if len(x) else x
    up = down = 0.0
    out = []
    for i, v in enumerate(z.tolist()):
        up, down = max(0.0, up + v - drift), max(0.0, down - v - drift)
        if up > threshold or down > threshold:
            out.append(i)
            up = down = 0.0
    return out
