"""Rolling aggregates in linear time.

Spark goes through a sliding frame anew for every row. Here a frame of n rows is put together from two runs: rows are
cut into blocks of n, so a frame is the end of one block and the beginning of the next, and running sums, maxima and
moments from both sides of each block give every frame by one addition. Nothing is ever subtracted from a long sum, so
a frame's value depends on its own rows alone, however large the values before it were; moments are taken around a
value of their block and the two sides are merged.

A symbol's history is dealt to chunks of rows, each with as many rows before it as the frames reach back, so groups
are bounded however long a history is and one symbol occupies many tasks. All aggregates that a `Rolling` has
collected, chained ones included, are computed in one pass over one shuffle.

Missing is NULL (NaN counts as NULL): a frame gives a value only if it holds `least` (n by default) non-null rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import BY, backfilled, clip, col, div, ordered

#: Rows of a chunk, without those before it.
CHUNK = 8192
_numbers = itertools.count()


def two_runs(x: np.ndarray, n: int, op: np.ufunc, neutral: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row, op over the frame's rows in the row's own block, and over those in the block before."""
    pad = -len(x) % n
    blocks = np.concatenate([np.full(pad, neutral), x]).reshape(-1, n)
    own = op.accumulate(blocks, axis=1)
    rest = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
    before = np.full_like(own, neutral)
    before[1:, :-1] = rest[:-1, 1:]
    return own.ravel()[pad:], before.ravel()[pad:]


def rolled(x: np.ndarray, n: int, op: np.ufunc, neutral: float) -> np.ndarray:
    """op over the non-missing rows of each frame; `neutral` where there are none."""
    return op(*two_runs(np.where(np.isnan(x), neutral, x), n, op, neutral))


def counted(x: np.ndarray, n: int) -> np.ndarray:
    return rolled((~np.isnan(x)).astype(float), n, np.add, 0.0)


def anchors(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first value of its block, and of the block before (0 where a block has none)."""
    pad = -len(x) % n
    blocks = np.concatenate([np.full(pad, np.nan), x]).reshape(-1, n)
    first = np.nan_to_num(blocks[np.arange(len(blocks)), (~np.isnan(blocks)).argmax(1)])
    return np.repeat(first, n)[pad:], np.repeat(np.concatenate([[0.0], first[:-1]]), n)[pad:]


def co_moments(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(count, mean of x, mean of y, sums of dx*dx, dy*dy and dx*dy about the means) of the rows in which neither is missing."""
    ok = ~(np.isnan(x) | np.isnan(y))
    x, y = np.where(ok, x, np.nan), np.where(ok, y, np.nan)
    ax, ay = anchors(x, n), anchors(y, n)
    dx, dy = np.where(ok, x - ax[0], 0.0), np.where(ok, y - ay[0], 0.0)
    c = two_runs(ok.astype(float), n, np.add, 0.0)
    sx, sy, xx, yy, xy = (two_runs(v, n, np.add, 0.0) for v in (dx, dy, dx * dx, dy * dy, dx * dy))
    sides = []
    for i in (0, 1):
        k = np.maximum(c[i], 1)
        sides.append((c[i], ax[i] + sx[i] / k, ay[i] + sy[i] / k, xx[i] - sx[i] * sx[i] / k, yy[i] - sy[i] * sy[i] / k, xy[i] - sx[i] * sy[i] / k))
    (c1, mx1, my1, xx1, yy1, xy1), (c2, mx2, my2, xx2, yy2, xy2) = sides
    total = np.maximum(c1 + c2, 1)
    gx, gy, w = mx2 - mx1, my2 - my1, c1 * c2 / total
    # Frames of one value have no spread at all, whatever the rest of their block left to rounding.
    flat_x, flat_y = (rolled(v, n, np.maximum, -np.inf) <= rolled(v, n, np.minimum, np.inf) for v in (x, y))
    vx, vy = (np.where(f, 0.0, np.maximum(v, 0.0)) for f, v in ((flat_x, xx1 + xx2 + gx * gx * w), (flat_y, yy1 + yy2 + gy * gy * w)))
    return c1 + c2, (c1 * mx1 + c2 * mx2) / total, (c1 * my1 + c2 * my2) / total, vx, vy, np.where(flat_x | flat_y, 0.0, xy1 + xy2 + gx * gy * w)


def quantiles(x: np.ndarray, n: int, level: float) -> np.ndarray:
    """Interpolated quantile of each frame's non-missing rows; frames are sorted in slices of bounded size."""
    padded, out = np.concatenate([np.full(n - 1, np.nan), x]), np.full(len(x), np.nan)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n)
    whole = counted(x, n) >= n
    at = np.flatnonzero(whole)
    for rows in np.array_split(at, max(1, -(-len(at) * n // (1 << 21)))):
        out[rows] = np.quantile(frames[rows], level, axis=1)
    for i in np.flatnonzero(~whole):  # the first rows of a history, and gaps
        held = frames[i][~np.isnan(frames[i])]
        if len(held):
            out[i] = np.quantile(held, level)
    return out


def lagged(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(0, len(x) - k)]])


def _moment(kind: str, x: np.ndarray, n: int) -> np.ndarray:
    c, mean, _, spread, _, _ = co_moments(x, x, n)
    if kind == "mean":
        return mean
    out = spread / np.where(kind.endswith("samp"), np.where(c > 1, c - 1, np.nan), np.maximum(c, 1))
    return np.sqrt(out) if kind.startswith("std") else out


def _pair(kind: str, y: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    c, _, _, vy, vx, cov = co_moments(y, x, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = {"slope": lambda: cov / vx, "corr": lambda: cov / np.sqrt(vy * vx), "cov_samp": lambda: cov / (c - 1)}[kind]()
    return np.where((c >= n) & np.isfinite(value), value, np.nan)


class Rolling:
    """Collects aggregates over the last n rows of a symbol; `over` computes them and adds them as columns.

    Arguments are columns, expressions over columns, or what this Rolling has given out before."""

    def __init__(self):
        self.inputs: dict[str, tuple[str, Column]] = {}
        self.steps: list[tuple[str, Callable[..., np.ndarray], tuple[str, ...]]] = []
        self.back: dict[str, int] = {}
        self.known: dict[tuple, Column] = {}
        self.given: dict[str, str] = {}

    def _name(self, x: str | Column) -> str:
        shown = str(col(x))
        if shown in self.given:
            return self.given[shown]
        if shown not in self.inputs:
            name = f"_in{next(_numbers)}"
            self.inputs[shown] = (name, col(x).cast("double"))
            self.back[name] = 0
        return self.inputs[shown][0]

    def _add(self, f: Callable[..., np.ndarray], reach: int, key: tuple, *xs: str | Column) -> Column:
        names = tuple(self._name(x) for x in xs)
        key = (*key, *names)
        if key not in self.known:
            name = f"_roll{next(_numbers)}"
            self.steps.append((name, f, names))
            self.back[name] = reach + max(self.back[n] for n in names)
            self.known[key] = F.col(name)
            self.given[str(F.col(name))] = name
        return self.known[key]

    def _framed(self, kind: str, f: Callable[[np.ndarray, int], np.ndarray], x: str | Column, n: int, least: int | None) -> Column:
        need = least or n

        def value(v: np.ndarray) -> np.ndarray:
            return np.where(counted(v, n) >= need, f(v, n), np.nan)

        return self._add(value, n - 1, (kind, n, need), x)

    def mean(self, x, n, least=None):
        return self._framed("mean", lambda v, k: _moment("mean", v, k), x, n, least)

    def std(self, x, n, least=None):
        return self._framed("std", lambda v, k: _moment("std_pop", v, k), x, n, least)

    def std_samp(self, x, n, least=None):
        return self._framed("std_samp", lambda v, k: _moment("std_samp", v, k), x, n, least)

    def var(self, x, n, least=None):
        return self._framed("var", lambda v, k: _moment("var_pop", v, k), x, n, least)

    def total(self, x, n, least=None):
        return self._framed("total", lambda v, k: rolled(v, k, np.add, 0.0), x, n, least)

    def most(self, x, n, least=None):
        return self._framed("most", lambda v, k: rolled(v, k, np.maximum, -np.inf), x, n, least)

    def least(self, x, n, least=None):
        return self._framed("least", lambda v, k: rolled(v, k, np.minimum, np.inf), x, n, least)

    def quantile(self, x, level, n, least=None):
        return self._framed(f"quantile{level}", lambda v, k: quantiles(v, k, level), x, n, least)

    def count(self, x, n):
        return self._add(lambda v: counted(v, n), n - 1, ("count", n), x)

    def lag(self, x, k=1):
        return self._add(lambda v: lagged(v, k), k, ("lag", k), x)

    def slope(self, y, x, n):
        """Slope of y on x over frames in which both are non-null throughout; NULL where x is constant."""
        return self._add(lambda a, b: _pair("slope", a, b, n), n - 1, ("slope", n), y, x)

    def corr(self, y, x, n):
        """Correlation over frames in which both are non-null throughout; NULL where either is constant."""
        return self._add(lambda a, b: _pair("corr", a, b, n), n - 1, ("corr", n), y, x)

    def cov_samp(self, y, x, n):
        return self._add(lambda a, b: _pair("cov_samp", a, b, n), n - 1, ("cov_samp", n), y, x)

    def derived(self, name: str, f: Callable[..., np.ndarray], *xs) -> Column:
        """A value of each row from others of the row (arrays, NaN for NULL); `name` tells functions apart."""
        return self._add(f, 0, ("derived", name), *xs)

    def diff(self, x):
        return self.derived("diff", np.subtract, x, self.lag(x))

    def change(self, k: int, x: str | Column = "close") -> Column:
        """Relative change over k rows; NULL where there is none or it was 0."""
        return div(col(x) - self.lag(x, k), self.lag(x, k), None)

    def power_sums(self, x: str, n: int, least: int) -> tuple[Column, Column, Column, Column]:
        """(count, second, third, fourth central moment sums) of a frame, from its raw power sums; the count is NULL below `least`."""
        c = self.count(x, n)
        s1, s2, s3, s4 = (self.total(F.pow(F.col(x), k), n, 1) for k in (1, 2, 3, 4))
        m = s1 / c
        return F.when(c >= least, c), s2 - c * m * m, s3 - 3 * m * s2 + 2 * c * m * m * m, s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * c * m * m * m * m

    def over(self, df: DataFrame, chunk: int = CHUNK) -> DataFrame:
        """df with the collected columns (and the inputs dropped). Rows are numbered by `rn` where df has it."""
        if not self.steps:
            return df
        reach, names = max(self.back[name] for name, _, _ in self.steps), [name for name, _, _ in self.steps]
        chunk = max(chunk, 4 * reach)
        rows = df.withColumns(dict(self.inputs.values()))
        rows = rows.withColumn("_n", (F.col("rn") if "rn" in df.columns else F.row_number().over(ordered())).cast("long") - 1)
        at = F.floor(F.col("_n") / chunk)
        near_end = F.col("_n") % chunk >= chunk - reach
        dealt = rows.withColumn("_at", F.explode(F.when(near_end, F.array(at, at + 1)).otherwise(F.array(at))))
        steps, inputs, kept = self.steps, [name for name, _ in self.inputs.values()], df.columns
        schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

        def compute(table: pa.Table) -> pa.Table:
            table = table.sort_by("_n")
            values = {n: table.column(n).to_numpy() for n in inputs}
            for name, f, xs in steps:
                values[name] = f(*(values[x] for x in xs))
            own = pc.equal(pc.floor(pc.divide(pc.cast(table.column("_n"), pa.float64()), float(chunk))), pc.cast(table.column("_at"), pa.float64()))
            out = table.select(kept)
            for name in names:
                out = out.append_column(name, pa.array(values[name], pa.float64(), from_pandas=True))
            return out.filter(own)

        return dealt.groupBy(BY, "_at").applyInArrow(compute, schema)


def robust_z(df: DataFrame, which: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds out: tanh of the clipped rolling z-score of a column over n rows (half of them at least)."""
    k = Rolling()
    stats = {f"_m_{o}": k.mean(c, n, n // 2) for o, (c, n) in which.items()} | {f"_s_{o}": k.std_samp(c, n, n // 2) for o, (c, n) in which.items()}
    df = k.over(df).withColumns(stats)
    df = df.withColumns({name: backfilled(name) for name in stats})
    df = df.withColumns({o: F.tanh(clip((F.col(c) - F.col(f"_m_{o}")) / (F.col(f"_s_{o}") + 1e-9), -10, 10)) for o, (c, _) in which.items()})
    return df.drop(*stats)
