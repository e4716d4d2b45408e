"""Column builders for ordered panels (symbol, date): rolling frames, guarded division, ranks.

Missing is NULL throughout: a frame gives a value only if it holds `n` non-null rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12
#: Far above the noise of summation order, far below a place that is kept: decides ties alike everywhere.
NUDGE = 1e-10
BY, ORDER = "symbol", "date"


def ordered() -> WindowSpec:
    return Window.partitionBy(BY).orderBy(ORDER)


def frame(n: int) -> WindowSpec:
    return ordered().rowsBetween(1 - n, 0)


def running() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(ordered())


def roll(f: Callable[[Column], Column], x: str | Column, n: int, least: int | None = None) -> Column:
    """f over the last n rows, NULL unless `least` (n by default) of them are non-null."""
    x = col(x)
    return F.when(F.count(x).over(frame(n)) >= (least or n), f(x).over(frame(n)))


def mean(x, n, least=None):
    return roll(F.avg, x, n, least)


def std(x, n):
    return roll(F.stddev_pop, x, n)


def most(x, n):
    return roll(F.max, x, n)


def least(x, n):
    return roll(F.min, x, n)


def total(x, n):
    return roll(F.sum, x, n)


def pair(f: Callable[[Column, Column], Column], y: str | Column, x: str | Column, n: int) -> Column:
    """A two-column aggregate over frames in which both are non-null throughout."""
    y, x = col(y), col(x)
    return F.when(F.count(y + x).over(frame(n)) >= n, f(y, x).over(frame(n)))


def corr(y: str | Column, x: str | Column, over: WindowSpec | None = None) -> Column:
    """Correlation of the rows in which both are non-null, as an aggregate or over a frame.

    NULL where either is constant: corr() divides by zero there, and a guard around it does not keep a frame from being evaluated."""
    y, x = F.when(col(x).isNotNull(), col(y)), F.when(col(y).isNotNull(), col(x))
    cov, vy, vx = (a.over(over) if over else a for a in (F.covar_pop(y, x), F.var_pop(y), F.var_pop(x)))
    return F.try_divide(cov, F.sqrt(vy * vx))


def pair_corr(y: str | Column, x: str | Column, n: int) -> Column:
    """`corr` over frames in which both are non-null throughout."""
    return F.when(F.count(col(y) + col(x)).over(frame(n)) >= n, corr(y, x, frame(n)))


# Coefficients of Hart's rational approximation of the lower normal tail, below 1e-14 off.
_TAIL_UP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_DOWN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function; beyond 7 deviations 0 or 1."""
    a = F.least(F.abs(x), F.lit(7.0))
    up, down = (reduce(lambda y, c: y * a + c, coef[1:], F.lit(coef[0])) for coef in (_TAIL_UP, _TAIL_DOWN))
    tail = F.when(F.abs(x) >= 7, F.lit(0.0)).otherwise(F.exp(-a * a / 2) * up / down)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def div(a: str | Column, b: str | Column, fill: float | None = 0.0) -> Column:
    """a / b where |b| exceeds EPS, else `fill`."""
    return F.when(F.abs(col(b)) > EPS, col(a) / col(b)).otherwise(F.lit(fill).cast("double"))


def clip(x: str | Column, lo: float, hi: float) -> Column:
    return F.when(col(x).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col(x))))  # the two skip NULLs


def backfilled(x: str) -> Column:
    """Missing values take the next known one, then the last known one, then 0."""
    # Backwards, as a frame up to the end of the history would be gone through again for each row.
    back = Window.partitionBy(BY).orderBy(F.desc(ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(x, ignorenulls=True).over(back), F.last(x, ignorenulls=True).over(running()), F.lit(0.0))


def part_count(df: DataFrame, least: int = 64, most: int = 4096) -> int:
    """Parts for `in_parts`: as many as the session deals a shuffle to, which is sized to the data (plans know no sizes here)."""
    return min(most, max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def in_parts(df: DataFrame, by: tuple[str, ...], order: str, parts: int | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds _part, the place of a row's `order` among some quantiles of its group, and _before, the rows of the group in lower parts.

    A group may hold most rows (there are but few horizons): what has to run in order runs inside parts, and goes on from
    prefix sums of the parts, here of their row count and of the columns `sums`. There are as many parts as a shuffle has tasks. Equal
    values are in one part: where a value may be most of a group, `cells` comes first. Cuts and sums have one row for each
    group and part; groups are few by contract and are broadcast."""
    parts = parts or part_count(df)
    number = F.unix_date(F.col(order)) if dict(df.dtypes)[order] == "date" else F.col(order)
    cuts = df.groupBy(*by).agg(F.percentile_approx(number, F.array(*(F.lit(i / parts) for i in range(1, parts))), max(2000, 20 * parts)).alias("_cuts"))
    rows = df.join(F.broadcast(cuts), list(by)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < number))).drop("_cuts")
    lower = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = {"_before": F.count(F.lit(1)), **{f"_before_{k}": F.sum(x) for k, x in (sums or {}).items()}}
    ahead = rows.groupBy(*by, "_part").agg(*(x.alias(k) for k, x in named.items())).select(*by, "_part", *(F.coalesce(F.sum(k).over(lower), F.lit(0)).alias(k) for k in named))
    return rows.join(F.broadcast(ahead), [*by, "_part"])


def cells(df: DataFrame, by: tuple[str, ...], x: str, weight: Column | None = None) -> DataFrame:
    """(by, x, _w, _upto): for each distinct value of a group its weight (rows, by default) and the weight of all values up to it.

    Rows of one value are put together before the shuffle, however many they are, and no task holds a whole group."""
    merged = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_w"))
    parts = in_parts(merged, by, x, sums={"w": F.col("_w")})
    run = F.sum("_w").over(Window.partitionBy(*by, "_part").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    return parts.select(*by, x, "_w", (F.col("_before_w") + run).alias("_upto"))


def group_row(df: DataFrame, by: tuple[str, ...], *order: str, name: str = "_row") -> DataFrame:
    """Adds a row's number in its group, from 1, in the given order; no task sorts a whole group."""
    made = in_parts(df, by, order[0])
    return made.withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).drop("_part", "_before")


def group_rank(df: DataFrame, by: tuple[str, ...], x: str, name: str) -> DataFrame:
    """Adds the rank of x in its group, ties averaged; no task sorts a whole group, and equal values meet only in a join that Spark can split."""
    ranks = cells(df, by, x).select(*by, x, (F.col("_upto") - (F.col("_w") - 1) / 2.0).alias(name))
    return df.join(ranks, [*by, x])


def group_quantiles(df: DataFrame, by: tuple[str, ...], x: str, levels: dict[str, float | Column]) -> DataFrame:
    """(by, n, one column a level): exact interpolated quantiles of x; a level may be a column of n."""
    n = df.groupBy(*by).agg(F.count(x).alias("n"))
    rows = cells(df, by, x).join(F.broadcast(n), list(by))  # one row a group

    def weight(level: float | Column) -> Column:
        at = (level if isinstance(level, Column) else F.lit(level)) * (F.col("n") - 1) + 1
        held = lambda row: (row > F.col("_upto") - F.col("_w")) & (row <= F.col("_upto"))
        return F.when(held(F.floor(at)), 1 - (at - F.floor(at))).otherwise(0.0) + F.when(held(F.floor(at) + 1), at - F.floor(at)).otherwise(0.0)

    return rows.groupBy(*by).agg(F.first("n").alias("n"), *(F.sum(F.col(x) * weight(level)).alias(k) for k, level in levels.items()))


def weighted_quantiles(df: DataFrame, by: tuple[str, ...], x: str, weight: str, levels: dict[str, float]) -> DataFrame:
    """(by, one column a level): the least value up to which a level's share of the group's weight lies.

    Exact for any weights (none below 0); rows of weight 0 or null do not count."""
    rows = cells(df.where(F.col(weight) > 0), by, x, F.col(weight))
    whole = rows.groupBy(*by).agg(F.max("_upto").alias("_whole"))
    # Sums of shares may fall short of a level by rounding.
    return rows.join(whole, list(by)).groupBy(*by).agg(*(F.min(F.when(F.col("_upto") >= F.col("_whole") * F.lit(q - 1e-12), F.col(x))).alias(k) for k, q in levels.items()))


def average_rank(x: str | Column, *by: str) -> Column:
    """Rank with ties averaged, NULLs unranked."""
    x = col(x)
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0)


def tidy(df: DataFrame, names: list[str], places: int = 4) -> DataFrame:
    """(symbol, date) and features: missing is 0, rounded with ties (to within NUDGE) upwards, no negative zero."""
    return df.select(BY, ORDER, *((F.round(F.coalesce(F.col(c), F.lit(0.0)) + NUDGE, places) + F.lit(0.0)).alias(c) for c in names))


def clipped_tails(df: DataFrame, names: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clips each feature at quantiles of its symbol's whole history (not causal)."""
    cuts = df.groupBy(BY).agg(*(F.percentile(c, F.array(F.lit(lo), F.lit(hi))).alias(f"_q_{c}") for c in names))
    return df.join(cuts, BY).select(BY, ORDER, *(F.greatest(F.col(f"_q_{c}")[0], F.least(F.col(f"_q_{c}")[1], F.col(c))).alias(c) for c in names))
