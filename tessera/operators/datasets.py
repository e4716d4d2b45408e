"""What a training set needs from a panel: samples of windows and their statistics, labels carried forward, correlations of features.

Windows are never laid out for this: a row counts as often as sampled windows cover it. Histories are dealt to parts of
consecutive rows and what must run on goes from part to part as one value, so a long history is never one task's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import BY

#: Windows of a sample, and the rows of a window that the encoder sees.
SAMPLE, ENCODED = 8000, 120
#: Consecutive rows of a history that one task takes in order.
PART = 65_536


def sampled_windows(index: DataFrame, most: int = SAMPLE, seed: int = 0) -> DataFrame:
    """`most` rows of a window index (symbol, sample, ...), drawn without replacement: those with the smallest digests of
    (seed, symbol, sample). The draw is the same however rows are dealt; each task hands on its own smallest only."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(BY), F.col("sample").cast("string")).cast("binary"))
    return index.withColumn("_digest", digest).orderBy("_digest", BY, "sample").limit(most).drop("_digest")


def running_total(rows: DataFrame, x: str, at: str, name: str, part: int = PART) -> DataFrame:
    """Adds the sum of x over the rows of a symbol up to this one in order of `at` (numbers from 0): within parts, and over parts before."""
    dealt = rows.withColumn("_part", F.floor(F.col(at) / part))
    before = Window.partitionBy(BY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    carried = dealt.groupBy(BY, "_part").agg(F.sum(x).alias("_s")).select(BY, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carried"))
    within = F.sum(x).over(Window.partitionBy(BY, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(carried, [BY, "_part"]).withColumn(name, F.col("_carried") + within).drop("_part", "_carried")


def coverage(rows: DataFrame, windows: DataFrame, length: int, encoded: int, at: str = "idx", part: int = PART) -> DataFrame:
    """Adds covered: in how many windows (symbol, end_idx; `length` rows) a row is among the first `encoded`.

    A window adds one at its first row and takes it away behind its last encoded one; the running total is the coverage."""
    start = F.col("end_idx") - (length - 1)
    edges = windows.select(BY, F.explode(F.array(F.struct(start.alias("_at"), F.lit(1).alias("_e")), F.struct((start + encoded).alias("_at"), F.lit(-1).alias("_e")))).alias("x"))
    edges = edges.groupBy(BY, F.col("x._at").cast("long").alias(at)).agg(F.sum("x._e").alias("_e"))
    marked = rows.join(edges, [BY, at], "left").withColumn("_e", F.coalesce("_e", F.lit(0)))
    return running_total(marked, "_e", at, "covered", part).drop("_e")


def dataset_norm_stats(rows: DataFrame, windows: DataFrame, targets: DataFrame, names: list[str], length: int, encoded: int = ENCODED, part: int = PART) -> DataFrame:
    """(feature, mu, sigma) of the encoded rows of the given windows, each as often as windows hold it, and of their targets.

    rows: (symbol, idx, features), idx from 0; a missing feature counts as 0. targets: (symbol, end_idx, target); missing ones do not count.
    A deviation of 0 counts as 1. Sums are taken about the features' plain means, so large levels do not cancel."""
    held = coverage(rows.select(BY, "idx", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names)), windows, length, encoded, part=part).where("covered > 0")
    centre = held.agg(*(F.avg(c).alias(f"_c_{c}") for c in names))
    w = F.col("covered")
    sums = held.join(F.broadcast(centre)).agg(  # one row
        F.sum(w).alias("_w"), *(F.first(f"_c_{c}").alias(f"_c_{c}") for c in names), *(F.sum(w * (F.col(c) - F.col(f"_c_{c}"))).alias(f"_s_{c}") for c in names), *(F.sum(w * (F.col(c) - F.col(f"_c_{c}")) * (F.col(c) - F.col(f"_c_{c}"))).alias(f"_q_{c}") for c in names)
    )

    def entry(c: str) -> Column:
        shift = F.col(f"_s_{c}") / F.col("_w")
        sd = F.sqrt(F.greatest(F.col(f"_q_{c}") / F.col("_w") - shift * shift, F.lit(0.0)))
        return F.struct(F.lit(c).alias("feature"), (F.col(f"_c_{c}") + shift).alias("mu"), F.when(sd < 1e-9, F.lit(1.0)).otherwise(sd).alias("sigma"))

    features = sums.where("_w is not null").select(F.inline(F.array(*map(entry, names))))
    of = targets.join(windows.select(BY, "end_idx"), [BY, "end_idx"], "left_semi").agg(F.avg("target").alias("mu"), F.stddev_pop("target").alias("sigma")).where("mu is not null")
    return features.unionByName(of.select(F.lit("target").alias("feature"), "mu", F.when(F.col("sigma") < 1e-9, F.lit(1.0)).otherwise(F.col("sigma")).alias("sigma")))


def filled_forward(rows: DataFrame, x: str, at: str, name: str | None = None, part: int = PART) -> DataFrame:
    """Adds the last known x of a symbol up to this row in order of `at` (numbers from 0); rows before the first known one take that one.

    A part's last known value goes to the parts behind it, so a symbol with most of the rows is many tasks' work."""
    dealt = rows.withColumn("_part", F.floor(F.col(at) / part))
    known = F.col(x).isNotNull()
    ends = dealt.groupBy(BY, "_part").agg(F.max_by(x, F.when(known, F.col(at))).alias("_last"), F.min_by(x, F.when(known, F.col(at))).alias("_first"))
    by_part = Window.partitionBy(BY).orderBy("_part")  # a row for each part
    carried = ends.select(BY, "_part", F.last("_last", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"), F.first("_first", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_head"))
    within = F.last(x, ignorenulls=True).over(Window.partitionBy(BY, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(carried, [BY, "_part"]).withColumn(name or x, F.coalesce(within, "_carried", "_head")).drop("_part", "_carried", "_head")


def correlation_matrix(rows: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, n, corr) for all pairs a <= b of features, over the rows in which no feature is missing; 0 where one is constant.

    The first pass takes means (of each feature's own rows, as a shift against cancellation), the second the upper triangle of products about them: a task multiplies whole batches and hands
    on one number for each pair, which are summed before and after the shuffle. Nothing grows with the rows."""
    wide = rows.select(*(F.col(c).cast("double").alias(c) for c in names))
    centre = np.nan_to_num(np.array([m or 0.0 for m in wide.agg(*(F.avg(c) for c in names)).first()]))
    i, j = np.triu_indices(len(names))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, sums = 0, np.zeros((len(names), len(names))), np.zeros(len(names))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float) - centre
            x = x[np.isfinite(x).all(1)]
            n, total, sums = n + len(x), total + x.T @ x, sums + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n), pa.int64()), *(pa.array(v) for v in (total[i, j], sums[i], sums[j]))], names=["i", "j", "n", "p", "si", "sj"])

    pairs = wide.mapInArrow(products, "i int, j int, n long, p double, si double, sj double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "p", "si", "sj")))
    cov = pairs.select("i", "j", "n", (F.col("p") - F.col("si") * F.col("sj") / F.col("n")).alias("c"))
    var = cov.where("i = j").select(F.col("i").alias("k"), F.col("c").alias("v"))
    both = cov.join(F.broadcast(var.toDF("i", "vi")), "i").join(F.broadcast(var.toDF("j", "vj")), "j")  # a row for each feature
    label = F.array(*map(F.lit, names))
    scale = F.sqrt(F.col("vi") * F.col("vj"))
    value = F.when((F.col("i") == F.col("j")) & (scale > 0), F.lit(1.0)).when(scale > 0, F.col("c") / scale).otherwise(0.0)
    return both.select(F.get(label, F.col("i")).alias("a"), F.get(label, F.col("j")).alias("b"), "n", value.alias("corr"))
