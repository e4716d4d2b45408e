"""Quality rules: base statistics of a text, and robust multivariate outliers per language and source.

The statistics of every document become a small transformed vector. For each (lang, source) group a
minimum-covariance-determinant estimate is found by concentration steps, each of them a distributed
aggregation over the group: distances under the present centre and covariance, sums by bins of distance,
then mean and covariance of the bins that hold the `support` nearest rows. Every group has three deterministic starts, all
from the standardised rows (medians and median absolute deviations): their diagonal, the covariance of their
hyperbolic tangents, and that of their spatial signs. After two steps the start with the smallest determinant
goes on, until the logarithm of the group's determinant falls by less than `REST`; what a group comes to does not
depend on other groups.

No group is ever gathered in one task: sums combine before the shuffle, and models (one row a group) are
broadcast to their rows up to `FEW_GROUPS` groups, beyond them joined by group and one of `SALTS` numbers, so
that a source that holds a third of all rows is split either way.

Null texts count as empty and fail the base rule; null lang or source form their own group; a group
that is too small for its own covariance leans on `FLOOR` (`prior_rows` rows' worth of it); ties and
repeated rows get equal verdicts; a very long text is held as its words, some 150 bytes for each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches, released, table, write_shared

SYMBOLS = b"#*$%&|<>"
#: Least number of words and largest percentage of repeated words of the base rule.
MIN_WORDS, MAX_REPEAT_PCT = 10, 20
FEATURES = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeat")
#: Standard deviations that any group is granted, so that a constant statistic does not make noise an outlier.
FLOOR = (1.5, 0.35, 0.06, 0.35, 0.35)
#: Squared distance beyond which a text is rejected: the chi-square quantile at 1 - 1e-11, 5 degrees of freedom.
CUTOFF = 60.0
#: Chi-square median with 5 degrees of freedom.
CHI2_MEDIAN = 4.351

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by a window of `width` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    code = ids[:n]
    for k in range(1, width):  # windows of k + 1 words, numbered from those of k words
        code = np.unique(code * len(number) + ids[k : k + n], return_inverse=True)[1]
    place = np.flatnonzero(np.bincount(code)[code] > 1)
    return int(np.minimum(np.diff(place, append=place[-1] + width), width).sum()) if len(place) else 0


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def with_text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the statistics of `text`."""
    others = [c for c in keep if c != "text"]
    keep = [*others, *["text"] * (len(others) < len(keep))]
    fields = [docs.schema[c] for c in keep]
    names = [x.split()[0] for x in _STATS.split(", ")]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found = [text_stats(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            cols = list(zip(*found, strict=True)) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x, pa.int64()) for x in cols)], names=[*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), _STATS])
    arrow_batches(docs.sparkSession)
    return docs.select(*others, F.col("text").cast("string").alias("text")).mapInArrow(stats, schema)


def transformed(stats: DataFrame) -> DataFrame:
    """Adds the vector: rates are shrunk towards a prior of some words, so that short texts do not scatter."""
    return stats.withColumns(
        {
            "x_words": F.log1p("n_words"),
            "x_length": (F.col("word_chars") + 300.0) / (F.col("n_words") + 50.0),
            "x_symbols": F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 50.0)),
            "x_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5.0)),
            "x_repeat": F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 50.0)),
        }
    )


def _model_rows(prior_rows: int):
    """Turns moment rows (one for each group and start) into centre, inverse covariance and logarithm of the determinant."""
    p = len(FEATURES)
    floor = np.diag(np.square(FLOOR))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mu, inv, det = [], [], []
            for n, m, s, scale in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "s", "scale")), strict=True):
                mean = np.array(m, float)
                cov = (np.array(s, float).reshape(p, p) - np.outer(mean, mean)) * scale
                cov = (n * cov + prior_rows * floor) / (n + prior_rows) + 0.05 * floor
                mu.append(m)
                inv.append(np.linalg.inv(cov).ravel())
                det.append(float(np.linalg.slogdet(cov)[1]))
            cols = [*(batch.column(c) for c in KEYS), pa.array(mu, pa.list_(pa.float64())), pa.array(inv, pa.list_(pa.float64())), pa.array(det, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*KEYS, "mu", "inv", "det"])

    return solve


KEYS = ["grp_lang", "grp_source", "start"]
_MODEL = "grp_lang string, grp_source string, start int, mu array<double>, inv array<double>, det double"
#: Groups whose models are broadcast to their rows, at most; parts that a group's rows are dealt into to meet its model where there are more.
FEW_GROUPS, SALTS = 5_000, 32
#: Bins of squared distance in an octave, and the least distance told from 0 (its inverse: the greatest): some 10,000 bins a group at most.
BINS, LEAST_D2 = 128, 1e-12
#: Fall of the logarithm of a determinant below which a group has come to rest.
REST = 1e-3


def _distance() -> F.Column:
    p = len(FEATURES)
    diff = [F.col(f) - F.col("mu")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            total = total + diff[i] * diff[j] * F.col("inv")[i * p + j]
    return total


def met(rows: DataFrame, groups: DataFrame, few: bool, *keys: str, how: str = "inner") -> DataFrame:
    """Rows (with a salt) and the columns of their group, which has one row a group and start; few: at most FEW_GROUPS groups."""
    if few:
        return rows.join(F.broadcast(groups), list(keys), how)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, [*keys, "salt"], how)


def _start_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns medians, deviations and the two matrices of each group into the models of its starts."""
    p = len(FEATURES)
    for batch in batches:
        out = []
        for lang, source, m, d, *shapes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k, x in enumerate((np.eye(p), *(np.array(x, float).reshape(p, p) for x in shapes))):
                side = np.sqrt(np.maximum(np.diag(x), 1e-12))
                r = x / np.outer(side, side)
                np.fill_diagonal(r, 1.0)
                cov = r * np.outer(d, d) + 0.05 * np.diag(np.square(FLOOR))
                out.append((lang, source, k, m, np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*KEYS, "mu", "inv", "det"])


def robust_starts(rows: DataFrame, med: DataFrame, few: bool) -> DataFrame:
    """Rows of `_MODEL`: the three starts of each group of `med` (its medians m)."""
    p, keys = len(FEATURES), KEYS[:2]
    off = met(rows, med, few, *keys).groupBy(*keys).agg(
        F.first("m").alias("m"), F.array(*(F.percentile_approx(F.abs(F.col(f) - F.col("m")[i]), 0.5, 1000) * 1.4826 for i, f in enumerate(FEATURES))).alias("d")
    )
    # A statistic that is constant in most of a group's rows is measured in the deviation that any group is granted.
    wide = [F.greatest(F.col("d")[i], F.lit(0.1 * f)) for i, f in enumerate(FLOOR)]
    z = [(F.col(f) - F.col("m")[i]) / wide[i] for i, f in enumerate(FEATURES)]
    ranked = met(rows, off, few, *keys).select(*keys, "m", "d", F.array(*map(F.tanh, z)).alias("t"), F.array(*z).alias("z"))
    length = F.greatest(F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    ranked = ranked.withColumn("u", F.transform("z", lambda x: x / length))
    def second(c: str) -> F.Column:
        return F.array(*(F.avg(F.col(c)[i] * F.col(c)[j]) for i in range(p) for j in range(p)))
    sums = ranked.groupBy(*keys).agg(F.first("m").alias("m"), F.first("d").alias("d"), second("t").alias("tt"), second("u").alias("uu"))
    return sums.select(*keys, "m", F.array(*wide).alias("d"), "tt", "uu").mapInArrow(_start_rows, _MODEL)


def concentrated(rows: DataFrame, model: DataFrame, few: bool, support: float, prior_rows: int) -> DataFrame:
    """One concentration step of every group and start in `model`: the moments of the `support` nearest rows under it.

    Rows are summed by bins of their distance first, which combines before the shuffle; a group's bins are then taken from the
    nearest on. Of the bin in which the last row falls the share that is still wanted counts, so that equal rows weigh the same."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = {f"m{i}": F.sum(f) for i, f in enumerate(FEATURES)} | {f"s{i}_{j}": F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs}
    far = F.floor(F.log2(F.least(F.greatest(_distance(), F.lit(LEAST_D2)), F.lit(1 / LEAST_D2))) * BINS)
    near = met(rows, model, few, *KEYS).select(*KEYS, far.alias("bin"), *FEATURES)
    bins = near.groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in sums.items()))
    group = Window.partitionBy(*KEYS)
    upto = F.sum("rows").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = F.ceil(F.sum("rows").over(group) * support) - (upto - F.col("rows"))
    taken = bins.withColumn("share", F.least(F.lit(1.0), wanted / F.col("rows"))).where("share > 0")
    n = F.sum(F.col("share") * F.col("rows"))
    mean = {name: F.sum(F.col("share") * F.col(name)) / n for name in sums}
    second = [mean[f"s{min(i, j)}_{max(i, j)}"] for i in range(len(FEATURES)) for j in range(len(FEATURES))]
    summed = taken.groupBy(*KEYS).agg(n.alias("n"), F.array(*(mean[f"m{i}"] for i in range(len(FEATURES)))).alias("m"), F.array(*second).alias("s"))
    return summed.withColumn("scale", F.lit(1.0 / support)).mapInArrow(_model_rows(prior_rows), _MODEL)


def robust_verdicts(stats: DataFrame, support: float = 0.75, prior_rows: int = 20, cutoff: float = CUTOFF) -> DataFrame:
    """Adds base_failed, distance2 (null if base_failed) and kept to a table with statistics, lang and source."""
    full = transformed(stats).withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")),
            "grp_lang": F.coalesce(F.col("lang").cast("string"), F.lit("\x00")),
            "grp_source": F.coalesce(F.col("source").cast("string"), F.lit("\x00")),
            "salt": F.pmod(F.xxhash64(*(["doc_id"] if "doc_id" in stats.columns else stats.columns)), F.lit(SALTS)).cast("int"),
        }
    )
    rows = full.where(~F.col("base_failed")).select(*KEYS[:2], "salt", *FEATURES)
    three = rows.withColumn("start", F.explode(F.array(*map(F.lit, range(3)))))
    med = write_shared(rows.groupBy(*KEYS[:2]).agg(F.array(*(F.percentile_approx(f, 0.5, 1000) for f in FEATURES)).alias("m")), "mcd-medians")
    few = med.count() <= FEW_GROUPS
    model = write_shared(robust_starts(rows, med, few), "mcd-starts")
    for _ in range(2):
        model = write_shared(concentrated(three, model, few, support, prior_rows), "mcd-three")
    # The start of the smallest determinant, ties to the first; one row a group.
    best = model.groupBy(*KEYS[:2]).agg(F.min_by(F.struct("start", "mu", "inv", "det"), F.struct("det", "start")).alias("x"))
    one = rows.withColumn("start", F.lit(0))
    model, settled = write_shared(best.select(*KEYS[:2], F.lit(0).alias("start"), "x.mu", "x.inv", "x.det"), "mcd-best"), []
    while not model.isEmpty():  # a determinant falls at each step, and the prior keeps it from falling for ever
        new = concentrated(one, model, few, support, prior_rows)
        both = model.select(*KEYS, F.struct("mu", "inv", "det").alias("old")).join(new.select(*KEYS, F.struct("mu", "inv", "det").alias("new")), KEYS)
        lower, falls = F.col("new.det") < F.col("old.det"), F.col("new.det") < F.col("old.det") - REST
        both = write_shared(both.select(*KEYS, F.when(lower, F.col("new")).otherwise(F.col("old")).alias("x"), falls.alias("falls")).select(*KEYS, "x.*", "falls"), "mcd-kept")
        settled.append(both.where(~F.col("falls")).drop("falls"))
        model = both.where("falls").drop("falls")  # a group that has come to rest takes no part in the steps of others
    model = write_shared(reduce(DataFrame.unionByName, settled), "mcd-models") if settled else model
    model = model.select(*KEYS[:2], "mu", "inv")
    near = met(rows, model, few, *KEYS[:2]).withColumn("d2", _distance())
    # Consistency: the median distance of a clean group is that of the chi-square law; groups are never tightened.
    scale = near.groupBy(*KEYS[:2]).agg(F.greatest(F.lit(1.0), F.percentile_approx("d2", 0.5, 1000) / CHI2_MEDIAN).alias("factor"))
    judged = met(full, write_shared(model.join(scale, KEYS[:2]), "mcd-final"), few, *KEYS[:2], how="left").withColumn("distance2", F.when(~F.col("base_failed"), _distance() / F.col("factor")))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))).drop(*KEYS[:2], "salt", *FEATURES, "mu", "inv", "factor")


def quality_rules(docs: DataFrame, keep: list[str] | None = None, **how) -> DataFrame:
    """Statistics and verdict of each document (doc_id, lang, source, text)."""
    names = list(dict.fromkeys(["doc_id", "lang", "source", *(keep or [])]))
    return robust_verdicts(write_shared(with_text_stats(docs, names), "text-stats"), **how)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
