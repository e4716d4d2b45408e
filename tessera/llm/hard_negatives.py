"""Hard negatives by branch and bound over ball trees.

For an anchor and one of its positives (the nearest rows of its label, by integer inner product), hard negatives
are the best rows of other labels whose product with the anchor lies within a share of the positive's. Rows are
dealt to shards by a hash of their id, whatever their label or vector, so no label, copy or cluster makes a shard
large. A shard's rows and then all anchors, in batches, stream through one task: the task builds ball trees over the
rows (one for each label with rows enough, one for all others) and walks them with a whole batch of anchors. A node
bounds the products of its rows both above and below. For each anchor and score window it is left out if it lies
wholly above or below the window, or strictly beneath the k-th best found so far; rows on a par with the k-th are
still looked at, so ties by id are exact. Bounds are widened for rounding, products are exact: nothing is lost.
Windows keep the k best of each shard's k, first for positives, then with the windows that these give.

Rows with a null id, label or vector or with a null or non-finite component take no part, nor do vectors of
another length than most have (of equally frequent lengths the smaller counts). Rows that repeat an id are versions
of one row, of which the smallest by (label, components) counts. Ties go to the smaller id; an anchor without
others of its label has no positives and gives no rows, nor does a window that no row meets (a negative positive
score leaves none); an empty table gives an empty result; extra columns are ignored. Components so large that a
product could reach 2^44 end the query with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.balltree import BallTree, ball_tree
from tessera.llm.common import arrow_batches, shuffle_width, table, write_shared

#: Rows of a shard at most, and at least where there are enough rows for all tasks; rows of a leaf.
SHARD_ROWS, LEAST_SHARD_ROWS, LEAF = 65_536, 4_096, 256
#: Anchors that walk a tree together.
ASKED = 256
SCALE = 256
#: Lowest possible and highest possible score of a window without bounds.
LOW, HIGH = -(1 << 62), 1 << 62
#: Stands for a key that is not there; scores stay below 2^44, and keys far above this.
NOTHING, MOST_SCORE = -(1 << 62), float(1 << 44)
_FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def labelled_vectors(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, v) of the rows that take part, one for each id, v as array<double>."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))  # combines before the shuffle
    return rows.select("id", "r.label", "r.v")


def integers(x: np.ndarray, scale: int, most: float) -> np.ndarray:
    """floor(scale * x), held as float64, in which products and sums up to 2^53 are exact."""
    out = np.floor(scale * x)
    if out.size and np.abs(out).max() ** 2 * max(1, x.shape[1]) >= most:
        raise ValueError("components are too large for exact scores")
    return out


class Forest:
    """Ball trees of a shard: one for each label of at least `leaf` rows, one for the rows of all other labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int):
        by = np.argsort(ids, kind="stable")  # ids ascend: a row's place decides ties
        self.ids, self.labels, self.x, self.n = ids[by], labels[by], x[by], len(ids)
        names, of, n = np.unique(self.labels, return_inverse=True, return_counts=True)
        groups = [(int(k), np.flatnonzero(of == i)) for i, k in enumerate(names) if n[i] >= leaf]
        rest = np.flatnonzero(n[of] < leaf)
        self.trees: list[tuple[int | None, np.ndarray, np.ndarray, BallTree]] = []
        for label, rows in [*groups, (None, rest)] if len(rest) else groups:
            tree = ball_tree(self.x[rows], leaf)
            rows = rows[tree.order]
            self.trees.append((label, rows, self.x[rows], tree))

    def search(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> np.ndarray:
        """Keys of the k best rows for each query and window (queries x windows x k), best first; NOTHING where there are fewer.

        A key is score * n + (n - 1 - place), which orders rows by score, then by smaller id."""
        best, norm = np.full((*lo.shape, k), NOTHING), np.sqrt((q**2).sum(1))
        self.looked = 0

        def wanted(tree: BallTree, node: int, asks: np.ndarray) -> tuple[np.ndarray, float]:
            below, above = tree.product_bounds(node, q[asks], norm[asks])
            kth = best[asks, :, -1]
            floor_ = np.where(kth == NOTHING, lo[asks], np.maximum(lo[asks], kth // self.n))
            return ((above[:, None] >= floor_) & (below[:, None] <= hi[asks])).any(1), float(above.mean())

        def leaf(rows: np.ndarray, x: np.ndarray, asks: np.ndarray) -> None:
            score = np.rint(q[asks] @ x.T).astype(np.int64)
            alike = labels[asks][:, None] == self.labels[rows][None, :]
            ok = (alike if same else ~alike) & (ids[asks][:, None] != self.ids[rows][None, :])
            key = score * self.n + (self.n - 1 - rows)[None, :]
            self.looked += score.size
            for w in range(lo.shape[1]):
                held = best[asks, w]
                fits = ok & (score >= lo[asks, w][:, None]) & (score <= hi[asks, w][:, None]) & (key > held[:, -1:])
                some = fits.any(1)
                if some.any():
                    both = np.concatenate([held[some], np.where(fits[some], key[some], NOTHING)], axis=1)
                    best[asks[some], w] = -np.sort(-np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)

        def walk(tree: BallTree, rows: np.ndarray, x: np.ndarray, node: int, asks: np.ndarray) -> None:
            found, _ = wanted(tree, node, asks)  # anew, as the sibling may have raised the k-th best
            asks = asks[found]
            if not len(asks):
                return
            if tree.left[node] < 0:
                at = slice(tree.lo[node], tree.hi[node])
                leaf(rows[at], x[at], asks)
                return
            sides = [(wanted(tree, c, asks)[1], c) for c in (tree.left[node], tree.right[node])]
            for _, child in sorted(sides, reverse=True):
                walk(tree, rows, x, child, asks)

        for label, rows, x, tree in self.trees:
            asks = np.arange(len(ids)) if label is None else np.flatnonzero((labels == label) == same)
            if len(asks):
                walk(tree, rows, x, 0, asks)
        return best


def _search(rows: DataFrame, anchors: DataFrame, shards: int, same: bool, k: int, window: tuple[int, int] | None, leaf: int) -> DataFrame:
    """The k best rows of each shard for each anchor and each of its windows (columns of _FOUND).

    anchors: (id, label, v, tags array<struct<id, score>>); a window reaches from window[0] to window[1] percent of a tag's score."""
    tags = "array<struct<id:bigint,score:bigint>>"
    of = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shards)).cast("int")
    members = rows.select("id", "label", "v", F.lit(None).cast(tags).alias("tags"), of.alias("shard"), F.lit(False).alias("asks"))
    asked = anchors.select("id", "label", "v", F.col("tags").cast(tags), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"))
    dealt = members.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        forest, now = None, None
        for batch in batches:
            ids, labels, of, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4, 5))
            if not len(ids):
                continue
            x = integers(batch.column(2).flatten().to_numpy().reshape(len(ids), -1), SCALE, MOST_SCORE)
            cut = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (asks[1:] != asks[:-1])])
            for a, b in zip(cut, [*cut[1:], len(ids)], strict=True):
                if of[a] != now:
                    held, forest, now = [], None, of[a]
                if not asks[a]:
                    held.append((ids[a:b], labels[a:b], x[a:b]))
                    continue
                if not held:
                    continue
                if forest is None:
                    forest = Forest(*(np.concatenate(c) for c in zip(*held, strict=True)), leaf)
                for at in range(a, b, ASKED):
                    yield answers(forest, batch.slice(at, min(ASKED, b - at)), x[at : min(at + ASKED, b)])

    def answers(forest: Forest, asked: pa.RecordBatch, q: np.ndarray) -> pa.RecordBatch:
        ids, labels = (asked.column(i).to_numpy() for i in (0, 1))
        names = [[(t["id"], t["score"]) for t in row] for row in asked.column(3).to_pylist()]
        width = max(map(len, names))
        lo, hi = np.full((len(ids), width), HIGH), np.full((len(ids), width), LOW)
        for i, row in enumerate(names):
            for w, (_, score) in enumerate(row):
                lo[i, w], hi[i, w] = (-(-window[0] * score // 100), window[1] * score // 100) if window else (LOW, HIGH)
        best = forest.search(ids, labels, q, lo, hi, same, k)
        i, w, r = np.nonzero(best != NOTHING)
        key = best[i, w, r]
        tag = [names[a][b] for a, b in zip(i.tolist(), w.tolist(), strict=True)]
        cols = [ids[i], np.array([t[0] for t in tag], np.int64), np.array([t[1] for t in tag], np.int64), forest.ids[forest.n - 1 - key % forest.n], key // forest.n]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor_id", "positive_id", "positive_score", "id", "score"])

    return write_shared(dealt.mapInArrow(search, _FOUND), "negatives-found")


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each group with their rank; Spark keeps k of each task's before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, k: int = 10,
    window: tuple[int, int] = (30, 90), shard_rows: int = SHARD_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row where `is_anchor` holds (a condition on column id)."""
    spark = vectors.sparkSession
    arrow_batches(spark, 4096)
    usable = write_shared(labelled_vectors(vectors, id_col, vec_col, label), "labelled-vectors")
    length = usable.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if not length:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    usable = usable.where(F.size("v") == length["length"])
    shards = max(-(-length["count"] // shard_rows), min(shuffle_width(spark), -(-length["count"] // LEAST_SHARD_ROWS)))
    anchors = usable.where(is_anchor)
    one = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")))
    near = _first(_search(usable, anchors.withColumn("tags", one), shards, True, positives, None, leaf), positives, "anchor_id")
    tags = near.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("id"), "score"))).alias("tags"))  # at most `positives` of an anchor
    found = _search(usable, anchors.join(tags, "id"), shards, False, k, window, leaf)
    best = _first(found, k, "anchor_id", "positive_id")
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


#: The same in DuckDB SQL, every anchor held against every row.
ORACLE_SQL = """
WITH used AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM used a JOIN used b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10
"""
