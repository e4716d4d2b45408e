"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its `order` nearest pivots. Each index shard, of about `shard_rows`
vectors, posts them in pivot inverted files: for each pivot the vectors that have it in their order, with its
place. A query walks the lists of its own `asked` nearest pivots only and adds up the footrule distance; the
`rerank` best-ranked vectors of a shard are compared exactly, by Euclidean distance on the original vectors. The
number is the same for every shard of every table, so recall does not fall as the table grows.

A shard's vectors and then all queries, in batches, stream through one task: its files are built once, and a task
holds one shard and one batch of queries, whatever the number of either. Shards return their k nearest found, and
a window keeps the k nearest of each query. Pivots are a bounded sample (`n_pivots`) of the rows, the smallest by
a hash of the id; every row is indexed.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length
than most vectors have (of equally frequent lengths the smaller counts). Rows that repeat an id are versions of
one vector, of which the smallest in order of its components stands for all: an id is listed once for a query and
has one list. Different ids with equal vectors are separate candidates; ties go to the smaller id; an empty table,
or one without queries, gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches, table, write_shared

N_PIVOTS, ORDER, ASKED, RERANK, SHARD_ROWS = 1024, 256, 64, 256, 16_384
_FOUND = "query_id long, vec_id long, score double"


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the usable rows, one for each id, v as array<double>."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def pivot_order(x: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """The ids of the nearest pivots of each row, nearest first."""
    d = (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.argsort(d, axis=1, kind="stable")[:, :order].astype(np.int16)


class Shard:
    """Pivot inverted files of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, order: int):
        by = np.argsort(ids, kind="stable")
        self.ids, self.x, self.order = ids[by], x[by], min(order, len(pivots))
        flat = np.concatenate([pivot_order(self.x[at : at + 2048], pivots, self.order) for at in range(0, len(by), 2048)]).ravel()
        posts = np.argsort(flat, kind="stable")
        self.rows, self.places = (posts // self.order).astype(np.int32), (posts % self.order).astype(np.int32)
        self.starts = np.r_[0, np.cumsum(np.bincount(flat, minlength=len(pivots)))]

    def saved(self, perm: np.ndarray) -> np.ndarray:
        """What each row's footrule distance to a query saves against sharing none of its pivots, a missing pivot being at place `order`."""
        most, gain = self.order, np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(perm.tolist()):
            at = slice(self.starts[pivot], self.starts[pivot + 1])
            gain[self.rows[at]] += 2 * (most - np.maximum(self.places[at], place))
        return gain

    def nearest(self, qid: int, q: np.ndarray, perm: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        most = min(n, max(rerank, k) + 1)  # one more, as the query's own vector may be among them
        rank = self.saved(perm).astype(np.int64) * n - np.arange(n)  # ids ascend: equal ranks go to the smaller id
        found = np.argpartition(-rank, most - 1)[:most] if most < n else np.arange(n)
        found = found[self.ids[found] != qid]
        d = np.sqrt(((self.x[found] - q) ** 2).sum(1))
        best = np.lexsort((self.ids[found], d))[:k]
        return self.ids[found][best], d[best]


def permutation_search(
    vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, n_pivots: int = N_PIVOTS, order: int = ORDER,
    asked: int = ASKED, rerank: int = RERANK, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row where `is_query` holds (a condition on column id)."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = write_shared(valid_vectors(vectors, id_col, vec_col), "vectors")
    length = usable.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if not length:
        return empty
    usable = usable.where(F.size("v") == length["length"])
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()  # bounded by n_pivots
    pivots = spark.sparkContext.broadcast(np.array([r.v for r in sample]))
    shards = max(1, -(-usable.count() // shard_rows))
    members = usable.withColumns({"shard": F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int"), "asks": F.lit(False)})
    queries = usable.where(is_query).withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "asks": F.lit(True)})
    dealt = members.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shard, now = None, None
        for batch in batches:
            ids, asks, of = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 2))
            x = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
            cut = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (asks[1:] != asks[:-1])]) if len(ids) else []
            for a, b in zip(cut, [*cut[1:], len(ids)], strict=True):
                if of[a] != now:
                    held, shard, now = [], None, of[a]
                if not asks[a]:
                    held.append((ids[a:b], x[a:b]))
                    continue
                if not held:
                    continue
                if shard is None:
                    shard = Shard(*(np.concatenate(v) for v in zip(*held, strict=True)), pivots.value, order)
                perms = pivot_order(x[a:b], pivots.value, min(asked, order))
                found = [shard.nearest(q, v, perm, k, rerank) for q, v, perm in zip(ids[a:b], x[a:b], perms, strict=True)]
                sizes = [len(i) for i, _ in found]
                cols = [np.repeat(ids[a:b], sizes), *(np.concatenate(v) for v in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    found = write_shared(dealt.select("id", "v", "shard", "asks").mapInArrow(search, _FOUND), "permutation-found")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
