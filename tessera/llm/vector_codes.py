"""Compression of vectors to codes of parts.

A vector is cut into equal consecutive parts; each part is replaced by the index of its nearest entry in the
codebook of its position. Codebooks are refined by rounds of assignment and averaging, all in integers
(floor(scale * x)), so results do not depend on the order of summation.

Nearest entries are found by metric branch and bound in one ball tree for each part position, walked with a whole
batch of parts. A part skips a node only if the node's bound, from a radius rounded up, is strictly beyond the best
distance found so far (nodes on a par are visited, for the lower index may be there); at the leaves, squared
distances are computed in integers, and ties go to the lower index.

Tasks hand over sums and counts of each entry, combined again by a shuffle; only the codebooks (parts x entries)
pass the driver. Error sums by label are combined before the shuffle and joined back, by broadcast if there are
at most `broadcast_labels` of them.

Rows whose vector is null or holds null or non-finite components are dropped, as are vectors of another length
than most kept ones have (of equally frequent lengths the smaller counts). A length that the number of parts does
not divide is filled up with zeros at the end. Every row of a repeated id is coded; starts are taken in order of
(id, components, label), null ids last; with fewer kept rows than entries codebooks are smaller. Null labels are one
label. An empty table gives an empty result; extra columns are ignored. Components beyond 2^27 after scaling end
the query with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.balltree import ball_tree
from tessera.llm.common import arrow_batches, table, write_shared

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 4
LARGEST = 1 << 27
#: Error sums of so many labels (16 bytes each) are broadcast; of more they are joined.
BROADCAST_LABELS = 100_000


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows to be coded, v as array<double>."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & finite)


def split_parts(flat: np.ndarray, rows: int, parts: int, scale: int) -> np.ndarray:
    """Integer parts (rows x parts x width) of vectors laid end to end."""
    x = np.floor(scale * flat.reshape(rows, -1))
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError("components are too large for exact distances")
    short = -x.shape[1] % parts
    if short:
        x = np.concatenate([x, np.zeros((rows, short))], axis=1)
    return x.astype(np.int64).reshape(rows, parts, -1)


class Codebook:
    """Entries of one part position (entries x width, integers) under a ball tree."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.tree = entries, ball_tree(entries, leaf)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row of x, and its squared distance."""
        best, index, real = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64), x.astype(float)
        tree, entries = self.tree, self.entries

        def walk(node: int, bound: np.ndarray, rows: np.ndarray) -> None:
            rows = rows[bound * bound * (1 - 1e-9) <= best[rows]]
            if not len(rows):
                return
            if tree.left[node] < 0:
                for e in np.sort(tree.order[tree.lo[node] : tree.hi[node]]).tolist():
                    d = ((x[rows] - entries[e]) ** 2).sum(1)
                    wins = (d < best[rows]) | (d == best[rows]) & (e < index[rows])
                    best[rows[wins]], index[rows[wins]] = d[wins], e
                return
            a, b = tree.left[node], tree.right[node]
            to_a, to_b = tree.nearest_bound(a, real[rows]), tree.nearest_bound(b, real[rows])
            first = to_a <= to_b  # each row goes to its nearer child first
            for child, near, some in ((a, to_a, first), (b, to_b, ~first), (b, to_b, first), (a, to_a, ~first)):
                walk(child, near[some], rows[some])

        if len(entries) and len(x):
            walk(0, np.zeros(len(x)), np.arange(len(x)))
        return index, best


def assign(parts: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (rows x parts each)."""
    found = [book.nearest(np.ascontiguousarray(parts[:, p])) for p, book in enumerate(books)]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def refined(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Codebooks (parts x entries x width) after one round; entries without parts stay."""
    n_parts, n_entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Codebook(b) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            if batch.num_rows:
                parts = split_parts(batch.column(0).flatten().to_numpy(), batch.num_rows, n_parts, scale)
                codes, _ = assign(parts, held)
                for p in range(n_parts):
                    np.add.at(total[p], codes[:, p], parts[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=n_entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    per_task = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    added = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)))
    out = books.copy()
    for r in added.collect():  # one row for each entry of a codebook at most
        out[r.part, r.entry] = [r[f"t{i}"] // r.n for i in range(width)]
    return out


def trained_codebooks(vectors: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks that start as the parts of the rows of the smallest ids, refined over all rows."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v", "label").limit(n_entries).select("v").collect()
    books = split_parts(np.array([r.v for r in first], float).ravel(), len(first), n_parts, scale).transpose(1, 0, 2)
    for _ in range(rounds):
        books = refined(vectors, books, scale)
    return books


def vector_codes(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(id, label, codes array<int>, error) of every row."""
    n_parts = len(books)
    kind = vectors.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Codebook(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, d = assign(split_parts(batch.column(2).flatten().to_numpy(), batch.num_rows, n_parts, scale), held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(d.sum(1))], names=["id", "label", "codes", "error"])

    return vectors.select("id", "label", "v").mapInArrow(code, f"id long, label {kind}, codes array<int>, error long")


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """Adds v, the vector that a row's codes stand for (components at the lower end of their integer)."""
    entries = F.array(*(F.array(*(F.array(*(F.lit(c / scale) for c in e)) for e in b)) for b in books.tolist()))
    return codes.withColumn("v", F.flatten(F.transform("codes", lambda c, p: entries[p][c])))


def label_errors(coded: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """Adds label_error, the error summed over the rows with an equal label; coded is read from storage."""
    sums = write_shared(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    if sums.limit(broadcast_labels + 1).count() <= broadcast_labels:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark, 8192)
    kept = write_shared(kept_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"), "kept-vectors")
    length = kept.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if not length:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    kept = kept.where(F.size("v") == length["length"])
    books = trained_codebooks(kept)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = label_errors(write_shared(vector_codes(kept, books), "vector-codes"))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return coded.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB SQL, for vectors of equal lengths that the number of parts divides; every part is held against every entry."""
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS (SELECT row_id, p, v[p * len(v) // {n_parts} + 1 : (p + 1) * len(v) // {n_parts}] AS x FROM kept, (SELECT unnest(range({n_parts})) AS p))",
        f"books0 AS (SELECT p, row_id - 1 AS e, x AS c FROM parts WHERE row_id <= {n_entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (SELECT row_id, p, arg_min(e, d * {n_entries} + e) AS e, min(d) AS d FROM (SELECT row_id, p, e,
            CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts JOIN books{k} USING (p)) GROUP BY row_id, p)""")
        if k < rounds:
            steps.append(f"""means{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM
                (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{k} JOIN parts USING (row_id, p)) GROUP BY p, e, i) GROUP BY p, e)""")
            steps.append(f"books{k + 1} AS (SELECT p, e, coalesce(n.c, o.c) AS c FROM books{k} o LEFT JOIN means{k} n USING (p, e))")
    return f"""WITH {", ".join(f"{s.split(' AS ', 1)[0]} AS MATERIALIZED {s.split(' AS ', 1)[1]}" for s in steps)},
        coded AS (SELECT row_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY row_id),
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row_id), digest"""
