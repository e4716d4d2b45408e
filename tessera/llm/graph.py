"""Connected components of an edge table, as distributed star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, write_shared

#: Edges that a task holds at most while it contracts them.
HELD_EDGES = 500_000


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) of each node of some edges that is not that smallest one."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    at = at.reshape(2, len(a))
    label = np.arange(len(nodes))
    while True:
        low, high = np.sort(label[at], axis=0)
        if np.array_equal(low, high):
            break
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def contract(edges: DataFrame) -> DataFrame:
    """The edges (a, b, no nulls) of each task as stars around the smallest ids, at most HELD_EDGES at a time; connects what they connected."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            pending.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            held += batch.num_rows
            if len(a) + held >= HELD_EDGES:
                a, b = local_stars(*(np.concatenate(x) for x in zip((a, b), *pending, strict=True)))
                pending, held = [], 0
                if 2 * len(a) >= HELD_EDGES:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a = b = np.zeros(0, np.int64)
        a, b = local_stars(*(np.concatenate(x) for x in zip((a, b), *pending, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(stars, "a long, b long")


def are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, or none and only edges from larger ones."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge (columns a, b of long).

    Tasks first contract the edges they hold. Then rounds of large-star and small-star, each written to the
    shared folder and contracted again, until only stars are left: a neighbourhood is only ever reduced to its
    minimum, which combines before the shuffle, so no node's edges meet in one task (the join back on a hot
    node is one that Spark can split). No step raises a node's smallest neighbour, and a round lowers one unless
    only stars are left, so the rounds end. Self-loops and null ends are ignored; an empty table gives an empty
    result."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("open")).where("open")
    edges = write_shared(contract(edges).distinct(), "edges")
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(down.select("a", F.col("least").alias("b")))
        made = write_shared(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        discard(edges)
        edges = write_shared(contract(made), "edges")
        discard(made)
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
