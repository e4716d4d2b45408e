"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become pieces of at most `capacity` tokens. Pieces are dealt by a hash into groups of about
`group_items`; each group is packed best-fit in order of falling length. Nearly full bins are emitted;
the underfull ones are the items of the next round, in fewer and merged groups, until one group is left
or a round closes no more bins. Every round's bins are written to the shared folder, so a lost executor
repeats a round's task with the same input and the same result. A group never holds more than about
`group_items` rows, whatever the number of documents: where the residuals of all groups would not fit in
one, they stay in several. The hash takes a row's place in the stored table besides its id, so that rows that
repeat an id, null ids included, are dealt out like others.

Null texts count as empty: one end token. Equal lengths go in order of (doc_id, piece); repeated rows are
packed as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import Encoder, default_tokenizer, utf8
from tessera.llm.common import arrow_batches, released, table, write_shared

CAPACITY, END_ID = 4096, 1
GROUP_ITEMS = 50_000
#: A bin with at most so many free tokens is emitted at once.
SLACK = 4
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBERS = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document (doc_id, text)."""
    path = path or default_tokenizer()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, None)
        end = array("I", [end_id]).tobytes()
        for batch in released(batches):
            rows: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = enc.text_ids(raw) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECE)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of places in `sizes`) by best fit in the order given."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin has r free tokens
    for i, size in enumerate(sizes):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if r > size:
            free[r - size].append(b)
            mask |= 1 << (r - size)
    return bins


def _pack_round(capacity: int, slack: int, level: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["total", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        totals, members, grp = pdf.total.tolist(), pdf.members.tolist(), int(pdf.grp.iloc[0])
        rows = []
        for k, places in enumerate(best_fit(totals, capacity)):
            inside, at = [], 0
            for i in places:
                inside += [{**m, "offset": m["offset"] + at} for m in members[i]]
                at += totals[i]
            rows.append((grp, level << 56 | grp << 28 | k, at, inside[0]["doc_id"], inside[0]["piece"], capacity - at <= slack, inside))
        return pd.DataFrame(rows, columns=["grp", "sequence_id", "total", "doc_id", "piece", "full", "members"])

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, group_items: int = GROUP_ITEMS, fan_in: int = 8) -> DataFrame:
    """Adds sequence_id and offset to rows of `PIECE` (a table read from storage: it is read more than once)."""
    n = pieces.count()
    groups = max(1, -(-n // group_items))
    first = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    items = pieces.select(
        F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("grp"), F.col("length").alias("total"), "doc_id", "piece", F.array(first).alias("members")
    )
    schema = f"grp int, sequence_id long, total long, doc_id long, piece int, full boolean, members {_MEMBERS}"
    done: list[DataFrame] = []
    level = 0
    while True:
        made = write_shared(items.groupBy("grp").applyInPandas(_pack_round(capacity, slack, level), schema), f"pack-{level}")
        rest = made.where(~F.col("full"))
        left = rest.count()
        merged = max(-(-groups // fan_in), -(-left // group_items), 1)
        if groups == 1 or merged >= groups or not left:
            done.append(made)
            break
        done.append(made.where("full"))
        items = rest.select(F.pmod("grp", F.lit(merged)).alias("grp"), "total", "doc_id", "piece", "members")
        groups, level = merged, level + 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack_pieces(write_shared(token_pieces(docs, path), "pieces"), **how)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
