"""Suffix-array dedup of byte strings.

A byte is removed if a `width`-byte string over it also starts earlier. Sorting every suffix of the corpus
would move each byte some hundred times, so anchors (see `anchors`) first settle what needs no order:
blocks of suffixes whose anchor occurs nowhere else drop out, and equal blocks are folded into their first
occurrence. The suffixes of the remaining blocks - text around edits and around shared passages - form a
sparse suffix array: blocks are range-partitioned by the eight leading bytes of their anchored suffix, with
splitters that Spark samples; each bucket sorts its suffixes by one multi-byte key after another, eight bytes to a
digit, where, as in multikey quicksort, only ties go on to the next digit (a digit is sorted by NumPy, not by
three-way partitions); suffixes that still tie at `width` bytes are repeats. Splitters
may cut through equal leading bytes (the id is part of the range key, so one hot passage fills many
buckets): the first occurrence of each string with a bucket's outermost leading bytes is compared once
more, across the boundaries.

Null texts count as empty; texts shorter than `width` are kept whole; rows that repeat a doc_id are
versions of one document, each loses what any of them would, and the same place is not earlier than
itself; rows with null doc_id are kept whole and are nobody's source; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.anchors import BLOCK, Rolling, block_rows, judged, merged_runs, mix, span_arrays, with_spans
from tessera.llm.bpe import utf8
from tessera.llm.common import arrow_batches, released, shuffle_width, table, write_shared

WIDTH, GRAM = 100, 32
#: Blocks in a bucket, about.
BUCKET_BLOCKS = 20_000
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_symbols(raw: bytes | None) -> np.ndarray:
    return _SYMBOL[np.frombuffer(raw or b"", np.uint8)]


def byte_blocks(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows of `BLOCK` over the bytes of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts_of() -> Iterator[tuple[list[int], list[np.ndarray]]]:
            for batch in released(batches):
                ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
                for at in range(0, len(ids), 250):
                    yield ids[at : at + 250], [byte_symbols(x) for x in texts[at : at + 250]]

        yield from block_rows(parts_of(), width, gram)

    arrow_batches(docs.sparkSession)
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, BLOCK)


def suffix_blocks(docs: DataFrame, blocks: DataFrame, width: int, gram: int) -> DataFrame:
    """(lead, doc_id, start, content) of the open blocks: lead orders as the first eight bytes at the anchor."""
    asked = blocks.groupBy("doc_id").agg(F.collect_set(F.struct("start", F.col("n").alias("length"))).alias("spans"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw, spans in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                start, n = span_arrays(spans)
                fits = start + n - 1 + width <= len(raw)
                start, n = start[fits], n[fits]
                if not len(start):
                    continue
                content = [raw[a : a + k - 1 + width] for a, k in zip(start.tolist(), n.tolist(), strict=True)]
                head = byte_symbols(b"".join([c[:width] for c in content]))
                at = np.arange(len(content))[:, None] * width + np.arange(width - gram + 1)
                grams = Rolling(head, 0).spans(at, gram) >> np.uint64(30)
                anchor = grams.argmin(1)
                lead = [int.from_bytes(c[a : a + 8], "big") - (1 << 63) for c, a in zip(content, anchor.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lead, pa.int64()), pa.array(np.full(len(start), doc)), pa.array(start), pa.array(content, pa.binary())], names=["lead", "doc_id", "start", "content"])

    arrow_batches(docs.sparkSession)
    return docs.join(asked, "doc_id").select("doc_id", "text", "spans").mapInArrow(rows, "lead long, doc_id long, start long, content binary")


def tied_suffixes(buffer: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey sort of the `width`-byte strings at places `at`, all groups of ties at once: (places in `at`, group), for those that tie with another."""
    padded = np.concatenate([buffer, np.zeros(16, np.uint8)]).astype(np.uint64)
    digit = np.zeros(len(buffer) + 8, np.uint64)  # the eight bytes from each place on
    for i in range(8):
        digit |= padded[i : i + len(digit)] << np.uint64(8 * (7 - i))
    who, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for d in range(0, width, 8):
        key = digit[at[who] + d]
        if width - d < 8:
            key = key >> np.uint64(8 * (8 - width + d))
        order = np.lexsort((key, group))
        who, group, key = who[order], group[order], key[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])] if len(who) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1 if len(who) else new
        who, group = who[tied], group[tied]
        if not len(who):
            break
    return who, group


def later_of(group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): rows sorted by group and place, and which of them lie after their group's first place."""
    order = np.lexsort((start, doc, group))
    group, doc, start = group[order], doc[order], start[order]
    if not len(order):
        return order, np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(order)), 0))
    return order, (doc != doc[lead]) | (start != start[lead])


def sort_buckets(suffixes: DataFrame, buckets: int, width: int) -> DataFrame:
    """(doc_id, start, h1, h2) of suffixes that repeat an earlier one (hashes null), or have to be compared across boundaries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(released(batches))
        content = [c for b in held for c in b.column(3).to_pylist()]
        if not content:
            return
        lead, doc0, start0 = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        sizes = np.array([len(c) for c in content])
        n = sizes - width + 1
        block = np.repeat(np.arange(len(content)), n)
        inner = np.arange(len(block)) - (np.cumsum(n) - n)[block]
        at = (np.cumsum(sizes) - sizes)[block] + inner
        doc, start = doc0[block], start0[block] + inner
        buffer = np.frombuffer(b"".join(content), np.uint8)
        who, group = tied_suffixes(buffer, at, width)
        order, later = later_of(group, doc[who], start[who])
        gone = who[order][later]
        left = np.ones(len(at), bool)
        left[gone] = False
        edge = np.flatnonzero(left & ((lead[block] == lead.min()) | (lead[block] == lead.max())))
        symbols = _SYMBOL[buffer]
        h = [Rolling(symbols, k).spans(at[edge], width).view(np.int64) for k in (0, 1)]
        none = pa.nulls(len(gone), pa.int64())
        names = ["doc_id", "start", "h1", "h2"]
        yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(start[gone]), none, none], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(doc[edge]), pa.array(start[edge]), pa.array(h[0]), pa.array(h[1])], names=names)

    dealt = suffixes.repartitionByRange(buckets, "lead", "doc_id")
    return dealt.mapInArrow(rows, "doc_id long, start long, h1 long, h2 long")


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, length) of everything to remove; docs: (doc_id, text)."""
    found = judged(byte_blocks(docs, width, gram), shuffle_width(docs.sparkSession)).where(F.col("repeat") | F.col("open"))
    found = write_shared(found.select("doc_id", "start", "n", "repeat"), "suffix-blocks")
    whole = found.where("repeat").select("doc_id", "start", (F.col("n") + F.lit(width - 1)).cast("long").alias("length"))
    suffixes = write_shared(suffix_blocks(docs, found.where(~F.col("repeat")), width, gram), "suffixes")
    buckets = max(shuffle_width(docs.sparkSession), -(-suffixes.count() // BUCKET_BLOCKS))
    settled = write_shared(sort_buckets(suffixes, buckets, width), "sorted-suffixes")
    edge = settled.where(F.col("h1").isNotNull())
    first = edge.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    crossed = edge.join(first, ["h1", "h2"]).where(F.struct("doc_id", "start") > F.col("first"))
    later = settled.where(F.col("h1").isNull()).select("doc_id", "start").unionByName(crossed.select("doc_id", "start"))
    return whole.unionByName(later.withColumn("length", F.lit(width).cast("long")))


def remove_bytes(docs: DataFrame, spans: DataFrame, texts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), with `texts` the remaining text, without characters that lost a byte, and the columns to keep."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            out: list[tuple] = []
            for raw, found in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                raw = raw or b""
                start, end = merged_runs(*span_arrays(found))
                inside = start < len(raw)
                start, end = start[inside], np.minimum(end[inside], len(raw))
                left = b"".join([raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True)])
                out.append((len(raw), len(raw) - len(left), len(start), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if texts else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False)), *batch.columns[3:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts, *keep])

    arrow_batches(docs.sparkSession)
    return with_spans(docs, spans, *keep).mapInArrow(rows, schema)


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Removes repeated `width`-byte strings from documents (doc_id, text, columns to keep)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return remove_bytes(docs, repeated_spans(docs.select("doc_id", "text"), width, gram), texts, keep)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
