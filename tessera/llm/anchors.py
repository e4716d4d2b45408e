"""Repeated windows of a symbol sequence, by anchors that depend on a window's content alone.

Every window of `width` symbols picks one of its `gram`-symbol grams as its anchor: the leftmost with the
smallest hash. Equal windows pick equal anchors at equal places, and neighbouring windows mostly share
one, so the windows of a document fall into blocks of a common anchor, about one for each
(width - gram) / 2 symbols. Blocks, not windows, are shuffled:

1. blocks with the same anchor and content: all windows of all but the first are repeats;
2. blocks with the same anchor and different content (text around edits and around shared passages):
   their windows have to be compared one by one;
3. all other blocks hold no repeated window and are dropped.

Hashes are taken of the content itself, 64 bits of the anchor and 64 independent bits of the block, so
two blocks are taken as equal on 128 bits. Long documents are cut into overlapping parts, which changes
no block's windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Symbols that are hashed at a time.
PART = 1 << 20
#: Blocks that a task holds before it folds and emits them.
FOLD = 500_000
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
BLOCK = "ha long, hb long, doc_id long, start long, n int, known boolean"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.r_[np.uint64(1), np.full(n, b, np.uint64)].cumprod(dtype=np.uint64) for b in (base, inverse))


class Rolling:
    """Hashes of any spans of a sequence of uint64 symbols, by prefix sums."""

    def __init__(self, symbols: np.ndarray, kind: int):
        size = 1 << max(20, int(len(symbols)).bit_length())
        self.up, self.down = _powers(_BASES[kind], size)
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((mix(symbols + np.uint64(kind)) if kind else symbols) * self.up[: len(symbols)], out=self.prefix[1:])

    def spans(self, start: np.ndarray, length) -> np.ndarray:
        raw = (self.prefix[start + length] - self.prefix[start]) * self.down[start]
        return mix(raw + np.asarray(length, np.uint64))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest (in its 34 high bits) of each `width` consecutive values."""
    n = len(values)
    key = (values >> np.uint64(30) << np.uint64(30)) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    grid = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & np.uint64((1 << 30) - 1)).astype(np.int64)


def blocks_of(symbols: np.ndarray, owner: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first window, windows, anchor hash, content hash) of each block; owner: the document of each symbol."""
    n = len(symbols)
    if n < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    one = Rolling(symbols, 0)
    grams = one.spans(np.arange(n - gram + 1), gram)
    anchor = sliding_argmin(grams, width - gram + 1)
    valid = owner[: n - width + 1] == owner[width - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    mine = anchor[at]
    first = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)])
    windows = np.diff(np.r_[first, len(at)])
    start = at[first]
    return start, windows, mix(grams[mine[first]]), Rolling(symbols, 1).spans(start, windows - 1 + width)


def parts(sizes: list[int], width: int, most: int = PART) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, from, to) of at most about `most` symbols; long documents overlap by width - 1."""
    group: list[tuple[int, int, int]] = []
    held = 0
    for d, size in enumerate(sizes):
        at = 0
        while size - at >= width:
            to = min(size, at + most)
            if held and held + to - at > most:
                yield group
                group, held = [], 0
            group.append((d, at, to))
            held += to - at
            if to == size:
                break
            at = to - width + 1
    if group:
        yield group


def block_rows(texts: Iterable[tuple[list[int], list[np.ndarray]]], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows of `BLOCK` of texts given as (ids, sequences), folded: of equal blocks in FOLD blocks or so, the first stays.

    The others are `known` to be repeats; runs of them come as one row each, so that copies take little room."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for ids, sequences in texts:
        for group in parts([len(s) for s in sequences], width):
            symbols = np.concatenate([sequences[d][a:b] for d, a, b in group])
            sizes = np.array([b - a for _, a, b in group])
            owner = np.repeat(np.arange(len(group)), sizes)
            start, windows, ha, hb = blocks_of(symbols, owner, width, gram)
            part = owner[start]
            doc = np.array([ids[d] for d, _, _ in group], np.int64)[part]
            place = start - (np.cumsum(sizes) - sizes)[part] + np.array([a for _, a, _ in group], np.int64)[part]
            held.append((ha, hb, doc, place, windows))
            n += len(ha)
            if n >= FOLD:
                yield folded(held)
                held, n = [], 0
    if held:
        yield folded(held)


def folded(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ha, hb, doc, place, windows = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((place, doc, hb, ha))
    ha, hb, doc, place, windows = (x[order] for x in (ha, hb, doc, place, windows))
    same = np.r_[False, (ha[1:] == ha[:-1]) & (hb[1:] == hb[:-1])] if len(ha) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(ha))))
    # Rows that repeat (doc_id, start) are the same place: versions of a document.
    later = np.flatnonzero((doc != doc[lead]) | (place != place[lead]))
    later = later[np.lexsort((place[later], doc[later]))]
    first = np.flatnonzero(~same)
    d, p, w = doc[later], place[later], windows[later]
    head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + w[:-1])]) if len(later) else later
    # Known ones need no hashes: small numbers, which deal them out evenly, take less room in the shuffle.
    key = mix(d[head].astype(np.uint64) * np.uint64(_BASES[0]) + p[head].astype(np.uint64)) >> np.uint64(50)
    n = np.r_[windows[first], np.add.reduceat(w, head) if len(head) else head]
    cols = [
        pa.array(np.r_[ha[first], key].view(np.int64)), pa.array(np.r_[hb[first], np.zeros(len(head), np.uint64)].view(np.int64)), pa.array(np.r_[doc[first], d[head]]),
        pa.array(np.r_[place[first], p[head]]), pa.array(n.astype(np.int32)), pa.array(np.arange(len(n)) >= len(first)),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in BLOCK.split(", ")])


def judged(blocks: DataFrame, partitions: int) -> DataFrame:
    """Adds `repeat` (its windows all start earlier elsewhere) and `open` (its windows have to be compared).

    One shuffle by anchor and one sort. Each task has folded its copies before, so a block that fills a third of all
    texts comes once from each task. Of rows at the same place with the same content one stays."""
    same = Window.partitionBy("ha", "hb").orderBy("doc_id", "start")
    anchor = Window.partitionBy("ha")
    ranked = blocks.repartition(partitions, "ha").withColumns({"place": F.rank().over(same), "row": F.row_number().over(same)})
    repeat = F.col("known") | (F.col("place") > 1)
    # Of the first ones only, which keeps this window above the other, whose sort serves both.
    lead = F.when(F.col("row") == 1, F.col("hb"))
    ranked = ranked.withColumns({"least": F.min(lead).over(anchor), "most": F.max(lead).over(anchor)}).where(repeat | (F.col("row") == 1))
    return ranked.select(*blocks.columns, repeat.alias("repeat"), (~repeat & (F.col("least") != F.col("most"))).alias("open"))


def merged_runs(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ascending (from, to) that cover the same places as spans (start, length)."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + length)[order]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:] - 1, len(start) - 1]]


def spans_by_doc(spans: DataFrame) -> DataFrame:
    """(doc_id, spans): a document's spans are bounded by its own length."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("spans"))


def span_arrays(value: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    if not value:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.array([x["start"] for x in value], np.int64), np.array([x["length"] for x in value], np.int64)


def with_spans(docs: DataFrame, spans: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, text, spans, columns to keep) of each document; spans is null where there are none.

    Rows without an id pass beside the join, so that its scan and shuffle of the texts are the same as those
    of an inner join on doc_id in the same plan, and Spark reuses them."""
    named = docs.where(F.col("doc_id").isNotNull()).join(spans_by_doc(spans), "doc_id", "left").select("doc_id", "text", "spans", *keep)
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<struct<start:bigint,length:bigint>>").alias("spans"), *keep)
    return named.unionByName(nameless)
