"""N-gram Jaccard join with prefix trees, down to components of linked documents.

A document's set is its distinct shingles of `width` words (A-Z lower-cased; 3 for the query, up to 5). Two sets of
n and m shingles with Jaccard similarity t or more differ in at most (1 - t) / (1 + t) (n + m) shingles. Candidates
come from one of two exact rules, whichever is the more selective at t:

* from `SIGNED` on, shingles are dealt by hash into more parts than two linked sets can differ in, so that they agree
  in whole parts; a part's content, some nine shingles, is a signature;
* below it, parts would hold too few shingles to tell texts apart. There, sets are ordered rare-first, and two linked
  sets share one of their first n - ceil(t n) + 1 shingles. The order comes from a count sketch of all shingles with
  one cell for about six of them (`MOST_BITS` at most: 64 MB), then from the hash; any order is right. In a fuller
  sketch shingles of a few texts pass for rare, and chains of unlike sets that share one each would run through most
  of the corpus. So sets that share a shingle of their beginnings are paired first, and pairs whose parities (a bit for
  each of n to 2n places: how many shingles fall there, modulo 2) differ in more places than linked sets can differ in
  shingles are left out. Only shingles that more than `PAIRED` beginnings have (more, in a fuller sketch) link all of
  theirs without a look at them.

Documents that share a signature, or make such a pair, fall into candidate groups, which are star-contracted.
The sets of a group are then stored in a trie in the global order, where sets with equal beginnings share them: a
probe walks it once, keeps the overlap so far, leaves a subtree as soon as the remaining lengths cannot reach the
overlap asked for, and skips subtrees that are already linked to it. A group of more than `SLICE` sets or
`SLICE_TOKENS` shingles is cut into slices, which are joined on their own, then with the group's first slice, and
then pairwise where two slices still hold more than one component. Equal sets are one class with the smallest id as
its representative; every pair of representatives is either compared, pruned by a bound, or already in one component.

Sets are compared as 64-bit shingle hashes, classes on two 64-bit sums besides the set's size.

Null or wordless texts have an empty set and link with nothing; with fewer than `width` words the whole
sequence is the one shingle; rows that repeat a doc_id each get the component of that id; rows with null
doc_id get a null component; a text of any length is one set of its distinct shingles; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.anchors import mix
from tessera.llm.bpe import utf8
from tessera.llm.common import arrow_batches, released, table, write_shared
from tessera.llm.graph import connected_components, local_stars
from tessera.llm.substring_dedup import WordHashes

#: Candidates (three numbers each) that are broadcast to the texts at a time: some 64 MB; times at most, each reads the texts once more.
BROADCAST_ROWS, LOTS = 1_000_000, 8
#: Similarity asked for, in hundredths, and words of a shingle.
PERCENT, WIDTH = 90, 3
SLICE, SLICE_TOKENS = 1000, 2_000_000
#: A level holds sets of sizes up to GROWTH times its smallest, in hundredths; SPARE parts more than asked for.
GROWTH, SPARE = 130, 3
#: From this percentage on candidates come from signatures.
SIGNED = 88
#: Shingles for a cell of the count sketch, its largest size, shingles that a task counts at a time, bits of a cell's place in its chunk.
CELL_SHINGLES, MOST_BITS, COUNTED, CHUNK_BITS = 6, 26, 2_000_000, 16
#: Candidate rows that a task holds before it folds and emits them; beginnings of one shingle that are paired, at most.
FOLD, PAIRED = 400_000, 64
#: Pairs that a task makes at a time, at most about half as many.
PAIRS = 8_000_000
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_set(raw: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words of a text."""
    w = hashes.sequence(raw.lower() if raw else None)
    if len(w) < width:
        return mix(np.array([len(w)], np.uint64) + (w * np.array(_K[: len(w)])).sum(dtype=np.uint64)) if len(w) else w
    n = len(w) - width + 1
    return np.unique(mix(sum((w[i : i + n] * _K[i] for i in range(width)), np.uint64(0))))


@lru_cache(maxsize=8)
def levels(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest size of each level, parts of each level); a level also takes sets that may link with its smallest."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, starts[-1] * GROWTH // 100))
    top = np.array(starts[1:], np.int64) - 1
    return np.array(starts[:-1], np.int64), (100 - percent) * 2 * top // (100 + percent) + 1 + SPARE


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(place in `sets`, signature); sets that link share one. Parts without a shingle count only for sets with more than SPARE of them."""
    starts, parts = levels(percent)
    n = np.array([len(x) for x in sets], np.int64)
    place = np.flatnonzero(n)
    own = np.searchsorted(starts, n[place], "right") - 1
    above = starts[own + 1] * percent <= 100 * n[place]
    place, level = np.r_[place, place[above]], np.r_[own, own[above] + 1]
    if not len(place):
        return place, np.zeros(0, np.uint64)
    size = n[place]
    tokens = np.concatenate([sets[i] for i in place])
    copy = np.repeat(np.arange(len(place)), size)
    first = np.cumsum(parts[level]) - parts[level]
    cell = first[copy] + (mix(tokens ^ _K[2]) % parts[level].astype(np.uint64)[copy]).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, tokens = cell[order], mix(tokens[order] ^ _K[0])
    lead = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    total = np.zeros(int(parts[level].sum()), np.uint64)
    total[cell[lead]] = np.add.reduceat(tokens, lead)
    filled = np.zeros(len(total), bool)
    filled[cell[lead]] = True
    of = np.repeat(np.arange(len(place)), parts[level])
    many = np.bincount(of[~filled], minlength=len(place)) > SPARE
    keep = np.flatnonzero(filled | many[of])
    inner = keep - first[of[keep]]
    key = mix(total[keep] + mix(level[of[keep]].astype(np.uint64) * _K[1] + inner.astype(np.uint64)))
    return place[of[keep]], key


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each place (a power of two of them, as many as shingles or up to twice that, 64 at least): whether an odd number of shingles falls there."""
    places = 1 << max(6, (len(shingles) - 1).bit_length())
    count = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many places the parities of two lists differ, pair by pair; the longer of a pair is folded first. Sets differ in as many shingles at least."""
    out = np.zeros(len(left), np.int64)
    sizes = np.array([[len(x) for x in left], [len(x) for x in right]], np.int64).reshape(2, -1)
    for m, n in np.unique(sizes, axis=1).T.tolist():
        rows = np.flatnonzero((sizes[0] == m) & (sizes[1] == n))
        a, b = (np.frombuffer(b"".join([x[i] for i in rows.tolist()]), np.uint64).reshape(len(rows), -1) for x in (left, right))
        while a.shape[1] != b.shape[1]:
            long, a = (a, b) if a.shape[1] > b.shape[1] else (b, a)
            b = long[:, : long.shape[1] // 2] ^ long[:, long.shape[1] // 2 :]
        out[rows] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return out


def document_sets(docs: DataFrame, width: int = WIDTH, bits: bool = False) -> DataFrame:
    """(doc_id, n, s1, s2) of each document; with `bits` also the parity of its shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(x, width, hashes) for x in utf8(batch.column(1))]
            s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            s2 = np.array([mix(s ^ _K[1]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            columns = {"doc_id": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "s1": pa.array(s1), "s2": pa.array(s2)}
            if bits:
                columns["bits"] = pa.array([parity(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(rows, "doc_id long, n long, s1 long, s2 long" + ", bits binary" * bits)


@dataclass
class RareFirst:
    """The global order of shingles: by the logarithm (in quarters of an octave) of their cell's count, then by hash."""

    level: np.ndarray
    bits: int

    def ranked(self, shingles: np.ndarray) -> np.ndarray:
        """The shingles, renumbered so that numbers ascend in the global order (eight bits of the level before 56 of the hash)."""
        at = (shingles >> np.uint64(64 - self.bits)).astype(np.int64)
        return self.level[at].astype(np.uint64) << np.uint64(56) | (shingles & np.uint64((1 << 56) - 1))

    def beginning(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        n = len(shingles)
        if not n:
            return shingles
        most = n - -(-percent * n // 100) + 1
        ranked = self.ranked(shingles)
        return np.partition(ranked, most - 1)[:most] if most < n else ranked


def gaps(places: np.ndarray) -> bytes:
    """Ascending places, repeats included, as the gaps between them: a byte below 255 for each place, after one of 255 for each whole 255 of its gap."""
    gap = np.diff(places, prepend=0)
    out = np.full(len(gap) + int((gap // 255).sum()), 255, np.uint8)
    out[np.cumsum(gap // 255 + 1) - 1] = gap % 255
    return out.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    gap = np.frombuffer(data, np.uint8)
    return np.cumsum(gap, dtype=np.int64)[gap != 255]


def rare_first(docs: DataFrame, total: int, width: int) -> RareFirst:
    """Counts the shingles of all documents (doc_id, text) into a sketch sized for `total` of them; about a byte of shuffle for each shingle."""
    bits = min(MOST_BITS, max(CHUNK_BITS, (total // CELL_SHINGLES).bit_length()))
    spark = docs.sparkSession

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0

        def summed() -> pa.RecordBatch:
            cell = np.sort(np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64)
            chunk = cell >> CHUNK_BITS
            lead = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else np.zeros(0, np.int64)
            place = cell & ((1 << CHUNK_BITS) - 1)
            data = [gaps(place[a:b]) for a, b in zip(lead, [*lead[1:], len(chunk)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(chunk[lead].astype(np.int32)), pa.array(data, pa.binary())], names=["chunk", "counts"])

        for batch in released(batches):
            for x in utf8(batch.column(0)):
                held.append(shingle_set(x, width, hashes))
                n += len(held[-1])
                if n >= COUNTED:
                    yield summed()
                    held, n = [], 0
        if held:
            yield summed()

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_of: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chunk not in total_of:
                    total_of[chunk] = np.zeros(1 << CHUNK_BITS, np.int64)
                np.add.at(total_of[chunk], from_gaps(data), 1)
        found = [np.floor(4 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in total_of.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total_of), pa.int32()), pa.array(found, pa.binary())], names=["chunk", "level"])

    arrow_batches(spark)
    dealt = docs.select("text").mapInArrow(counts, "chunk int, counts binary").repartition("chunk")
    out = np.zeros(1 << bits, np.uint8)
    for r in dealt.mapInArrow(levels, "chunk int, level binary").collect():  # at most 2 ** MOST_BITS bytes
        out[r.chunk << CHUNK_BITS : (r.chunk + 1) << CHUNK_BITS] = np.frombuffer(r.level, np.uint8)
    return RareFirst(out, bits)


def candidate_edges(docs: DataFrame, percent: int, width: int = WIDTH) -> DataFrame:
    """(a, b): each document with the smallest id that shares one of its signatures."""

    def folded(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        doc, token = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((doc, token))
        token, doc = token[by], doc[by]
        first = np.r_[True, token[1:] != token[:-1]] if len(token) else np.zeros(0, bool)
        lead = doc[np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))]
        a, b = local_stars(doc[~first], lead[~first])
        names = ["token", "a", "b"]
        yield pa.RecordBatch.from_arrays([pa.array(token[first].view(np.int64)), pa.array(doc[first]), pa.nulls(int(first.sum()), pa.int64())], names=names)
        # What the task has connected passes through the shuffle dealt out by its document.
        yield pa.RecordBatch.from_arrays([pa.array(mix(a.astype(np.uint64)).view(np.int64)), pa.array(a), pa.array(b)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            place, token = signatures([shingle_set(x, width, hashes) for x in utf8(batch.column(1))], percent)
            held.append((ids[place], token))
            n += len(token)
            if n >= FOLD:
                yield from folded(held)
                held, n = [], 0
        if held:
            yield from folded(held)

    arrow_batches(docs.sparkSession)
    # One row of a task for each token, copies folded: one that a third of all texts share comes once or a few times from each task.
    same = Window.partitionBy("token")
    found = docs.mapInArrow(rows, "token long, a long, b long").withColumn("least", F.min(F.when(F.col("b").isNull(), F.col("a"))).over(same))
    return found.select("a", F.coalesce("b", "least").alias("b")).where("a != b")


def size_pairs(token: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(smaller id, larger id), each pair once, of documents with a common token whose sizes let them link; rows are sorted by token, then size."""
    low, high, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    at = np.arange(len(token))
    while len(at := at[at + k < len(token)]) and len(at := at[token[at] == token[at + k]]):
        fits = at[(100 * n[at] >= percent * n[at + k]) & (doc[at] != doc[at + k])]
        low.append(np.minimum(doc[fits], doc[fits + k]))
        high.append(np.maximum(doc[fits], doc[fits + k]))
        k += 1
    a, b = np.concatenate(low), np.concatenate(high)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def beginning_edges(docs: DataFrame, sets: DataFrame, percent: int, width: int, order: Broadcast, paired: int) -> DataFrame:
    """(a, b): pairs of documents that share a shingle of their beginnings and whose sizes and parities let them link.

    Where more than `paired` beginnings have a shingle, each of their documents with the smallest id instead. sets: (doc_id, n, bits), read from storage."""

    def dealt(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        token, doc, n = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((doc, token))
        token, doc, n = token[by], doc[by], n[by]
        lead = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        many = np.diff(lead, append=len(token))
        star, first = np.repeat(many > paired, many), np.repeat(lead, many)
        a, b = local_stars(doc[star], doc[first[star]])
        star[lead] = False
        n[lead[many > paired]] = -1  # stands for more than are paired
        kept = ~star
        names = ["token", "a", "n", "b"]
        yield pa.RecordBatch.from_arrays([pa.array(token[kept].view(np.int64)), pa.array(doc[kept]), pa.array(n[kept].astype(np.int32)), pa.nulls(int(kept.sum()), pa.int64())], names=names)
        # What the task has connected passes through the shuffle dealt out by its document.
        yield pa.RecordBatch.from_arrays([pa.array(mix(a.astype(np.uint64)).view(np.int64)), pa.array(a), pa.nulls(len(a), pa.int32()), pa.array(b)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, total = WordHashes(), [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                shingles = shingle_set(text, width, hashes)
                token = order.value.beginning(shingles, percent)
                held.append((token, np.full(len(token), doc, np.int64), np.full(len(token), len(shingles), np.int64)))
                total += len(token)
            if total >= FOLD:
                yield from dealt(held)
                held, total = [], 0
        if held:
            yield from dealt(held)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted(rows: pa.Table) -> pa.RecordBatch:
            a, b = size_pairs(rows["token"].to_numpy(), rows["a"].to_numpy(), rows["n"].to_numpy().astype(np.int64), percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))], names=["a", "b", "sure"])

        held, total = [], 0
        for batch in batches:
            known = batch.filter(batch["b"].is_valid())
            yield pa.RecordBatch.from_arrays([known["a"], known["b"], pa.array(np.ones(len(known), bool))], names=["a", "b", "sure"])
            held.append(batch.filter(batch["b"].is_null()))
            total += len(held[-1])
            if total * paired >= PAIRS:
                rows = pa.Table.from_batches(held).combine_chunks()
                token = rows["token"].to_numpy()
                whole = int(np.searchsorted(token, token[-1]))  # the last shingle may go on
                yield emitted(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                total = len(rows) - whole
        if total:
            yield emitted(pa.Table.from_batches(held).combine_chunks())

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy() + batch["m"].to_numpy()
            fits = (100 + percent) * apart(batch["bits"].to_pylist(), batch["others"].to_pylist()) <= (100 - percent) * n
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    arrow_batches(docs.sparkSession)
    # A task that has more than `paired` rows of a shingle has folded them into one.
    same = Window.partitionBy("token")
    found = docs.mapInArrow(rows, "token long, a long, n int, b long")
    found = found.withColumns({"least": F.min(F.when(F.col("b").isNull(), F.col("a"))).over(same), "many": F.count(F.lit(1)).over(same), "most": F.min("n").over(same)})
    star = F.when((F.col("many") > paired) | (F.col("most") < 0), F.col("least"))
    shared = found.where("many > 1 or most < 0 or b is not null").select("token", "a", "n", F.coalesce("b", star).alias("b")).sortWithinPartitions("token", "n", "a")
    met = write_shared(shared.mapInArrow(pairs, "a long, b long, sure boolean").where("a != b").distinct(), "pairs")
    left = sets.select(F.col("doc_id").alias("a"), "n", "bits")
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("others"))
    unsure = met.where("not sure").join(left, "a").join(right, "b").select("a", "b", "n", "m", "bits", "others")
    return unsure.mapInArrow(near, "a long, b long").unionByName(met.where("sure").select("a", "b"))


class Trie:
    """Ordered sets with shared beginnings; edges carry runs of shingles."""

    class Node:
        __slots__ = ("end", "kids", "least", "members", "most", "run", "uniform")

        def __init__(self, run: list[int]):
            self.run, self.kids, self.members = run, {}, []
            self.least, self.most, self.end, self.uniform = 1 << 60, 0, 0, None

    def __init__(self, parent: list[int], percent: int):
        self.root, self.parent, self.percent = Trie.Node([]), parent, percent
        self.sizes: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def insert(self, i: int, tokens: list[int]) -> None:
        node, at, n = self.root, 0, len(tokens)
        node.least, node.most, node.uniform = min(node.least, n), max(node.most, n), None
        while at < n:
            kid = node.kids.get(tokens[at])
            if kid is None:
                kid = node.kids[tokens[at]] = Trie.Node(tokens[at:])
                at = n
            else:
                run = kid.run
                k, most = 1, min(len(run), n - at)
                while k < most and run[k] == tokens[at + k]:
                    k += 1
                if k < len(run):  # split the edge
                    upper = Trie.Node(run[:k])
                    upper.least, upper.most = kid.least, kid.most
                    kid.run = run[k:]
                    upper.kids[kid.run[0]] = kid
                    node.kids[tokens[at]] = kid = upper
                at += k
            kid.least, kid.most, kid.uniform = min(kid.least, n), max(kid.most, n), None
            node = kid
        node.members.append(i)

    def probe(self, i: int, tokens: list[int]) -> list[tuple[int, int]]:
        """Links of set i with members outside its component; each joins the components."""
        mine, n, p = frozenset(tokens), len(tokens), self.percent
        links: list[tuple[int, int]] = []
        least, most = -(-p * n // 100), n * 100 // p

        def walk(node: Trie.Node, depth: int, overlap: int) -> None:
            if node.least > most or node.most < least:
                return
            if node.uniform is not None and self.find(node.uniform) == self.find(i):
                return
            # A set of m shingles in this subtree may miss at most m - overlap asked for; the longest may miss most.
            longest = min(node.most, most)
            may_miss = longest - -(-p * (n + longest) // (100 + p))
            run = node.run
            for k in range(0, len(run), 32):
                part = run[k : k + 32]
                overlap += len(mine.intersection(part))
                depth += len(part)
                if depth - overlap > may_miss:
                    return
            for j in node.members:
                if (100 + p) * overlap >= p * (n + depth) and self.find(i) != self.find(j):
                    self.parent[self.find(i)] = self.find(j)
                    links.append((i, j))
            for kid in node.kids.values():
                walk(kid, depth, overlap)
            if node.uniform is None:
                roots = {self.find(j) for j in node.members} | {-1 if kid.uniform is None else self.find(kid.uniform) for kid in node.kids.values()}
                if len(roots) == 1 and -1 not in roots:
                    node.uniform = roots.pop()

        walk(self.root, 0, 0)
        return links


def slice_links(sets: list[list[int]], sides: list[int], labels: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets that join their components; sets of side 0 are stored, all are probed if there is one side only, else those of side 1."""
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    first = {label: i for i, label in reversed(list(enumerate(labels)))}
    trie = Trie([first[label] for label in labels], percent)
    links: list[tuple[int, int]] = []
    order = sorted(range(len(sets)), key=lambda i: (sides[i], len(sets[i]), i))
    alone = not any(sides)
    for i in order:
        if alone or sides[i]:
            links += trie.probe(i, sets[i])
        if not sides[i]:
            trie.insert(i, sets[i])
    return links


def _join_groups(percent: int, width: int, order: Broadcast | None = None):
    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("doc_id", "ascending")])
        ids, hashes = group["doc_id"].to_pylist(), WordHashes()
        sets = [shingle_set(x, width, hashes) for x in utf8(group["text"])]
        sets = [(np.sort(order.value.ranked(x)) if order else x).tolist() for x in sets]
        links = slice_links(sets, group["side"].to_pylist(), group["label"].to_pylist(), percent)
        a, b = local_stars(*(np.array([ids[link[k]] for link in links], np.int64) for k in (0, 1)))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return join


def with_texts(named: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, grp, slices, slice, text) of the candidates (doc_id, grp, slices; read from storage).

    Candidates are sent to the texts, in lots that fit an executor. Only of more than `LOTS` of them are texts and candidates
    dealt out by id; that shuffles every text, so it is done once and what it gives is stored."""
    lots = -(-chosen.count() // BROADCAST_ROWS)
    lot = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(max(lots, 1)))
    parts = [F.broadcast(chosen.where(lot == k)) for k in range(max(lots, 1))] if lots <= LOTS else [chosen]
    found = reduce(DataFrame.unionByName, (named.join(part, "doc_id").select("doc_id", "grp", "slices", "text") for part in parts))
    found = found.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
    return found if lots <= LOTS else write_shared(found, "candidate-texts")


def group_links(members: DataFrame, sliced: bool, percent: int, width: int = WIDTH, order: Broadcast | None = None) -> DataFrame:
    """(a, b) edges that span the components of links of each group; members: (grp, slices, slice, doc_id, text); sliced: some group has several slices."""
    link = "a long, b long"
    alone = members.select("grp", "slice", "doc_id", "text", F.lit(0).alias("side"), F.col("doc_id").alias("label"))
    links = write_shared(alone.groupBy("grp", "slice").applyInArrow(_join_groups(percent, width, order), link), "links-inside")
    if not sliced:
        return links
    cut = write_shared(members.where("slices > 1"), "sliced")

    def labelled() -> DataFrame:
        known = connected_components(links).withColumnRenamed("id", "doc_id")
        return cut.join(known, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")

    def joined(paired: DataFrame) -> DataFrame:
        return write_shared(paired.select("grp", "lo", "hi", "doc_id", "text", "side", "label").groupBy("grp", "lo", "hi").applyInArrow(_join_groups(percent, width, order), link), "links-across")

    # The first slice of a group with each other one: what is alike throughout is one component after this.
    sides = labelled().withColumn("lo", F.lit(0)).withColumn("side", (F.col("slice") > 0).cast("int"))
    hub = sides.where("slice = 0").withColumn("hi", F.explode(F.sequence(F.lit(1), F.col("slices") - 1)))
    links = links.unionByName(joined(hub.unionByName(sides.where("slice > 0").withColumn("hi", F.col("slice")))))
    # Then the pairs of slices that still hold more than one component; a pair is a pair of numbers, not of documents.
    now = write_shared(labelled().where("slice > 0"), "sliced-labels")
    least = now.groupBy("grp", "slice").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    other = least.select("grp", F.col("slice").alias("other"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    pairs = least.join(other, "grp").where((F.col("slice") < F.col("other")) & (F.least("least", "least2") != F.greatest("most", "most2")))
    pairs = write_shared(pairs.select("grp", F.col("slice").alias("lo"), F.col("other").alias("hi")), "slice-pairs")
    if pairs.isEmpty():
        return links
    low = now.join(pairs.withColumn("slice", F.col("lo")), ["grp", "slice"]).withColumn("side", F.lit(0))
    high = now.join(pairs.withColumn("slice", F.col("hi")), ["grp", "slice"]).withColumn("side", F.lit(1))
    return links.unionByName(joined(low.unionByName(high)))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where(F.col("doc_id").isNotNull())
    sets = write_shared(document_sets(docs, width, percent < SIGNED), "document-sets")
    key = ["n", "s1", "s2"]
    classes = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy(*key).agg(F.min("doc_id").alias("rep"))
    classes = write_shared(classes, "set-classes")

    order = None
    if percent < SIGNED:
        total = sets.agg(F.sum("n").alias("n")).first().n or 0
        sketch = rare_first(named, total, width)
        order = docs.sparkSession.sparkContext.broadcast(sketch)  # at most 2 ** MOST_BITS bytes
        # In a cell for several shingles, one that up to a few times as many texts share may pass for rare.
        edges = beginning_edges(named, sets.where("doc_id is not null"), percent, width, order, max(PAIRED, 4 * (total >> sketch.bits)))
    else:
        edges = candidate_edges(named, percent, width)
    groups = connected_components(edges)
    # A representative of several classes (an id with several versions) counts once.
    chosen = classes.groupBy("rep").agg(F.sum("n").alias("n")).join(groups.withColumnRenamed("id", "rep"), "rep").select("rep", "n", F.col("component").alias("grp"))
    chosen = write_shared(chosen, "grouped")
    # Sizes are written before the join: it then deals both sides anew, and Spark can split a group that holds most rows.
    sizes = write_shared(chosen.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens")).where("size > 1"), "group-sizes")
    slices = F.ceil(F.greatest(F.col("size") / SLICE, F.col("tokens") / SLICE_TOKENS)).cast("int")
    chosen = write_shared(chosen.join(sizes, "grp").select("rep", "grp", slices.alias("slices")), "candidates")

    # Rows that repeat an id are versions of it: the sets of all of them are compared under that id.
    sliced = not chosen.where("slices > 1").isEmpty()
    members = with_texts(named, chosen.withColumnRenamed("rep", "doc_id"))
    linked = connected_components(group_links(members, sliced, percent, width, order)).withColumnRenamed("id", "rep")
    labelled = classes.join(linked, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return sets.join(labelled, key, "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op6_jaccard_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
