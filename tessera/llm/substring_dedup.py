"""Substring dedup of word windows with a log-structured fingerprint index.

The index keeps the first occurrence of every block of windows (see `anchors`) that it has seen, in immutable
runs: each a folder of buckets by fingerprint, sorted by fingerprint within a bucket. A new batch of documents is
hashed, shuffled once into the same buckets, sorted, and merge-joined with each run as it lies on disk: the
history is neither shuffled nor sorted again. The join tells repeats of an earlier block, blocks whose windows
have to be compared one by one with those of other blocks with the same anchor, and new blocks, which become the
next run. `verify` reads the texts of the blocks to be compared again, batch and history alike, and settles each
window on two independent 64-bit hashes of its words. When there are more than `max_runs` runs, the two
neighbours with the fewest rows are merged into one and deleted once the manifest names the new run. A manifest
in the index's folder, replaced as a whole after each step, lets a later job open the index and add to it; a job
that died leaves at most an unnamed folder.

Batches come in ascending order of doc_id; one that starts at or before the index's last id is refused. A word is
removed if it lies in a window of `width` words whose word sequence also starts earlier. Null texts count as
empty; texts shorter than a window are kept whole; rows that repeat a doc_id are versions of one document, each
loses what any of them would, and the same place is not earlier than itself; rows with null doc_id are kept whole
and are nobody's source; an empty table gives an empty result; a text of any length is hashed in overlapping
parts, its words are held whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.anchors import BLOCK, FOLD, Rolling, block_rows, judged, merged_runs, mix, parts, span_arrays, with_spans
from tessera.llm.bpe import utf8
from tessera.llm.common import Folder, Memo, arrow_batches, session_conf, shared_dir, shuffle_width, table

WIDTH, GRAM = 20, 5
#: Batches of the query, and runs that it lets stand.
BATCHES, MAX_RUNS = 3, 1


class WordHashes(Memo):
    """64-bit hashes of words."""

    def __init__(self):
        super().__init__(xxhash.xxh64_intdigest)

    def sequence(self, raw: bytes | None) -> np.ndarray:
        words = (raw or b"").split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_blocks(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows of `BLOCK` over the words of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        texts = ((b.column(0).to_pylist(), [hashes.sequence(x) for x in utf8(b.column(1))]) for b in batches)
        yield from block_rows(texts, width, gram)

    arrow_batches(docs.sparkSession)
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, BLOCK)


_RUN = "ha long, hb long, doc_id long, start long, n int, open boolean"
_SPAN = "doc_id long, start long, n int"


class FingerprintIndex:
    """Sorted runs of block fingerprints in `home`, which is opened if it holds an index and made otherwise."""

    def __init__(self, spark: SparkSession, home: str | None = None, width: int = WIDTH, gram: int = GRAM, buckets: int | None = None, max_runs: int = 4):
        self.spark, self.home, self.max_runs = spark, home or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}", max_runs
        self.folder = Folder(spark, self.home)
        found = [x for x in self.folder.names() if x.startswith("manifest-")]
        new = {"width": width, "gram": gram, "buckets": buckets or shuffle_width(spark), "last_id": None, "runs": [], "batches": []}
        self.state, self.version = (json.loads(self.folder.read(found[-1])), int(found[-1].split("-")[1])) if found else (new, 0)
        if (self.state["width"], self.state["gram"]) != (width, gram):
            raise ValueError("the index holds windows of another width")
        self.tables: dict[str, str] = {}

    def _commit(self, **change) -> None:
        self.state = {**self.state, **change}
        self.version += 1
        self.folder.write(f"manifest-{self.version:09d}", json.dumps(self.state))

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed and sorted table, known to this session's catalog by a name of its own."""
        if name not in self.tables:
            self.tables[name] = f"run_{uuid.uuid4().hex}"
            columns = ", ".join(x.replace(" long", " bigint") for x in _RUN.split(", "))
            self.spark.sql(f"CREATE TABLE {self.tables[name]} ({columns}) USING parquet CLUSTERED BY (ha) SORTED BY (ha, hb) INTO {self.state['buckets']} BUCKETS LOCATION '{self.home}/{name}/kind=first'")
        return self.spark.table(self.tables[name])

    def _write(self, rows: DataFrame, name: str) -> None:
        """Rows dealt by ha (and a column kind) into bucket files; the catalog forgets them at once."""
        made = f"made_{uuid.uuid4().hex}"
        rows.write.partitionBy("kind").bucketBy(self.state["buckets"], "ha").sortBy("ha", "hb").format("parquet").option("path", f"{self.home}/{name}").saveAsTable(made)
        self.spark.sql(f"DROP TABLE {made}")

    def merging(self):
        """Lets Spark use the runs' order and bucketing as they are."""
        return session_conf(
            self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__requireAllClusterKeysForCoPartition="false", spark__sql__execution__replaceHashWithSortAgg="true"
        )

    def merged(self, new: DataFrame) -> DataFrame:
        """A batch's judged blocks, dealt by ha, after a merge join with every run: adds to `repeat` and `open`."""
        runs = [self.run(r["name"]) for r in self.state["runs"]]
        for k, old in enumerate(runs):
            new = new.join(old.select("ha", "hb", F.lit(True).alias(f"seen{k}")).hint("merge"), ["ha", "hb"], "left")
        for k, old in enumerate(runs):
            new = new.join(old.select("ha").distinct().withColumn(f"met{k}", F.lit(True)).hint("merge"), "ha", "left")
        seen, met = (F.coalesce(*(F.col(f"{c}{k}") for k in range(len(runs))), F.lit(False)) for c in ("seen", "met"))
        repeat = F.col("repeat") | seen
        new = new.select("ha", "hb", "doc_id", "start", "n", repeat.alias("repeat"), (~repeat & (F.col("open") | met)).alias("open"))
        return new

    def add(self, docs: DataFrame) -> None:
        """Judges a batch of documents (doc_id, text) against all before it and appends it to the index."""
        ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
        if ends.lo is None:
            return
        last = self.state["last_id"]
        if last is not None and ends.lo <= last:
            raise ValueError(f"documents up to {last} are in the index already, the batch starts at {ends.lo}")
        self.compact()
        name, buckets = f"batch-{uuid.uuid4().hex}", self.state["buckets"]
        blocks = judged(word_blocks(docs, self.state["width"], self.state["gram"]), buckets).drop("known")
        with self.merging():
            self._write(self.merged(blocks).withColumn("kind", F.when(F.col("repeat"), "repeat").otherwise("first")).drop("repeat"), name)
            runs = self.state["runs"]
            if self.folder.has(f"{name}/kind=first"):
                asked = self.run(name).where("open").select("ha").distinct()
                sources = [self.run(r["name"]).join(asked.hint("merge"), "ha", "left_semi").select("doc_id", "start", "n") for r in runs]
                if sources:
                    reduce(DataFrame.unionByName, sources).write.parquet(f"{self.home}/{name}/sources")
                runs = [*runs, {"name": name, "rows": self.run(name).count()}]
        self._commit(runs=runs, batches=[*self.state["batches"], name], last_id=ends.hi)

    def compact(self) -> None:
        """Merges neighbouring runs until at most `max_runs` are left; a run's blocks are in no other run."""
        while len(self.state["runs"]) > self.max_runs:
            runs = self.state["runs"]
            k = min(range(len(runs) - 1), key=lambda i: runs[i]["rows"] + runs[i + 1]["rows"])
            name = f"run-{uuid.uuid4().hex}"
            with self.merging():
                a, b = (self.run(r["name"]) for r in runs[k : k + 2])
                both = a.alias("a").join(b.alias("b").hint("merge"), ["ha", "hb"], "full_outer")
                rest = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("doc_id", "start", "n", "open")]
                self._write(both.select("ha", "hb", *rest, F.lit("first").alias("kind")), name)
            kept = {"name": name, "rows": runs[k]["rows"] + runs[k + 1]["rows"]}
            self._commit(runs=[*runs[:k], kept, *runs[k + 2 :]])
            for r in runs[k : k + 2]:
                self._forget(r["name"])

    def _forget(self, name: str) -> None:
        """Deletes a run; which blocks of a batch were open, and which repeat, stays."""
        opened = self.run(name).where("open").select("doc_id", "start", "n")
        if name in self.state["batches"]:
            opened.write.parquet(f"{self.home}/{name}/open")
        self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
        self.folder.remove(f"{name}/kind=first")

    def _spans(self, name: str, part: str) -> DataFrame:
        path = f"{name}/{part}"
        return (self.spark.read.schema(_SPAN).parquet(f"{self.home}/{path}") if self.folder.has(path) else self.spark.createDataFrame([], _SPAN)).select("doc_id", "start", "n")

    def verdicts(self, batches: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(doc_id, start, n) of whole repeats, and of the blocks whose windows have to be compared; of all batches, or of some."""
        names = self.state["batches"] if batches is None else batches
        repeats = [self.spark.createDataFrame([], _SPAN), *(self._spans(b, "kind=repeat") for b in names)]
        opened = [self.spark.createDataFrame([], _SPAN)]
        for b in names:
            first = self.spark.read.schema(_RUN).parquet(f"{self.home}/{b}/kind=first").where("open").select("doc_id", "start", "n") if self.folder.has(f"{b}/kind=first") else self._spans(b, "open")
            opened += [first, self._spans(b, "sources")]
        return reduce(DataFrame.unionByName, repeats), reduce(DataFrame.unionByName, opened)


WINDOW = "h1 long, h2 long, doc_id long, start long, length long, known boolean"


def folded_windows(found: list[tuple[np.ndarray, ...]], width: int) -> pa.RecordBatch:
    """Rows of `WINDOW`; windows that an earlier one of the task repeats are `known`, runs of them come as one row each."""
    h1, h2, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, doc, h2, h1))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    same = np.r_[False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])] if len(h1) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h1))))
    known = (doc != doc[lead]) | (start != start[lead])
    d, p = doc[known], start[known]
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)]) if len(d) else np.zeros(0, np.int64)
    length = p[np.r_[head[1:], len(d)][: len(head)] - 1] - p[head] + width if len(d) else head
    # Known ones need no hashes: small numbers, which deal them out evenly, take less room in the shuffle.
    key = mix(d[head].astype(np.uint64) + mix(p[head].astype(np.uint64))) >> np.uint64(50)
    n = int((~known).sum())
    cols = [
        pa.array(np.r_[h1[~known], key].view(np.int64)), pa.array(np.r_[h2[~known], np.zeros(len(head), np.uint64)].view(np.int64)), pa.array(np.r_[doc[~known], d[head]]),
        pa.array(np.r_[start[~known], p[head]]), pa.array(np.r_[np.full(n, width, np.int64), length]), pa.array(np.arange(n + len(head)) >= n),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in WINDOW.split(", ")])


def open_windows(docs: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """Rows of `WINDOW`, for each window of the open blocks (doc_id, start, n), hashed from the texts."""
    asked = blocks.groupBy("doc_id").agg(F.collect_set(F.struct("start", F.col("n").alias("length"))).alias("spans"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        found: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for doc, raw, spans in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = hashes.sequence(raw)
                start, end = merged_runs(*span_arrays(spans))
                wanted = np.concatenate([np.arange(a, b) for a, b in zip(start, end, strict=True)])
                for (_, a, b), *_ in parts([len(words)], width):
                    at = wanted[(wanted >= a) & (wanted <= b - width)] - a
                    found.append((*(Rolling(words[a:b], k).spans(at, width) for k in (0, 1)), np.full(len(at), doc), at + a))
                    n += len(at)
            if n >= FOLD:
                yield folded_windows(found, width)
                found, n = [], 0
        if found:
            yield folded_windows(found, width)

    arrow_batches(docs.sparkSession)
    return docs.join(asked, "doc_id").select("doc_id", "text", "spans").mapInArrow(rows, WINDOW)


def repeated_spans(docs: DataFrame, repeats: DataFrame, opened: DataFrame, width: int) -> DataFrame:
    """(doc_id, start, length) of everything to remove; docs: (doc_id, text) of all documents that are named."""
    whole = repeats.select("doc_id", "start", (F.col("n") + F.lit(width - 1)).cast("long").alias("length"))
    windows = open_windows(docs, opened, width)
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "start"))
    later = windows.withColumn("place", place).where(F.col("known") | (F.col("place") > 1))
    return whole.unionByName(later.select("doc_id", "start", "length"))


def remove_words(docs: DataFrame, spans: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and with `texts` the kept words joined by one space."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha, kept = [], [], [], []
            for raw, found in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = (raw or b"").split()
                n.append(len(words))
                start, end = merged_runs(*span_arrays(found))
                end = np.minimum(end, len(words))
                gone.append(int(np.maximum(end - start, 0).sum()))
                left = b" ".join([w for a, b in zip([0, *end.tolist()], [*start.tolist(), len(words)], strict=True) for w in words[a:b]])
                sha.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(left.decode("utf-8"))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] * texts)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts])

    arrow_batches(docs.sparkSession)
    return with_spans(docs, spans).mapInArrow(rows, schema)


def substring_dedup(docs: DataFrame, batches: int = BATCHES, width: int = WIDTH, gram: int = GRAM, max_runs: int = MAX_RUNS, texts: bool = False) -> DataFrame:
    """Adds documents to a fresh index in `batches` ranges of doc_id and removes repeated windows."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    index = FingerprintIndex(spark, None, width, gram, None, max_runs)
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = docs
        if lo is not None:
            part = part.where(F.col("doc_id") > int(lo))
        if hi is not None:
            part = part.where(F.col("doc_id") <= int(hi))
        index.add(part)
    return remove_words(docs, repeated_spans(docs, *index.verdicts(), width), texts)


def op10_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
