"""Token ids in files of fixed-width bits.

Every id takes the bits that the largest id of the vocabulary needs. 64 ids of w bits fill exactly w 64-bit words, so
ids are packed and unpacked by vectorised shifts of such groups, and the place of any id follows from its number. A
file holds blocks of `BLOCK_IDS` ids, each with its offset, and documents with their starts: one document, or any span
of ids, is read by fetching its blocks alone.

Documents are dealt by ranges of their id, so files ascend as ids do and no range is a single task for the sake of one
id. A task encodes the texts of its range as they pass and closes a file after `file_ids` ids; it holds one batch of
texts and one file's packed words. Files go to the shared folder under a name of their own for each attempt, and only
those that the committed manifest names count, so lost executors and repeated tasks leave nothing wrong behind. The
manifest has a row for each file; a running sum over it gives the ids before each.

File, little-endian: magic (8 bytes); bits, ids of a block (uint32 each); numbers of ids, documents and blocks (uint64
each); document ids (int64) and flags of the null ones (uint8, filled up to 8 bytes); first id of each document and one
more (uint64); byte offset of each block in the words and one more (uint64); words.

A null text counts as empty, and an empty one is its end id alone. Rows that repeat an id follow one another in the
order of the scan; null ids come first. Texts of any length are encoded whole, and a document is never cut between
files. An empty table writes no file and gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import byte_characters
from tessera.llm.common import Folder, arrow_batches, released, shared_dir, shuffle_width, table, write_shared

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"TOKBITS1"
_HEAD = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 8192
#: Ids after which a file is closed: 128 MB at 16 bits.
FILE_IDS = 64 << 20
#: Ids that a reader unpacks at a time.
READ_IDS = 1 << 20
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"


# Packing


def bits_for(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """uint64 words that hold the ids, `bits` bits each, the first in the lowest; filled up to a multiple of 64 ids."""
    groups = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(groups), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= groups[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= groups[:, j] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids (uint32) of packed words."""
    rows = words.reshape(-1, bits)
    out, mask = np.empty((len(rows), 64), np.uint32), np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | rows[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


class FileBuilder:
    """The content of one file: whole blocks are packed as they fill."""

    def __init__(self, bits: int, block_ids: int = BLOCK_IDS):
        self.bits, self.block_ids = bits, block_ids
        self.doc_ids: list[int | None] = []
        self.starts, self.words, self.n_words, self.offsets = [0], [], 0, [0]
        self.rest: list[np.ndarray] = []
        self.n_rest = 0

    @property
    def n_ids(self) -> int:
        return self.starts[-1]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {int(ids.max())} does not fit into {self.bits} bits")
        self.doc_ids.append(doc_id)
        self.starts.append(self.n_ids + len(ids))
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= 16 * self.block_ids:
            self._close(self.n_rest // self.block_ids * self.block_ids)

    def _close(self, n: int) -> None:
        """Packs the first n of the ids that wait: whole blocks, but for the last of the file."""
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        self.words.append(pack(ids[:n], self.bits))
        done = self.n_words
        self.n_words += len(self.words[-1])
        full = self.block_ids // 64 * self.bits
        self.offsets += [8 * min(done + (i + 1) * full, self.n_words) for i in range(-(-n // self.block_ids))]
        self.rest, self.n_rest = [ids[n:].copy()], len(ids) - n

    def content(self) -> Iterator[memoryview]:
        """The file, piece by piece."""
        self._close(self.n_rest)
        flags = np.array([d is None for d in self.doc_ids], np.uint8)
        flags = np.concatenate([flags, np.zeros(-len(flags) % 8, np.uint8)])
        head = _HEAD.pack(MAGIC, self.bits, self.block_ids, self.n_ids, len(self.doc_ids), len(self.offsets) - 1)
        parts = [np.array([d or 0 for d in self.doc_ids], "<i8"), flags, np.array(self.starts, "<u8"), np.array(self.offsets, "<u8"), *(w.astype("<u8", copy=False) for w in self.words)]
        yield memoryview(head)
        yield from (p.data.cast("B") for p in parts if p.size)


class PackedFile:
    """Reads a file: its documents, and any span of its ids by fetching the blocks that hold it."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        magic, self.bits, self.block_ids, self.n_ids, n_docs, n_blocks = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        at = _HEAD.size

        def part(n: int, kind: str) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            out = np.frombuffer(self.file.read_at(size, at), kind)
            at += size
            return out

        self.doc_ids, flags = part(n_docs, "<i8"), part(n_docs + -n_docs % 8, "u1")
        self.null, self.starts, self.offsets = flags[:n_docs].astype(bool), part(n_docs + 1, "<u8").astype(np.int64), part(n_blocks + 1, "<u8").astype(np.int64)
        self.at = at

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from number `start` up to `stop` of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        a, b = self.offsets[first], self.offsets[last + 1]
        words = np.frombuffer(self.file.read_at(int(b - a), int(self.at + a)), "<u8")
        skip = first * self.block_ids
        return unpack(words, self.bits, stop - skip)[start - skip :]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, read_ids: int = READ_IDS) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of each document, unpacking about `read_ids` ids at a time."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + read_ids, "right")) - 1)
            ids = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                yield k, ids[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]]
            i = j

    def close(self) -> None:
        self.file.close()


# Encoding


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


class ByteBpe:
    """Ids of a byte-level BPE file, as the tokenizers library gives them.

    Where ids of merged tokens ascend as merges do, the same vocabulary is run as ranks, which takes a fifth of the time;
    other files, and texts that this refuses (a million blanks in a row), go to the tokenizers library itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        vocab, specials = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.largest = max([*vocab.values(), *specials.values()])
        raw = {c: b for b, c in enumerate(byte_characters())}
        pre, merged = spec["pre_tokenizer"] or {}, [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        ordinary = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"] and not spec["model"].get("ignore_merges")
        ordinary = ordinary and all(not x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        single = [vocab.get(c, -1) for c in raw]
        self.ranks = None
        if ordinary and min(single) >= 0 and merged == sorted(set(merged)) and merged[:1] > [max(single)] and len(merged) + 256 == len(vocab):
            # Fixed value: the pattern that a byte-level pre-tokenizer splits text by.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={bytes(raw[c] for c in token): i for token, i in vocab.items()}, special_tokens=specials)

    def encode(self, text: str) -> np.ndarray:
        if self.ranks:
            try:
                return self.ranks.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except ValueError:
                pass
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def pack_documents(
    docs: DataFrame, path: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encodes and writes all texts; the manifest (part, seq, file, n_docs, n_ids), whose files ascend by (part, seq)."""
    if block_ids % 64:
        raise ValueError("a block holds a multiple of 64 ids")
    spark = docs.sparkSession
    path = path or default_tokenizer()
    bits = bits_for(max(byte_bpe(path).largest, end_id or 0))
    arrow_batches(spark)
    folder = f"{shared_dir(spark)}/packed-ids-{uuid.uuid4().hex}"
    Folder(spark, f"{folder}/files").write("about.json", json.dumps({"bits": bits, "block_ids": block_ids}))  # also makes the folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, model, seq = TaskContext.get(), byte_bpe(path), 0
        store, root = fs.FileSystem.from_uri(f"{folder}/files")
        end = np.array([] if end_id is None else [end_id], np.uint32)
        built = FileBuilder(bits, block_ids)

        def stored() -> pa.RecordBatch:
            nonlocal seq, built
            name = f"{task.partitionId():06d}-{seq:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bits"
            with store.open_output_stream(f"{root}/{name}") as out:
                for piece in built.content():
                    out.write(piece)
            row = {"part": task.partitionId(), "seq": seq, "file": f"{folder}/files/{name}", "n_docs": len(built.doc_ids), "n_ids": built.n_ids}
            seq, built = seq + 1, FileBuilder(bits, block_ids)
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in released(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                built.add(doc_id, np.concatenate([model.encode(text or ""), end]))
                if built.n_ids >= file_ids:
                    yield stored()
        if built.doc_ids:
            yield stored()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "text")
    return write_shared(dealt.mapInArrow(write, MANIFEST), "packed-manifest")


def read_documents(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids array<int>) of every document, read from the files; without ids where they are not asked for."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("file", "first")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = PackedFile(uri)
                rows: list[tuple] = []
                held = 0
                for k, found in file.documents():
                    raw = found.astype("<u4", copy=False)
                    rows.append((None if file.null[k] else int(file.doc_ids[k]), first + int(file.starts[k]), len(raw), zlib.crc32(raw.tobytes()), raw))
                    held += len(raw) if ids else 16
                    if held >= READ_IDS:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)
                file.close()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32()))] if ids else [])
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    # A row is some bytes, but stands for a file: a fixed number of tasks, which is not made smaller by the size of the rows.
    return files.repartition(shuffle_width(manifest.sparkSession)).mapInArrow(read, schema)


def op12_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(pack_documents(table(spark, sf_dir, "documents")), ids=False)
