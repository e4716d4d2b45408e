"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these.
ASCII_SPACE = b" \t\n\r\x0b\x0c"
#: Rows and bytes of an Arrow batch at most; only a single longer text makes a larger one.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"
#: Bytes that a task's memory of words holds before it starts afresh.
MEMO_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches that Python workers get from now on, for the whole session: plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write_shared(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes a DataFrame to the shared folder, into a folder for each value of `by`, and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (n, other columns; read from storage) whose n is greater than that of all but at most `most`.

    A histogram of n finds the least count (beyond 256: the least sixteenth of an octave) from which on at most `most` rows
    are left, so that what is collected of them does not grow with the number of partitions."""
    level = F.when(F.col("n") < 256, F.col("n")).otherwise(256 + F.floor(16 * F.log2(F.col("n") / 256)))
    left, cut = most, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most some 900 levels
        left -= r["count"]
        if left < 0:
            cut = r.level
            break
    return counts.where(level > cut)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Deletes what `write_shared` wrote for these tables, or one folder (name=value) of each, once nothing that has yet to run reads it."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not folder.endswith(part):
                continue
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, after the worker has given back what its allocators keep from former tasks.

    Python workers are used again and again; without this a worker that once held 500 MB stays that large."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library of this system may have no such call
        ctypes.CDLL(None).malloc_trim(0)
    yield from batches


@contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings (with __ for .) for what runs inside; the old ones come back."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class Folder:
    """A folder in the shared store: small text files, and removal of what is in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(""))) if self.fs.exists(self._at("")) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Under another name first, so that a reader sees all of it or nothing."""
        out = self.fs.create(self._at(f".{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self._at(f".{name}.tmp"), self._at(name)):
            raise OSError(f"{self.path}/{name} is there already")

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Memo(dict):
    """Values of words, made by `make` and remembered up to `most` bytes; one for each task, so that it ends with the task."""

    def __init__(self, make, entry_bytes: int = 150, most: int = MEMO_BYTES):
        self.make, self.held, self.entry_bytes, self.most = make, 0, entry_bytes, most

    def __missing__(self, word: bytes):
        if self.held >= self.most:
            self.clear()
            self.held = 0
        made = self[word] = self.make(word)
        self.held += len(word) + self.entry_bytes
        return made


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: bytes) -> bytes:
    """bytes.lower() touches A-Z only."""
    return text.lower()


def share_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Puts bytes into the shared folder and hands the file to every executor; returns the name for SparkFiles.get()."""
    jvm = spark.sparkContext._jvm
    name = f"{name}-{uuid.uuid4().hex}"
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name
