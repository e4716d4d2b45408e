"""A cache of panels by symbol and range of dates.

A manifest names, for each symbol, the ranges that are held and the folder of rows that each came with. A request reads
what is held and loads only the ranges that are missing; rows are written first, then a new version of the manifest is put
in place by one rename. A writer that dies in between leaves a folder that no manifest names; of two writers the second finds
its version taken, and starts over from the first one's manifest. Rows stay in Spark; the manifest is a line for each range."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Range = tuple[date, date]
Load = Callable[[DataFrame], DataFrame]
#: A range counts as held only if it came with more rows than this for each symbol that was asked for.
LEAST_ROWS = 50


def missing_ranges(asked: Range, held: list[Range]) -> list[Range]:
    """The parts of a range (both ends included) that no held range covers, in order."""
    out, at, day = [], asked[0], timedelta(days=1)
    for lo, hi in sorted(held):
        if hi < at or lo > asked[1]:
            continue
        if lo > at:
            out.append((at, lo - day))
        at = hi + day
        if at > asked[1]:
            return out
    return [*out, (at, asked[1])] if at <= asked[1] else out


class PanelCache:
    """Panels (symbol, date, ...) kept under `path`. `load` gives the rows of (symbol, lo, hi): any DataFrame of source rows."""

    def __init__(self, spark: SparkSession, path: str, load: Load, least_rows: int = LEAST_ROWS):
        self.spark, self.path, self.load, self.least_rows = spark, path.rstrip("/"), load, least_rows
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        if not self.fs.exists(self._at("")):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self._at(""))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> tuple[int, dict[str, list[tuple[date, date, str]]]]:
        """Number of the newest version (0 for none), and its ranges with their folders by symbol."""
        found = self._versions()
        if not found:
            return 0, {}
        stream = self.fs.open(self._at(f"manifest-{found[-1]:08d}.json"))
        try:
            held = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return found[-1], {s: [(date.fromisoformat(a), date.fromisoformat(b), f) for a, b, f in rows] for s, rows in held.items()}

    def _publish(self, version: int, held: dict[str, list[tuple[date, date, str]]]) -> bool:
        """Puts a version in place; False if another writer was first."""
        draft = self._at(f".draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps({s: [(a.isoformat(), b.isoformat(), f) for a, b, f in rows] for s, rows in held.items()}).encode()))
        out.close()
        place = self._at(f"manifest-{version:08d}.json")
        if not self.fs.exists(place) and self.fs.rename(draft, place):
            return True
        self.fs.delete(draft, False)
        return False

    def fetch(self, symbols: list[str], lo: date, hi: date, tries: int = 5) -> DataFrame:
        """The rows of the symbols from lo to hi, loaded where they are not held."""
        for _ in range(tries):
            version, held = self.manifest()
            todo = [(s, a, b) for s in dict.fromkeys(symbols) for a, b in missing_ranges((lo, hi), [r[:2] for r in held.get(s, [])])]
            if not todo:
                return self._read(symbols, lo, hi, held)
            folder = f"rows-{uuid.uuid4().hex}"
            asked = self.spark.createDataFrame(todo, "symbol string, lo date, hi date")
            self.load(asked).join(F.broadcast(asked.select("symbol").distinct()), "symbol", "left_semi").write.parquet(f"{self.path}/{folder}")  # a row for each symbol asked for
            counts = {r.symbol: r["count"] for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy("symbol").count().collect()}  # only symbols that were asked for
            now = {s: list(rows) for s, rows in held.items()}
            for s, a, b in todo:
                if counts.get(s, 0) > self.least_rows:
                    now.setdefault(s, []).append((a, b, folder))
            if self._publish(version + 1, now):
                short = [t for t in todo if counts.get(t[0], 0) <= self.least_rows]
                got = self._read(symbols, lo, hi, now)
                if not short:
                    return got
                # Too few rows to be kept as an answer: they are given, and asked for again the next time.
                return got.unionByName(self._within(self.spark.read.parquet(f"{self.path}/{folder}"), short))
        raise RuntimeError("other writers were always first")

    def _within(self, rows: DataFrame, ranges: list[tuple[str, date, date]]) -> DataFrame:
        of = self.spark.createDataFrame(ranges, "symbol string, _lo date, _hi date")
        return rows.join(F.broadcast(of), "symbol").where("date between _lo and _hi").drop("_lo", "_hi")  # a row for each range asked for

    def _read(self, symbols: list[str], lo: date, hi: date, held: dict) -> DataFrame:
        by_folder: dict[str, list[tuple[str, date, date]]] = {}
        for s in dict.fromkeys(symbols):
            for a, b, folder in held.get(s, []):
                if a <= hi and b >= lo:
                    by_folder.setdefault(folder, []).append((s, max(a, lo), min(b, hi)))
        if not by_folder:
            schema = self.load(self.spark.createDataFrame([], "symbol string, lo date, hi date")).schema
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, (self._within(self.spark.read.parquet(f"{self.path}/{f}"), r) for f, r in by_folder.items()))


def load_from(source: DataFrame) -> Load:
    """Loads ranges from a table of bars."""

    def load(asked: DataFrame) -> DataFrame:
        return source.join(F.broadcast(asked), "symbol").where("date between lo and hi").drop("lo", "hi")  # a row for each range asked for

    return load
