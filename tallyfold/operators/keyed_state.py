"""A table by key that an import only touches: sorted runs of files, each with its least and greatest key and a Bloom filter.

An import appends a run of its own rows; a key's newest row counts. Looking keys up reads those files only whose range and
filter say that they may hold one of them. Runs are merged as they grow: an import takes with it the newest runs until the next is
at least twice as large as all that it holds, so a row is rewritten a logarithmic number of times and there are as many
runs at most. What a table consists of is its manifest, a list of files, which the caller keeps with a commit.

A filter is blocked: a key sets BITS_SET bits of one block of 32,768 bits, and a block is a row of its own, so filters are
built and asked by joins on (file, block), however large the file or the import.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks

KEY = "_key"
FILE_ROWS = 250_000  # of a file, about
BLOCK_BITS = 32_768  # of a bitmap of Spark's bitmap functions
BITS_PER_KEY = 12
BITS_SET = 3


@dataclass
class File:
    path: str
    low: str
    high: str
    rows: int
    blocks: int


@dataclass
class Run:
    path: str
    files: list[File] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.files)


@dataclass
class Manifest:
    """Runs, oldest first."""

    runs: list[Run] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, separators=(",", ":"))

    @staticmethod
    def from_json(text: str) -> Manifest:
        return Manifest([Run(r["path"], [File(**f) for f in r["files"]]) for r in json.loads(text)["runs"]])

    def files(self) -> list[File]:
        return [f for r in self.runs for f in r.files]


def key_of(columns: list[str]) -> Column:
    """One text that orders and tells apart keys of several columns; a null is like a blank."""
    return F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _positions(digest: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(digest, 4 + 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(BITS_SET)])


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int"))


class KeyedState:
    """``rows`` of a table have the key columns, a version (greater is newer) and whatever else."""

    def __init__(self, spark: SparkSession, keys: list[str], version: str, schema: str, file_rows: int = FILE_ROWS):
        self.spark, self.keys, self.version, self.schema, self.file_rows = spark, keys, version, schema, file_rows

    # ------------------------------------------------------------------------------------------ reading

    def _load(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, {KEY} string")
        return self.spark.read.schema(f"{self.schema}, {KEY} string").parquet(*paths)

    def _newest(self, rows: DataFrame) -> DataFrame:
        from .dedup import last_wins

        return last_wins(rows, [KEY], self.version)

    def all(self, manifest: Manifest) -> DataFrame:
        """Every key's newest row."""
        return self._newest(self._load([r.path + "/rows" for r in manifest.runs])).drop(KEY)

    def touched(self, manifest: Manifest, keys: DataFrame) -> list[File]:
        """The files that may hold any of the keys: by range, then by filter. The driver gets names of files only. A table
        of less than a file's rows is read as it is."""
        if sum(r.rows for r in manifest.runs) <= self.file_rows:
            return manifest.files()
        runs = [(r.path, [f.low for f in r.files], [f.high for f in r.files], [f.path for f in r.files], [f.blocks for f in r.files]) for r in manifest.runs if r.files]
        if not runs:
            return []
        held = self.spark.sparkContext.broadcast(runs)  # the list of files

        def assign(batches):
            for batch in batches:
                names, digests = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                files, blocks, mine = [], [], []
                for _, lows, highs, paths, sizes in held.value:
                    for k, name in enumerate(names):
                        at = bisect.bisect_right(lows, name) - 1
                        if at >= 0 and name <= highs[at]:
                            files.append(paths[at])
                            blocks.append(int(np.uint64(digests[k]) >> np.uint64(49)) % sizes[at])
                            mine.append(digests[k])
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(blocks, pa.int64()), pa.array(mine, pa.int64())], ["file", "block", "digest"])

        asked = keys.select(key_of(self.keys).alias(KEY)).select(KEY, F.xxhash64(KEY).alias("digest")).mapInArrow(assign, "file string, block long, digest long")
        filters = self.spark.read.schema("file string, block long, bits binary").parquet(*[r.path + "/filters" for r in manifest.runs if r.files])
        hit = F.lit(True)
        spots = _positions(F.col("digest"))
        for k in range(BITS_SET):
            hit = hit & (_bit(F.col("bits"), spots[k]) == 1)
        found = {r["file"] for r in asked.join(filters, ["file", "block"]).where(hit).select("file").distinct().collect()}
        return [f for f in manifest.files() if f.path in found]

    def lookup(self, manifest: Manifest, keys: DataFrame) -> DataFrame:
        """The newest row of each of the keys that the table has."""
        files = self.touched(manifest, keys)
        rows = self._load([f.path for f in files]).join(keys.select(key_of(self.keys).alias(KEY)).distinct(), KEY, "left_semi")
        return self._newest(rows).drop(KEY)

    # ------------------------------------------------------------------------------------------ writing

    def append(self, manifest: Manifest, rows: DataFrame, path: str) -> Manifest:
        """The manifest with ``rows`` (one a key) as the newest; a new run is written at ``path``, nothing else changes."""
        rows = rows.select(*self.names(), key_of(self.keys).alias(KEY))
        size = total = rows.count()
        if not size:
            return manifest
        kept, merged = list(manifest.runs), []
        while kept and kept[-1].rows < 2 * total:
            merged.append(kept.pop())
            total += merged[-1].rows
        if merged:
            rows = self._newest(rows.unionByName(self._load([r.path + "/rows" for r in merged])))
        return Manifest([*kept, self._write(rows, path, total)])

    def names(self) -> list[str]:
        from pyspark.sql.types import StructType

        return StructType.fromDDL(self.schema).names

    def _write(self, rows: DataFrame, path: str, size: int) -> Run:
        parts = max(1, -(-size // self.file_rows))
        rows.repartitionByRange(parts, KEY).sortWithinPartitions(KEY).write.mode("overwrite").parquet(f"{path}/rows")
        keys = self.spark.read.schema(f"{KEY} string").parquet(f"{path}/rows").select(KEY, F.input_file_name().alias("file"))
        found = keys.groupBy("file").agg(F.min(KEY).alias("low"), F.max(KEY).alias("high"), F.count(F.lit(1)).alias("rows")).orderBy("low").collect()
        files = [File(r["file"], r["low"], r["high"], r["rows"], -(-r["rows"] * BITS_PER_KEY // BLOCK_BITS)) for r in found]
        sizes = F.broadcast(self.spark.createDataFrame([(f.path, f.blocks) for f in files], "file string, blocks long"))  # the list of files
        digest = F.xxhash64(KEY)
        block = F.shiftrightunsigned(digest, 49) % F.col("blocks")
        spread = keys.join(sizes, "file").select("file", block.alias("block"), F.explode(_positions(digest)).alias("at"))
        spread.groupBy("file", "block").agg(F.bitmap_construct_agg("at").alias("bits")).write.mode("overwrite").parquet(f"{path}/filters")
        return Run(path, files)

    def drop_unused(self, old: Manifest, kept: list[Manifest]) -> None:
        """Removes the runs of ``old`` that none of ``kept`` has."""
        used = {r.path for m in kept for r in m.runs}
        for r in old.runs:
            if r.path not in used:
                sinks.remove(self.spark, r.path)
