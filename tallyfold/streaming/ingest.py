"""Structured Streaming: landed windows merged into a table of rows, and bundles ingested once each."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import merge_windows
from ..operators.ledger import Ledger
from ..sources import sinks


def stream_windows(spark: SparkSession, landing: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(landing)


def merge_stream(rows: DataFrame, key: str, table: str, checkpoint: str, text: str | None = "text_original", once: bool = True) -> StreamingQuery:
    """Merges micro-batches of rows (with ``_ord``, later batches behind earlier ones) field by field; ``current`` reads the
    merged table.

    A table is the parts that its last manifest lists, oldest first. A batch is merged in itself and becomes the newest part;
    it takes with it the parts before it until the next is at least twice as large, so what a batch writes follows its
    rows, a row is rewritten a logarithmic number of times, and there are as many parts at most. A manifest is written when its parts are
    whole, and the one before it keeps its own until the next, so a batch that is lost at any point and replayed writes
    the same again.
    """
    spark = rows.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        earlier = [k for k in _manifests(spark, table) if k < n]
        parts = _parts(spark, table, earlier[-1]) if earlier else []
        own = f"part={n:012d}"
        merge_windows(batch, key, text).write.mode("overwrite").parquet(f"{table}/{own}")
        total = spark.read.parquet(f"{table}/{own}").count()
        taken: list[tuple[str, int]] = [(own, total)]
        while parts and parts[-1][1] < 2 * sum(size for _, size in taken):
            taken.insert(0, parts.pop())
        if len(taken) > 1:
            own = f"merged={n:012d}"
            merge_windows(_union(spark, table, [name for name, _ in taken]), key, text).write.mode("overwrite").parquet(f"{table}/{own}")
            total = spark.read.parquet(f"{table}/{own}").count()
        sinks.make_dirs(spark, f"{table}/manifests")
        sinks.write_json(spark, f"{table}/manifests/{n:012d}.json", [*parts, (own, total)] if total else parts)
        _clean(spark, table, n, earlier[-1:])

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _clean(spark: SparkSession, table: str, n: int, before: list[int]) -> None:
    """Removes what neither manifest ``n`` nor the one before it has."""
    kept = {name for k in [*before, n] for name, _ in _parts(spark, table, k)}
    for name in sinks.names_in(spark, table):
        if name != "manifests" and name not in kept:
            sinks.remove(spark, f"{table}/{name}")
    for k in _manifests(spark, table):
        if k not in (*before, n):
            sinks.remove(spark, f"{table}/manifests/{k:012d}.json")


def _manifests(spark: SparkSession, table: str) -> list[int]:
    return [int(name.removesuffix(".json")) for name in sinks.names_in(spark, f"{table}/manifests") if name.endswith(".json")]


def _parts(spark: SparkSession, table: str, n: int) -> list[tuple[str, int]]:
    """Names and rows of the parts of a manifest, oldest first."""
    return [(name, size) for name, size in json.loads(sinks.read_text(spark, f"{table}/manifests/{n:012d}.json"))]


def _union(spark: SparkSession, table: str, names: list[str]) -> DataFrame | None:
    out = None
    for name in names:
        one = spark.read.parquet(f"{table}/{name}")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def current(spark: SparkSession, table: str, key: str, text: str | None = "text_original") -> DataFrame | None:
    """The table as of its last manifest; None before the first row."""
    last = _manifests(spark, table)[-1:]
    rows = _union(spark, table, [name for name, _ in _parts(spark, table, last[0])]) if last else None
    return None if rows is None else merge_windows(rows, key, text)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stagnant_stream(windows: DataFrame, scope: str, key: str, rounds: int, checkpoint: str, table: str, keep_ms: int | None = None) -> StreamingQuery:
    """From windows as they land (scope, file, y, h and keys: what they show), appended to ``table`` per window: scope, file,
    seen (new keys), quiet and stopped, as ``collect.quiet_windows`` gives them in one go.

    A scope's state is an entry for each key that it has shown, and one of its last extent and its quiet windows. A window
    looks up its own keys, whatever else the scope has shown; the entries are on disk (RocksDB). With ``keep_ms`` an entry goes so
    long after it was written, for scopes that are never captured again. Windows of a scope come in the order of their
    files.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Quiet(StatefulProcessor):
        def init(self, handle):
            self.shown = handle.getMapState("shown", "key string", "file string", keep_ms)
            self.last = handle.getValueState("last", "y long, h long, quiet long", keep_ms)

        def handleInputRows(self, name, frames, timers):  # noqa: N802  Spark's name
            out = []
            for window in sorted((r for f in frames for r in f.to_dict("records")), key=lambda r: r["file"]):
                keys = window[key] if window[key] is not None else ()
                new = [k for k in dict.fromkeys(keys) if not self.shown.containsKey((k,))]
                for k in new:
                    self.shown.updateValue((k,), (window["file"],))
                here = (int(window["y"]), int(window["h"]))
                last = tuple(self.last.get()) if self.last.exists() else None
                quiet = last[2] + 1 if last and last[:2] == here and not new else 0
                self.last.update((*here, quiet))
                out.append((name[0], window["file"], len(new), quiet, quiet >= rounds))
            yield pd.DataFrame(out, columns=[scope, "file", "seen", "quiet", "stopped"])

        def close(self):
            pass

    spark = windows.sparkSession
    schema = f"{scope} string, file string, seen long, quiet long, stopped boolean"
    found = windows.groupBy(scope).transformWithStateInPandas(Quiet(), schema, "Append", "ProcessingTime" if keep_ms else "None")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the settings that it starts with
    try:
        return found.writeStream.option("checkpointLocation", checkpoint).option("path", table).format("parquet").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def ingest_stream(ledger: Ledger, announcements: DataFrame, checkpoint: str, on_report: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Ingests bundles as their paths (column ``bundle``) arrive, in order. A bundle that comes twice, or whose batch is
    replayed, is found by its fingerprint and not added again. Records are never evicted: absent ones are marked."""

    def run(batch: DataFrame, n: int) -> None:
        for row in batch.orderBy("at", "bundle").collect():  # paths of a few captures, not their rows
            report = ledger.ingest(row["bundle"])
            if on_report:
                on_report(report)

    named = announcements.select(F.col("bundle"), F.coalesce(F.col("at"), F.lit("")).alias("at"))
    return named.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Event counts by day and type with late data bounded by a watermark: an extension for live event tables."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("count"))
