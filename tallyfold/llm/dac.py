"""Token ids in directly addressable codes.

A segment splits each id into chunks, low bits first, of fixed widths by level. A level holds the chunks of the ids
that reach it, packed, a bitmap that says which of them go on to the next level, and a rank directory over the bitmap
(ones before each 512-bit block). The place of an id's chunk in the next level is the rank of its bit, so any id is
read from one chunk and one rank a level; no block is decoded. Widths come from the segment's own bit lengths: the
split of least size.

File format: a Parquet table with one row per segment of at most about SEGMENT_IDS ids: part and number (their order is
the order of documents), first (ids of the part's segments before it), n_ids, documents (little-endian int64 per document: its first id's place; one more at the end),
doc_ids, payload (see ``Segment``).

Scale: one shuffle of the texts (by ranges of ids, in order); segments are bounded, and so is what a task holds. The
driver gets one number per part, to add up where each begins.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_encoder, local_tokenizer, new_path, text_of, tokenizer_path

MAGIC = b"DAC1"
SEGMENT_IDS = 1 << 20
SUPER = 512
READ_IDS = 1 << 16  # places looked up at once, so that the steps between stay in the processor's cache


def best_widths(ids: np.ndarray, at_most: int = 4) -> list[int]:
    """Chunk widths of least total size: a chunk of w bits costs w + 1 bits (w in the last level)."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    longer = np.zeros(bits + 1, np.int64)  # ids with more than k bits; every id reaches the first level
    longer[0] = len(ids)
    for k in range(1, bits):
        longer[k] = int((ids >> k != 0).sum())
    best: dict[tuple[int, int], tuple[int, list[int]]] = {(bits, n): (0, []) for n in range(at_most + 1)}
    for n in range(1, at_most + 1):
        for start in range(bits - 1, -1, -1):
            options = []
            for end in range(start + 1, bits + 1):
                if (end, n - 1) in best:
                    cost, widths = best[end, n - 1]
                    options.append((cost + int(longer[start]) * (end - start + (end < bits)), [end - start, *widths]))
            if options:
                best[start, n] = min(options)
    return min(best[0, n] for n in range(1, at_most + 1) if (0, n) in best)[1]


def pack(values: np.ndarray, width: int) -> bytes:
    group = 8 // math.gcd(8, width)  # the fewest values that fill whole bytes
    if group * width <= 64:
        rows = np.pad(values, (0, -len(values) % group)).reshape(-1, group)
        words = rows[:, 0].astype("<u8")
        for k in range(1, group):
            words |= rows[:, k].astype("<u8") << np.uint64(k * width)
        packed = words.view(np.uint8).reshape(-1, 8)[:, : group * width // 8].tobytes()
        return packed[: -(-len(values) * width // 8)] + bytes(4)
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() + bytes(4)


def unpack(packed: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    bit = at * width
    byte = bit >> 3
    kind = np.uint32 if width <= 25 else np.uint64  # holds the bytes that a chunk lies in
    word = packed[byte].astype(kind)
    for k in range(1, (width + 14) // 8):
        word |= packed[byte + k].astype(kind) << kind(8 * k)
    return (word >> (bit & 7).astype(kind)) & kind((1 << width) - 1)


class Segment:
    """Reads a payload: ``ids(places)`` gives the ids at any places, in any order."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment")
        levels, at = payload[4], 5
        self.levels = []
        for k in range(levels):
            width, count, size = struct.unpack_from("<BQQ", payload, at)
            at += 17
            chunks = np.frombuffer(payload, np.uint8, size, at)
            at += size
            if k + 1 < levels:
                words = -(-count // 64)
                bitmap = np.frombuffer(payload, "<u8", words, at)
                at += 8 * words
                blocks = -(-count // SUPER)
                directory = np.frombuffer(payload, "<u4", blocks, at)
                at += 4 * blocks
                inside = np.bitwise_count(bitmap).astype(np.uint32)
                before = np.cumsum(np.pad(inside, (0, -len(inside) % 8)).reshape(-1, 8), axis=1, dtype=np.uint32).ravel()[: len(inside)] - inside
            else:
                bitmap = directory = before = None
            self.levels.append((width, chunks, bitmap, directory, before))

    def ids(self, places: np.ndarray) -> np.ndarray:
        return np.concatenate([self._ids(places[k : k + READ_IDS]) for k in range(0, max(1, len(places)), READ_IDS)])

    def _ids(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint32)
        rows, at, shift = np.arange(len(places)), places.astype(np.int64), 0
        for width, chunks, bitmap, directory, before in self.levels:
            out[rows] |= unpack(chunks, width, at).astype(np.uint32) << np.uint32(shift)
            shift += width
            if bitmap is None or not len(rows):
                break
            word, bit = bitmap[at >> 6], (at & 63).astype(np.uint64)
            on = np.flatnonzero(word >> bit & np.uint64(1))
            rank = directory[at >> 9].astype(np.int64) + before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            rows, at = rows[on], rank[on]
        return out


def encode_segment(ids: np.ndarray, widths: list[int] | None = None) -> bytes:
    ids = ids.astype(np.uint32)
    widths = widths or best_widths(ids)
    out = [MAGIC, bytes([len(widths)])]
    left = ids
    for k, width in enumerate(widths):
        packed = pack(left & np.uint32((1 << width) - 1), width)
        out += [struct.pack("<BQQ", width, len(left), len(packed)), packed]
        if k + 1 < len(widths):
            more = (left >> np.uint32(width)) != 0
            bits = np.packbits(np.pad(more, (0, -len(more) % 64)), bitorder="little")
            ones = np.add.reduceat(more, np.arange(0, len(more), SUPER), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
            out += [bits.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
            left = left[more] >> np.uint32(width)
    return b"".join(out)


SCHEMA = "part int, number int, first long, n_ids long, documents binary, doc_ids array<long>, payload binary"


def write_token_ids(df: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2) -> None:
    """Writes every text's ids (and ``end_id`` behind each) to segments under ``out``, in ascending order of id.

    Null texts are empty: they hold the end id alone. Null ids come first; rows with the same id go by text. An empty
    table writes no segment.
    """
    path = path or tokenizer_path()

    def encode(batches):
        from pyspark import TaskContext

        encoder = chunk_encoder(local_tokenizer(path))
        part, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list = []
        size = before = 0

        def segment():
            ids = np.concatenate(held)
            begins = np.cumsum([0] + [len(h) for h in held]).astype("<i8").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([begins], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([encode_segment(ids)], pa.binary())],
                ["part", "number", "first", "n_ids", "documents", "doc_ids", "payload"],
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text"), end_id), strict=True):
                held.append(ids)
                doc_ids.append(doc_id)
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield segment()
                    held, doc_ids, before, size, number = [], [], before + size, 0, number + 1
        if held:
            yield segment()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    in_order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    in_order.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(out)


def read_token_ids(spark, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the segments under ``path``: doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` ids."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row per task that wrote
    begins, total = {}, 0
    for r in sizes:
        begins[r["part"]] = total
        total += r["n"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [f.split()[0] for f in schema.split(", ")]
    where = spark.sparkContext.broadcast(begins)

    def decode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, n, documents, doc_ids, payload = (batch.column(c)[row].as_py() for c in ("part", "first", "n_ids", "documents", "doc_ids", "payload"))
                segment = Segment(payload)
                first = where.value[part] + before
                cut = np.frombuffer(documents, "<i8")
                ids = segment.ids(np.arange(n)).astype("<u4")
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(cut[:-1] + first), pa.array(np.diff(cut)), pa.array(sums, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    return stored.mapInArrow(decode, schema)


def token_ids_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the table's token ids to a new set of segments in the shared folder and reads the documents back."""
    out = new_path(df.sparkSession, "token-ids")
    write_token_ids(df, out, id_col, text_col, path, end_id)
    return read_token_ids(df.sparkSession, out)
