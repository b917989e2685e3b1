"""Texts' bytes as audio, and its features.

A payload is stored as a WAV file of 8-bit mono samples in a Parquet table of the shared folder and read back from there.
Features: polyphase resampling to three fifths of the rate, log-mel energies of overlapped frames, and segments of energy by hysteresis (on above one threshold,
off below a lower one). Log-mel frames are cut into windows of fixed shape, held in an Arrow fixed-shape tensor column
beside each window's time span.

Scale: one map over the scan for storing and one over the stored table for features, no shuffle; frames are taken in blocks, so memory
doesn't grow with a text beyond its own samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table, text_of

RATE = 16_000  # samples a second of the stored media
UP, DOWN = 3, 5  # resampling to 9.6 kHz, by a bank of three branches
TAPS = 16  # for each phase
FRAME, HOP, FFT = 240, 96, 256  # samples at the lower rate: 25 and 10 ms
MELS = 32
WINDOW = 16  # frames of a tensor
UNIT = 192
ON_DB, OFF_DB = 1.5, 0.5  # over the mean energy of the text
BLOCK = 4096  # frames taken at once


def to_wav(payload: bytes) -> bytes:
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of the file's data chunk; chunks are walked by their lengths."""
    at = 12
    while at < len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def low_pass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed sinc over ``up`` phases of ``taps`` each, with a gain of ``up``."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    return (up * h / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Rational resampling: each output phase filters the input with its own branch, so no zero is ever multiplied."""
    h = low_pass(up, down, taps)
    n_out = -(-len(x) * up // down)
    out = np.zeros(n_out, np.float32)
    half = taps // 2
    padded = np.concatenate([np.zeros(taps, np.float32), x.astype(np.float32), np.zeros(taps + down, np.float32)])
    for i in range(min(up, n_out)):
        first, phase = divmod(i * down, up)
        count = len(range(i, n_out, up))
        views = np.lib.stride_tricks.sliding_window_view(padded, taps)[first + half + 1 :: down][:count]
        out[i::up] = views @ np.ascontiguousarray(h[phase::up][::-1])
    return out


def mel_bank(rate: float = RATE * UP / DOWN) -> np.ndarray:
    def mel(f: float) -> float:
        return 2595 * np.log10(1 + f / 700)

    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, bank: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Log-mel energies (dB), a row per overlapped frame; the signal is filled up so that its end is in a whole frame."""
    frames = max(0, -(-(len(y) - FRAME) // HOP)) + 1
    y = np.concatenate([y, np.zeros((frames - 1) * HOP + FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft(frames[at : at + BLOCK] * shape, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[at : at + BLOCK] = 10 * np.log10(power @ bank + 1e-6)
    return out


def segments(energy: np.ndarray, on: float = ON_DB, off: float = OFF_DB) -> list[tuple[int, int]]:
    """(first frame, frame behind the last) of each stretch that starts above ``on`` and lasts while above ``off``."""
    over = energy - energy.mean()
    state = np.where(over > on, 1, np.where(over < off, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    held = np.where(last >= 0, state[np.maximum(last, 0)], 0)
    edge = np.diff(np.concatenate([[0], held, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def tensor_batch(mel: np.ndarray) -> pa.RecordBatch:
    """The frames as windows of WINDOW x MELS, the last filled with its own lowest level, with their time spans in ms."""
    n = -(-len(mel) // WINDOW)
    full = np.full((n * WINDOW, MELS), mel.min(), np.float32)
    full[: len(mel)] = mel
    start = np.arange(n, dtype=np.int64) * WINDOW
    stop = np.minimum(start + WINDOW, len(mel))
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(full.reshape(n, WINDOW, MELS)))
    step = 1000 * HOP * DOWN // (RATE * UP)
    return pa.RecordBatch.from_arrays([pa.array(start * step), pa.array(stop * step), tensors], ["start_ms", "end_ms", "log_mel"])


def as_stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_stream(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def describe(mel: np.ndarray, spans: list[tuple[int, int]], tensors: pa.RecordBatch) -> str:
    """Counts, the mean level, and a checksum of the tensors in whole decibels and of the segments."""
    whole = np.rint(tensors.column("log_mel").to_numpy_ndarray()).astype(np.int16)
    mark = zlib.crc32(np.array(spans, np.int64).tobytes(), zlib.crc32(whole.tobytes()))
    return f"frames={len(mel)};windows={len(whole)};segments={len(spans)};mean_db={float(mel.mean()):.1f};crc={mark:08x}"


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), media (the WAV file). A null text is the empty text: 192 spaces."""
    kind = dict(df.dtypes)[id_col]

    def store(batches):
        for batch in batches:
            made = [payload_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([to_wav(p) for p, _ in made], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def stored_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """store_media's rows, written to a table in the shared folder and read from it. An empty table gives an empty one."""
    return kept_table(store_media(df, id_col, text_col), "media")


def audio_features(media: DataFrame, with_tensors: bool = True) -> DataFrame:
    """From store_media's rows: doc_id, n_bytes, what is stored (payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256), feature (a digest), spans (array of start_ms, end_ms of energy segments) and tensors (an Arrow stream
    of start_ms, end_ms, log_mel; null without ``with_tensors``). Equal media give equal values.
    """
    kind = dict(media.dtypes)["doc_id"]
    schema = (
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, spans array<struct<start_ms:long,end_ms:long>>, tensors binary"
    )
    step = 1000 * HOP * DOWN // (RATE * UP)

    def compute(batches):
        bank, shape = mel_bank(), np.hanning(FRAME).astype(np.float32)
        names = [f.split()[0] for f in schema.replace("array<struct<start_ms:long,end_ms:long>>", "a").split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for item in batch.column("media"):
                stored = item.as_py()
                payload = from_wav(stored)
                mel = log_mel(resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128), bank, shape)
                spans = segments(mel.mean(axis=1))
                tensors = tensor_batch(mel)
                rows.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(stored),
                        hashlib.sha256(stored).hexdigest(),
                        describe(mel, spans, tensors),
                        [{"start_ms": a * step, "end_ms": b * step} for a, b in spans] if with_tensors else None,
                        as_stream(tensors) if with_tensors else None,
                    )
                )
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return media.mapInArrow(compute, schema)
