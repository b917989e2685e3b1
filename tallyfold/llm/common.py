"""What the operators share: scratch tables in the cluster's shared folder, sizing, and the cached word encoder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers get the operators' functions by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules["tallyfold.llm"])

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one of our own where that is unset and the session runs
    on one machine (tests). A cluster without that setting is refused, as executors would write to disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tallyfold-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name with underscores before it until no column has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def must_be_free(df: DataFrame, *names: str) -> None:
    if clash := sorted({c.lower() for c in df.columns} & {n.lower() for n in names}):
        raise ValueError(f"the table has columns of these names already: {', '.join(clash)}; name others")


def _drop_all() -> None:
    for spark, path in _made:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clean
            return


atexit.register(_drop_all)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/tallyfold/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


FEW_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def kept_table(df: DataFrame, name: str, codec: str = "zstd", few_rows: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, and survives lost executors.

    ``few_rows``: rows are of megabytes. Parquet looks at its buffers after 100 rows only, and a reader's batch is as many
    rows of a row group as it can get; so the size is looked at after each row, and row groups are small."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", codec)
    (writer.options(**FEW_ROWS) if few_rows else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bucket_of(column: str, mod: int) -> Column:
    """crc32 of the id written as text, mod ``mod``: the rule that sets held-out rows apart (null ids: crc32 of '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def append_columns(df: DataFrame, fields: str, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """All of ``df`` with columns (``fields``: DDL) that ``make()``, called once per task, computes from each batch."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    names = [f.name for f in added]
    must_be_free(df, *names)

    def run(batches):
        forget_encoders()
        compute = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch)], [*batch.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word (bytes between ASCII white space) of a buffer, and where each starts."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    prime = 0x100000001B3
    powers = np.cumprod(np.full(len(b), prime, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers)])
    back = np.cumprod(np.full(len(b), pow(prime, -1, 1 << 64), np.uint64))
    return mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)), start


CHUNK = re.compile(r"\s*\S+(?:[^\S \n\t]\s*\S+)*(?:[^\S \n\t]\s*\Z)?|\s+")


def chunks_of(text: str) -> list[str]:
    """The text in pieces, cut before each blank, line feed or tab that follows something other than white space. Every
    piece but a text's first begins with white space and every one but its last ends otherwise, so white space is never
    cut in two. A piece of white space alone can only be the last."""
    return CHUNK.findall(text)


# ---------------------------------------------------------------------------------------------------------------
# Encoding whole texts with a tokenizers file, a white-space chunk at a time.
# ---------------------------------------------------------------------------------------------------------------

CACHE_WORDS = 200_000  # words held in each of two generations of a worker's cache
BLOCK_BYTES = 2 << 20  # of texts encoded at once


def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ChunkEncoder:
    """``encode(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` as little-endian uint16 bytes.

    The file's normalizer and pre-tokenizer never join text across ASCII white space, so a text's ids are those of its
    white-space chunks in turn. Texts go by blocks: Arrow numbers a block's distinct chunks, parts them into letters and
    the stops behind them (two pre-tokens), and strings the ids of both together again, so each distinct word of a block
    is looked up once; a word's ids are remembered. Plain letters or stops are one pre-token and go straight to the
    library's BPE model; any other chunk goes through the library's whole chain. ASCII capitals are lowered first unless a
    text may hold a special token.
    """

    LETTERS, STOPS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:;=-@\[-`{-~]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.model = self.full.model
        self.two_bytes = [k.to_bytes(2, "little") for k in range(self.full.get_vocab_size())]
        self.plain = re.compile(f"{self.LETTERS}|{self.STOPS}+")
        self.symbols = byte_symbols()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if not word.isalpha() and self.plain.fullmatch(text) is None:
            return self.ids(text)
        seen = text.lower() if word.isascii() else "".join(map(self.symbols.__getitem__, text.lower().encode()))
        two_bytes = self.two_bytes
        return b"".join([two_bytes[t.id] for t in self.model.tokenize(seen)])

    def missing(self, word: bytes) -> bytes:
        got = self.young.get(word)  # a generation may have begun since it was missed
        if got is not None:
            return got
        got = self.old.get(word)
        if got is None:
            got = self.word(word)
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = got
        return got

    def looked_up(self, words: pa.Array) -> pa.Array:
        """The ids of each of a block's words or stops, as bytes."""
        numbered = words.dictionary_encode()
        asked = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        got = [self.missing(w) if g is None else g for w, g in zip(asked, map(self.young.get, asked), strict=True)]
        return pa.array(got, pa.large_binary()).take(numbered.indices)

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts one after another, and where each text's begin (and the last one's end)."""
        lowered = pc.ascii_lower(texts)
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():
            lowered = pc.if_else(special, texts, lowered)
        chunks = pc.ascii_split_whitespace(lowered)
        numbered = chunks.flatten().dictionary_encode()
        parted = pc.extract_regex(numbered.dictionary, f"^(?P<word>{self.LETTERS})(?P<stops>{self.STOPS}*)$")
        words = self.looked_up(pc.coalesce(pc.struct_field(parted, "word"), numbered.dictionary))
        stops = self.looked_up(pc.fill_null(pc.struct_field(parted, "stops"), ""))
        ids = pc.binary_join_element_wise(words, stops, pa.scalar(b"", pa.large_binary())).take(numbered.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) // 2
        return np.frombuffer(ids.buffers()[2] or b"", "<u2", int(ends[-1])), ends[np.asarray(chunks.offsets)]

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> Iterator[np.ndarray]:
        """Each text's ids in turn, with ``end_id`` behind them if given."""
        sizes = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
            ids, begins = self.block(texts.slice(at, end - at))
            if end_id is not None:
                ids, begins = np.insert(ids, begins[1:], end_id), begins + np.arange(len(begins))
            pa.default_memory_pool().release_unused()  # or the pool keeps a block's tables, beside the words, in idle workers
            cut = begins.tolist()
            yield from (ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))
            at = end

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string()))).tobytes()


def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's encoder: kept on ``sys`` from task to task, as functions sent by value lose their module."""
    held = sys.__dict__.setdefault("_tallyfold_encoders", {})
    if path not in held:
        held.clear()
        held[path] = ChunkEncoder(path)
    return held[path]


def forget_encoders() -> None:
    """Gives up the worker's encoder and its words: for tasks of operators that use none, as workers serve a pipeline's
    stages one after another and would hold them all the while."""
    sys.__dict__.setdefault("_tallyfold_encoders", {}).clear()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def local_tokenizer(path: str) -> str:
    """The tokenizer file on the executor: the given path, or the same name in its own installed package."""
    if os.path.exists(path):
        return path
    return tokenizer_path(os.path.basename(path))
