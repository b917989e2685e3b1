"""Lexical retrieval packing.

Documents are dealt into shards of bounded size. A shard's tokens are cut into whole windows where a document is longer
than one; what is left of each document (under a window) is an item of the shard's BM25 inverted index, whose terms are
token ids over the whole document. The first unused item seeds a window; the index returns its nearest unused
neighbours, which fill the window greedily, best first. The last neighbour is cut where the window ends, and the rest of
it seeds the next window, so no window has padding but a shard's last tokens, which go to windows of powers of two.

Query: all of the seed's terms (``query_terms`` keeps only those of greatest BM25 weight). When no unused document shares
a term with the seed, the next unused item in order follows.

Scale: a shard is what a task holds (SHARD_TOKENS tokens at most, beside one document, and SHARD_DOCS documents); a partition
has as many shards as it needs. Neighbours come together by ranges of a signature (the least hash over a text's words), so a hot group spans
as many shards as it fills, and the texts cross one shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_encoder, local_tokenizer, text_of, tokenizer_path

WINDOW = 2048
SHARD_TOKENS = 3 << 20
SHARD_DOCS = 1 << 16  # of a shard too, as a seed's question goes over all documents of its shard
QUERY_TERMS = 12
NEIGHBOURS = 24  # asked for at a time; asked again while the window has room
K1, B = 1.2, 0.75
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ShardIndex:
    """An inverted index of documents' token ids with BM25 weights."""

    def __init__(self, docs: list[np.ndarray]):
        found = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(t) for t, _ in found], np.int64)
        terms = np.concatenate([t for t, _ in found]).astype(np.int64) if docs else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in found]).astype(np.float32) if docs else np.zeros(0, np.float32)
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        length = np.array([len(d) for d in docs], np.float32)
        order = np.argsort(terms, kind="stable")
        self.first = np.searchsorted(terms[order], np.arange(int(terms.max(initial=0)) + 2))
        df = np.diff(self.first)
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = K1 * (1 - B + B * length / max(1.0, float(length.mean()) if len(docs) else 1.0))
        weight = idf[terms] * tf * (K1 + 1) / (tf + norm[owner])
        self.owner, self.weight = owner[order], weight[order]
        self.terms, self.own, self.cut = terms, weight, np.concatenate([[0], np.cumsum(sizes)])
        self.live = np.arange(len(docs))  # the documents that postings still hold; owners are places in it
        self.row = np.full(len(df), -1)  # of terms in a quarter of the documents or more, whose weights stand in full rows
        common = np.flatnonzero(df * 4 >= max(1, len(docs)))
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), len(docs)), np.float32)
        inside = self.row[terms] >= 0
        self.full[self.row[terms[inside]], owner[inside]] = weight[inside]
        self.last: tuple = (-1, None, np.zeros(0))

    def shrink(self, unused: np.ndarray) -> None:
        """Drops the postings of used documents."""
        stays = unused[self.live]
        kept = stays[self.owner]
        self.first = np.concatenate([[0], np.cumsum(kept)])[self.first]
        self.owner, self.weight = (np.cumsum(stays) - 1).astype(np.int32)[self.owner[kept]], self.weight[kept]
        self.live, self.full = self.live[stays], np.ascontiguousarray(self.full[:, stays])
        self.last = (-1, None, np.zeros(0))

    def scores(self, doc: int, query_terms: int | None) -> np.ndarray:
        """The BM25 score of each document in ``live``."""
        if self.last[:2] != (doc, query_terms):
            terms = self.query_terms(doc, query_terms)
            rows = self.row[terms]
            score = self.full[rows[rows >= 0]].sum(axis=0).astype(np.float64)
            ranges = [(self.first[t], self.first[t + 1]) for t in terms[rows < 0]]
            if ranges:
                owners = np.concatenate([self.owner[a:b] for a, b in ranges])
                score += np.bincount(owners, np.concatenate([self.weight[a:b] for a, b in ranges]), minlength=len(self.live))
            self.last = (doc, query_terms, score)
        return self.last[2]

    def query_terms(self, doc: int, n: int | None) -> np.ndarray:
        a, b = self.cut[doc], self.cut[doc + 1]
        best = np.lexsort((self.terms[a:b], -self.own[a:b]))[:n]
        return self.terms[a:b][best]

    def neighbours(self, doc: int, unused: np.ndarray, n: int, query_terms: int | None = QUERY_TERMS) -> np.ndarray:
        """At most ``n`` unused documents with a score above 0, best first, ties by place. From call to call, documents
        only leave ``unused``."""
        if 2 * np.count_nonzero(unused) < len(self.live):
            self.shrink(unused)
        score = self.scores(doc, query_terms)
        hits = np.flatnonzero((score > 0) & unused[self.live])
        if len(hits) > n:
            hits = hits[np.argpartition(-score[hits], n)[: n + 1]]
        return self.live[hits[np.lexsort((hits, -score[hits]))][:n]]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, query_terms: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces that hold each token of the shard once."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rest = np.zeros(len(docs), np.int64)  # where each item (what whole windows leave) begins
    unused = np.zeros(len(docs), bool)
    for k, d in enumerate(docs):
        whole = len(d) // window
        for w in range(whole):
            pieces.append((k, w * window, window, sequence, 0))
            sequence += 1
        rest[k] = whole * window
        unused[k] = len(d) > rest[k]
    index = ShardIndex(docs)
    held: list[tuple[int, int, int]] = []  # of the window being filled: document, start, length
    filled, at = 0, 0

    def take(doc: int, start: int) -> int:
        """Puts what fits into the window; returns where the rest begins."""
        nonlocal filled, sequence, held
        n = min(window - filled, len(docs[doc]) - start)
        held.append((doc, start, n))
        filled += n
        if filled == window:
            offset = 0
            for d, s, length in held:
                pieces.append((d, s, length, sequence, offset))
                offset += length
            sequence, held, filled = sequence + 1, [], 0
        return start + n

    seed, start = -1, 0
    while True:
        if seed < 0:
            while at < len(docs) and not unused[at]:
                at += 1
            if at == len(docs):
                break
            seed, start = at, int(rest[at])
            unused[at] = False
        if start < len(docs[seed]):
            start = take(seed, start)
            if filled == 0:
                seed = seed if start < len(docs[seed]) else -1
                continue
        found = index.neighbours(seed, unused, NEIGHBOURS, query_terms)
        full = False
        next_seed = -1
        for k in found.tolist():
            unused[k] = False
            left = take(k, int(rest[k]))
            if filled == 0:
                full = True
                if left < len(docs[k]):
                    next_seed, start = k, left
                break
        if full or len(found) == 0:
            seed = next_seed  # with no neighbour left the next item in order goes on filling
    offset = 0
    room = 1 << (filled.bit_length() - 1) if filled else 0
    for doc, start, length in held:
        while length:
            n = min(length, room - offset)
            pieces.append((doc, start, n, sequence, offset))
            start, length, offset, filled = start + n, length - n, offset + n, filled - n
            if offset == room:
                sequence, offset, room = sequence + 1, 0, 1 << (filled.bit_length() - 1) if filled else 0
    return pieces


def signature(text_col: str = "text"):
    """The least hash over a text's words: near texts often share it, and so meet in a shard."""
    return F.array_min(F.transform(F.split(text_of(text_col), " "), lambda w: F.xxhash64(w)))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; a null text is the end id alone. Rows with the same id are packed each for
    itself. sequence_id is unique over the table; within a sequence pieces follow each other without gaps from 0, and its
    length is ``window`` or a power of two, so nothing is padded. An empty table gives an empty result.
    """
    path = path or tokenizer_path()
    kind = dict(df.dtypes)[id_col]

    def pack(batches):
        from pyspark import TaskContext

        encoder = chunk_encoder(local_tokenizer(path))
        first = TaskContext.get().partitionId() << 40
        docs: list[np.ndarray] = []
        names: list = []
        size = 0

        def shard():
            nonlocal first
            found = pack_shard(docs, window)
            cols = np.array(found, np.int64).reshape(-1, 5)
            sums = [zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in found]
            total = np.array([len(d) for d in docs], np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in cols[:, 0]], id_type), pa.array(cols[:, 1]), pa.array(cols[:, 2]), pa.array(sums, pa.int64()), pa.array(total[cols[:, 0]]), pa.array(cols[:, 3] + first), pa.array(cols[:, 4])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            first += int(cols[:, 3].max(initial=-1)) + 1
            return out

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text"), end_id), strict=True):
                docs.append(ids)
                names.append(doc_id)
                size += len(docs[-1])
                if size >= SHARD_TOKENS or len(docs) >= SHARD_DOCS:
                    yield shard()
                    docs, names, size = [], [], 0
        if docs:
            yield shard()

    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("sig", signature())
    near = rows.repartitionByRange("sig", "doc_id").sortWithinPartitions("sig", "doc_id", "text").select("doc_id", "text")
    return near.mapInArrow(pack, f"doc_id {kind}, {SCHEMA}")
