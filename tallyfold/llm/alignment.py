"""Alignment of two tokenizers' tokens of a text by their bytes, and corpus-wide counts of linked id pairs.

Both read one blank and the text. A byte offset where a token of A and a token of B end is a cut; cuts part the tokens into
groups. A link is a pair of token occurrences whose byte ranges end together; with ``links="group"`` any pair within a group.

Method: ends are cumulative sums of token lengths, cuts the ends in both (``intersect1d``), group labels by ``searchsorted``,
and links an expansion by ``repeat``. It runs over texts' distinct chunks, laid end to end: neither tokenizer makes a token
across a blank, line feed or tab behind something that is not white space (checked against B's vocabulary), so a chunk's tokens do not
depend on its neighbours, a chunk's end is a cut, and what a chunk gives is remembered and summed.

Scale: texts are taken in scan order into blocks of bounded size (BLOCK_CHARS); tokens are made once and a block is kept as a
row: its chunks' links over the block's list of distinct pairs, and each document's chunks. A block's distinct pairs are the only rows
that are counted: salted partial sums, then totals; so a pair has at most one row a block, however frequent it is. The most
frequent count of each B id is broadcast (its rows are bounded by B's vocabulary). Totals go back to blocks by a join on
the pair, and meet their block by its id: a block's answers are as bounded as the block. No text is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import sys
import uuid
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_symbols, chunks_of, kept_table, local_tokenizer, text_of, tokenizer_path

BLOCK_CHARS = 3 << 20  # of text in a block; a longer document is a block's last. A row of it is some 4 MB
CACHE = 150_000  # chunks in each of two generations of a worker's cache
EMPTY = (b"", 0, 0, 0, b"")  # what a chunk gives that the ids do not spell
PIECE = 1 << 17  # characters given to a tokenizer at a time
SALTS = 8
SHIFT = 32  # bits of an id of B in a pair


def group_links(ends_a: np.ndarray, ends_b: np.ndarray, links: str = "ends") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts, the group of each A token and of each B token, and links as places of A and of B tokens, by group.

    Ends ascend strictly and both lists end at the same byte (or are empty)."""
    lists = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.int8)  # how many of the two end at each byte
    lists[ends_a] += 1
    lists[ends_b] += 1
    cut_a, cut_b = lists[ends_a] == 2, lists[ends_b] == 2
    cuts, of_a, of_b = ends_a[cut_a], np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    if links == "ends":  # of each group, the tokens that end at its cut
        return cuts, of_a, of_b, np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    mine_a, mine_b = np.arange(len(ends_a)), np.arange(len(ends_b))
    n_a, n_b = np.bincount(of_a[mine_a], minlength=len(cuts)), np.bincount(of_b[mine_b], minlength=len(cuts))
    first_b = np.cumsum(n_b) - n_b
    wide = n_b[of_a[mine_a]]  # each A token meets all B tokens of its group
    step = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
    return cuts, of_a, of_b, np.repeat(mine_a, wide), mine_b[np.repeat(first_b[of_a[mine_a]], wide) + step]


def laid(strings: pa.Array, places: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The strings at the places end to end, and where each begins (and the last one ends)."""
    got = strings.take(pa.array(places))
    begins = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)
    return (got.buffers()[2] or pa.py_buffer(b"")).slice(0, int(begins[-1])).to_pybytes(), begins


class Aligner:
    """Chunks' results: (groups as text, tokens of A, tokens of B, groups, pairs of all links as the bytes of 64-bit
    numbers). Nothing in them is looked at by Python's collector of cycles, as a worker holds hundreds of thousands."""

    def __init__(self, path_a: str, path_b: str, links: str = "ends"):
        import sentencepiece
        from tokenizers import Tokenizer

        if links not in ("ends", "group"):
            raise ValueError("links must be ends or group")
        self.links = links
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: bytes([k]) for k, c in enumerate(byte_symbols())}
        labels = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [b"".join(byte.get(c, c.encode()) for c in t) for t in labels]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(r"\S[ \n\t▁]", p.replace("▁", " ")) for p in pieces):
            raise ValueError("a piece goes on behind a word into white space, so texts can't be cut there")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.spelt_a, self.spelt_b = (pa.array(xs, pa.large_binary()) for xs in (self.bytes_a, self.bytes_b))
        self.span = max(len(labels), len(pieces))
        self.marked = pa.array([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(self.span)], pa.large_binary())
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B for a blank and the text."""
        of_a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0]  # which makes no offsets
        return np.array(of_a.ids, np.int64), np.array(self.b.encode(text), np.int64)

    def spelled(self, ids_a: np.ndarray, ids_b: np.ndarray, text: str) -> bool:
        """Whether both lists of ids spell a blank and the text."""
        raw = b" " + text.encode()
        return laid(self.spelt_a, ids_a)[0] == raw and laid(self.spelt_b, ids_b)[0] == raw

    def results(self, chunks: list[str]) -> list[tuple | None]:
        """What each chunk gives; None for one that the ids do not spell. They begin with white space, and only the last
        may end with it."""
        lead = "a"  # a word before them, so that the blank which B adds is not a chunk's own
        text = lead + "".join(chunks)
        ids_a, ids_b = self.ids(text)
        if not self.spelled(ids_a, ids_b, text):
            if len(chunks) == 1:
                return [None]
            half = len(chunks) // 2
            return self.results(chunks[:half]) + self.results(chunks[half:])
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        cuts, of_a, of_b, link_a, link_b = group_links(ends_a, ends_b, self.links)
        sizes = map(len, chunks if text.isascii() else map(str.encode, chunks))
        last = np.cumsum([2, *sizes])  # where the lead and each chunk end
        group = np.searchsorted(cuts, last)
        if not np.array_equal(cuts[group], last):
            raise ValueError("a chunk's end is not a cut: the tokenizers join text across white space")
        group = group + 1  # groups before each chunk's first
        at_a, at_b, at_link = np.searchsorted(of_a, group), np.searchsorted(of_b, group), np.searchsorted(of_a[link_a], group)
        pairs = (ids_a[link_a] << SHIFT | ids_b[link_b]).tobytes()
        # the groups as text: each token's number and what stands behind it, a group's tokens of A and then of B
        every = np.arange(len(cuts) + 1)
        edge_a, edge_b = np.searchsorted(of_a, every), np.searchsorted(of_b, every)
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[np.arange(len(ids_a)) + edge_b[of_a]] = ids_a
        ids[np.arange(len(ids_b)) + edge_a[of_b + 1]] = ids_b
        ids[edge_a[1:] + edge_b[:-1] - 1] += self.span
        ids[edge_a[1:] + edge_b[1:] - 1] += 2 * self.span
        said, begins = laid(self.marked, ids)
        numbers = [np.diff(x).tolist() for x in (at_a, at_b, group)]
        said_at, link_at = begins[at_a + at_b].tolist(), (8 * at_link).tolist()
        told = zip(said_at, said_at[1:], *numbers, link_at, link_at[1:], strict=False)
        return [(said[x : y - 1], a, b, g, pairs[p:q]) for x, y, a, b, g, p, q in told]

    def learn(self, chunks: set[str]) -> dict[str, tuple | None]:
        """What each of the chunks gives."""
        out: dict[str, tuple | None] = {}
        batch: list[str] = []
        size = 0
        alone = [c for c in chunks if c[-1].isspace()]
        for c in sorted(chunks.difference(alone)):
            batch.append(c)
            size += len(c)
            if size >= PIECE:
                out.update(zip(batch, self.results(batch), strict=True))
                batch, size = [], 0
        if batch:
            out.update(zip(batch, self.results(batch), strict=True))
        for c in alone:
            out[c] = self.results([c])[0]
        return out

    def know(self, chunks: set[str]) -> None:
        """Has what each of the chunks gives at hand in ``young``."""
        if len(self.young) >= CACHE:  # only here, so that all of these chunks stay at hand
            self.old, self.young = self.young, {}
        new = chunks.difference(self.young)
        again = [c for c in new if c in self.old]
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        self.young.update(self.learn(new.difference(again)))

    def parts(self, texts: list[list[str]]) -> list[list[tuple]]:
        """What the chunks of each text give, in order; nothing for a text that the ids do not spell."""
        self.know(set().union(*texts))
        found = ([self.young[c] for c in chunks] for chunks in texts)
        return [[] if None in got else [(*p[:4], np.frombuffer(p[4], np.int64)) for p in got] for got in found]


def worker_aligner(path_a: str, path_b: str, links: str) -> Aligner:
    """The worker's aligner, kept on ``sys`` from task to task, as functions sent by value lose their module."""
    held = sys.__dict__.setdefault("_tallyfold_aligners", {})
    key = (path_a, path_b, links)
    if key not in held:
        held.clear()
        held[key] = Aligner(*key)
    return held[key]


def summed(values: np.ndarray, sizes: np.ndarray | list[int]) -> np.ndarray:
    """The sums of consecutive stretches of the given sizes."""
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.asarray(sizes, np.int64))])
    return upto[edge[1:]] - upto[edge[:-1]]


def listed(values: np.ndarray) -> pa.ListArray:
    """One row that holds all of the values."""
    return pa.ListArray.from_arrays([0, len(values)], pa.array(values, pa.int64()))


class Block:
    """Gathers documents' results over a block: its distinct chunks once, with their links over the block's pairs."""

    def __init__(self):
        self.place: dict[str, int] = {}  # of a chunk in the two lists that follow
        self.held: list[tuple] = []
        self.said: list[bytes] = []
        self.unspelt: set[int] = set()
        self.ids: list = []
        self.digests: list[str] = []
        self.chunks: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, texts: list[list[str]], size: int, aligner: Aligner) -> None:
        """Texts' chunks; each distinct one of the block is looked at once."""
        distinct = set().union(*texts)
        aligner.know(distinct)
        new = list(distinct.difference(self.place))
        told = [aligner.young[c] for c in new]
        if None in told:
            self.unspelt.update(k for k, p in enumerate(told, len(self.held)) if p is None)
            told = [p or EMPTY for p in told]
        self.place.update(zip(new, count(len(self.held)), strict=False))
        self.held += told
        self.said += [p[0] for p in told]
        for chunks in texts:
            at = list(map(self.place.__getitem__, chunks))
            if self.unspelt and not self.unspelt.isdisjoint(at):
                at = []
            self.digests.append(hashlib.sha256(b";".join(map(self.said.__getitem__, at))).hexdigest() if at else "")
            self.chunks.append(np.array(at, "<u4"))
        self.ids += ids
        self.size += size

    def row(self, block: str, id_type: pa.DataType) -> pa.RecordBatch:
        chunks = np.concatenate(self.chunks) if self.chunks else np.zeros(0, "<u4")
        held = self.held or [EMPTY]
        used = np.bincount(chunks, minlength=len(held))
        if not used.all():  # chunks only of texts that the ids do not spell
            held = [p if u else EMPTY for p, u in zip(held, used.tolist(), strict=True)]
        _, *sizes, links = zip(*held, strict=True)
        n = np.fromiter(map(len, links), np.int64, len(links)) // 8
        pairs, of = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
        counts = np.bincount(of, np.repeat(used, n), minlength=len(pairs)).astype(np.int64)
        doc_chunks = [len(c) for c in self.chunks]
        lists = [listed(summed(np.array(x, np.int64)[chunks], doc_chunks)) for x in (*sizes, n)]
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([self.ids], pa.list_(id_type)), *lists, pa.array([self.digests], pa.list_(pa.string())), listed(pairs), listed(counts)]
            + [pa.array([np.asarray(x, "<u4").tobytes()], pa.binary()) for x in (n, of, doc_chunks, chunks)],
            ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "counts", "chunk_links", "links", "doc_chunks", "chunks"],
        )


def aligned_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, links: str = "ends", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: its documents' ids, sizes and digests, its distinct pairs with their counts, and its links."""
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    kind = dict(df.dtypes)[id_col]
    longs = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    schema = f"block string, ids array<{kind}>, {longs}, digests array<string>, pairs array<long>, counts array<long>, chunk_links binary, links binary, doc_chunks binary, chunks binary"

    def run(batches):
        from pyspark import TaskContext

        aligner = worker_aligner(local_tokenizer(path_a), local_tokenizer(path_b), links)
        part, made, stamp, block, id_type = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:8], Block(), None
        for batch in batches:
            id_type = batch.column("doc_id").type
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            first = 0
            while first < len(ids):
                held: list[str] = []
                size = 0
                while first + len(held) < len(ids) and size < PIECE:
                    held.append(texts[first + len(held)].as_py())
                    size += len(held[-1])
                chunks = [chunks_of(" " + t) if t and "▁" not in t else [] for t in held]
                block.add(ids[first : first + len(held)], chunks, size, aligner)
                first += len(held)
                if block.size >= block_chars:
                    row = block.row(f"{part}-{made}-{stamp}", id_type)
                    made, block = made + 1, Block()  # the old one goes before the next is filled
                    yield row
                    del row
        if block.ids:
            yield block.row(f"{part}-{made}-{stamp}", id_type)

    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame, salts: int = SALTS) -> DataFrame:
    """pair (id of A, then of B in the low 32 bits), n: links of the corpus that hold it, and best: whether no other pair of its B id has more.

    Blocks' counts are summed by pair and salt, then by pair."""
    rows = blocks.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    partly = rows.groupBy(F.col("pairs").alias("pair"), "salt").agg(F.sum("counts").alias("n"))
    total = partly.groupBy("pair").agg(F.sum("n").alias("n"))
    return kept_table(total, "pair-counts")


def align_tokenizers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, links: str = "ends", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has the corpus-wide
    highest count of those with its B id, ties included), count_sum (of the links' pairs' counts), groups_sha256.

    Texts that are null or empty, and those that A's or B's ids do not spell in full, have no tokens: zeros and an empty
    digest. Rows with the same id or text count each for itself; null ids stay; other columns are not looked at; an empty
    table gives an empty one; texts of any length are aligned whole.
    """
    blocks = kept_table(aligned_blocks(df, id_col, text_col, path_a, path_b, links, block_chars), "aligned-blocks", few_rows=True)
    totals = pair_counts(blocks)
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    best = totals.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # at most the vocabulary of B
    marked = totals.withColumn("b", b_id).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = blocks.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(marked, "pair").select("of_block", "place", "n", "best")
    kind = dict(df.dtypes)[id_col]

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        row = {c: mine.column(c)[0] for c in mine.column_names}
        place = told.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = told.column("n").to_numpy(), told.column("best").to_numpy(zero_copy_only=False)
        chunk_links, of, doc_chunks, chunks = (np.frombuffer(row[c].as_py(), "<u4").astype(np.int64) for c in ("chunk_links", "links", "doc_chunks", "chunks"))
        sums = [pa.array(summed(summed(values[of], chunk_links)[chunks], doc_chunks)) for values in (best, n)]
        return pa.table([row["ids"].values, *(row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")), *sums, row["digests"].values], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kept = blocks.drop("pairs", "counts")
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return kept.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(run, out)
