"""Ranked lexical search over a sharded inverted index, a document at a time.

Index (``build_index``): documents are taken in scan order into shards of bounded text. A shard keeps its documents sorted
by id, and for each term the places of its documents in that order, as gaps, with the term's occurrences, as variable-byte
numbers. A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A-Z lowered. The index is a
table: one row per shard and term, and one per shard with its documents' ids and lengths.

Search (``search``): each shard merges a query's postings with a heap of cursors keyed by document place, scores one document
at a time, and keeps the best ``k`` in a heap keyed by score and then id. Lists that together can't lift a document above the
worst kept one are not merged but looked up (their cursors only move forward), and a lookup ends when what is left can't
matter; both are exact. The shards' lists are then merged.

Score of a term in a document: ``w * ((10^9 * tf) div (1000 * tf + 8 * m))``, with ``w = floor(1000 * ln((2N+2) / (2df+1)))``,
``m = 10 + (90 * n * N) div L``; N documents with terms, L their terms, n the document's, df the documents with the term.

Scale: the index takes one map without a shuffle; memory is a shard's, whatever the scan's partitions are. A search moves
the postings of its terms, by shard, and at most k rows per shard and query. Queries are taken in blocks of bounded text
(QUERY_CHARS), each one pass over the index's rows of its terms; what is broadcast, and what the driver holds, is a block.
"""

from __future__ import annotations

import heapq
import math
import uuid
from bisect import bisect_left
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_table, text_of

SHARD_BYTES = 24 << 20  # of text in a shard; a longer document is a shard's last
QUERY_CHARS = 4 << 20  # of distinct query terms in a block of queries
K = 10
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The text's terms in order, in UTF-8."""
    return (text or "").encode().translate(TERM_BYTES).split()


# ---------------------------------------------------------------------------------------------------------------
# Numbers in variable bytes: seven bits a byte, least first, the high bit set while more follow.
# ---------------------------------------------------------------------------------------------------------------


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of non-negative numbers, and where each number's begin, with the end behind."""
    rest = numbers.astype(np.uint64)
    size = np.ones(len(rest), np.int64)
    for k in range(1, 10):
        size += rest >= np.uint64(1 << 7 * k)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    live = np.arange(len(rest))
    k = 0
    while len(live):
        more = size[live] > k + 1
        out[at[live] + k] = (rest[live] & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        rest[live] >>= np.uint64(7)
        live, k = live[more], k + 1
    return out, at


def unpacked(raw: np.ndarray) -> np.ndarray:
    """All numbers in the bytes."""
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1] + 1])
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        at = starts + k
        live = at <= ends
        out[live] |= (raw[at[live]].astype(np.int64) & 127) << (7 * k)
    return out


# ---------------------------------------------------------------------------------------------------------------
# The index.
# ---------------------------------------------------------------------------------------------------------------


class ShardWriter:
    """Gathers documents; ``rows`` gives the shard's rows (shard, term, df, postings, ids, lengths)."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids: list = []
        self.terms: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.length: list[int] = []
        self.size = 0

    def add(self, doc_id, text: str) -> None:
        terms = terms_of(text)
        self.size += len(text)
        if not terms:
            return
        counts = Counter(terms)
        known = self.known
        self.ids.append(doc_id)
        self.length.append(len(terms))
        self.terms.append(np.array([known.setdefault(t, len(known)) for t in counts], np.int32))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))

    def rows(self, shard: str, id_type: pa.DataType, schema: pa.Schema):
        ids = pa.array(self.ids, id_type)
        order = np.asarray(pc.sort_indices(ids, null_placement="at_end")) if len(ids) else np.zeros(0, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.length, np.int64)[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([None], pa.binary()), pa.array([len(ids)], pa.int64()), pa.array([None], pa.binary()), pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(id_type)), pa.array([lengths.tolist()], pa.list_(pa.int64()))],
            schema=schema,
        )
        if not len(order):
            return
        sizes = np.array([len(t) for t in self.terms], np.int64)
        term, doc, tf = np.concatenate(self.terms), np.repeat(place, sizes), np.concatenate(self.tf)
        names = list(self.known)
        rank = np.empty(len(names), np.int32)
        by_name = np.array(sorted(range(len(names)), key=names.__getitem__))
        rank[by_name] = np.arange(len(names), dtype=np.int32)
        term = rank[term]
        at = np.lexsort((doc, term))
        term, doc, tf = term[at], doc[at], tf[at]
        df = np.bincount(term, minlength=len(names))
        first = np.concatenate([[0], np.cumsum(df)])
        gap = np.diff(doc, prepend=-1)
        gap[first[:-1]] = doc[first[:-1]] + 1
        both = np.empty(2 * len(gap), np.int64)
        both[0::2], both[1::2] = gap - 1, tf - 1
        raw, cut = packed(both)
        raw, cut = raw.tobytes(), cut[2 * first]
        for a in range(0, len(names), 50_000):
            b = min(len(names), a + 50_000)
            n = b - a
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n), pa.array([names[k] for k in by_name[a:b]], pa.binary()), pa.array(df[a:b]), pa.array([raw[cut[k] : cut[k + 1]] for k in range(a, b)], pa.binary()), pa.nulls(n, pa.list_(id_type)), pa.nulls(n, pa.list_(pa.int64()))],
                schema=schema,
            )


def postings_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of documents, ascending, and the term's occurrences in each."""
    both = unpacked(np.frombuffer(raw, np.uint8))
    return np.cumsum(both[0::2] + 1) - 1, both[1::2] + 1


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as a table kept in the shared folder: shard, term, df, postings, ids, lengths.

    A row with a null term stands for its shard: df documents, their ids in order (null ids last) and their numbers of
    terms. Documents without a term (null and empty texts too) are in no row. Rows that share an id are documents each;
    an empty table gives an empty index; other columns are not looked at.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        from pyspark import TaskContext

        part, made, writer, schema = TaskContext.get().partitionId(), 0, ShardWriter(), None
        stamp = uuid.uuid4().hex[:8]  # tells apart what two attempts at a task name; only one's rows are kept
        for batch in batches:
            id_type = batch.column("doc_id").type
            schema = pa.schema([("shard", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("postings", pa.binary()), ("ids", pa.list_(id_type)), ("lengths", pa.list_(pa.int64()))])
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                writer.add(doc_id, text.as_py())
                if writer.size >= shard_bytes:
                    yield from writer.rows(f"{part}-{made}-{stamp}", id_type, schema)
                    made, writer = made + 1, ShardWriter()
        if writer.ids:
            yield from writer.rows(f"{part}-{made}-{stamp}", id_type, schema)

    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    built = rows.mapInArrow(run, f"shard string, term binary, df long, postings binary, ids array<{kind}>, lengths array<long>")
    return kept_table(built, "search-index")


# ---------------------------------------------------------------------------------------------------------------
# One query in one shard.
# ---------------------------------------------------------------------------------------------------------------


class Postings:
    """A term's documents in a shard, ascending, and what it adds to each one's score."""

    __slots__ = ("docs", "gains", "most")

    def __init__(self, docs: np.ndarray, gains: np.ndarray):
        keep = gains > 0
        self.docs, self.gains = docs[keep].tolist(), gains[keep].tolist()
        self.most = max(self.gains, default=0)


def top_documents(lists: list[Postings], k: int) -> list[tuple[int, int]]:
    """At most ``k`` (score, place), best first, equal scores by place: the highest sums over the lists, all above 0."""
    lists = sorted((x for x in lists if x.docs), key=lambda x: x.most)
    below = [0]  # the most that the first lists can add together
    for x in lists:
        below.append(below[-1] + x.most)
    best: list[tuple[int, int]] = []  # heap of (score, -place)
    cursors = [0] * len(lists)  # of the lists that are looked up
    merged = 0  # lists from here on are merged, those before only looked up
    heap = [(x.docs[0], n, 0) for n, x in enumerate(lists)]
    heapq.heapify(heap)
    bar = 0  # a score must be above it: places ascend, so an equal one would lose
    while heap:
        doc = heap[0][0]
        score = 0
        while heap and heap[0][0] == doc:
            _, n, at = heap[0]
            x = lists[n]
            score += x.gains[at]
            at += 1
            if n < merged:  # merged no more
                cursors[n] = at
                heapq.heappop(heap)
            elif at < len(x.docs):
                heapq.heapreplace(heap, (x.docs[at], n, at))
            else:
                cursors[n] = at
                heapq.heappop(heap)
        n = merged - 1
        while n >= 0 and score + below[n + 1] > bar:
            x = lists[n]
            at = cursors[n] = bisect_left(x.docs, doc, cursors[n])
            if at < len(x.docs) and x.docs[at] == doc:
                score += x.gains[at]
                cursors[n] = at + 1
            n -= 1
        if n >= 0 or score <= bar:
            continue
        if len(best) < k:
            heapq.heappush(best, (score, -doc))
        else:
            heapq.heapreplace(best, (score, -doc))
        if len(best) == k:
            bar = best[0][0]
            was = merged
            while merged < len(lists) and below[merged + 1] <= bar:
                merged += 1
            if merged > was:
                kept = []
                for entry in heap:
                    if entry[1] < merged:
                        cursors[entry[1]] = entry[2]
                    else:
                        kept.append(entry)
                heap = kept
                heapq.heapify(heap)
    return [(s, -d) for s, d in sorted(best, key=lambda x: (-x[0], -x[1]))]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---------------------------------------------------------------------------------------------------------------
# Search.
# ---------------------------------------------------------------------------------------------------------------


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per query: item (its id), terms (distinct), chars."""
    kind = dict(queries.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.binary())), pa.array([sum(map(len, t)) for t in found], pa.int64())], ["item", "terms", "chars"])

    return queries.select(F.col(id_col).alias("item"), text_of(text_col).alias("text")).mapInArrow(run, f"item {kind}, terms array<binary>, chars long").where("chars > 0")


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = K, query_chars: int = QUERY_CHARS) -> DataFrame:
    """The ``k`` best documents of each query, of those with a score above 0: item_id, rank, doc_id, score.

    Ranks begin at 1, highest score first, equal scores by ascending doc_id (null ids last); rows of one id are ranked each
    for itself. A query is a set of terms. Queries without a term, a null text's too, and those whose terms no document has
    give no row; queries that share an id are one list each, told apart by no column. An empty index or table of queries
    gives an empty result.
    """
    spark = index.sparkSession
    item_kind = dict(queries.dtypes)[id_col]
    ids_kind = dict(index.dtypes)["ids"][6:-1]
    schema = f"item {item_kind}, q long, doc_id {ids_kind}, score long"
    asked = kept_table(_query_terms(queries, id_col, text_col).withColumn("q", F.monotonically_increasing_id()), "search-queries")
    total = asked.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    n_docs, n_terms = index.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    blocks = max(1, math.ceil(total / query_chars))
    found = [_search_block(spark, index, asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b), schema, k, n_docs, n_terms) for b in range(blocks)]
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def _search_block(spark, index: DataFrame, asked: DataFrame, schema: str, k: int, n_docs: int, n_terms: int) -> DataFrame:
    rows = asked.select("item", "q", "terms").collect()  # a block: at most about QUERY_CHARS of terms
    if not rows or not n_docs:
        return spark.createDataFrame([], schema)
    wanted = sorted({t for r in rows for t in r["terms"]})
    terms = F.broadcast(spark.createDataFrame([(bytes(t),) for t in wanted], "term binary"))
    postings = index.where("term is not null").join(terms, "term", "leftsemi").select("shard", "term", "df", "postings", "ids", "lengths")
    shards = index.where("term is null").select("shard", "term", "df", "postings", "ids", "lengths")
    df = {bytes(r["term"]): r["df"] for r in postings.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # by the block's terms
    held = spark.sparkContext.broadcast(
        (
            {t: (n, weight(n_docs, df[t])) for n, t in enumerate(sorted(df))},
            [(r["item"], r["q"], [bytes(t) for t in r["terms"] if bytes(t) in df]) for r in rows],
        )
    )

    def run(table: pa.Table) -> pa.Table:
        weights, queries = held.value
        head = table.filter(pc.is_null(table.column("term"))).slice(0, 1)
        ids, lengths = head.column("ids").combine_chunks().flatten(), head.column("lengths").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 8 * (10 + 90 * lengths * n_docs // n_terms)
        mine: dict[bytes, Postings] = {}
        for term, raw in zip(table.column("term").to_pylist(), table.column("postings").to_pylist(), strict=True):
            if term is not None:
                docs, tf = postings_of(raw)
                mine[term] = Postings(docs, weights[term][1] * (1_000_000_000 * tf // (1000 * tf + m[docs])))
        items, q, place, score = [], [], [], []
        for item, number, query in queries:
            for s, d in top_documents([mine[t] for t in query if t in mine], k):
                items.append(item)
                q.append(number)
                place.append(d)
                score.append(s)
        return pa.table([pa.array(items, item_type), pa.array(q, pa.int64()), ids.take(pa.array(place, pa.int64())), pa.array(score, pa.int64())], names=["item", "q", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(asked.schema["item"].dataType)
    return postings.unionByName(shards).groupBy("shard").applyInArrow(run, schema)


def ranked_search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = K) -> DataFrame:
    """Builds the index of ``docs`` and searches it: see ``build_index`` and ``search``."""
    return search(build_index(docs, id_col, text_col), queries, query_id, query_text, k)
