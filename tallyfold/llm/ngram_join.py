"""Near-duplicate texts: Jaccard similarity of five-word shingles, by MinHash banding and full verification.

1. Texts with the same words (lower case, white space apart) are one node; copies are counted, never paired.
2. Each node has MinHash values; rows per band are fixed, and the number of bands is the least that finds a pair at the
   threshold with the target recall. Nodes are shuffled on band hashes; every node of a bucket hangs on the bucket's least
   node, one edge per node and band, so edges grow with the nodes whatever the size of a bucket, and no pair is ruled out.
3. Connected components of these edges are candidate families, so each text is shipped to its family once.
4. Families are verified pair by pair on full shingle sets; the links are counted per node and never leave the task as
   rows, only a spanning forest does. Its components are the classes.

Scale: a family within ``block`` texts and WEIGHT shingles meets in one task. A larger one is dealt as pairs of such blocks
over tasks: no task holds an unbounded group, no pair is skipped, and a text goes out once per block of its family. Every
step between jobs is written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget_encoders, free_names, kept_table, mixed, text_of, word_hashes
from .components import connected_components

WORDS = 5
SIMILAR = 0.8
ROWS = 6
RECALL = 0.9999
BLOCK = 1024
WEIGHT = 1 << 20  # shingles in a block, but for a text that has more by itself
PIECE = 1 << 16  # shingles hashed at once


def bands_for(similar: float = SIMILAR, rows: int = ROWS, recall: float = RECALL) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similar**rows)))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a lower-cased text, ascending; none under ``words`` words."""
    w = word_hashes(text.encode())[0]
    if len(w) < words:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - words + 1, np.uint64)
    for k in range(words):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - words + 1 + k])
    return np.unique(h)


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """A row of MinHash values for each non-empty set."""
    rng = np.random.default_rng(20)
    flips = rng.integers(0, 1 << 64, hashes, np.uint64)
    odd = rng.integers(0, 1 << 64, hashes, np.uint64) | np.uint64(1)
    out = np.empty((len(sets), hashes), np.uint64)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (size == 0 or size + len(sets[last]) <= PIECE):
            size += len(sets[last])
            last += 1
        x = np.concatenate(sets[first:last])
        cut = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        for k in range(hashes):
            out[first:last, k] = np.minimum.reduceat((x ^ flips[k]) * odd[k], cut)
        first = last
    return out


def sign(rows: DataFrame, words: int, bands: int, per_band: int) -> DataFrame:
    """From (doc_id, place, node, text): doc_id, place, node, size (shingles), keys (a hash per band; null for short texts and for nodes
    that the task has had)."""

    def run(batches):
        forget_encoders()
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        had: set[int] = set()
        for batch in batches:
            sets, of = [], []
            for k, (node, text) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text"), strict=True)):
                if node not in had:
                    had.add(node)
                    s = shingles(text.as_py(), words)
                    if len(s):
                        of.append(k)
                        sets.append(s)
            size, lists = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            size[of], lists[of] = [len(s) for s in sets], bands
            keys = np.broadcast_to(salt, (len(sets), bands)).copy()
            if sets:
                values = mixed(signatures(sets, bands * per_band))
                for k in range(per_band):
                    keys = mixed(keys ^ values[:, k::per_band])
            offsets = pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32())
            flat = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()), mask=pa.array(lists == 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), batch.column("node"), pa.array(size), flat], ["doc_id", "place", "node", "size", "keys"])

    return rows.select("doc_id", "place", "node", "text").mapInArrow(run, "doc_id long, place long, node long, size long, keys array<long>")


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables that end where a group of rows with equal keys ends; the rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        ends = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        if held:
            tail = held[-1].slice(held[-1].num_rows - 1)
            if any(tail.column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
        if len(ends):
            yield pa.Table.from_batches([*held, batch.slice(0, ends[-1])])
            held = []
            batch = batch.slice(ends[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_cuts(table: pa.Table, *keys: str) -> np.ndarray:
    marks = np.stack([table.column(k).to_numpy() for k in keys])
    return np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, [table.num_rows]])


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The least index in each index's component of a symmetric matrix."""
    roots = np.arange(len(linked))
    while True:
        seen = np.where(linked, roots[None, :], len(roots)).min(axis=1, initial=len(roots))
        new = np.minimum(roots, seen)
        new = np.minimum(new, new[new])
        if (new == roots).all():
            return roots
        roots = new


def blocks(count: Column, node: str) -> Column:
    """For explode: the pairs (lo, hi) of ``count`` blocks that a node takes part in, and its own."""
    own = F.pmod(F.xxhash64(node, F.lit(7)), count).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi"), own.alias("own"))
    )


def family_edges(signed: DataFrame) -> DataFrame:
    """Edges (a, b): each node of a bucket with the bucket's least node, at most one row for each node and band."""
    bare = signed.select("node", F.explode("keys").alias("key"))
    crowded = bare.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top")
    # the key is computed, so that the join deals both sides anew and adaptive execution can split a large bucket
    crowded = crowded.select(F.bitwise_not(F.bitwise_not("key")).alias("k"), "b")
    return bare.join(crowded, F.col("key") == F.col("k")).where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")


def links_of(sets: list[np.ndarray], similar: float) -> np.ndarray:
    """The matrix of pairs with a Jaccard similarity of at least ``similar``, counted on full sets."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    common = np.zeros(m * m, np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(every, kind="stable")
    value, row = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.append(first, len(value)))
    often = count > max(8, m // 16)
    for k in np.unique(count[~often & (count > 1)]).tolist():  # shingles of few texts: each of their pairs has one more
        i, j = np.triu_indices(k, 1)
        step = max(1, (1 << 20) // len(i))
        starts = first[count == k]
        for at in range(0, len(starts), step):
            group = row[starts[at : at + step, None] + np.arange(k)]
            common += np.bincount((group[:, i] * m + group[:, j]).ravel(), minlength=m * m)
    common = common.reshape(m, m)
    common += common.T
    width = 4096
    heavy = np.flatnonzero(often)
    for at in range(0, len(heavy), width):  # shingles of many texts: a product of 0-1 matrices
        part = heavy[at : at + width]
        has = np.zeros((m, len(part)), np.float32)
        at_row = np.concatenate([row[first[c] : first[c] + count[c]] for c in part])
        has[at_row, np.repeat(np.arange(len(part)), count[part])] = 1
        common += np.rint(has @ has.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    # an exact comparison: common / union >= similar with similar in thousandths
    linked = common * 1000 >= round(similar * 1000) * union
    np.fill_diagonal(linked, False)
    return linked


def verified(families: DataFrame, words: int, similar: float) -> DataFrame:
    """From (root, lo, hi, own, node, text): node, many (of several blocks), links, peer (the least node it hangs on)."""
    order = ["root", "lo", "hi"]

    def run(batches):
        for table in whole_groups(batches, *order):
            cut = group_cuts(table, *order)
            node, own, lo, hi, many = (table.column(c).to_numpy() for c in ("node", "own", "lo", "hi", "many"))
            text = table.column("text")
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                _, pick = np.unique(node[a:b], return_index=True)
                pick += a
                linked = links_of([shingles(text[int(k)].as_py(), words) for k in pick], similar)
                if lo[a] != hi[a]:
                    linked &= own[pick][:, None] != own[pick][None, :]
                out.append((node[pick], many[pick], linked.sum(axis=1), node[pick][local_roots(linked)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[k] for o in out]).astype(bool if k == 1 else np.int64)) for k in range(4)], ["node", "many", "links", "peer"]
            )

    return families.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(run, "node long, many boolean, links long, peer long")


def same_words(text_col: str = "text"):
    return F.trim(F.regexp_replace(F.lower(text_of(text_col)), "[\\x20\\x09-\\x0D]+", " "))


def near_classes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similar: float = SIMILAR,
    per_band: int = ROWS,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: ngram_join's columns, place (the 64-bit hash of its text as it stands) and class_place (that
    of the class's least row), so that a class's least row is known where ids repeat."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("raw"))
    text = same_words("raw")
    bands = bands_for(similar, per_band, recall)
    base = rows.select("doc_id", F.xxhash64("raw").alias("place"), text.alias("text")).withColumn("node", F.xxhash64("text"))
    signed = kept_table(sign(base, words, bands, per_band), "signatures")
    alike = signed.groupBy("node", "doc_id", "place").agg(F.count(F.lit(1)).alias("again"), F.max("size").alias("size"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place", "again"))
    nodes = alike.groupBy("node").agg(first.alias("least"), F.sum("again").alias("n_copies"), F.max("size").alias("size"))
    named = [F.struct("least.no_id", "least.doc_id", "least.place").alias("first"), F.col("least.doc_id").alias("rep"), F.col("least.place").alias("place"), F.col("least.again").alias("again")]
    nodes = kept_table(nodes.select("node", *named, "n_copies", "size"), "nodes")
    family = kept_table(connected_components(family_edges(signed.select("node", "keys"))), "families")
    member = family.join(nodes.select("node", "rep", "place", "again", "size"), "node")
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
    parts = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("weight") / F.lit(WEIGHT))).cast("int")
    sizes = sizes.select(F.bitwise_not(F.bitwise_not("root")).alias("of"), parts.alias("parts"))
    asked = member.join(sizes, F.col("root") == F.col("of")).select("root", "parts", "rep", F.col("place").alias("at"), "again", "node")
    # a node's text is that of its least id; ids may repeat or be null, so the hash of the text as it stands decides
    same = (F.xxhash64("raw") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    found = rows.join(asked, same).select("root", "node", text.alias("text"), (F.col("parts") > 1).alias("many"), "parts", "again")
    if not asked.where("again > 1").isEmpty():  # rows alike in id and text: one of them
        found = found.where("again = 1").union(found.where("again > 1").dropDuplicates(["node"]))
    dealt = found.select("root", "node", "text", "many", F.explode(blocks(F.col("parts"), "node")).alias("at"))
    dealt = dealt.select("root", "at.lo", "at.hi", "at.own", "node", "many", "text")
    checked = kept_table(verified(dealt, words, similar), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("peer").alias("peer"))
    over = checked.where("many").select(F.col("node").alias("a"), F.col("peer").alias("b"))
    if not over.isEmpty():
        joined = connected_components(over).select("node", F.col("root").alias("far"))
        links = links.join(joined, "node", "left").select("node", "n_links", F.coalesce("far", "peer").alias("peer"))
    full = nodes.select("node", "first", "n_copies").join(links, "node", "left")
    full = kept_table(full.select("node", "first", "n_copies", F.coalesce("peer", "node").alias("peer"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "members")
    classes = full.groupBy(F.col("peer").alias("of")).agg(F.min("first").alias("least"))
    told = full.join(classes.select(F.bitwise_not(F.bitwise_not("of")).alias("of"), "least"), F.col("peer") == F.col("of"))
    told = told.select(F.col("node").alias("of"), F.col("least.doc_id").alias("class_id"), F.col("least.place").alias("class_place"), "n_links", "n_copies")
    out = signed.select("doc_id", "place", "node").join(kept_table(told, "classes"), F.col("node") == F.col("of"))
    return out.select("doc_id", "class_id", "n_links", "n_copies", "place", "class_place")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: doc_id, class_id (the least id of its class), n_links (other texts it is similar to),
    n_copies (rows with its words, itself too). ``settings``: see ``near_classes``.

    A null text counts as empty. Texts without a word are copies of each other, as are texts under five words with the
    same words; these have no links. Null ids are greater than any other; a class of these alone has a null class_id.
    Repeated rows are copies. Nodes are known by a 64-bit hash of their words. An empty table gives an empty result.
    """
    return near_classes(df, id_col, text_col, **settings).select("doc_id", "class_id", "n_links", "n_copies")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``df``, all columns, that are the least of their class (by id, then by a hash of the text), each once.

    Ids may repeat, with the same text or others, or be null. Rows that are alike in id and text count as one row.
    """
    told = near_classes(df, id_col, text_col, **settings).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("place") == F.col("class_place")))
    k_id, k_place, k_count = free_names(df, "_keep_id", "_keep_place", "_keep_count")
    told = told.groupBy(F.col("doc_id").alias(k_id), F.col("place").alias(k_place)).agg(F.count(F.lit(1)).alias(k_count))
    told = kept_table(told, "kept-rows")
    joined = df.join(told, df[id_col].cast("long").eqNullSafe(F.col(k_id)) & (F.xxhash64(df[text_col]) == F.col(k_place)))
    once = joined.where(F.col(k_count) == 1).select(*[df[c] for c in df.columns])
    many = joined.where(F.col(k_count) > 1).dropDuplicates([k_id, k_place]).select(*[df[c] for c in df.columns])
    return once.union(many)
