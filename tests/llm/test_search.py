"""Ranked search: postings, the merge and whole queries against brute force and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.llm import search as module
from tallyfold.llm.queries import ORACLE_SQL, QUERIES
from tallyfold.llm.search import Postings, build_index, packed, postings_of, ranked_search, search, terms_of, top_documents, unpacked

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, queries, k=10):
    """Lists of (item, rank, doc_id, score) by the stated formulas over plain lists."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: TERM.findall((t or "").translate(low))
    held = [(i, Counter(ws), len(ws)) for i, ws in ((i, split(t)) for i, t in docs) if ws]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i, s))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, x[2], x[3]) for r, x in enumerate(scored[:k], 1)]
    return out


def same(df, want):
    got = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def frame(spark, rows):
    clash = {c: F.lit(7) for c in ("shard", "TERM", "df", "postings", "ids", "item", "q", "rank", "score")}
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).withColumns(clash)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({"q": F.lit(1), "terms": F.lit(2), "item": F.lit(3), "chars": F.lit(0)})


@given(st.lists(st.integers(0, 2**62)))
def test_packed_numbers(numbers):
    raw, at = packed(np.array(numbers, np.int64))
    assert unpacked(raw).tolist() == numbers
    for k in range(len(numbers)):
        assert unpacked(raw[at[k] : at[k + 1]]).tolist() == [numbers[k]]


def test_terms():
    assert terms_of("Ab-9 c_É日本\x7fZ　x") == ["ab".encode(), b"9", b"c", "É日本".encode(), "z　x".encode()]
    assert terms_of(None) == terms_of(" -\n") == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(0, 4), max_size=25), max_size=8), st.integers(1, 6))
def test_merge_equals_brute_force(lists, k):
    """Few different gains make many ties; documents with no gain must not appear."""
    total = Counter()
    for x in lists:
        total.update({d: g for d, g in x.items() if g})
    want = sorted(((s, d) for d, s in total.items() if s), key=lambda x: (-x[0], x[1]))[:k]
    made = [Postings(np.array(sorted(x), np.int64), np.array([x[d] for d in sorted(x)], np.int64)) for x in lists]
    assert top_documents(made, k) == want


def test_operator(spark):
    rng = random.Random(4)
    words = ["the", "The", "of", "É", "zeta", "x9", "rare", "日本"]
    docs = [(k, " ".join(rng.choices(words, weights=[30, 9, 20, 3, 2, 2, 1, 1], k=rng.randrange(1, 40)))) for k in range(300)]
    docs += [(300, None), (301, ""), (302, " .;- "), (303, "long " * 60_000 + "rare"), (5, docs[5][1]), (5, docs[5][1]), (None, docs[5][1]), (304, "the")] + [(400 + k, "copy of rare text") for k in range(40)]
    rng.shuffle(docs)
    queries = [(1, "rare THE text"), (2, None), (3, ""), (4, "nowhere"), (5, "the the of of"), (6, "É 日本 x9 long zeta rare of the"), (6, "zeta"), (None, "x9"), (7, "copy " * 900)]
    want = brute(docs, queries)
    same(ranked_search(frame(spark, docs).repartition(3), items(spark, queries)), want)
    index = build_index(frame(spark, docs).repartition(2), shard_bytes=700)  # many shards
    assert index.where("term is null").count() > 20
    same(search(index, items(spark, queries)), want)
    same(search(index, items(spark, queries), query_chars=8), want)  # many blocks
    same(search(index, items(spark, queries), k=3), brute(docs, queries, 3))


def test_index_holds_every_posting(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for r in docs:
        for term, n in Counter(terms_of(r["text"])).items():
            want[(term, r["doc_id"], n)] += 1
    index = build_index(spark.read.parquet(f"{SMALL}/documents.parquet"), shard_bytes=100_000).collect()
    ids = {r["shard"]: r["ids"] for r in index if r["term"] is None}
    got = Counter()
    for r in index:
        if r["term"] is not None:
            places, tf = postings_of(bytes(r["postings"]))
            assert len(places) == r["df"] and (np.diff(places) > 0).all()
            got.update((bytes(r["term"]), ids[r["shard"]][d], n) for d, n in zip(places.tolist(), tf.tolist(), strict=True))
    assert got == want and all(x == sorted(x) for x in ids.values())


def test_empty_tables(spark):
    full, none = frame(spark, [(1, "a b")]), frame(spark, []).limit(0)
    assert ranked_search(none, items(spark, [(1, "a")])).count() == 0
    assert ranked_search(full, items(spark, [(1, "a")]).limit(0)).count() == 0
    assert ranked_search(full, items(spark, [(1, "c")])).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    con = duckdb.connect()
    data = f"/root/testdata/{sf}"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(ORACLE_SQL["op11_ranked_search"]).fetchall()
    same(QUERIES["op11_ranked_search"](spark, data), want)
    if sf == "sf0.001":
        docs, queries = (con.execute(q).fetchall() for q in ("SELECT doc_id, text FROM documents", "SELECT item_id, text FROM benchmark"))
        assert sorted(want) == sorted(brute(docs, queries))
    assert module.K == 10
