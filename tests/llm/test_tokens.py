"""Token counts and token alignment: equal to the libraries on whole texts."""

import cProfile
import hashlib
import pstats
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyfold.llm import alignment as alignment_module
from tallyfold.llm import token_counts as counts_module
from tallyfold.llm.alignment import Aligner, align_tokenizers, aligned_blocks, pair_counts
from tallyfold.llm.common import chunks_of, kept_table, tokenizer_path
from tallyfold.llm.queries import QUERIES
from tallyfold.llm.token_counts import PairCounter, token_counts

SMALL = "/root/testdata/sf0.001"
BYTES, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "   ", "\n", " \n ", "a", " a", "a ", "a \n", "a\n  b", "\n x", "\r\n\r\n", "a;\r\n b );\r", "x\r", "x \r", "Hello WORLD's it'll <|endoftext|> x<|endoftext|><|endoftext|>y <|ENDOFTEXT|>",
    "<|endoftext|>", "naïve café é ﬁ 12345 ½²", "a" * 3000 + "b", "日本語 🙂‍\U0001f525 \x1c\x85x", "! \x1c!\x1c a　 b　  c\xa0 d", "don't 'S", "a▁b ▁", "<s> </s> <unk> <0x41>", "﻿a ​", "a\x00b",
    "՘࢏ x\U0003fc3f", "lorem ipsum, " * 3000, "  x  y  ", "₿ \U0010ffff",
]
ANY_TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r　\xa0\x1c▁.,;!?'<|>sStTdDlLeE012éÉßñaAoOnNiIhH"), st.characters(min_codepoint=1, max_codepoint=0x24F), st.characters(exclude_categories=["Cs"])), max_size=50)


def frame(spark, rows):
    extra = {"n_tokens": F.lit("c"), "n_bytes": F.lit(1), "block": F.lit(2), "n": F.lit(3), "PAIR": F.lit(4)}
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).withColumns(extra)


def odd_rows():
    return [*enumerate(ODD), (3, ODD[3]), (None, "null id"), (140, ODD[16])]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def counter():
    return PairCounter(BYTES)


def test_chunks_hold_the_text():
    for text in ODD:
        assert "".join(chunks_of(text or "")) == (text or "")
    assert chunks_of(" a b\n\nc　 d ") == [" a", " b", "\n\nc　 d", " "]


def test_counts_of_odd_texts(library, counter):
    for text in ODD:
        assert counter.count(text or "") == len(library.encode(text or "", add_special_tokens=False).ids), text


@settings(max_examples=400, deadline=None)
@given(ANY_TEXT)
def test_counts_of_any_text(library, counter, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_count_caches_roll_over(library, monkeypatch):
    monkeypatch.setattr(counts_module, "CACHE", 3)
    small = PairCounter(BYTES)
    for k in range(40):
        text = " ".join(["the", "of.", "zebra,", "Über", "x1"][(k * j) % 5] for j in range(7))
        assert small.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert max(map(len, [*small.words, *small.chunks])) <= 3


def test_count_operator(spark, library):
    got = token_counts(frame(spark, odd_rows()), limit=10).collect()
    want = []
    for i, t in odd_rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 10))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = token_counts(frame(spark, odd_rows()).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_count_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), n, n > 1024) for r in docs for n in [len(library.encode(r["text"] or "", add_special_tokens=False).ids)]}
    got = [tuple(r) for r in QUERIES["op12_token_counts"](spark, SMALL).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    assert len(got) == len(docs) and set(got) == want


@pytest.fixture(scope="module")
def aligner():
    return Aligner(BYTES, PIECES)


def whole_groups(aligner, text, links="ends"):
    """(groups, links) of a whole text, from the libraries' ids of it, in plain loops."""
    if not text:
        return [], []
    ids_a, ids_b = (x.tolist() for x in aligner.ids(text))
    raw_a, raw_b = [aligner.bytes_a[i] for i in ids_a], [aligner.bytes_b[i] for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == b" " + text.encode():
        return [], []
    groups, pairs = [], []
    a = b = at_a = at_b = 0
    mine_a, mine_b = [], []
    while a < len(ids_a) or b < len(ids_b):
        if at_a <= at_b and a < len(ids_a):
            at_a += len(raw_a[a])
            mine_a.append(ids_a[a])
            a += 1
        else:
            at_b += len(raw_b[b])
            mine_b.append(ids_b[b])
            b += 1
        if at_a == at_b:
            groups.append((mine_a, mine_b))
            pairs += [(mine_a[-1], mine_b[-1])] if links == "ends" else [(x, y) for x in mine_a for y in mine_b]
            mine_a, mine_b = [], []
    return groups, pairs


def shown(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def same_alignment(aligner, texts):
    found = aligner.parts([chunks_of(" " + t) if t and "▁" not in t else [] for t in texts])
    for text, parts in zip(texts, found, strict=True):
        groups, pairs = whole_groups(aligner, text, aligner.links)
        assert b";".join(p[0] for p in parts).decode() == shown(groups), text
        assert [sum(p[k] for p in parts) for k in (1, 2, 3)] == [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups)]
        assert sorted((x >> 32, x & (1 << 32) - 1) for p in parts for x in p[4].tolist()) == sorted(pairs)


@pytest.mark.parametrize("links", ["ends", "group"])
def test_alignment_of_odd_texts(links):
    small = Aligner(BYTES, PIECES, links)
    same_alignment(small, [t or "" for t in ODD])
    for t in ODD:
        same_alignment(small, [t or ""])


def test_odd_texts_without_tokens(aligner):
    """Null and empty texts, and those whose pieces spell another text, have no tokens; all others have."""
    without = [t for t in ODD if not whole_groups(aligner, t)[0]]
    assert without == [None, "", "a▁b ▁"]


@settings(max_examples=300, deadline=None)
@given(st.lists(ANY_TEXT, min_size=1, max_size=3))
def test_alignment_of_any_text(aligner, texts):
    same_alignment(aligner, texts)


def test_alignment_caches_roll_over(monkeypatch):
    monkeypatch.setattr(alignment_module, "CACHE", 3)
    monkeypatch.setattr(alignment_module, "PIECE", 9)
    small = Aligner(BYTES, PIECES)
    for k in range(30):
        same_alignment(small, [" ".join(["the", "of.", "zebra,", "Über", "x1"][(k * j) % 5] for j in range(7)), "the x1"])


def calls_of(work):
    profile = cProfile.Profile()
    profile.runcall(work)
    return pstats.Stats(profile).total_calls


def test_alignment_takes_chunks_in_bulk():
    """Python calls are what the operator's CPU goes to: a new chunk takes a few, one seen before in the block none."""
    small = Aligner(BYTES, PIECES)
    texts = [[f" {a}{b}x{k}" for a in "bcdfghklm" for b in "aeiou"] for k in range(100)]
    n = sum(map(len, texts))
    small.parts([[" a"]])
    assert calls_of(lambda: small.parts(texts)) < 6 * n
    block = alignment_module.Block()
    block.add([*range(100)], texts, n, small)
    assert calls_of(lambda: block.add([*range(100)], texts, n, small)) < n / 4
    row, parts = block.row("b", pa.int64()).to_pylist()[0], small.parts(texts) * 2
    assert row["ids"] == [*range(100)] * 2 and sum(row["counts"]) == sum(row["n_links"])
    assert row["n_links"] == [sum(len(p[4]) for p in x) for x in parts] and row["n_a"] == [sum(p[1] for p in x) for x in parts]
    assert row["digests"] == [hashlib.sha256(b";".join(p[0] for p in x)).hexdigest() for x in parts]


def test_texts_that_ids_do_not_spell_count_nowhere(monkeypatch):
    """Nor do their other chunks, before and after texts that share them."""
    small, spelled = Aligner(BYTES, PIECES), Aligner.spelled
    monkeypatch.setattr(small, "spelled", lambda a, b, text: "Q" not in text and spelled(small, a, b, text))
    texts = [" only here Q", " the zebra", " zebra Q", "", " the the"]
    block = alignment_module.Block()
    for k, t in enumerate(texts):
        block.add([k], [chunks_of(t)], len(t), small)
    row = block.row("b", pa.int64()).to_pylist()[0]
    want = [whole_groups(small, t[1:])[1] if "Q" not in t else [] for t in texts]
    assert row["n_links"] == list(map(len, want)) and [bool(d) for d in row["digests"]] == list(map(bool, want))
    assert {(p >> 32, p & (1 << 32) - 1): n for p, n in zip(row["pairs"], row["counts"], strict=True)} == dict(Counter(p for x in want for p in x))


def brute_alignment(aligner, rows, links="ends"):
    told = [(i, *whole_groups(aligner, t, links)) for i, t in rows]
    count = Counter(p for _, _, pairs in told for p in pairs)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(pairs), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(shown(groups).encode()).hexdigest() if groups else "")
        for i, groups, pairs in told
    ]


@pytest.mark.parametrize("links", ["ends", "group"])
def test_alignment_operator(spark, aligner, links):
    rows = [*odd_rows(), *((500 + k, "the zebra of Über the x1 zebras") for k in range(40))]
    got = [tuple(r) for r in align_tokenizers(frame(spark, rows).repartition(3), links=links, block_chars=300).collect()]
    assert sorted(got, key=repr) == sorted(brute_alignment(aligner, rows, links), key=repr)
    empty = align_tokenizers(frame(spark, rows).limit(0))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_pair_counts(spark, aligner):
    rows = odd_rows()
    blocks = aligned_blocks(frame(spark, rows).repartition(4), block_chars=50)
    got = {(r["pair"] >> 32, r["pair"] & (1 << 32) - 1): r["n"] for r in pair_counts(blocks).collect()}
    assert got == Counter(p for _, t in rows for p in whole_groups(aligner, t)[1])


def test_alignment_query_equals_brute_force(spark, aligner):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op13_token_alignment"](spark, SMALL).collect()]
    assert sorted(got) == sorted(brute_alignment(aligner, docs))


def test_rows_of_megabytes_are_kept_in_small_row_groups(spark):
    """A task that writes many blocks holds few of them at a time, and so does one that reads them."""
    import os
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([os.urandom(2 << 20)])], ["id", "payload"])

    kept = kept_table(spark.range(0, 40, 1, 1).mapInArrow(run, "id long, payload binary"), "blocks", few_rows=True)
    sizes = [g for f in kept.inputFiles() for m in [pq.ParquetFile(urlparse(f).path).metadata] for g in [m.row_group(k).num_rows for k in range(m.num_row_groups)]]
    assert sum(sizes) == 40 and max(sizes) <= 10
