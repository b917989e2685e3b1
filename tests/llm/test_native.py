"""Exact dedup, line dedup and components: edge cases and brute force."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import exact_dedup as ed
from tallyfold.llm.components import connected_components
from tallyfold.llm.line_dedup import line_dedup
from tallyfold.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in rows], DOC)


def by_text(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("bound", [1000, 3])
def test_exact_dedup(spark, monkeypatch, bound):
    """Nulls, empty and long texts, ties, repeated rows; with the small bound hot texts are salted over many runs."""
    monkeypatch.setattr(ed, "HOT_ROWS", bound)
    rows = [(k, "same  text") for k in range(40)] + [(100, None), (101, ""), (102, " "), (103, "\t\n"), (104, "x" * 200_000), (105, "x" * 200_000 + "y"), (7, "same text"), (None, "same\ttext"), (None, "z"), (None, "z")]
    random.Random(1).shuffle(rows)
    frame = docs(spark, rows).withColumns({"h": F.lit(1), "norm": F.lit("clash"), "salt": F.lit(0), "keep_id": F.lit("a")})
    got = ed.exact_dedup(frame.repartition(5)).collect()
    groups = by_text(rows)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        mine = [r for r in got if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        least = min((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and {r["group_size"] for r in mine} == {len(ids)} and {r["keep_id"] for r in mine} == {least}
        assert [r["doc_id"] for r in mine if r["kept"]] == [least]


def test_exact_dedup_empty(spark):
    assert ed.exact_dedup(docs(spark, [])).collect() == []


def test_line_dedup(spark):
    line, rare = "all rights are reserved here", "this line is on few sites"
    rows = [(k, f"own words of {k} stand here\n  {line}\nOk\n", "en", f"s{k % 9}", 0) for k in range(18)]
    rows += [(50, line, "en", "s1", 0), (51, f"{rare}\n{line}\n{line}", "en", None, 0), (52, rare, "en", "s2", 0), (53, None, "en", "s3", 0), (54, "", "en", "s4", 0), (50, line, "en", "s1", 0)]
    frame = spark.createDataFrame(rows, DOC).withColumns({"pos": F.lit(1), "line": F.lit("c"), "h1": F.lit(0)})
    got = {}
    for r in line_dedup(frame, min_sites=8).collect():
        got.setdefault(r["doc_id"], r)
    assert got[0]["text"] == rows[0][1] and got[0]["_n_removed"] == 0
    assert all(got[k]["text"] == f"own words of {k} stand here\nOk\n" and got[k]["_kept"] for k in range(1, 18))
    assert got[50]["text"] == "" and not got[50]["_kept"]
    assert got[51]["text"] == rare and got[51]["_n_removed"] == 2
    assert got[52]["text"] == rare and got[53]["text"] is None and got[53]["_kept"] and got[54]["_kept"]
    assert line_dedup(frame.limit(0)).collect() == []


def test_every_line_may_be_boilerplate(spark):
    """One word, a script without spaces, and white space of any kind around a line."""
    shared = ["Les.", "版権所有無断転載禁止", "all rights are reserved"]
    edges = ["", "\t", "\r", " \u3000", "\u00a0 "]
    rows = [(k, "\n".join([f"own{k}", *(f"{edges[k % 5]}{line}{edges[(k + 1) % 5]}" for line in shared), " ", ""]), "en", f"s{k}", 0) for k in range(9)]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, DOC), min_sites=8, every_line=True).collect()}
    assert got[0]["text"] == rows[0][1]
    assert all(got[k]["text"] == f"own{k}\n \n" and got[k]["_n_removed"] == 3 for k in range(1, 9))


def test_near_threshold_counts_are_exact(spark):
    """Lines on 6 to 14 sites around a threshold of 10, with sketches too small to tell."""
    rows = [(100 * n + s, f"line number {n} of all", "en", f"site {s}", 0) for n in range(6, 15) for s in range(n)]
    got = line_dedup(spark.createDataFrame(rows, DOC), min_sites=10, lg_k=4).where("_n_removed > 0").collect()
    assert {r["doc_id"] // 100 for r in got} == set(range(10, 15))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, DATA).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_native_plans(spark):
    for name in ("op2_line_dedup", "op7_content_sort"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(200, 210), (210, 205), (300, 300)] + [(400, 401 + k) for k in range(50)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges] * 2
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(61)} == {0} and got[205] == got[210] == 200 and got[300] == 300 and {got[401 + k] for k in range(50)} == {400}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_line_dedup_with_clashing_names(spark):
    """Columns with the names that the operator uses or adds: the former are no matter, the latter are refused or renamed."""
    frame = docs(spark, [(k, f"own {k}\nall rights are reserved here") for k in range(3)]).withColumns({n: F.lit("c") for n in ("_of_id", "_of_text", "_of_lines", "_of_hash", "h1", "t", "gone")})
    got = line_dedup(frame, min_sites=1)
    assert got.columns == [*frame.columns, "_n_lines", "_n_removed", "_kept"] and {r["_of_id"] for r in got.collect()} == {"c"}
    taken = frame.withColumn("_KEPT", F.lit(1))
    with pytest.raises(ValueError):
        line_dedup(taken)
    assert [r["k"] for r in line_dedup(taken, min_sites=1, added=("a", "b", "k")).collect()] == [True] * 3
