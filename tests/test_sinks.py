"""Sinks that many tasks write: order, quoting, empty tables, and the same bytes as one writer's."""

import csv
import json

from pyspark.sql import functions as F

from tallyfold.sources import sinks

ODD = ["plain", "", None, 'say "x"', "a,b", "line\nbreak", " edge ", "é 日本", "\\", "'"]


def test_csv_is_ordered_and_whole(spark, tmp_path):
    rows = [(k, ODD[k % len(ODD)]) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("left out", F.lit(1)).repartition(7)
    path = f"file://{tmp_path}/out.csv"
    for _ in range(2):  # over a file that is there
        sinks.write_csv(df, path, ["t", "a,b", "k"], [F.desc("k")])
    with open(tmp_path / "out.csv", newline="", encoding="utf-8") as f:
        got = list(csv.reader(f))
    assert got[0] == ["t", "a,b", "k"]
    assert got[1:] == [[t or "", "", str(k)] for k, t in sorted(rows, reverse=True)]
    assert [p.name for p in tmp_path.iterdir()] == ["out.csv"]
    sinks.write_csv(df.limit(0), path, ["k", "t"], ["k"])
    assert (tmp_path / "out.csv").read_text() == "k,t\n"


def test_csv_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    joined = []
    join = sinks.join_files
    monkeypatch.setattr(sinks, "join_files", lambda s, pieces, target: (joined.append(pieces), join(s, pieces, target)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_csv(spark.range(4000).withColumn("t", F.repeat(F.lit("x"), 50)), f"{tmp_path}/many.csv", ["id", "t"], ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(joined[0]) == 5  # the header and a piece for each of four tasks
    with open(tmp_path / "many.csv", newline="") as f:
        assert [int(r[0]) for r in list(csv.reader(f))[1:]] == list(range(4000))


def test_json_with_a_list(spark, tmp_path):
    before, after = {"a": 1, "n": {"x": [1, 2], "y": "é"}}, {"note": 'say "x", or y', "z": None}
    for n in (0, 1, 2, 57):
        rows = [(k, ODD[k % len(ODD)], {"f": [str(k)], "e": []}) for k in range(n)]
        df = spark.createDataFrame(rows, "k long, t string, m map<string,array<string>>").repartition(5)
        shape = lambda r: {"t": r["t"], "m": dict(sorted(r["m"].items()))}
        sinks.write_json_with_list(df, f"{tmp_path}/x.json", before, "rows", after, ["k"], shape)
        want = {**before, "rows": [{"t": t, "m": dict(sorted(m.items()))} for _, t, m in rows], **after}
        assert (tmp_path / "x.json").read_text() == json.dumps(want, ensure_ascii=False, indent=2) + "\n"
