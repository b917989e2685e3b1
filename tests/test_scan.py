"""Running values against plain loops: one scope over all parts, many small ones, nulls and ties."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators.scan import PART, running, spread


def looped(rows):
    """(scope, at) -> sum, last, lag, since."""
    out, held = {}, {}
    for scope, at, v, flag in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        total, last, before, since = held.get(scope, (None, None, None, 0))
        total = total if v is None else v + (total or 0)
        lag, last, since = before, last if v is None else v, 0 if flag else since + 1
        out[(scope, at)] = (total, last, lag, since)
        held[scope] = (total, last, v, since)
    return out


@pytest.mark.parametrize("scopes", [["one"], ["a", "b", None], [str(k) for k in range(60)], ["hot"] * 30 + [str(k) for k in range(20)]])
def test_running(spark, scopes):
    rng = random.Random(len(scopes))
    rows = [(rng.choice(scopes), k, rng.choice([None, None, 1, 5, -2]), rng.random() < rng.choice([0.02, 0.5])) for k in rng.sample(range(10_000), 600)]
    df = spark.createDataFrame(rows, "scope string, at long, v long, flag boolean").withColumns({"_n": F.lit(1), "before": F.lit("c")}).drop("_n")
    got = running(df.repartition(5), ["scope"], "at", {"s": ("sum", F.col("v")), "l": ("last", F.col("v")), "p": ("lag", F.col("v")), "q": ("since", F.col("flag"))}, parts=11)
    assert {(r["scope"], r["at"]): (r["s"], r["l"], r["p"], r["q"]) for r in got.collect()} == looped(rows)
    assert got.columns == [*df.columns, "s", "l", "p", "q"]


def test_one_scope_is_spread_over_all_parts(spark):
    rows = spark.range(4000).select(F.lit("x").alias("scope"), F.col("id").alias("at"))
    sizes = {r[PART]: r["count"] for r in spread(rows, ["scope"], "at", 8).groupBy(PART).count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 1000
    got = running(rows, ["scope"], "at", {"s": ("sum", F.lit(1))}, parts=8)
    assert got.where("s <> at + 1").isEmpty() and got.count() == 4000
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line and "sum(_of_s" in plan]
    assert windows and "BroadcastExchange" in plan


def test_ties_and_empty(spark):
    rows = spark.createDataFrame([("x", 1, 2), ("x", 1, 2), ("x", 1, 2), ("y", 0, 5)], "scope string, at long, v long")
    got = running(rows, ["scope"], "at", {"s": ("sum", F.col("v"))}, parts=3).collect()
    assert sorted((r["scope"], r["s"]) for r in got) == [("x", 2), ("x", 4), ("x", 6), ("y", 5)]
    assert running(rows.limit(0), ["scope"], "at", {"s": ("sum", F.col("v"))}).count() == 0
