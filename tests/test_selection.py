"""Exact medians and ranks against sorted lists, for any span of values, and no ordering of a group's values in the plan."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import stats
from tallyfold.operators.stats import at_ranks, medians


@pytest.mark.parametrize("span", [1, 3000, 10**9, 2**63 - 1])
def test_medians(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["a", "hot", "hot", "hot", None]), rng.choice([None, rng.randint(-span, span), rng.randint(-span, span), 0])) for _ in range(400)] + [("one", 5), ("none", None), ("two", -1), ("two", 4)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(3)
    want = {}
    for g, v in rows:
        want.setdefault(g, []).extend([] if v is None else [v])
    got = {r["g"]: r["median"] for r in medians(df, ["g"], "v").collect()}
    middle = lambda vs: (statistics.median_low(vs) + statistics.median_high(vs)) / 2
    assert got == pytest.approx({g: middle(vs) for g, vs in want.items() if vs}, rel=1e-12)
    if span == 3000:
        assert medians(df, [], "v").first()[0] == middle([v for _, v in rows if v is not None])


def test_medians_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, v long")
    assert medians(df, ["g"], "v").count() == 0 and medians(df, [], "v").first()[0] is None
    assert stats.totals(spark.createDataFrame([], "views string")).first().asDict() == {"content_rows": 0, "total_views": 0, "mean_views": 0, "median_views": 0, "view_coverage": 0}


def test_ranks(spark):
    values = sorted(random.Random(5).choices(range(50_000), k=900))
    counts = spark.createDataFrame([(v,) for v in values], "_v long").groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    ranks = spark.createDataFrame([(k,) for k in (0, 1, 449, 450, 898, 899)], "_rank long")
    found = at_ranks(counts, [], ranks)
    assert {r["_rank"]: r["_v"] for r in found.collect()} == {k: values[k] for k in (0, 1, 449, 450, 898, 899)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("_bin" in line for line in plan.splitlines() if "Window" in line)  # bins are ordered, values are not
