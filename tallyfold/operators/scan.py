"""Running values within scopes of any size, without a task that holds a scope.

Rows are put in order over all tasks, by scope and then by order, and the part that a row falls in is kept with it. Each part is
scanned by itself; what a scope leaves at a part's end is carried to its next parts. As a part's edge cuts at most one scope,
at most one carried row exists a part, whatever the scopes' number and sizes: that is what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

PART = "_part"


def spread(df: DataFrame, scope: list[str], order: str, parts: int | None = None) -> DataFrame:
    """The rows with ``_part``: parts follow each other by scope and order, and rows that are equal in both share one.
    Written and read back, as the edges come from a sample that another run of the plan need not draw again."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    path = scratch(spark, "scan")
    df.repartitionByRange(parts, *scope, order).withColumn(PART, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def running(df: DataFrame, scope: list[str], order: str, values: dict[str, tuple[str, Column]], parts: int | None = None) -> DataFrame:
    """Adds a column for each of ``values``, a kind and what it is of, over a scope's rows up to and with each row:

    ``sum``: the sum so far; ``last``: the last value so far that isn't null; ``lag``: the value of the row before (null for
    the first); ``since``: the rows since the last for which the condition held, 0 for such a row, all so far if there was
    none (a null condition does not hold). Rows that are equal in scope and order come in any order. Null scopes are one scope.
    """
    from functools import reduce

    made = {name: f"_of_{name}" for name in values}
    typed = {made[n]: F.coalesce(v.cast("boolean"), F.lit(False)) if kind == "since" else F.struct(v.alias("v")) if kind == "lag" else v for n, (kind, v) in values.items()}
    rows = spread(df.withColumns(typed), scope, order, parts)
    here = Window.partitionBy(PART, *scope).orderBy(order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_n", F.row_number().over(here))
    local, ends = {}, [F.count(F.lit(1)).alias("_rows")]
    for name, (kind, _) in values.items():
        v = F.col(made[name])
        if kind == "sum":
            local[name] = F.sum(v).over(upto)
            ends.append(F.sum(v).alias(made[name]))
        elif kind == "last":
            local[name] = F.last(v, ignorenulls=True).over(upto)
            ends.append(F.max_by(v, F.when(v.isNotNull(), F.col("_n"))).alias(made[name]))
        elif kind == "lag":
            local[name] = F.lag(v).over(here)
            ends.append(F.max_by(v, "_n").alias(made[name]))
        else:
            local[name] = F.last(F.when(v, F.col("_n")), ignorenulls=True).over(upto)  # place of the last that held, in the part
            ends.append(F.max(F.when(v, F.col("_n"))).alias(made[name]))
    scanned = rows.withColumns({f"_local_{n}": c for n, c in local.items()})

    left = rows.groupBy(PART, *scope).agg(*ends)
    by_part = Window.partitionBy(*scope).orderBy(PART)  # a row a part at most
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    carried = {}
    for name, (kind, _) in values.items():
        v = F.col(made[name])
        if kind == "sum":
            carried[name] = F.sum(v).over(before)
        elif kind == "last":
            carried[name] = F.last(v, ignorenulls=True).over(before)
        elif kind == "lag":
            carried[name] = F.lag(v).over(by_part)
        else:  # rows up to the end of the last part less the place, counted from the scope's start, of the last that held
            start = F.coalesce(F.sum("_rows").over(before), F.lit(0))
            left = left.withColumn(f"_held_{name}", v + start)
            carried[name] = start - F.coalesce(F.last(f"_held_{name}", ignorenulls=True).over(before), F.lit(0))
    left = left.withColumns({f"_carry_{n}": c for n, c in carried.items()}).withColumn("_k", F.row_number().over(by_part)).where("_k > 1")
    carries = left.select(F.col(PART).alias("_c_part"), *[F.col(f"`{c}`").alias(f"_c_{k}") for k, c in enumerate(scope)], *[f"_carry_{n}" for n in values])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_c_{k}")) for k, c in enumerate(scope)], F.col(PART) == F.col("_c_part"))
    joined = scanned.join(F.broadcast(carries), same, "left")  # at most a row a part
    out = {}
    for name, (kind, _) in values.items():
        mine, carry = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        if kind == "sum":
            out[name] = F.when(mine.isNull(), carry).when(carry.isNull(), mine).otherwise(mine + carry)
        elif kind == "last":
            out[name] = F.coalesce(mine, carry)
        elif kind == "lag":
            out[name] = F.coalesce(mine, carry)["v"]
        else:
            out[name] = F.coalesce(F.col("_n") - mine, F.col("_n") + F.coalesce(carry, F.lit(0))).cast("long")
    return joined.withColumns(out).select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *values)
