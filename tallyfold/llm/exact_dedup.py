"""Exact dedup by content sort, in DataFrame operations only.

Normalised texts are dealt out by sampled splitters (``repartitionByRange``) over their first bytes, a hash and a salt,
sorted within partitions by Spark's external sorter so that equal texts stand next to each other, and each row is
compared in full with the one before it. The sampled keys are a few bytes, never texts.

Scale: one shuffle of the texts. A text with more than 1/(4 P) of the rows (P: shuffle partitions; so there are at most
4 P of them, which bounds what is broadcast) is salted by id into runs of bounded size; those runs' ids and sizes meet
again through a pre-aggregated group-by on the text itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_of

SPACES = "[\\x20\\x09-\\x0D]+"
PREFIX_CHARS = 16
HOT_ROWS = 1000  # a text with fewer rows than this is never salted


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null texts count as empty; a null id is greater than any other, and keep_id is null only where a whole group's ids
    are. Repeated rows (same id and text) are copies of each other: exactly one row of each group is kept. An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text_of(text_col), SPACES, " ").alias("norm"))
    base = base.withColumn("h", F.xxhash64("norm"))
    rows = df.count()
    bound = max(HOT_ROWS, rows // (4 * shuffle_partitions(spark)))
    hot = base.groupBy("h").count().where(F.col("count") > bound).collect()
    runs = spark.createDataFrame([(r["h"], -(-r["count"] // bound)) for r in hot], "hot_h long, runs long")
    if hot:
        keyed = base.join(F.broadcast(runs), base.h == runs.hot_h, "left").withColumn(
            "salt", F.when(F.col("runs").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("runs")))
        )
    else:
        keyed = base
    key = ["pre", "h", "salt"] if hot else ["pre", "h"]
    keyed = keyed.withColumn("pre", F.substring("norm", 1, PREFIX_CHARS)).select("doc_id", "norm", *dict.fromkeys(["h", *key]))
    dealt = keyed.repartitionByRange(*key)
    order = [F.col("norm"), F.col("doc_id").asc_nulls_last()]
    before = F.lag("norm").over(Window.partitionBy(*key).orderBy(*order))
    run = Window.partitionBy(*key, "norm")
    found = dealt.select(
        "doc_id",
        "h",
        "norm",
        (~before.eqNullSafe(F.col("norm"))).alias("first"),
        F.min("doc_id").over(run).alias("keep_id"),
        F.count(F.lit(1)).over(run).alias("group_size"),
    ).select("doc_id", "h", "first", "keep_id", "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    if hot:
        totals = (
            base.join(F.broadcast(runs), base.h == runs.hot_h, "left_semi")
            .groupBy("h", "norm")
            .agg(F.min("doc_id").alias("all_min"), F.count(F.lit(1)).alias("all_size"))
            .select(F.col("h").alias("t_h"), F.sha2(F.col("norm").cast("binary"), 256).alias("t_sha"), "all_min", "all_size")
        )
        found = found.join(F.broadcast(totals), (F.col("h") == F.col("t_h")) & (F.col("text_sha256") == F.col("t_sha")), "left")
        salted = F.col("all_size").isNotNull()
        found = found.withColumn("first", F.col("first") & (~salted | F.col("keep_id").eqNullSafe(F.col("all_min"))))
        found = found.withColumn("keep_id", F.when(salted, F.col("all_min")).otherwise(F.col("keep_id")))
        found = found.withColumn("group_size", F.when(salted, F.col("all_size")).otherwise(F.col("group_size")))
    return found.select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256")
