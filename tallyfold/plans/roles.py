"""The tables of a folder in the roles of the evidence model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def video_number(n: Column) -> Column:
    """A video's id, made of a row's: a time in the bits above the low 32, of any size (so in decimals)."""
    return (F.lit(1_600_000_000) + n * 1000).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + n


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as content: platform is the source, the category the language, views the number of characters."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"),
        F.col("source").alias("platform"),
        F.col("lang").alias("content_type"),
        F.col("text").alias("text_original"),
        F.lit("").alias("text_translation"),
        F.col("n_chars").cast("string").alias("views"),
        F.lit("").alias("likes"),
        F.lit("").alias("comments_count"),
        F.lit("").alias("published_at"),
        F.lit("").alias("url"),
        F.col("doc_id").alias("_ord"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as comments: assistants are official, a turn's parent is the user turn before it. Every row counts: where
    a turn has several, all but the first (by role, then text) have a number behind their id."""
    again = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    rows = table(spark, sf_dir, "conversations").withColumn("again", again)
    place = ((F.col("conv_id") * 1_000_000 + F.col("turn")) * 1_000 + F.col("again")).cast("bigint")
    return rows.select(
        F.concat(F.concat_ws("-", "conv_id", "turn"), F.when(F.col("again") > 0, F.concat(F.lit("."), F.col("again").cast("string"))).otherwise("")).alias("comment_id"),
        F.col("conv_id").cast("string").alias("content_id"),
        F.when(F.col("role") == "assistant", F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1)).otherwise("").alias("parent_comment_id"),
        F.concat(F.lit("user "), (F.col("conv_id") % 50).cast("string")).alias("commenter"),
        F.lit("unclassified").alias("commenter_type"),
        F.when(F.col("role") == "assistant", "true").otherwise("false").alias("is_official"),
        F.col("text").alias("text_original"),
        F.lit("").alias("text_translation"),
        F.length("text").cast("string").alias("likes"),
        F.concat(F.lit("topic "), (F.col("conv_id") % 7).cast("string")).alias("topic"),
        F.when(F.length("text") % 3 == 0, "redirect").when(F.length("text") % 3 == 1, "useful_answer").otherwise("").alias("response_mode"),
        F.lit("").alias("url"),
        place.alias("_ord"),
    )


# The same roles in SQL, for the queries' oracles.
CONTENT_SQL = """
content AS (SELECT doc_id::VARCHAR AS record_id, source AS platform, lang AS content_type, text AS text_original, n_chars AS v, doc_id AS ord FROM documents)"""
COMMENTS_SQL = """
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) - 1 AS again FROM conversations),
comments AS (
  SELECT conv_id || '-' || turn || CASE WHEN again > 0 THEN '.' || again ELSE '' END AS comment_id, conv_id::VARCHAR AS content_id,
    CASE WHEN role = 'assistant' THEN conv_id || '-' || (turn - 1) ELSE '' END AS parent_comment_id, text AS text_original,
    'user ' || (conv_id % 50) AS commenter, role = 'assistant' AS official, length(text) AS likes, 'topic ' || (conv_id % 7) AS topic,
    CASE length(text) % 3 WHEN 0 THEN 'redirect' WHEN 1 THEN 'useful_answer' ELSE '' END AS response_mode, (conv_id::BIGINT * 1000000 + turn) * 1000 + again AS ord
  FROM turns)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: a user's last event of a day is what that day's run saw of the user."""
    events = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    one = events.groupBy("user_id", day.alias("day")).agg(F.max_by(F.struct("event_type", "value", "props", "event_id"), F.struct("ts", "event_id")).alias("e"))
    row = F.create_map(F.lit("event_type"), F.col("e.event_type"), F.lit("value"), F.format_string("%.2f", "e.value"), F.lit("props"), F.col("e.props"))
    return one.select("user_id", "day", row.alias("row"), F.col("e.event_id").alias("event_id"))


OBSERVATIONS_SQL = """
obs AS (
  SELECT user_id, day, event_type, printf('%.2f', value) AS value, props, event_id FROM (
    SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id DESC) AS r FROM events
  ) WHERE r = 1)"""
