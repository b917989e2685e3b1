"""Cross-site boilerplate lines, in DataFrame operations only.

Each line's hash gets a HyperLogLog sketch of the sites it stands on; sketches merge by aggregation. A line whose
estimate is clear of ``min_sites`` by more than the sketch's error is settled by the estimate; the lines near it get
exact distinct counts. Lines on ``min_sites`` or more sites are removed from every document but the first that has
them (lowest id, then place), so that no content is lost.

Scale: sketches and first places combine before the shuffle, so a line in a third of all documents costs a row per
task; texts meet the places to remove in one join on the document. Only hashes, ids and places are shuffled for lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, kept_table, must_be_free, text_of

MIN_SITES = 8
LG_K = 10
LONG_ENOUGH = r"\S\s+\S+\s+\S"  # three words or more
EDGES = r"(?U)^\s+|\s+$"  # all white space around a line


def _occurrences(df: DataFrame, id_col: str, text_col: str, site_col: str, every_line: bool) -> DataFrame:
    line = F.regexp_replace("line", EDGES, "") if every_line else F.trim("line")
    lines = df.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_of(text_col)).alias("t"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(text_of(text_col), "\n")).alias("pos", "line"),
    ).withColumn("line", line)
    return lines.where(F.col("line") != "" if every_line else F.col("line").rlike(LONG_ENOUGH)).select(
        "id", "t", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")
    )


def boilerplate_lines(df: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, lg_k: int, every_line: bool = False) -> DataFrame:
    """A row per boilerplate line: h1, h2 (its hashes, 96 bits together) and first (id, t, pos)."""
    occurrences = _occurrences(df, id_col, text_col, site_col, every_line)
    margin = max(1, math.ceil(3 * 1.04 / math.sqrt(2**lg_k) * min_sites))
    spread = occurrences.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    spread = spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin)
    spread = kept_table(spread.select("h1", "h2", (F.col("sites") > min_sites + margin).alias("sure")), "line-spread")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "t", "pos")
    near_site = F.when(~F.col("sure"), F.col("site"))
    per_site = occurrences.join(spread, ["h1", "h2"]).groupBy("h1", "h2", "sure", near_site.alias("s")).agg(F.min(place).alias("first"))
    exact = per_site.groupBy("h1", "h2", "sure").agg(F.count("s").alias("sites"), F.min("first").alias("first"))
    return kept_table(exact.where(F.col("sure") | (F.col("sites") >= min_sites)).select("h1", "h2", "first"), "line-boilerplate")


def line_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    every_line: bool = False,
    added: tuple[str, str, str] = ("_n_lines", "_n_removed", "_kept"),
) -> DataFrame:
    """The input's rows with ``text`` cleaned, and the columns ``added`` behind all of theirs: lines and removed lines (long),
    and kept. The names must be free; other columns may have any names.

    kept is false where a text had words and every line that did has gone: what it said stands in an earlier
    document. Lines are compared without spaces around them, and those under three words are never removed; with
    ``every_line``, lines are compared without any white space around them, and all but blank ones count. A null
    text stays null, null and empty sites are one site, null ids come last. Rows with the same id and text are one
    document; texts without removed lines come back byte for byte.
    """
    must_be_free(df, *added)
    found = boilerplate_lines(df, id_col, text_col, site_col, min_sites, lg_k, every_line)
    occurrences = _occurrences(df, id_col, text_col, site_col, every_line)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "t", "pos")
    g_id, g_text, g_lines, g_hash = free_names(df, "_of_id", "_of_text", "_of_lines", "_of_hash")
    gone = (
        occurrences.join(found, ["h1", "h2"])
        .where(place != F.col("first"))
        .groupBy("id", "t")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .select(F.col("id").alias(g_id), F.col("t").alias(g_text), F.col("gone").alias(g_lines))
    )
    at = df.withColumn(g_hash, F.xxhash64(text_of(text_col)))
    joined = at.join(gone, at[id_col].eqNullSafe(F.col(g_id)) & (F.col(g_hash) == F.col(g_text)), "left")
    lines = F.split(F.col(text_col), "\n")
    stays: Column = F.filter(lines, lambda line, i: ~F.array_contains(F.col(g_lines), i))
    clean = F.when(F.col(g_lines).isNull(), F.col(text_col)).otherwise(F.array_join(stays, "\n"))
    n_lines, n_removed, kept = added
    return (
        joined.withColumn(n_lines, F.size(F.split(text_of(text_col), "\n")).cast("long"))
        .withColumn(n_removed, F.coalesce(F.size(g_lines), F.lit(0)).cast("long"))
        .withColumn(text_col, clean)
        .withColumn(kept, F.col(g_lines).isNull() | F.coalesce(F.col(text_col), F.lit("")).rlike(r"\S"))
        .drop(g_id, g_text, g_lines, g_hash)
    )
