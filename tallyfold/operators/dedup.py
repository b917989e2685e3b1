"""Latest-per-key and merging of repeated captures. ``_ord`` is the order of rows; every tie goes by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, filled

ORDINAL = "_ord"


def _pick(df: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """The row of each key with the greatest ``by``: one shuffle, combined before it, no sort and no self join."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), by).alias("_row"))
    return picked.select("_row.*")


def last_wins(df: DataFrame, keys: list[str], order: str = ORDINAL) -> DataFrame:
    return _pick(df, keys, F.col(order))


def first_wins(df: DataFrame, keys: list[str], order: str = ORDINAL) -> DataFrame:
    return _pick(df, keys, F.struct(-F.col(order)))


def longest_wins(df: DataFrame, keys: list[str], text: str, order: str = ORDINAL) -> DataFrame:
    return _pick(df, keys, F.struct(F.length(filled(F.col(text))), -F.col(order)))


def richest_wins(df: DataFrame, keys: list[str], score: Column, tab: str, order: str = ORDINAL) -> DataFrame:
    """The row of greatest score (the first of equals), with ``tab`` as all tabs that had the key, in order.

    Rows meet by key and tab first, so what is gathered for a key is a row per tab.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(score, -F.col(order))
    by_tab = df.groupBy(*keys, F.col(tab).alias("_tab")).agg(F.max_by(whole, rank).alias("_row"), F.max(rank).alias("_rank"), F.min(order).alias("_first"))
    tabs = F.transform(F.array_sort(F.collect_list(F.struct("_first", "_tab"))), lambda x: x["_tab"])
    picked = by_tab.groupBy(*keys).agg(F.max_by("_row", "_rank").alias("_row"), F.array_join(tabs, ",").alias("_tabs"))
    return picked.select("_row.*", "_tabs").withColumn(tab, F.col("_tabs")).drop("_tabs")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str = ORDINAL) -> DataFrame:
    """Each key's distinct values in the order of their first appearance, as an array of that name."""
    firsts = df.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias(value))


def filled_fields(df: DataFrame, fields: list[str]) -> Column:
    """How many fields have a value: what makes a record rich."""
    return sum((F.when(clean(F.col(f)) != "", 1).otherwise(0) for f in fields), F.lit(0))


def merge_windows(df: DataFrame, key: str, text: str | None = "text_original", order: str = ORDINAL) -> DataFrame:
    """One row per key from repeated windows: of each field the first value that isn't blank, of the text the longest."""
    out = []
    for c in df.columns:
        if c in (key, order):
            continue
        value = filled(F.col(c))
        if c == text:
            out.append(F.max_by(value, F.struct(F.length(value), -F.col(order))).alias(c))
        else:
            out.append(F.coalesce(F.min_by(value, F.when(value != "", F.col(order))), F.lit("")).alias(c))
    return df.groupBy(key).agg(*out, F.min(order).alias(order))


def stagnant(df: DataFrame, scope: list[str], order: str, reset: Column, rounds: int) -> DataFrame:
    """Adds ``quiet`` (rounds since the last reset) and ``stopped`` (``rounds`` of these in a row) to a log of windows. A scope may have any
    number of rows: none of them is gathered."""
    from .scan import running

    return running(df, scope, order, {"quiet": ("since", reset)}).withColumn("stopped", F.col("quiet") >= rounds)
