"""Joins between rows, labels, replies and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, filled, identity_name, truthy
from ..schemas import CONTENT_LABELS

ORDINAL = "_ord"


def orphans(comments: DataFrame, content: DataFrame) -> DataFrame:
    """Distinct content ids of comments that no content row has."""
    return comments.select("content_id").distinct().join(content.select(F.col("record_id").alias("content_id")), "content_id", "left_anti")


def missing_and_unknown(source: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    a, b = source.select(clean(F.col(key)).alias(key)).distinct(), labels.select(clean(F.col(key)).alias(key)).distinct()
    return a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def answer_gaps(asked: DataFrame, answered: DataFrame, batch: str, key: str) -> DataFrame:
    """Per batch: unknown (ids that were answered but not asked) and missing (asked but not answered); both are sets."""
    a = asked.select(batch, key).distinct().withColumn("_asked", F.lit(True))
    b = answered.select(batch, key).distinct().withColumn("_answered", F.lit(True))
    both = a.join(b, [batch, key], "full_outer")
    return both.groupBy(batch).agg(F.count_if(F.col("_asked").isNull()).alias("unknown"), F.count_if(F.col("_answered").isNull()).alias("missing"))


def merge_labels(content: DataFrame, labels: DataFrame, key: str = "record_id") -> DataFrame:
    """Content with the labels' columns in place of its own; raw rows stay as they are elsewhere."""
    own = labels.select(clean(F.col(key)).alias("_id"), *[clean(F.col(c)).alias(f"_new_{c}") for c in CONTENT_LABELS if c != key])
    joined = content.join(own, clean(F.col(key)) == F.col("_id"))
    taken = set(CONTENT_LABELS) - {key}
    kept = [F.col(f"_new_{c}").alias(c) if c in taken else F.col(f"`{c}`") for c in content.columns]
    added = [F.col(f"_new_{c}").alias(c) for c in CONTENT_LABELS if c not in content.columns]
    return joined.select(*kept, *added)


def reply_summary(comments: DataFrame, order: str = ORDINAL) -> DataFrame:
    """Per customer comment with official replies: their count, distinct modes (sorted) and ids in order."""
    official = truthy(F.col("is_official"))
    parents = comments.where(~official).select(clean(F.col("comment_id")).alias("parent"))
    replies = comments.where(official).withColumn("parent", clean(F.col("parent_comment_id"))).join(parents, "parent", "left_semi")
    mode = clean(F.col("response_mode"))
    return replies.groupBy("parent").agg(
        F.count(F.lit(1)).alias("official_reply_count"),
        F.array_sort(F.collect_set(F.when(mode != "", mode))).alias("official_response_modes"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), clean(F.col("comment_id")).alias("id")))), lambda x: x["id"]).alias("official_reply_ids"),
    )


def resolve_parents(rows: DataFrame, scope: list[str], order: str = ORDINAL) -> DataFrame:
    """parent: of a reply (level 2), the top-level comment that it names (the last of that user and text before it), or
    else the last top-level comment before it; blank for all others and where there is none.

    Rows have comment_id (of top-level comments at least), level (null counts as 1), user, text, parent_user and
    parent_text. A top-level comment and the replies that name it share a key, so running values by scope and by key find them:
    no join, and no scope or key in one task.
    """
    from .scan import running

    level = F.coalesce(F.col("level"), F.lit(1))
    top, reply = level == 1, level == 2
    keyed = rows.withColumns(
        {"_top": F.when(top, F.col("comment_id")), "_user": F.when(reply, F.col("parent_user")).otherwise(F.col("user")), "_text": F.when(reply, F.col("parent_text")).otherwise(F.col("text"))}
    )
    above = running(keyed, scope, order, {"_above": ("last", F.col("_top"))})
    named = running(above, [*scope, "_user", "_text"], order, {"_named": ("last", F.col("_top"))})
    parent = F.when(reply, F.coalesce("_named", "_above", F.lit(""))).otherwise("")
    return named.withColumn("parent", parent).drop("_top", "_user", "_text", "_above", "_named")


def selected(content: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows asked for, and what was asked for that isn't there."""
    return content.join(wanted.select(key), key, "left_semi"), wanted.select(key).distinct().join(content.select(key), key, "left_anti")


def backfill(content: DataFrame, metrics: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """New values that aren't blank take the old ones' place."""
    new = metrics.select(F.col(key), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = content.join(new, key, "left")
    kept = [F.coalesce(F.nullif(clean(F.col(f"_new_{c}")), F.lit("")), F.col(f"`{c}`")).alias(c) if c in fields else F.col(f"`{c}`") for c in content.columns]
    return joined.select(*kept)


def is_owner(creator: Column, names: list[Column], owners: list[str]) -> Column:
    """The creator's own flag, or any name that is among a short list of owners; all are compared as identities."""
    if not isinstance(owners, list):
        raise TypeError("owners is a list of names; join larger sets")
    listed = F.transform(F.array(*[F.lit(o) for o in owners]).cast("array<string>"), identity_name)
    hit = F.coalesce(creator, F.lit(False))
    for n in names:
        hit = hit | ((identity_name(n) != "") & F.array_contains(listed, identity_name(n)))
    return hit


def with_accounts(rows: DataFrame, names: list[str], accounts: DataFrame, account: str = "account") -> DataFrame:
    """Rows with _own_<name> for each named column: the account that it is, as an identity, or null."""
    known = accounts.select(identity_name(F.col(account)).alias("_id")).where("_id <> ''").distinct()
    for n in names:
        rows = rows.join(known.select(F.col("_id").alias(f"_own_{n}")), identity_name(F.col(n)) == F.col(f"_own_{n}"), "left")
    return rows


def representatives(taxonomy: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """From (id, rep) pairs: representatives without a source row, and those assigned elsewhere."""
    named = labels.select(clean(F.col(key)).alias("rep"), clean(F.col(label)).alias("assigned"))
    unknown = taxonomy.join(named, "rep", "left_anti")
    elsewhere = taxonomy.join(named, "rep").where(F.col("assigned") != F.col("id"))
    return unknown, elsewhere


def unused(declared: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    return declared.select("id").distinct().join(labels.select(clean(F.col(label)).alias("id")).distinct(), "id", "left_anti")


def history(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """Observations with their run. Runs are one row per import; Spark broadcasts them while they are small."""
    return observations.join(runs, "run_sequence")


def month_context(signals: DataFrame, content: DataFrame) -> DataFrame:
    """Signals by month of the content they stand under; those without a dated parent don't count."""
    dated = content.select(clean(F.col("record_id")).alias("content_id"), F.substring(filled(F.col("published_at")), 1, 7).alias("month"))
    return signals.join(dated, "content_id").where("month <> ''").groupBy("month").agg(F.count(F.lit(1)).alias("count")).orderBy("month")
