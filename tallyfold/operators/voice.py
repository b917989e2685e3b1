"""Customer voice: customers' comments with their labels, pseudonymous, with the official replies they got."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number
from ..functions.text import clean, pseudonym, truthy
from ..schemas import ANALYZED_VOICE
from .joins import month_context, reply_summary
from .stats import most_common, severity_rank

ORDINAL = "_ord"


def customers(comments: DataFrame) -> DataFrame:
    return comments.where(~truthy(F.col("is_official")))


def analyzed_voice(comments: DataFrame, labels: DataFrame) -> DataFrame:
    """ANALYZED_VOICE and ``_ord``; no commenter's name is left."""
    words = ["signal_type", "sentiment", "severity", "analysis_confidence"]
    named = labels.select(
        clean(F.col("comment_id")).alias("_id"),
        *[(F.lower(clean(F.col(c))) if c in words else clean(F.col(c))).alias(f"_l_{c}") for c in ("text_translation", "issue_type", *words, "analysis_notes")],
    )
    replies = reply_summary(comments)
    rows = customers(comments).withColumn("_key", clean(F.col("comment_id")))
    joined = rows.join(named, F.col("_key") == F.col("_id")).join(replies, F.col("_key") == F.col("parent"), "left")
    values = {
        "comment_id": F.col("_key"),
        **{c: clean(F.col(c)) for c in ("content_id", "parent_comment_id", "commenter_type", "likes", "url")},
        "commenter_alias": pseudonym(F.col("commenter")),
        "text_original": F.col("text_original"),
        **{c: F.col(f"_l_{c}") for c in ("text_translation", "issue_type", *words, "analysis_notes")},
        "official_reply_count": F.coalesce("official_reply_count", F.lit(0)).cast("string"),
        "official_response_modes": F.coalesce(F.array_join("official_response_modes", "|"), F.lit("")),
        "official_reply_ids": F.coalesce(F.array_join("official_reply_ids", "|"), F.lit("")),
    }
    return joined.select(*[values[c].alias(c) for c in ANALYZED_VOICE], ORDINAL)


def mode_counts(analyzed: DataFrame) -> DataFrame:
    modes = analyzed.select(ORDINAL, F.posexplode(F.split("official_response_modes", r"\|")).alias("p", "mode")).where("mode <> ''")
    return most_common(modes.withColumn(ORDINAL, F.struct(ORDINAL, "p")), F.col("mode"), "mode")


def voice_summary(content: DataFrame, analyzed: DataFrame, issue_labels: dict[str, str], target: str) -> dict:
    def counted(column: str) -> dict[str, int]:
        by = analyzed.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(ORDINAL).alias("o")).orderBy(F.desc("n"), "o")
        return {r[column]: r["n"] for r in by.collect()}

    from .stats import first_k_rows

    first = first_k_rows(analyzed, ["issue_type"], [ORDINAL], 5).orderBy("issue_type", ORDINAL).select("issue_type", "comment_id")
    evidence: dict[str, list[str]] = {}
    for r in first.collect():
        evidence.setdefault(r["issue_type"], []).append(r["comment_id"])
    one = analyzed.agg(
        F.count(F.lit(1)).alias("customer_signals"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("high_or_critical"),
        F.count_if(F.col("official_reply_count") != "0").alias("visible_response_count"),
        F.count_if(F.array_contains(F.split("official_response_modes", r"\|"), "useful_answer")).alias("useful_response_count"),
    ).first()
    return {
        "research_mode": "customer_voice",
        "target": target,
        **one.asDict(),
        "issue_counts": counted("issue_type"),
        "issue_labels": issue_labels,
        "signal_type_counts": counted("signal_type"),
        "sentiment_counts": counted("sentiment"),
        "severity_counts": counted("severity"),
        "response_mode_counts": {r["mode"]: r["count"] for r in mode_counts(analyzed).collect()},
        "context_month_counts": {r["month"]: r["count"] for r in month_context(analyzed, content).collect()},
        "issue_evidence": evidence,
    }


def top_signals(analyzed: DataFrame, k: int = 30) -> DataFrame:
    """By severity, then likes, then id."""
    return analyzed.orderBy(severity_rank(F.col("severity")), F.desc(number(F.col("likes"))), "comment_id").limit(k)
