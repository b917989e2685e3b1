"""Counts, coverages, means, rankings and first-k lists. Ties go by ``_ord``, the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number, parsed
from ..functions.text import clean, working_text

ORDINAL = "_ord"


def category_stats(content: DataFrame, category: str = "content_type", views: str = "views", key: str = "record_id", k: int = 3) -> DataFrame:
    """Per category: count, share of all rows, rounded mean and median and coverage of views, the first k ids by views.

    Blank categories are ``unclassified``; blank views count in no mean. The first ids are kept k per task before the
    shuffle, so no category is gathered.
    """
    rows = content.withColumn("_category", F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("unclassified")))
    value = parsed(F.col(views))
    stats = rows.groupBy("_category").agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.bround(F.avg(value)), F.lit(0)).cast("bigint").alias("mean_views"),
        F.count(value).alias("view_coverage"),
    )
    middle = medians(rows.select("_category", value.alias("_value")), ["_category"], "_value")
    stats = stats.join(middle.select("_category", F.bround("median").cast("bigint").alias("_median")), "_category", "left")
    stats = stats.withColumn("median_views", F.coalesce("_median", F.lit(0)).cast("bigint"))
    top = first_k_rows(rows, ["_category"], [F.desc(number(F.col(views))), F.col(ORDINAL)], k)
    top = top.groupBy("_category").agg(first_k(F.struct("_rank", F.col(key).alias("id")), k, "id").alias("evidence_ids"))
    total = content.groupBy().agg(F.count(F.lit(1)).alias("_total"))
    joined = stats.join(top, "_category").crossJoin(F.broadcast(total))  # the total is one row
    share = (F.col("count") / F.col("_total")).alias("share")
    names = [F.col("_category").alias("category"), "count", share, "mean_views", "median_views", "view_coverage", "evidence_ids"]
    return joined.select(*names).orderBy(F.desc("mean_views"), "category")


def first_k(order_and_key: Column, k: int, key: str) -> Column:
    """The k least structs of a bounded group, as their key."""
    return F.transform(F.slice(F.array_sort(F.collect_list(order_and_key)), 1, k), lambda x: x[key])


def first_k_rows(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group: Spark keeps k per task and group before it shuffles, so no group is gathered."""
    from pyspark.sql import Window

    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k)


DIGIT = 11  # bits of a value that a round of the selection settles


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact median of ``value`` (a whole number; nulls don't count) for each group: ``by`` and median (a double)."""
    from ..sources.scratch import scratch

    spark = df.sparkSession
    path = scratch(spark, "counts")
    df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).write.parquet(path)
    counts = spark.read.parquet(path)
    ends = counts.groupBy(*by).agg(F.sum("_n").alias("_all")).where("_all > 0")
    ranks = F.explode(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)))
    picked = at_ranks(counts, by, ends.select(*by, ranks.alias("_rank")).distinct())
    return picked.groupBy(*by).agg(F.avg("_v").alias("median")) if by else picked.agg(F.avg("_v").alias("median"))


def at_ranks(counts: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """The values at ranks (from 0) of groups: ``by``, _rank, _v, from counts (``by``, _v, _n) of whole numbers.

    Each round counts a group's values by their next DIGIT bits, among those that begin as the one sought does, and goes on
    within the bin that holds the rank. So there is a scan of the counts for every DIGIT bits of the values' span, at most
    2^DIGIT rows a rank after each, and no task puts a group's values in order or holds them.
    """
    from functools import reduce

    from pyspark.sql import Window

    span = counts.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    low, bits = span["lo"] or 0, max(1, ((span["hi"] or 0) - (span["lo"] or 0)).bit_length())
    rounds = -(-bits // DIGIT)
    least = F.lit(low if bits < 64 else -(1 << 63)).cast("bigint")
    offset = F.col("_v") - least if bits < 64 else F.col("_v").bitwiseXOR(least)  # from the least value, as an unsigned number
    digit = lambda k: F.shiftrightunsigned(offset, DIGIT * (rounds - k))  # noqa: E731  the first k digits
    sought = ranks.withColumns({"_left": F.col("_rank"), "_begin": F.lit(0).cast("bigint")})
    own = [F.col(f"`{c}`").alias(f"_of_{k}") for k, c in enumerate(by)]
    for k in range(1, rounds + 1):
        named = sought.select(*own, "_rank", "_left", "_begin")
        same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_of_{j}")) for j, c in enumerate(by)], F.lit(True))
        within = counts.join(named if by else F.broadcast(named), same & (digit(k - 1) == F.col("_begin")) if k > 1 else same)  # without groups: two rows
        bins = within.groupBy(*by, "_rank", "_left", digit(k).alias("_bin")).agg(F.sum("_n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*by, "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = bins.withColumn("_upto", upto).where((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_n") <= F.col("_left")))
        sought = found.select(*by, "_rank", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), F.col("_bin").alias("_begin"))
    return sought.select(*by, "_rank", (F.col("_begin") + least if bits < 64 else F.col("_begin").bitwiseXOR(least)).alias("_v"))


def totals(content: DataFrame, views: str = "views") -> DataFrame:
    """One row of totals, with the exact median of what is known."""
    value = parsed(F.col(views))
    one = content.agg(
        F.count(F.lit(1)).alias("content_rows"),
        F.coalesce(F.sum(value), F.lit(0)).alias("total_views"),
        F.coalesce(F.bround(F.avg(value)), F.lit(0)).cast("bigint").alias("mean_views"),
        F.count(value).alias("view_coverage"),
    )
    middle = medians(content.select(value.alias("_value")), [], "_value").select(F.coalesce(F.bround("median"), F.lit(0)).cast("bigint").alias("median_views"))
    return one.crossJoin(F.broadcast(middle)).select("content_rows", "total_views", "mean_views", "median_views", "view_coverage")  # one row each


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """How many rows meet each condition, in one pass; a condition of None counts all rows."""
    return df.agg(*[(F.count(F.lit(1)) if c is None else F.count_if(c)).alias(name) for name, c in conditions.items()])


def only_value(df: DataFrame, column: Column, value: str, by: list[str] | None = None) -> DataFrame:
    """only_one: whether every row has ``value``; any: whether there are rows."""
    return df.groupBy(*(by or [])).agg(F.coalesce(F.bool_and(column == value), F.lit(False)).alias("only_one"), (F.count(F.lit(1)) > 0).alias("any"))


def share_counts(df: DataFrame, column: Column, name: str, condition: Column) -> DataFrame:
    """Rows by key with the share of them that meets a condition, as a percentage."""
    from ..functions.numbers import percent

    by = df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("count"), F.count_if(condition).alias("_met"))
    return by.select(name, "count", percent(F.col("_met"), F.col("count")).alias("share"))


def first_and_last(df: DataFrame, keys: list[str], order: str, first: str = "first_seen_run", last: str = "last_seen_run") -> DataFrame:
    """The first and last place of each key."""
    return df.groupBy(*keys).agg(F.min(order).alias(first), F.max(order).alias(last), F.count(F.lit(1)).alias("runs"))


def most_common(df: DataFrame, column: Column, name: str, order: str = ORDINAL) -> DataFrame:
    """Values by falling count, equal counts by first appearance; blanks don't count."""
    return df.where(column != "").groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("first")).orderBy(F.desc("count"), "first")


def key_counts(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("count")).orderBy(name)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def coverage(df: DataFrame, column: Column, rows: Column | None = None) -> Column:
    """Share of rows with a value, 0 for no rows."""
    return F.coalesce(F.try_divide(F.count_if(clean(column) != ""), rows if rows is not None else F.count(F.lit(1))), F.lit(0.0))


def top_evidence(content: DataFrame, k: int = 8) -> DataFrame:
    """The k rows of most views, with what is available; a top-k plan, not a sort of the table."""
    top = content.orderBy(F.desc(number(F.col("views"))), ORDINAL).limit(k)
    fields = [("views", "views"), ("likes", "likes"), ("comments", "comments_count")]
    shown = [x for name, c in fields for x in (number(F.col(c)).alias(name), (clean(F.col(c)) != "").alias(f"{name}_available"))]
    return top.select("record_id", "platform", "published_at", working_text(F.col("text_translation"), F.col("text_original")).alias("text"), *shown, "url")


def batches(df: DataFrame, order: list, bucket: Column, size: int) -> DataFrame:
    """batch: rows in ``order``, ``size`` at a time, counted from 0.

    ``bucket`` rises with the order (a leading part of it). Rows are numbered within buckets, and a prefix sum over the
    buckets' sizes says where each begins, so only one row per bucket meets in one task.
    """
    from pyspark.sql import Window

    own = df.withColumn("_bucket", bucket)
    sizes = own.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    at = own.withColumn("_row", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    joined = at.join(starts, F.col("_bucket").eqNullSafe(F.col("_b")))
    return joined.withColumn("batch", F.floor((F.col("_before") + F.col("_row") - 1) / size)).drop("_bucket", "_b", "_row", "_before")


def severity_rank(c: Column) -> Column:
    from ..schemas import SEVERITIES

    rank = F.lit(9)
    for k, name in enumerate(SEVERITIES):
        rank = F.when(F.lower(clean(c)) == name, k).otherwise(rank)
    return rank


def analyze(census: DataFrame, content: DataFrame, comments: DataFrame) -> dict:
    """The baseline summary as small collected results; duplicates and orphaned comments are errors first."""
    from ..functions.text import truthy
    from ..sources.bundle import EvidenceError
    from .joins import orphans

    for df, key, name in ((content, "record_id", "content"), (comments, "comment_id", "comments")):
        if twice := [r[key] for r in duplicates(df, key).orderBy(key).limit(10).collect()]:
            raise EvidenceError(f"{name}: duplicate {key}: {', '.join(twice)}")
    if lost := [r["content_id"] for r in orphans(comments, content).orderBy("content_id").limit(10).collect()]:
        raise EvidenceError(f"comments: unknown content_id: {', '.join(lost)}")
    users, official = comments.where(~truthy(F.col("is_official"))), comments.where(truthy(F.col("is_official")))
    told = truthy(F.col("is_official"))
    counts = conditional_counts(comments, {"comment_rows": None, "user_comments": ~told, "official_replies": told}).first().asDict()
    deep = conditional_counts(census, {"census_channels": None, "deep_dive_channels": F.lower("deep_dive") == "yes"}).first().asDict()
    unclassified = only_value(content, F.coalesce(F.nullif(F.col("content_type"), F.lit("")), F.lit("unclassified")), "unclassified").first()["only_one"]
    topics = {r["topic"]: r["count"] for r in most_common(users, F.col("topic"), "topic").collect()}
    stats = [r.asDict() for r in category_stats(content).collect()]
    return {
        **deep,
        **totals(content).first().asDict(),
        **counts,
        "platforms": {r["platform"]: r["count"] for r in key_counts(content, F.col("platform"), "platform").collect()},
        "category_stats": stats,
        "topic_counts": topics,
        "response_counts": {r["mode"]: r["count"] for r in most_common(official, F.col("response_mode"), "mode").collect()},
        "top_topic": next(iter(topics), None),
        "unclassified_only": unclassified,
        "evidence": [r.asDict() for r in top_evidence(content).collect()],
    }


def last_active(df: DataFrame, column: str = "published_at") -> Column:
    return F.coalesce(F.max(F.nullif(F.col(column), F.lit(""))), F.lit(""))


def observation_columns(row: Column) -> list[Column]:
    """platform, account (handle only where there is no account field at all) and url of a row kept as a map."""
    def get(k: str) -> Column:
        return F.coalesce(F.try_element_at(row, F.lit(k)), F.lit(""))

    account = F.when(F.map_contains_key(row, "account"), get("account")).otherwise(get("handle"))
    return [get("platform").alias("platform"), account.alias("account"), get("url").alias("canonical_url")]


