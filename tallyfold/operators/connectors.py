"""Landed payloads to evidence rows, per site. Crawling itself is left to whatever lands the payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text, urls
from ..schemas import COMMENT_PLAIN, CONTENT, LABEL_EXTRAS, VIDEO_EXTRAS
from .stats import last_active

ORDINAL = "_ord"


def _content(df: DataFrame, values: dict[str, Column], extras: list[str]) -> DataFrame:
    return df.select(*[values.get(c, F.lit("")).alias(c) for c in (*CONTENT, *extras)], ORDINAL)


def tiktok_content(items: DataFrame, company: str, handle: str, name: str, collected_at: str, latest: int = numbers.LATEST) -> DataFrame:
    """From grid items (url, accessibilityText, viewsLabel, badge); items without a video URL go. ``latest``: the last
    second that an id's time is believed."""
    url = urls.tiktok_video(F.col("url"))
    number = urls.tiktok_video_id(url)
    rows = items.withColumn("_url", url).where("_url <> ''")
    number = urls.tiktok_video_id(F.col("_url"))
    values = {
        "record_id": F.concat(F.lit("TT-"), number),
        "platform": F.lit("TikTok"),
        "account": F.lit(handle),
        "published_at": numbers.snowflake_time(number, latest=latest),
        "text_original": text.caption(F.col("accessibilityText"), F.lit(name), F.lit(handle)),
        "views": numbers.compact_number(F.col("viewsLabel")),
        "url": F.col("_url"),
        "content_type": F.lit("unclassified"),
        "brand": F.lit(company),
        "metric_labels": text.tagged_labels(("views:", F.col("viewsLabel")), ("badge:", F.col("badge"))),
        "collected_at": F.lit(collected_at),
        "retrieval_status": F.lit("captured"),
    }
    return _content(rows, values, LABEL_EXTRAS)


def facebook_content(articles: DataFrame, company: str, account: str, collected_at: str) -> DataFrame:
    """From articles (permalink, text, publishedAt, publishedLabel, metricLabels); both a URL and a text are needed."""
    rows = articles.withColumn("_url", urls.facebook_post(F.col("permalink"))).withColumn("_text", text.clean(F.col("text"))).where("_url <> '' and _text <> ''")
    labels = F.coalesce(F.col("metricLabels"), F.array().cast("array<string>"))
    values = {
        "record_id": F.concat(F.lit("FB-"), urls.facebook_post_key(F.col("_url"))),
        "platform": F.lit("Facebook"),
        "account": F.lit(account),
        "published_at": text.clean(F.col("publishedAt")),
        "text_original": F.col("_text"),
        **{c: numbers.first_label_metric(labels, k) for c, k in (("likes", "likes"), ("comments_count", "comments"), ("shares", "shares"))},
        "url": F.col("_url"),
        "content_type": F.lit("unclassified"),
        "brand": F.lit(company),
        "published_label": text.clean(F.col("publishedLabel")),
        "metric_labels": text.joined_labels(labels),
        "collected_at": F.lit(collected_at),
        "retrieval_status": F.lit("captured"),
    }
    return _content(rows, values, LABEL_EXTRAS)


def linkedin_content(posts: DataFrame, company: str, account: str, profile_url: str, collected_at: str) -> DataFrame:
    """From cards (permalink, author, body, publishedLabel, metricLabels, rawText); a body or a URL is needed."""
    rows = posts.withColumn("_url", urls.linkedin_post(F.col("permalink"))).withColumn("_body", text.clean(F.col("body"))).where("_url <> '' or _body <> ''")
    labels = F.coalesce(F.col("metricLabels"), F.array().cast("array<string>"))
    label = text.clean(F.col("publishedLabel"))
    values = {
        "record_id": F.concat(F.lit("LI-"), urls.linkedin_post_id(F.col("_url"), text.clean(F.col("author")), label, F.col("_body"))),
        "platform": F.lit("LinkedIn"),
        "account": F.lit(account),
        "text_original": F.col("_body"),
        **{c: numbers.number_before_word(labels, F.col("rawText"), k) for c, k in (("views", "views"), ("likes", "likes"), ("comments_count", "comments"), ("shares", "shares"))},
        "url": F.coalesce(F.nullif("_url", F.lit("")), F.lit(profile_url)),
        "content_type": F.lit("unclassified"),
        "brand": F.lit(company),
        "published_label": label,
        "metric_labels": text.joined_labels(labels),
        "collected_at": F.lit(collected_at),
        "retrieval_status": F.when(F.col("_url") != "", "captured").otherwise("captured_without_permalink"),
    }
    return _content(rows, values, LABEL_EXTRAS)


def youtube_content(videos: DataFrame, company: str, collected_at: str) -> DataFrame:
    """From video records with source_tab; repeated ids across tabs are merged before (``richest_wins``)."""
    title, about = text.filled(F.col("title")), text.filled(F.col("description"))

    def whole(c: str) -> Column:
        return F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(""))

    values = {
        "record_id": F.concat(F.lit("YT-"), F.col("id")),
        "platform": F.lit("YouTube"),
        "account": text.first_present(F.col("uploader_id"), F.col("channel")),
        "published_at": numbers.published_at(F.col("timestamp"), F.col("upload_date")),
        "language": text.filled(F.col("language")),
        "text_original": F.when(about == "", title).otherwise(F.concat(title, F.lit("\n\n"), about)),
        "views": whole("view_count"),
        "likes": whole("like_count"),
        "comments_count": whole("comment_count"),
        "url": text.first_present(F.col("webpage_url"), F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("id"))),
        "content_type": F.lit("unclassified"),
        "brand": F.lit(company),
        "collected_at": F.lit(collected_at),
        "retrieval_status": F.lit("captured"),
        "duration_seconds": whole("duration"),
        "channel_id": text.filled(F.col("channel_id")),
        "availability": text.filled(F.col("availability")),
        "source_tab": text.filled(F.col("source_tab")),
    }
    return _content(videos, values, VIDEO_EXTRAS)


def youtube_comments(comments: DataFrame, content: DataFrame) -> DataFrame:
    """From read_video_comments' rows, with the content they stand under; the channel's own are official."""
    owner = content.select(
        urls.content_video_id(F.col("url"), F.col("record_id")).alias("video_id"), F.col("record_id").alias("_content"), F.col("url").alias("_url"), F.col("channel_id").alias("_channel")
    )
    rows = comments.where(text.filled(F.col("id")) != "").join(owner, "video_id")
    official = F.coalesce(F.col("author_is_uploader"), F.lit(False)) | ((F.col("_channel") != "") & (F.col("author_id") == F.col("_channel")))
    parent = text.filled(F.col("parent"))
    values = {
        "comment_id": F.concat(F.lit("YTC-"), F.col("id")),
        "content_id": F.col("_content"),
        "parent_comment_id": F.when(parent.isin("", "root"), "").otherwise(F.concat(F.lit("YTC-"), parent)),
        "commenter": text.filled(F.col("author")),
        "commenter_type": F.when(official, "official").otherwise("unclassified"),
        "is_official": F.when(official, "true").otherwise("false"),
        "text_original": text.filled(F.col("text")),
        "likes": F.coalesce(F.col("like_count").cast("bigint").cast("string"), F.lit("")),
        "url": urls.comment_url(F.col("_url"), F.col("id")),
    }
    names = [*COMMENT_PLAIN[:6], "published_at", *COMMENT_PLAIN[6:]]
    values["published_at"] = numbers.iso_from_epoch(F.col("timestamp").cast("bigint"))
    return rows.select(*[values.get(c, F.lit("")).alias(c) for c in names], ORDINAL)


def tiktok_comments(rows: DataFrame, owners: list[str], accounts: DataFrame | None = None) -> DataFrame:
    """From panel rows (content_id, url, level, user, userHref, text, likeLabel, creator, parentUser, parentText, and file
    where there are several windows, each of which is read for itself). Rows without a text go.

    A reply's id holds its parent's id, so parents are found first; a top-level comment's id needs none. Official are the
    creator's own rows and those whose user or profile link is one of ``owners`` or of the ``accounts``.
    """
    from .joins import is_owner, resolve_parents, with_accounts

    link = text.clean(F.col("userHref"))
    scope = ["content_id", *(["file"] if "file" in rows.columns else [])]
    named = rows.select(
        ORDINAL, *scope, "url", "level", text.first_present(F.col("user"), F.regexp_replace(link, "^/@", "")).alias("user"), text.clean(F.col("user")).alias("shown"),
        F.regexp_replace(link, "^(?:[^/]*/){1,2}", "").alias("linked"), text.clean(F.col("text")).alias("text"), "likeLabel", "creator",
        text.clean(F.col("parentUser")).alias("parent_user"), text.clean(F.col("parentText")).alias("parent_text"),
    ).where("text <> ''")

    def id_under(parent: Column) -> Column:
        return text.comment_hash(F.col("content_id"), parent, F.col("user"), F.col("text"))

    found = resolve_parents(named.withColumn("comment_id", id_under(F.lit(""))), scope)
    official = is_owner(F.col("creator"), [F.col("shown"), F.col("linked")], owners)
    if accounts is not None:
        found = with_accounts(found, ["shown", "linked"], accounts)
        official = official | F.col("_own_shown").isNotNull() | F.col("_own_linked").isNotNull()
    values = {
        "comment_id": id_under(F.col("parent")),
        "content_id": F.col("content_id"),
        "parent_comment_id": F.col("parent"),
        "commenter": F.col("user"),
        "commenter_type": F.when(official, "official").otherwise("unclassified"),
        "is_official": F.when(official, "true").otherwise("false"),
        "text_original": F.col("text"),
        "likes": numbers.compact_number(F.col("likeLabel")),
        "url": F.col("url"),
    }
    return found.select(*[values.get(c, F.lit("")).alias(c) for c in COMMENT_PLAIN], ORDINAL)


def panel_metrics(heads: DataFrame) -> DataFrame:
    """From windows (record_id, file, metrics): the last window's likes, comments_count and shares of each post."""
    last = heads.where("metrics is not null").groupBy("record_id").agg(F.max_by("metrics", "file").alias("m"))
    named = (("likes", "likes"), ("comments", "comments_count"), ("shares", "shares"))
    return last.select("record_id", *[numbers.compact_number(F.col(f"m.{m}")).alias(c) for m, c in named])


def legacy_content(videos: DataFrame, company: str, language: str = "my", collected_at: str = "") -> DataFrame:
    rows = videos.where("vid <> '' and url <> ''")
    values = {
        "record_id": F.concat(F.lit("TT-"), F.col("vid")),
        "published_at": numbers.legacy_date(F.col("published")),
        "account": urls.tiktok_handle(F.col("url")),
        "language": F.lit(language),
        "url": urls.strip_query(F.col("url")),
        "brand": text.first_present(F.col("brand"), F.lit(company)),
        "collected_at": F.lit(collected_at),
        "retrieval_status": F.lit("legacy_imported"),
        **{c: F.col(c) for c in ("platform", "text_original", "text_translation", "views", "likes", "comments_count", "shares", "content_type")},
    }
    return _content(rows, values, [])


def legacy_comments(comments: DataFrame) -> DataFrame:
    """Reconstructed ids; the first of equal comments stays."""
    from .dedup import first_wins

    content = F.concat(F.lit("TT-"), F.col("vid"))
    official = text.truthy(F.col("is_official"))
    values = {
        "comment_id": text.comment_hash(content, F.lit(""), F.col("commenter"), F.col("text_original")),
        "content_id": content,
        "commenter_type": F.when(official, "official").otherwise("unclassified"),
        "is_official": F.when(official, "true").otherwise("false"),
        "url": urls.strip_query(F.col("url")),
        **{c: F.col(c) for c in ("commenter", "text_original", "text_translation", "likes", "topic")},
    }
    rows = comments.where("vid <> ''").select(*[values.get(c, F.lit("")).alias(c) for c in COMMENT_PLAIN], ORDINAL)
    return first_wins(rows, ["comment_id"])


def census_row(content: DataFrame, platform: str, handle: str, url: str, followers: str = "", notes: str = "") -> DataFrame:
    """The one platform row of a capture, from its content."""
    one = content.agg(F.count(F.lit(1)).cast("string").alias("visible_items"), last_active(content).alias("last_active_at"))
    return one.select(
        F.lit(platform).alias("platform"), F.lit(handle).alias("handle"), F.lit(url).alias("url"), F.lit("verified").alias("identity_status"), F.lit("").alias("identity_evidence"),
        F.lit(followers).alias("followers"), "visible_items", "last_active_at", F.lit("yes").alias("deep_dive"), F.lit(notes).alias("notes"),
    )


def write_bundle(out: str, content: DataFrame, comments: DataFrame | None, platform: DataFrame, manifest: dict) -> None:
    """A bundle: content newest first (by text, then id), comments by id, one platform row, the manifest."""
    from ..schemas import COMMENT, PLATFORM
    from ..sources import sinks

    spark = content.sparkSession
    sinks.make_dirs(spark, out)
    columns = [c for c in content.columns if c != ORDINAL]
    sinks.write_csv(content, f"{out}/content.csv", columns, [F.desc("published_at"), F.desc("record_id")])
    if comments is not None:
        sinks.write_csv(comments, f"{out}/comments.csv", [c for c in comments.columns if c != ORDINAL], ["comment_id"])
    elif not sinks.exists(spark, f"{out}/comments.csv"):
        sinks.write_text(spark, f"{out}/comments.csv", ",".join(COMMENT) + "\n")
    sinks.write_csv(platform, f"{out}/platform_census.csv", PLATFORM)
    sinks.write_json(spark, f"{out}/run_manifest.json", manifest)


def deep_reads(content: DataFrame, platform: str, top: int = 30, wanted: list[str] | None = None) -> DataFrame:
    """The posts of a platform that are read further: those asked for by URL (a URL that isn't there is an error), or else
    the ``top`` most viewed ones that can be (0: all)."""
    from ..sources.bundle import EvidenceError
    from .joins import selected

    fits = F.lower(text.clean(F.col("platform"))) == platform
    fits = fits & (F.col("url").contains("/video/") if platform == "tiktok" else urls.content_video_id(F.col("url"), F.col("record_id")) != "")
    found = content.where(fits)
    if wanted:
        asked = content.sparkSession.createDataFrame([(w,) for w in wanted], "u string").select(urls.strip_query(F.col("u")).alias("_bare"))
        chosen, missing = selected(found.withColumn("_bare", urls.strip_query(F.col("url"))), asked, "_bare")
        if lost := sorted(r["_bare"] for r in missing.collect()):
            raise EvidenceError(f"not among the posts: {', '.join(lost)}")
        return chosen.drop("_bare")
    return most_viewed(found, numbers.number(F.col("views")), top)


def most_viewed(content: DataFrame, views: Column, top: int, order: str = ORDINAL) -> DataFrame:
    """The ``top`` rows of most views, the first of equals first; all of them for 0. A top-k plan, not a sort."""
    ranked = content.orderBy(F.desc(views), order)
    return ranked.limit(top) if top else ranked
