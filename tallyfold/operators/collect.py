"""From landed payloads to bundles: the part of collection that is behind the browser or downloader.

A landing folder holds what a collector saw, one JSON file per window (or JSON lines per tab). Whatever lands them stops
at a page that asks for a person; that shows here as ``challenge`` and ends in a status that is not ingested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text, urls
from ..schemas import COMMENT, COMMENT_PLAIN
from ..sources import sinks
from ..sources.bundle import BROKEN, EvidenceError, read_csv, read_manifest, read_video_comments, read_video_heads, read_video_lines, read_windows
from . import connectors, dedup, joins, scan
from .ledger import now

# How a capture ended.
COMPLETED, CHALLENGED, LIMITED, PARTIAL = "completed", "human_verification_required", "row_limit_reached", "partial_with_errors"
SINGLE, SCROLLED, STAGNANT, BY_HAND = "single_window_captured", "scroll_limit_reached", "profile_end_or_stagnant", "manual_scroll_confirmed"
INTERRUPTED, FAILED = "interrupted_with_checkpoint", "collector_error_with_checkpoint"
SINGLE_FEED, STAGNANT_FEED = "single_window_complete", "feed_end_or_stagnant"  # what pages with a feed say for SINGLE and STAGNANT
FEEDS = {SINGLE: SINGLE_FEED, STAGNANT: STAGNANT_FEED}
STAGNANT_ROUNDS = {"tiktok": 6, "facebook": 6, "linkedin": 5, "tiktok-comments": 3}  # fixed values

# Fields of the elements of each site's windows.
WINDOWS = {
    "tiktok": ("items", "struct<url:string,accessibilityText:string,viewsLabel:string,badge:string>"),
    "facebook": ("articles", "struct<permalink:string,text:string,publishedAt:string,publishedLabel:string,metricLabels:array<string>>"),
    "linkedin": ("posts", "struct<permalink:string,author:string,body:string,publishedLabel:string,metricLabels:array<string>,rawText:string>"),
    "tiktok-comments": ("rows", "struct<level:int,user:string,userHref:string,text:string,likeLabel:string,creator:boolean,parentUser:string,parentText:string>"),
}
HEAD = "title string, displayName string, followersLabel string, challenge boolean, signedOut boolean, url string, status string, scrollY long, scrollHeight long, metrics struct<likes:string,comments:string,shares:string>"
EXIT_CODES = {COMPLETED: 0, LIMITED: 0, SINGLE: 0, SCROLLED: 0, STAGNANT: 0, BY_HAND: 0, SINGLE_FEED: 0, STAGNANT_FEED: 0, PARTIAL: 1, CHALLENGED: 2, INTERRUPTED: 2, FAILED: 2}


def window_heads(spark: SparkSession, landing: str) -> DataFrame:
    heads = spark.read.schema(HEAD).option("multiLine", True).json(landing)
    return heads.select(F.input_file_name().alias("file"), "*")


def challenged(heads: DataFrame) -> bool:
    """Whether any window asks for a person or has lost its session."""
    asks: Column = F.coalesce(F.col("challenge"), F.lit(False)) | F.coalesce(F.col("signedOut"), F.lit(False)) | text.needs_person(F.col("title"))
    return not heads.where(asks).isEmpty()


def quiet_windows(heads: DataFrame, items: DataFrame, key: str, rounds: int) -> DataFrame:
    """Per window in order: seen (keys that no earlier window had), quiet (windows in a row that brought none and did not
    move) and stopped (whether that is ``rounds`` of them). ``heads``: file, scrollY, scrollHeight; ``items``: file, key."""
    first = items.groupBy(key).agg(F.min("file").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("seen"))
    rows = heads.join(first, "file", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    extent = F.struct(F.coalesce("scrollY", F.lit(0)).alias("y"), F.coalesce("scrollHeight", F.lit(0)).alias("h"))
    rows = scan.running(rows.withColumn("capture", F.lit(0)), ["capture"], "file", {"before": ("lag", extent)})
    rows = rows.withColumn("moved", (F.col("seen") > 0) | F.col("before").isNull() | (F.col("before") != extent))
    return dedup.stagnant(rows, ["capture"], "file", F.col("moved"), rounds).select("file", "seen", "quiet", "stopped")


def capture_status(heads: DataFrame, windows: DataFrame, max_scrolls: int | None) -> str:
    """How a capture ended: a page that asks for a person, then what the last window says of itself, then what follows
    from the windows: stagnation, the bound on scrolls, or else that it came to its end."""
    if challenged(heads):
        return CHALLENGED
    last = heads.orderBy(F.desc("file")).select("status").first()
    if last and last["status"] in EXIT_CODES:
        return last["status"]
    end = windows.agg(F.count(F.lit(1)).alias("n"), F.max_by("stopped", "file").alias("stopped")).first()
    if end["stopped"]:
        return STAGNANT
    if max_scrolls is not None and end["n"] > max_scrolls:
        return SCROLLED if max_scrolls else SINGLE
    return COMPLETED


def exit_code(status: str, rows: int) -> int:
    """2 where a person is needed, 1 without any row, else by status."""
    return EXIT_CODES.get(status, 2) if rows else 2 if status == CHALLENGED else 1


def published_since(content: DataFrame, since: str | None) -> DataFrame:
    """Rows dated on or after a YYYY-MM-DD; undated ones stay, as their date isn't known to be earlier."""
    if not since:
        return content
    numbers.parse_since(since)
    return content.where((F.col("published_at") == "") | (F.substring("published_at", 1, 10) >= since))


def _normalized(spark: SparkSession, site: str, url: str) -> tuple[str, str]:
    one = spark.range(1).select(F.lit(url).alias("u"))
    known = {
        "tiktok": lambda u: (urls.tiktok_profile(u), urls.tiktok_handle(urls.tiktok_profile(u))),
        "facebook": lambda u: (urls.facebook_page(u), urls.facebook_handle(urls.facebook_page(u))),
        "linkedin": lambda u: (urls.linkedin_profile(u)["canonical"], urls.linkedin_profile(u)["handle"]),
        "youtube": lambda u: (urls.youtube_channel(u), F.element_at(F.split(urls.youtube_channel(u), "/"), -1)),
    }[site](F.col("u"))
    row = one.select(*known).first()
    if row[0] is None:
        raise EvidenceError(f"not a {site} profile: {url}")
    return row[0], row[1]


def collect_profile(spark: SparkSession, site: str, landing: str, out: str, company: str, url: str, limit: int = 0, since: str | None = None, tabs: str = "", max_scrolls: int | None = None) -> dict:
    """A bundle of a profile's posts; returns status, rows and exit code."""
    profile, handle = _normalized(spark, site, url)
    started, name, followers, status = now(), "", "", COMPLETED
    if site == "youtube":
        wanted = numbers.parse_tabs(tabs)
        there = [t for t in wanted if sinks.exists(spark, f"{landing}/{t}")]
        if not there:
            raise EvidenceError(f"{landing}: no tab has landed")
        read = None
        for k, tab in enumerate(there):
            part = read_video_lines(spark, f"{landing}/{tab}", broken=True).withColumns({"source_tab": F.lit(tab), "_ord": F.col("_ord") + k * (1 << 40)})
            read = part if read is None else read.unionByName(part)
        broken = read.groupBy("source_tab").agg(F.count_if(F.col(BROKEN).isNotNull()).alias("n"), F.count("id").alias("ids")).where("n > 0").collect()  # a row a tab
        warnings = {r["source_tab"]: f"{r['n']} lines could not be read in full" for r in sorted(broken)}
        read = read.where(text.clean(F.col("id")) != "").drop(BROKEN)
        score = dedup.filled_fields(read, ["title", "description", "upload_date", "timestamp", "view_count", "like_count", "comment_count", "duration"])
        content = connectors.youtube_content(dedup.richest_wins(read, ["id"], score, "source_tab"), company, started)
        seen = read.agg(F.max("channel_follower_count").cast("bigint").cast("string").alias("f")).first()["f"]
        followers = seen or ""
    else:
        heads = window_heads(spark, landing)
        last = [F.max_by(c, F.when(text.clean(F.col(c)) != "", F.col("file"))).alias(n) for c, n in (("displayName", "n"), ("followersLabel", "f"))]
        first = heads.agg(*last).first()
        name, followers = first["n"] or "", first["f"] or ""
        items = read_windows(spark, landing, *WINDOWS[site])
        status = capture_status(heads, quiet_windows(heads, items, "permalink" if "permalink" in items.columns else "url", STAGNANT_ROUNDS[site]), max_scrolls)
        if site in ("facebook", "linkedin"):
            status = FEEDS.get(status, status)
        if site == "tiktok":
            content = connectors.tiktok_content(items, company, handle, name, started)
        elif site == "facebook":
            content = connectors.facebook_content(items, company, handle, started)
        else:
            content = connectors.linkedin_content(items, company, handle, profile, started)
        content = dedup.longest_wins(content, ["record_id"], "text_original") if site == "linkedin" else dedup.merge_windows(content, "record_id")
        followers = spark.range(1).select(numbers.compact_number(F.lit(followers))).first()[0]
    content = published_since(content, since)
    rows = content.count()
    if limit and rows >= limit:
        content, status = content.orderBy("_ord").limit(limit), LIMITED if EXIT_CODES[status] == 0 else status
        rows = min(rows, limit)
    counts = {"unique_content": rows}
    if site == "youtube":
        counts["by_tab"] = {r["source_tab"]: r["count"] for r in read.groupBy("source_tab").count().collect()}
    platform = connectors.census_row(content, {"tiktok": "TikTok", "facebook": "Facebook", "linkedin": "LinkedIn", "youtube": "YouTube"}[site], handle, profile, followers)
    key = {"youtube": "normalized_channel_url", "facebook": "normalized_page_url"}.get(site, "normalized_profile_url")
    manifest = {
        "schema_version": "1.0", "research_mode": "competitor_intelligence", "target": {"company": company, "platform": site, "account": handle}, "input_url": url, key: profile,
        "started_at_utc": started, "cutoff_utc": now(), "status": status, "challenge_detected": status == CHALLENGED, "counts": counts,
        "limitations": ["Blank metrics are unknown, not zero.", "What a site did not show is not in the capture."],
    }
    if site == "youtube":
        manifest["selected_tabs"] = wanted
        manifest["warnings"] = warnings
    connectors.write_bundle(out, content, None, platform, manifest)
    return {"status": status, "rows": rows, "exit_code": exit_code(status, rows)}


def update_manifest(spark: SparkSession, bundle: str, status: str, selected: int, comments: int, warnings: list[str] | None = None) -> None:
    """The conversation block, the count of comments, and what was amiss with posts."""
    path = f"{bundle}/run_manifest.json"
    manifest = read_manifest(spark, path) if sinks.exists(spark, path) else {"schema_version": "1.0"}
    manifest["conversation_collection"] = {"selected_content": selected, "public_comments_and_replies": comments, "status": status, "challenge_detected": status == CHALLENGED, "cutoff_utc": now()}
    manifest.setdefault("counts", {})["comments"] = comments
    if warnings:
        manifest.setdefault("warnings", {})["youtube_comments"] = warnings
    sinks.write_json(spark, path, manifest)


def panel_status(heads: DataFrame) -> str:
    """How a capture of comment panels ended: a page that asks for a person, what the last window says of itself if it was
    interrupted or failed, or else that it came to its end."""
    if challenged(heads):
        return CHALLENGED
    last = heads.orderBy(F.desc("file")).select("status").first()
    return last["status"] if last and last["status"] in (INTERRUPTED, FAILED) else COMPLETED


def video_status(heads: DataFrame, chosen: DataFrame) -> tuple[str, list[str]]:
    """How a capture of videos' comments ended, and a warning for each chosen post that failed or said something: a page
    that asked for a person, posts that failed beside others, or all of them complete."""
    posts = chosen.select("record_id", urls.content_video_id(F.col("url"), F.col("record_id")).alias("video_id"))
    told = heads.join(posts, "video_id").where(F.col("challenge") | (F.col("error") != "") | (F.col("warning") != ""))
    asks = F.col("challenge") | text.needs_person(F.col("error"))
    said = F.element_at(F.split(F.coalesce(F.nullif("error", F.lit("")), F.nullif("warning", F.lit("")), F.lit("asks for a person")), r"[\r\n]+"), -1)
    found = told.select(asks.alias("asks"), (F.col("error") != "").alias("failed"), F.concat("record_id", F.lit(": "), said).alias("said")).orderBy("said").collect()  # of the posts asked for
    status = CHALLENGED if any(r["asks"] for r in found) else PARTIAL if any(r["failed"] for r in found) else COMPLETED
    return status, [r["said"] for r in found]


def collect_comments(
    spark: SparkSession, site: str, landing: str, bundle: str, owners: list[str] | None = None, top: int = 30, wanted: list[str] | None = None, resume: bool = True
) -> dict:
    """Adds landed comments of the posts asked for, or of the most viewed ones, to a bundle; the last capture of a comment
    stays. Without ``resume`` the bundle's own comments go first."""
    content = read_csv(spark, f"{bundle}/content.csv")
    chosen = connectors.deep_reads(content, "tiktok" if site == "tiktok-comments" else "youtube", top, wanted)
    columns, warnings = COMMENT, []
    if site == "youtube-comments":
        status, warnings = video_status(read_video_heads(spark, landing), chosen)
        found = connectors.youtube_comments(read_video_comments(spark, landing), chosen)
    else:
        columns = COMMENT_PLAIN
        heads = window_heads(spark, landing)
        status = panel_status(heads)
        at = heads.select("file", urls.tiktok_video_id(F.col("url")).alias("_video"), "metrics")
        posts = chosen.select(F.col("record_id").alias("content_id"), "url", urls.tiktok_video_id(F.col("url")).alias("_video"))
        rows = read_windows(spark, landing, *WINDOWS[site]).join(at.select("file", "_video"), "file").join(posts, "_video")
        found = connectors.tiktok_comments(rows, sorted({*(owners or [])}), chosen)
        metrics = connectors.panel_metrics(at.join(posts, "_video").select(F.col("content_id").alias("record_id"), "file", "metrics"))
        filled = joins.backfill(content, metrics, "record_id", ["likes", "comments_count", "shares"])
        kept = [c for c in content.columns if c != "_ord"]
        sinks.write_csv(filled, f"{bundle}/content.csv.next", kept, ["_ord"])
    old = read_csv(spark, f"{bundle}/comments.csv")
    if resume and set(columns) <= set(old.columns) and not old.isEmpty():
        found = old.select(*columns, F.col("_ord")).unionByName(found.select(*columns, (F.col("_ord") + (1 << 50)).alias("_ord")))
    found = dedup.last_wins(found.select(*columns, "_ord"), ["comment_id"])
    sinks.write_csv(found, f"{bundle}/comments.csv.next", columns, ["comment_id"])
    for name in ("content.csv", "comments.csv"):
        if sinks.exists(spark, f"{bundle}/{name}.next"):
            sinks.remove(spark, f"{bundle}/{name}")
            sinks.move(spark, f"{bundle}/{name}.next", f"{bundle}/{name}")
    rows = read_csv(spark, f"{bundle}/comments.csv").count()
    update_manifest(spark, bundle, status, chosen.count(), rows, warnings)
    return {"status": status, "rows": rows, "exit_code": EXIT_CODES[status]}
