"""Scans of evidence: CSV tables, manifests, bundles, landed payloads. All columns are text and blank is never null."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean, filled
from ..schemas import BUNDLE_FILES, ENTITIES

ORDINAL = "_ord"
SNAPSHOT = "derived_current_snapshot"  # fixed value: the artifact_type of an exported snapshot


class EvidenceError(ValueError):
    """Input that breaks a rule of the evidence format."""


def read_csv(spark: SparkSession, path: str, ordinal: bool = True) -> DataFrame:
    """A CSV with a header: quoted line breaks and a byte-order mark are fine, blanks stay ``''``, types aren't guessed.

    ``_ord`` numbers rows in file order (the order that ties go by): one file is one partition in a multi-line scan.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False)
    df = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = df.select([filled(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.withColumn(ORDINAL, F.monotonically_increasing_id()) if ordinal else df


def read_csv_trimmed(spark: SparkSession, path: str) -> DataFrame:
    """read_csv with names and values stripped, for older exports."""
    df = read_csv(spark, path)
    return df.select([clean(F.col(f"`{c}`")).alias(c.strip()) if c != ORDINAL else F.col(c) for c in df.columns])


def require_columns(df: DataFrame, required: list[str], name: str, allow_empty: bool = True) -> DataFrame:
    if missing := sorted(set(required) - set(df.columns)):
        raise EvidenceError(f"{name}: missing columns {', '.join(missing)}")
    if not allow_empty and df.isEmpty():
        raise EvidenceError(f"{name}: no rows")
    return df


def read_keyed(df: DataFrame, key: str) -> DataFrame:
    """A checkpoint by id: rows without one go, the last of an id stays."""
    from ..operators.dedup import last_wins

    return last_wins(df.where(clean(F.col(key)) != ""), [key])


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A JSON object (small: one file)."""
    text = spark.read.text(path, wholetext=True).first()
    try:
        found = json.loads(text[0].removeprefix("﻿")) if text else None
    except json.JSONDecodeError as e:
        raise EvidenceError(f"{path}: not JSON") from e
    if not isinstance(found, dict):
        raise EvidenceError(f"{path}: not a JSON object")
    return found


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256, content of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "content")


def bundle_fingerprint(spark: SparkSession, bundle: str) -> str:
    """sha256 over name, NUL, bytes, NUL of the four files in order. Files of any size go through a buffer of a mebibyte."""
    from . import sinks

    if missing := [n for n in BUNDLE_FILES if not sinks.exists(spark, f"{bundle}/{n}")]:
        raise EvidenceError(f"{bundle}: missing {', '.join(missing)}")
    return sinks.sha256(spark, [x for n in BUNDLE_FILES for x in (n.encode() + b"\0", f"{bundle}/{n}", b"\0")])


def read_bundle(spark: SparkSession, bundle: str) -> dict:
    """fingerprint, manifest and the three tables of a bundle. A derived snapshot is refused."""
    fingerprint = bundle_fingerprint(spark, bundle)
    manifest = read_manifest(spark, f"{bundle}/run_manifest.json")
    if manifest.get("artifact_type") == SNAPSHOT:
        raise EvidenceError(f"{bundle}: a derived snapshot can't be imported")
    tables = {kind: read_csv(spark, f"{bundle}/{name}") for kind, (name, _, _) in ENTITIES.items()}
    return {"fingerprint": fingerprint, "manifest": manifest, "tables": tables}


VIDEO = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "description", "upload_date", "webpage_url", "language", "channel", "channel_id", "uploader_id", "uploader_url", "availability")]
    + [T.StructField(n, T.DoubleType()) for n in ("timestamp", "view_count", "like_count", "comment_count", "duration", "channel_follower_count")]
)


BROKEN = "_broken"


def read_video_lines(spark: SparkSession, path: str, broken: bool = False) -> DataFrame:
    """JSON lines of videos; rows without an id go. A line that is not what it should be is an error, or with ``broken`` a row
    whose ``_broken`` has the line, whether or not an id could be read from it."""
    if not broken:
        return spark.read.schema(VIDEO).option("mode", "FAILFAST").json(path).where(filled(F.col("id")) != "").withColumn(ORDINAL, F.monotonically_increasing_id())
    schema = T.StructType([*VIDEO.fields, T.StructField(BROKEN, T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    return rows.where((filled(F.col("id")) != "") | F.col(BROKEN).isNotNull()).withColumn(ORDINAL, F.monotonically_increasing_id())


def read_video_heads(spark: SparkSession, path: str) -> DataFrame:
    """Of each ``*.info.json``: video_id (its id, or else its name), error and warning (what its lander says of it, or that
    it can't be read) and challenge."""
    schema = f"id string, error string, warning string, challenge boolean, comments string, {BROKEN} string"
    heads = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    named = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.info)?\.json$", 1)
    return heads.select(
        F.coalesce(F.nullif(clean(F.col("id")), F.lit("")), F.url_decode(named)).alias("video_id"),
        F.when(F.col(BROKEN).isNotNull(), "not readable as JSON").otherwise(clean(F.col("error"))).alias("error"),
        clean(F.col("warning")).alias("warning"),
        F.coalesce("challenge", F.lit(False)).alias("challenge"),
    )


COMMENTS = (
    "id string, comments array<struct<id:string,parent:string,author:string,author_id:string,author_is_uploader:boolean,text:string,like_count:double,timestamp:double>>"
)


def read_video_comments(spark: SparkSession, path: str) -> DataFrame:
    """A row per comment in ``*.info.json`` files: video_id and the comment's fields; null entries go."""
    info = spark.read.schema(COMMENTS).option("multiLine", True).json(path)
    rows = info.select(F.col("id").alias("video_id"), F.posexplode("comments").alias("_ord", "c")).where(F.col("c").isNotNull())
    return rows.select("video_id", F.col("_ord").cast("long").alias("_ord"), "c.*")


def read_windows(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Landed window payloads: an object with an array (items, articles, posts or rows) -> its elements, in order."""
    windows = spark.read.schema(f"title string, challenge boolean, {field} array<{schema}>").option("multiLine", True).json(path)
    named = windows.select(F.input_file_name().alias("file"), F.col("challenge"), F.posexplode(field).alias("pos", "item"))
    # a file's elements stand behind those of all files before it: only one number a file meets in one task
    sizes = named.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("file", F.coalesce(before, F.lit(0)).alias("_before"))
    return named.join(starts, "file").select((F.col("_before") + F.col("pos") + 1).cast("long").alias(ORDINAL), "file", "challenge", "item.*")


def salvage_json(text: str) -> object:
    """The JSON in a text: the whole, or from its first bracket the longest readable start; code fences go."""
    body = text.strip()
    if fenced := re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", body, re.DOTALL):
        body = fenced[1]
    decoder = json.JSONDecoder()
    try:
        return json.loads(body)
    except json.JSONDecodeError:
        at = min((k for k in (body.find("{"), body.find("[")) if k >= 0), default=-1)
        if at < 0:
            raise EvidenceError("no JSON in the text") from None
        try:
            return decoder.raw_decode(body, at)[0]
        except json.JSONDecodeError as e:
            raise EvidenceError("malformed JSON") from e


def salvage(df: DataFrame, column: str, out: str) -> DataFrame:
    """salvage_json over a column, as canonical JSON text; null where there is none."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(salvage_json(t), ensure_ascii=False, sort_keys=True)
            except EvidenceError:
                return None

        return texts.map(one)

    return df.withColumn(out, run(F.col(column)))


# Headers of the older export and the columns they become.
LEGACY_VIDEOS = {
    "vid": "vid", "平台": "platform", "发布日期": "published", "内容类型": "content_type", "主推品牌": "brand", "播放": "views", "点赞": "likes",
    "评论数": "comments_count", "分享": "shares", "原文缅文": "text_original", "译文中文": "text_translation", "链接": "url",
}
LEGACY_COMMENTS = {
    "所属vid": "vid", "视频链接": "url", "类型": "topic", "用户名": "commenter", "是否官方": "is_official", "点赞数": "likes",
    "评论原文": "text_original", "译文中文": "text_translation",
}
LEGACY_CENSUS = {"平台": "platform", "handle": "handle", "粉丝": "followers", "是否活跃": "active", "是否深挖": "deep_dive", "链接": "url", "备注": "notes"}


def read_legacy(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    df = read_csv_trimmed(spark, path)
    return require_columns(df, list(names), path).select(*[F.col(k).alias(v) for k, v in names.items()], ORDINAL)
