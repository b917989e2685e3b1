"""Numeric expressions over text metrics, and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, filled

# Units of compact numbers.
UNITS = {"k": 1e3, "m": 1e6, "b": 1e9, "千": 1e3, "万": 1e4, "百万": 1e6, "亿": 1e8}

# Words that name a metric in a label.
FACEBOOK_WORDS = {"likes": "reaction|reacted|like|likes|心情|赞|တုံ့ပြန်", "comments": "comment|comments|评论|မှတ်ချက်", "shares": "share|shares|分享|မျှဝေ"}
LINKEDIN_WORDS = {
    "likes": "reaction|reactions|like|likes|赞|反应",
    "comments": "comment|comments|评论",
    "shares": "repost|reposts|share|shares|转发|分享",
    "views": "impression|impressions|view|views|展示|浏览",
}


def compact_number(c: Column, any_letter: bool = False) -> Column:
    """``23.2K`` -> ``23200``; blank without a number. A Latin unit must end its word (``12 members`` is 12), unless
    ``any_letter`` asks for the looser reading, where any letter k, m or b behind a number is a unit."""
    text = F.lower(F.replace(clean(c), F.lit(","), F.lit("")))
    behind = "" if any_letter else r"(?![a-z])"
    shape = rf"(?U)(\d+(?:\.\d+)?)\s*(百万|[千万亿]|[kmb]{behind})?"
    value = F.regexp_extract(text, shape, 1).try_cast("double")
    unit = F.regexp_extract(text, shape, 2)
    times = F.lit(1.0)
    for name, size in UNITS.items():
        times = F.when(unit == name, size).otherwise(times)
    return F.coalesce(F.bround(value * times).cast("bigint").cast("string"), F.lit(""))


def first_label_metric(labels: Column, kind: str) -> Column:
    """The first label that names the metric and yields a number; blank where none does."""
    named = F.filter(labels, lambda x: F.rlike(x, F.lit(f"(?i)(?:{FACEBOOK_WORDS[kind]})")))
    found = F.filter(F.transform(named, lambda x: compact_number(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def number_before_word(labels: Column, raw_text: Column, kind: str) -> Column:
    """The number right before the metric's word, in the labels and then in the raw text."""
    shape = rf"(?i)(\d[\d,.]*\s*(?:k|m|b|千|万|百万|亿)?)\s*(?:{LINKEDIN_WORDS[kind]})"
    texts = F.concat(labels, F.array(filled(raw_text)))
    found = F.filter(F.transform(texts, lambda x: F.regexp_extract(x, shape, 1)), lambda x: x != "")
    return F.coalesce(compact_number(F.try_element_at(found, F.lit(1))), F.lit(""))


def parsed(c: Column) -> Column:
    """A whole number (cut, not rounded) from text with or without commas; null where blank or no finite number."""
    value = F.replace(clean(c), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < 9.2e18), value).cast("bigint")


def number(c: Column) -> Column:
    return F.coalesce(parsed(c), F.lit(0).cast("bigint"))


def csv_number(c: Column) -> Column:
    return F.coalesce(parsed(c).cast("string"), F.lit(""))


def unparseable(c: Column) -> Column:
    return (clean(c) != "") & parsed(c).isNull()


def confidence(c: Column) -> Column:
    """A model's confidence as a word: its own, or from a number; low where it is neither."""
    text = F.lower(clean(c))
    value = text.try_cast("double")
    return F.when(text.isin("high", "medium", "low"), text).when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low")


def display(value: Column, available: Column) -> Column:
    return F.when(available, F.format_number(value, 0)).otherwise("n/a")


def percent(part: Column, whole: Column) -> Column:
    share = F.try_divide(part.cast("double") * 100, whole)
    return F.when(whole > 0, F.format_string("%.0f%%", F.bround(share))).otherwise("n/a")


ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
EARLIEST, LATEST = 1_262_304_000, 4_102_444_800  # fixed values: seconds between which an id's time is believed
EVER = (1 << 63) // 1_000_000 - 1  # the last second that a timestamp can hold


def iso_from_epoch(seconds: Column) -> Column:
    """Seconds as ISO text in UTC whatever the session's zone."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.coalesce(F.ltrim(F.date_format(utc, ISO), F.lit("+")), F.lit(""))  # a plus stands before years over 9999


def snowflake_time(id_text: Column, earliest: int = EARLIEST, latest: int = LATEST) -> Column:
    """The time in an id's bits above the low 32, in decimals: ids of believed times go beyond 63 bits from 2038 on."""
    number = F.regexp_extract(filled(id_text), r"^\s*\+?0*(\d{1,28})\s*$", 1).try_cast("decimal(28,0)")
    seconds = ((number - F.pmod(number, F.lit(1 << 32))) / F.lit(1 << 32)).try_cast("bigint")
    return F.coalesce(F.when(seconds.between(earliest, latest), iso_from_epoch(seconds)), F.lit(""))


def published_at(timestamp: Column, upload_date: Column) -> Column:
    day = F.regexp_extract(clean(upload_date), r"^(\d{4})(\d{2})(\d{2})$", 0)
    dashed = F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    seconds = timestamp.try_cast("double").cast("bigint")
    return F.when(seconds.isNotNull(), iso_from_epoch(seconds)).otherwise(dashed)


def legacy_date(c: Column) -> Column:
    day = F.try_to_date(F.substring(clean(c), 1, 10), "yyyy-MM-dd")
    return F.coalesce(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00+00:00")), clean(c))


def month(c: Column) -> Column:
    return F.substring(clean(c), 1, 7)


def parse_since(value: str | None) -> str | None:
    """YYYY-MM-DD as YYYYMMDD; anything else is an error."""
    from datetime import datetime

    return datetime.strptime(value.strip(), "%Y-%m-%d").strftime("%Y%m%d") if value else None


def parse_tabs(value: str) -> list[str]:
    from .urls import TABS

    asked = list(dict.fromkeys(x.strip().lower() for x in value.split(",") if x.strip()))
    if unknown := sorted(set(asked) - set(TABS)):
        raise ValueError(f"unknown tabs: {', '.join(unknown)}")
    return asked or list(TABS)
