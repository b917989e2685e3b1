"""URL expressions: a host outside the allowed ones or an unknown path gives null (profiles) or blank (posts).

Hosts are matched whole, or as a suffix behind a dot, so a host that merely ends in a site's name is not that site's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, filled, sha256

POST_KEYS = ("story_fbid", "fbid", "id", "v", "set", "type")  # fixed value: query keys a post keeps, in this order


def host(url: Column) -> Column:
    """Lower case, without user or port; blank where there is none."""
    raw = F.regexp_extract(clean(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(raw, r"^.*@", "")), r":.*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(clean(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(clean(url), r"^[^?#]*\?([^#]*)", 1)


def query_value(url: Column, key: str) -> Column:
    """The raw (still encoded) value of a key; blank where absent."""
    return F.regexp_extract(query(url), rf"(?:^|&){key}=([^&]*)", 1)


def on_site(url: Column, site: str) -> Column:
    h = host(url)
    return (h == site) | h.endswith(f".{site}")


def host_and_path(url: Column) -> Column:
    return F.concat(host(url), path(url))


def strip_query(url: Column) -> Column:
    return F.rtrim(F.substring_index(filled(url), "?", 1), F.lit("/"))


def tiktok_profile(raw: Column) -> Column:
    value = clean(raw)
    bare = value.rlike(r"^@?[A-Za-z0-9._-]+$")
    handle = F.regexp_extract(path(value), r"^/@([^/?#]+)", 1)
    known = host(value).isin("tiktok.com", "www.tiktok.com", "m.tiktok.com") & (handle != "")
    name = F.when(bare, F.ltrim(value, F.lit("@"))).when(known, handle)
    return F.concat(F.lit("https://www.tiktok.com/@"), name)


def tiktok_handle(profile: Column) -> Column:
    return F.regexp_extract(path(profile), r"^/@?([^/]*)", 1)


def tiktok_video(raw: Column) -> Column:
    found = F.regexp_extract(path(raw), r"(/@[^/?#]+/video/\d+)", 1)
    return F.when(on_site(raw, "tiktok.com") & (found != ""), F.concat(F.lit("https://www.tiktok.com"), found)).otherwise("")


def tiktok_video_id(url: Column) -> Column:
    return F.regexp_extract(filled(url), r"/video/(\d+)", 1)


def facebook_page(raw: Column) -> Column:
    known = host(raw).isin("facebook.com", "www.facebook.com", "m.facebook.com", "web.facebook.com")
    where = F.rtrim(F.regexp_replace(path(raw), "/{2,}", "/"), F.lit("/"))
    where = F.when(where == "", "/").otherwise(where)
    number = query_value(raw, "id")
    has_id = query(raw).rlike("(?:^|&)id=")
    return F.when(known, F.concat(F.lit("https://www.facebook.com"), where, F.when(has_id, F.concat(F.lit("?id="), number)).otherwise("")))


def facebook_handle(page: Column) -> Column:
    number = query_value(page, "id")
    first = F.regexp_extract(path(page), "^/+([^/]+)", 1)
    is_profile = F.rtrim(path(page), F.lit("/")) == "/profile.php"
    return F.when(is_profile & (number != ""), number).when(first != "", first).otherwise("facebook-page")


def facebook_post(raw: Column) -> Column:
    where = F.rtrim(F.regexp_replace(path(raw), "/{2,}", "/"), F.lit("/"))
    where = F.when(where == "", "/").otherwise(where)
    kept = F.filter(
        F.array(*[F.when(query_value(raw, k) != "", F.concat(F.lit(f"{k}="), query_value(raw, k))) for k in POST_KEYS]), lambda x: x.isNotNull()
    )
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(on_site(raw, "facebook.com"), F.concat(F.lit("https://www.facebook.com"), where, tail)).otherwise("")


def facebook_post_key(url: Column) -> Column:
    options = [query_value(url, k) for k in ("story_fbid", "fbid", "v")]
    options += [F.regexp_extract(path(url), p, 1) for p in (r"/posts/([^/?#]+)", r"/videos/(\d+)", r"/reel/(\d+)", r"/photos/(?:[^/]+/)?(\d+)")]
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], sha256(url, 20))


def linkedin_profile(raw: Column) -> Column:
    """A struct of canonical, activity and handle; null outside /in/ and /company/."""
    value = clean(raw)
    value = F.when(value.rlike("^https?://"), value).otherwise(F.concat(F.lit("https://www.linkedin.com/"), F.ltrim(value, F.lit("/"))))
    kind = F.regexp_extract(path(value), "^/(in|company)/([^/?#]+)", 1)
    handle = F.regexp_extract(path(value), "^/(in|company)/([^/?#]+)", 2)
    canonical = F.concat(F.lit("https://www.linkedin.com/"), kind, F.lit("/"), handle, F.lit("/"))
    activity = F.concat(canonical, F.when(kind == "in", "recent-activity/all/").otherwise("posts/?feedView=all"))
    known = host(value).isin("linkedin.com", "www.linkedin.com") & (kind != "")
    return F.when(known, F.struct(canonical.alias("canonical"), activity.alias("activity"), handle.alias("handle")))


def linkedin_post(raw: Column) -> Column:
    known = host(raw).isin("linkedin.com", "www.linkedin.com") & path(raw).rlike("/feed/update/|/posts/|/pulse/")
    return F.when(known, F.concat(F.lit("https://www.linkedin.com"), F.rtrim(path(raw), F.lit("/")), F.lit("/"))).otherwise("")


def linkedin_post_id(url: Column, author: Column, label: Column, body: Column) -> Column:
    activity = F.regexp_extract(filled(url), r"(?i)(?:activity[:-]|activity%3A)(\d{8,})", 1)
    return F.coalesce(F.nullif(activity, F.lit("")), sha256(F.concat_ws("|", filled(url), filled(author), filled(label), filled(body)), 20))


TABS = ("videos", "shorts", "streams")  # fixed value


def youtube_channel(raw: Column) -> Column:
    parts = F.filter(F.split(path(raw), "/"), lambda x: x != "")
    last = F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))
    parts = F.when(last.isin(*TABS), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    whole = (first.startswith("@") & (F.size(parts) == 1)) | (F.lower(first).isin("channel", "c", "user") & (F.size(parts) == 2))
    known = host(raw).isin("youtube.com", "www.youtube.com", "m.youtube.com") & whole
    return F.when(known, F.concat(F.lit("https://www.youtube.com/"), F.array_join(parts, "/")))


def youtube_video_id(url: Column) -> Column:
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    first, second = (F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit("")) for k in (1, 2))
    long_host = host(url).isin("youtube.com", "www.youtube.com", "m.youtube.com")
    return (
        F.when(host(url).isin("youtu.be", "www.youtu.be"), first)
        .when(long_host & (F.rtrim(path(url), F.lit("/")) == "/watch"), query_value(url, "v"))
        .when(long_host & F.lower(first).isin("shorts", "live", "embed"), second)
        .otherwise("")
    )


def content_video_id(url: Column, record_id: Column) -> Column:
    found = youtube_video_id(url)
    return F.when(found != "", found).when(filled(record_id).startswith("YT-"), F.substr(filled(record_id), F.lit(4))).otherwise("")


def comment_url(content_url: Column, comment_id: Column) -> Column:
    base = F.regexp_replace(filled(content_url), "#.*$", "")
    parts = F.filter(F.split(query(base), "&"), lambda x: (x != "") & ~x.rlike("^lc(=|$)"))
    parts = F.concat(parts, F.array(F.concat(F.lit("lc="), filled(comment_id))))
    return F.concat(F.substring_index(base, "?", 1), F.lit("?"), F.array_join(parts, "&"))
