import pytest
from pyspark.sql import functions as F

from tallyfold.functions import numbers, text, urls


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda *cs: one.select(*[c.alias(f"c{k}") for k, c in enumerate(cs)]).first()


def lit(*xs):
    return [F.lit(x).cast("string") for x in xs]


def test_compact_numbers(value):
    got = value(*[numbers.compact_number(c) for c in lit("23.2K", "1.3万", "1,234", "12 members", "no", None, "2.5百万", "3M views")])
    assert list(got) == ["23200", "13000", "1234", "12", "", "", "2500000", "3000000"]
    assert value(numbers.compact_number(F.lit("12 members"), any_letter=True))[0] == "12000000"


def test_numbers(value):
    assert list(value(*[numbers.number(c) for c in lit("1,200", "3.9", "", "nan", "x", None)])) == [1200, 3, 0, 0, 0, 0]
    assert list(value(*[numbers.csv_number(c) for c in lit("1,200", "", "x")])) == ["1200", "", ""]
    assert list(value(*[numbers.confidence(c) for c in lit(".95", "0.5", "0.1", "High", "?")])) == ["high", "medium", "low", "high", "low"]
    assert value(numbers.display(F.lit(1200), F.lit(True)), numbers.display(F.lit(0), F.lit(False)))[:] == ("1,200", "n/a")
    assert list(value(numbers.percent(F.lit(1), F.lit(8)), numbers.percent(F.lit(1), F.lit(0)))) == ["12%", "n/a"]


def test_times_of_ids_beyond_63_bits(value):
    """Times from 2038 on lift an id over 63 bits; an id's time is believed up to 2100, or to a caller's last second."""
    ids = ["15000000000000000000", str((4_102_444_800 << 32) + (1 << 32) - 1), str(4_102_444_801 << 32), str(1_262_304_000 << 32), str((1_262_304_000 << 32) - 1), "9" * 60, "-5", "1.5", ""]
    got = value(*[numbers.snowflake_time(c) for c in lit(*ids)])
    assert list(got) == ["2080-09-01T23:40:54+00:00", "2100-01-01T00:00:00+00:00", "", "2010-01-01T00:00:00+00:00", "", "", "", "", ""]
    late = value(*[numbers.snowflake_time(c, latest=numbers.EVER) for c in lit(str((4_102_444_801 << 32) + 7), str((253_402_300_800 << 32) + 7))])
    assert list(late) == ["2100-01-01T00:00:01+00:00", "10000-01-01T00:00:00+00:00"]


def test_times(value):
    got = value(numbers.snowflake_time(F.lit("7416929728608701704")), numbers.snowflake_time(F.lit("12")), numbers.snowflake_time(F.lit("x")))
    assert list(got) == ["2024-09-21T03:15:22+00:00", "", ""]
    assert value(numbers.published_at(F.lit(None).cast("double"), F.lit("20260102")), numbers.published_at(F.lit(1767312000.0), F.lit("")))[:] == ("2026-01-02", "2026-01-02T00:00:00+00:00")
    assert list(value(*[numbers.legacy_date(c) for c in lit("2025-03-04 10:00", "soon")])) == ["2025-03-04T00:00:00+00:00", "soon"]
    assert numbers.parse_since("2026-01-02") == "20260102" and numbers.parse_since(None) is None
    with pytest.raises(ValueError):
        numbers.parse_since("02/01/2026")
    assert numbers.parse_tabs("shorts, videos,shorts") == ["shorts", "videos"]
    with pytest.raises(ValueError):
        numbers.parse_tabs("live")


def test_urls(value):
    profile = [urls.tiktok_profile(c) for c in lit("@Example.Company", "https://m.tiktok.com/@Example.Company?lang=en", "https://xtiktok.com/@a", "https://tiktok.com/x")]
    assert list(value(*profile)) == ["https://www.tiktok.com/@Example.Company"] * 2 + [None, None]
    video = "https://www.tiktok.com/@a/video/12?x=1"
    assert value(urls.tiktok_video(F.lit(video)), urls.tiktok_video(F.lit("https://nottiktok.com/@a/video/12")), urls.tiktok_video_id(F.lit(video)))[:] == ("https://www.tiktok.com/@a/video/12", "", "12")
    page = [urls.facebook_page(c) for c in lit("https://m.facebook.com/ExamplePage/?ref=x", "https://www.facebook.com/profile.php?id=12345&ref=x", "https://x.test/a")]
    assert list(value(*page)) == ["https://www.facebook.com/ExamplePage", "https://www.facebook.com/profile.php?id=12345", None]
    post = urls.facebook_post(F.lit("https://m.facebook.com/ExamplePage/posts/12345/?ref=share&id=7"))
    assert value(post, urls.facebook_post_key(post))[:] == ("https://www.facebook.com/ExamplePage/posts/12345?id=7", "12345")
    assert value(urls.facebook_post(F.lit("https://notfacebook.com/a")))[0] == ""
    channel = [urls.youtube_channel(c) for c in lit("https://m.youtube.com/@a/videos?x=1", "https://www.youtube.com/channel/UC1/", "https://www.youtube.com/watch?v=1", "https://www.youtube.com/@a/live")]
    assert list(value(*channel)) == ["https://www.youtube.com/@a", "https://www.youtube.com/channel/UC1", None, None]
    ids = [urls.youtube_video_id(c) for c in lit("https://youtu.be/abc?t=1", "https://www.youtube.com/watch?a=1&v=abc", "https://youtube.com/shorts/abc", "https://x.test/abc")]
    assert list(value(*ids)) == ["abc", "abc", "abc", ""]
    assert value(urls.comment_url(F.lit("https://www.youtube.com/watch?v=a&lc=old#x"), F.lit("r1")))[0] == "https://www.youtube.com/watch?v=a&lc=r1"
    found = value(urls.linkedin_profile(F.lit("company/example")))[0]
    assert (found["canonical"], found["activity"]) == ("https://www.linkedin.com/company/example/", "https://www.linkedin.com/company/example/posts/?feedView=all")
    assert value(urls.linkedin_post_id(F.lit("https://www.linkedin.com/feed/update/urn:li:activity:7345678901234567890/"), *lit("", "", "")))[0] == "7345678901234567890"


def test_text(value):
    assert list(value(*[text.clean(c) for c in lit("  a\t\n", "　x　", None)])) == ["a", "x", ""]
    assert list(value(*[text.truthy(c) for c in lit(" TRUE ", "1", "yes", "是", "no", "", None)])) == [True] * 4 + [False] * 3
    assert value(text.caption(F.lit("Video created by Example Public caption #tag"), *lit("Example", "ex")))[0] == "Example Public caption #tag"
    assert value(text.caption(F.lit("x created by @ex"), *lit("Example", "ex")))[0] == ""
    assert value(text.slug(F.lit("  How To! "), "none"), text.slug(F.lit("!!"), "none"))[:] == ("how-to", "none")
    assert value(text.pseudonym(F.lit(" a ")))[0] == value(text.pseudonym(F.lit("a")))[0] != value(text.pseudonym(F.lit("b")))[0]
    assert value(text.working_text(*lit("", "one\ntwo")), text.working_text(*lit("", "")))[:] == ("one", "")
    assert value(text.needs_person(F.lit("Sign in to confirm you’re not a bot")), text.needs_person(F.lit("fine")))[:] == (True, False)
    assert value(text.canonical_json(F.create_map(*lit("b", "é", "a", '"'))))[0] == '{"a":"\\"","b":"é"}'
    assert value(text.html_escape(F.lit("<a & 'b'>")))[0] == "&lt;a &amp; &#x27;b&#x27;&gt;"


def test_label_metrics(value):
    labels = F.array(*lit("1.2K reactions", "34 comments", "5 shares"))
    assert list(value(*[numbers.first_label_metric(labels, k) for k in ("likes", "comments", "shares")])) == ["1200", "34", "5"]
    assert value(numbers.first_label_metric(F.array(F.lit("Public post")), "likes"))[0] == ""
    raw = F.lit("I like this 21 reactions 4 comments")
    none = F.array().cast("array<string>")
    assert list(value(*[numbers.number_before_word(none, raw, k) for k in ("likes", "comments", "shares")])) == ["21", "4", ""]
