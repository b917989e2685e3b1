import csv
import json

import pytest
from pyspark.sql import functions as F

from tallyfold import cli
from tallyfold.operators import collect, connectors, dedup, joins
from tallyfold.sources.bundle import LEGACY_CENSUS, LEGACY_COMMENTS, LEGACY_VIDEOS, read_video_comments, read_video_lines, read_windows
from tallyfold.streaming import ingest


def test_tiktok_windows(spark, tmp_path):
    one = {"url": "https://www.tiktok.com/@ex/video/7416929728608701704", "accessibilityText": "x created by A first", "viewsLabel": "1.2K"}
    two = {"url": "https://www.tiktok.com/@ex/video/7416929728608701705", "accessibilityText": "", "viewsLabel": ""}
    for k, items in enumerate(([one], [{**one, "viewsLabel": ""}, two, {"url": "https://x.test/"}])):
        (tmp_path / f"w{k}.json").write_text(json.dumps({"title": "t", "challenge": False, "items": items}))
    items = read_windows(spark, str(tmp_path), "items", "struct<url:string,accessibilityText:string,viewsLabel:string,badge:string>")
    rows = connectors.tiktok_content(items, "Ex", "ex", "Ex", "t")
    merged = {r["record_id"]: r for r in dedup.merge_windows(rows, "record_id").collect()}
    assert len(merged) == 2
    assert merged["TT-7416929728608701704"]["views"] == "1200" and merged["TT-7416929728608701704"]["published_at"].startswith("2024-09-")


def test_facebook_and_linkedin(spark):
    articles = spark.createDataFrame(
        [("https://m.facebook.com/P/posts/100/?ref=x", "hello", "", "2d", ["1.2K reactions", "34 comments", "5 shares"], 0), ("", "no url", "", "", [], 1)],
        "permalink string, text string, publishedAt string, publishedLabel string, metricLabels array<string>, _ord long",
    )
    (row,) = connectors.facebook_content(articles, "P", "p", "t").collect()
    assert (row["record_id"], row["likes"], row["comments_count"], row["shares"], row["views"]) == ("FB-100", "1200", "34", "5", "")
    posts = spark.createDataFrame(
        [("https://www.linkedin.com/feed/update/urn:li:activity:7345678901234567890", "A", "body", "2d", ["21 reactions"], "4 comments 2 reposts", 0), ("", "A", "only body", "", [], "", 1), ("", "A", "", "", [], "", 2)],
        "permalink string, author string, body string, publishedLabel string, metricLabels array<string>, rawText string, _ord long",
    )
    rows = connectors.linkedin_content(posts, "L", "l", "https://www.linkedin.com/in/l/", "t").orderBy("_ord").collect()
    assert [r["retrieval_status"] for r in rows] == ["captured", "captured_without_permalink"]
    assert (rows[0]["record_id"], rows[0]["likes"], rows[0]["comments_count"], rows[0]["shares"]) == ("LI-7345678901234567890", "21", "4", "2")


def test_youtube(spark, tmp_path):
    for tab, likes in (("videos", None), ("shorts", 5)):
        (tmp_path / tab).mkdir()
        lines = [{"id": "v1", "title": "T", "description": "D", "upload_date": "20260102", "view_count": 10, "like_count": likes, "channel_id": "UC", "uploader_id": "@u"}, {"id": ""}]
        (tmp_path / tab / "out.json").write_text("\n".join(map(json.dumps, lines)))
    tabs = [read_video_lines(spark, str(tmp_path / t)).withColumn("source_tab", F.lit(t)).withColumn("_ord", F.lit(k)) for k, t in enumerate(("videos", "shorts"))]
    both = tabs[0].union(tabs[1])
    one = dedup.richest_wins(both, ["id"], dedup.filled_fields(both, ["title", "like_count"]), "source_tab")
    content = connectors.youtube_content(one, "U", "t")
    (row,) = content.collect()
    assert (row["text_original"], row["likes"], row["source_tab"], row["published_at"]) == ("T\n\nD", "5", "videos,shorts", "2026-01-02")
    info = {"id": "v1", "comments": [{"id": "p1", "parent": "root", "author": "a", "author_id": "x", "text": "q", "timestamp": 1767312000}, None, {"id": "r1", "parent": "p1", "author": "u", "author_id": "UC", "text": "a"}]}
    (tmp_path / "v1.info.json").write_text(json.dumps(info))
    rows = {r["comment_id"]: r for r in connectors.youtube_comments(read_video_comments(spark, str(tmp_path / "v1.info.json")), content).collect()}
    assert rows["YTC-p1"]["published_at"] == "2026-01-02T00:00:00+00:00" and rows["YTC-p1"]["is_official"] == "false"
    assert rows["YTC-r1"]["parent_comment_id"] == "YTC-p1" and rows["YTC-r1"]["is_official"] == "true" and rows["YTC-r1"]["url"].endswith("lc=r1")


def test_tiktok_comment_parents(spark):
    rows = spark.createDataFrame(
        [(0, 1, "ann", "q one", None, None, None), (1, 1, "bob", "q two", None, None, None), (2, 2, "Ex.Shop", "to ann", None, "ann", "q one"), (3, 2, "cy", "to last", None, "", "")],
        "_ord long, level int, user string, text string, creator boolean, parentUser string, parentText string",
    ).withColumns({"content_id": F.lit("V"), "url": F.lit("u"), "userHref": F.lit(""), "likeLabel": F.lit("1.2K")})
    found = {r["text_original"]: r for r in connectors.tiktok_comments(rows, ["exshop"]).collect()}
    assert found["to ann"]["parent_comment_id"] == found["q one"]["comment_id"] and found["to ann"]["is_official"] == "true"
    assert found["to last"]["parent_comment_id"] == found["q two"]["comment_id"] and found["q one"]["parent_comment_id"] == ""


PANEL = "_ord long, level int, user string, userHref string, text string, creator boolean, parentUser string, parentText string"


def panel(spark, rows):
    return spark.createDataFrame(rows, PANEL).withColumns({"content_id": F.lit("V"), "url": F.lit("u"), "likeLabel": F.lit("")})


def test_tiktok_comment_ids_and_decoys(spark):
    """A reply of equal user and text is no parent; equal replies under different parents have ids of their own; a row
    without a level is a top-level comment; a blank user is known by its link."""
    rows = [
        (0, 1, "ann", "", "q", None, None, None), (1, 2, "bob", "", "q2", None, "ann", "q"), (2, None, "bob", "", "q2", None, "", ""), (3, 2, "shop", "", "thanks", None, "bob", "q2"),
        (4, 1, "cy", "", "q3", None, None, None), (5, 2, "shop", "", "thanks", None, "cy", "q3"), (6, 2, "", "/@dee", "me too", None, "ann", "q"), (7, 2, "eve", "", "late", None, "ann", "no such"), (8, 2, "x", "", " ", None, "ann", "q"),
    ]
    found = {r["_ord"]: r for r in connectors.tiktok_comments(panel(spark, rows), []).collect()}
    assert sorted(found) == list(range(8)) and len({r["comment_id"] for r in found.values()}) == 8
    assert [found[k]["parent_comment_id"] for k in (0, 2, 4)] == ["", "", ""]
    assert found[3]["parent_comment_id"] == found[2]["comment_id"] != found[1]["comment_id"]
    assert found[5]["parent_comment_id"] == found[7]["parent_comment_id"] == found[4]["comment_id"]
    assert found[6]["commenter"] == "dee" and found[6]["parent_comment_id"] == found[0]["comment_id"]
    from tallyfold.functions import text

    want = spark.range(1).select(text.comment_hash(F.lit("V"), F.lit(found[2]["comment_id"]), F.lit("shop"), F.lit("thanks"))).first()[0]
    assert found[3]["comment_id"] == want


def test_owners_and_accounts(spark):
    rows = [(0, 1, "Example.Company", "", "a", None, None, None), (1, 1, "", "/@my_shop", "b", None, None, None), (2, 1, "ann", "", "c", True, None, None), (3, 1, "ann", "", "d", None, None, None)]
    accounts = spark.createDataFrame([("My.Shop",), ("my shop",), ("",)], "account string")
    found = {r["_ord"]: r["is_official"] for r in connectors.tiktok_comments(panel(spark, rows), ["@Example.Company"], accounts).collect()}
    assert found == {0: "true", 1: "true", 2: "true", 3: "false"}


def test_windows_are_read_each_for_itself(spark):
    rows = panel(spark, [(0, 1, "ann", "", "q", None, None, None), (1, 2, "bob", "", "r", None, "", "")]).withColumn("file", F.concat(F.lit("w"), "_ord"))
    assert {r["parent_comment_id"] for r in connectors.tiktok_comments(rows, []).collect()} == {""}


def test_panel_metrics_are_the_last_windows(spark):
    rows = [("V", "w1", ("10", "", "7")), ("V", "w2", ("9", "1.5K", ""))]
    heads = spark.createDataFrame(rows, "record_id string, file string, metrics struct<likes:string,comments:string,shares:string>")
    (row,) = connectors.panel_metrics(heads).collect()
    assert (row["likes"], row["comments_count"], row["shares"]) == ("9", "1500", "")


def test_posts_asked_for(spark):
    import pytest

    from tallyfold.sources.bundle import EvidenceError

    rows = [("TT-1", "TikTok", "https://www.tiktok.com/@a/video/1", "9", 0), ("TT-2", "tiktok", "https://www.tiktok.com/@a/video/2", "1,200", 1), ("TT-3", "TikTok", "https://www.tiktok.com/@a/photo/3", "99K", 2)]
    content = spark.createDataFrame(rows, "record_id string, platform string, url string, views string, _ord long")
    assert [r["record_id"] for r in connectors.deep_reads(content, "tiktok", 1).collect()] == ["TT-2"]
    assert [r["record_id"] for r in connectors.deep_reads(content, "tiktok", 1, ["https://www.tiktok.com/@a/video/1/?x=2"]).collect()] == ["TT-1"]
    with pytest.raises(EvidenceError, match="video/7"):
        connectors.deep_reads(content, "tiktok", 1, ["https://www.tiktok.com/@a/video/7"])


def test_how_a_capture_ended(spark, tmp_path):

    def ended(windows, max_scrolls=None):
        folder = tmp_path / f"l{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        for k, (items, y, more) in enumerate(windows):
            (folder / f"{k}.json").write_text(json.dumps({"title": "t", "scrollY": y, "scrollHeight": 9, "items": [{"url": u} for u in items], **more}))
        heads = collect.window_heads(spark, str(folder))
        items = read_windows(spark, str(folder), *collect.WINDOWS["tiktok"])
        return collect.capture_status(heads, collect.quiet_windows(heads, items, "url", 2), max_scrolls)

    assert ended([(["a"], 0, {}), (["b"], 1, {})]) == collect.COMPLETED
    assert ended([(["a"], 0, {}), (["b"], 1, {})], 1) == collect.SCROLLED and ended([(["a"], 0, {})], 0) == collect.SINGLE
    assert ended([(["a"], 0, {}), (["a"], 0, {}), (["a"], 0, {})], 9) == collect.STAGNANT
    assert ended([(["a"], 0, {}), (["a"], 0, {"challenge": True})]) == collect.CHALLENGED
    assert ended([(["a"], 0, {}), (["a"], 1, {"status": "interrupted_with_checkpoint"})]) == collect.INTERRUPTED
    assert (collect.exit_code(collect.INTERRUPTED, 3), collect.exit_code(collect.STAGNANT, 3), collect.exit_code(collect.COMPLETED, 0)) == (2, 0, 1)


def test_backfill(spark):
    content = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "id string, likes string, other string")
    new = spark.createDataFrame([("a", "45"), ("b", "")], "id string, likes string")
    assert {r["id"]: r["likes"] for r in joins.backfill(content, new, "id", ["likes"]).collect()} == {"a": "45", "b": "2"}


def test_legacy(spark, tmp_path):
    def write(name, header, rows):
        with (tmp_path / name).open("w", newline="", encoding="utf-8-sig") as f:
            out = csv.DictWriter(f, list(header), restval="")
            out.writeheader()
            out.writerows([{k: r.get(v, "") for k, v in header.items()} for r in rows])

    write("v.csv", LEGACY_VIDEOS, [{"vid": "1", "platform": "TikTok", "published": "2025-01-02", "url": "https://www.tiktok.com/@ex/video/1?x=1", "views": "10"}, {"vid": ""}])
    same = {"vid": "1", "url": "u", "commenter": "a", "text_original": "q", "is_official": "否"}
    write("c.csv", LEGACY_COMMENTS, [same, same])
    write("p.csv", LEGACY_CENSUS, [{"platform": "TikTok", "handle": "ex", "deep_dive": "是", "url": "https://www.tiktok.com/@ex"}])
    args = ["migrate-legacy-tiktok", "--company", "Ex", "--output", str(tmp_path / "out")]
    args += [x for n, f in (("videos", "v"), ("comments", "c"), ("census", "p")) for x in (f"--{n}", str(tmp_path / f"{f}.csv"))]
    assert cli.main(args, spark) == 0
    (row,) = csv.DictReader((tmp_path / "out/content.csv").open())
    assert row["record_id"] == "TT-1" and row["url"] == "https://www.tiktok.com/@ex/video/1"
    assert len(list(csv.DictReader((tmp_path / "out/comments.csv").open()))) == 1


def test_merge_stream(spark, tmp_path):
    landing, table = tmp_path / "landing", str(tmp_path / "table")
    landing.mkdir()
    schema = "id string, text_original string, views string, _ord long"

    def land(name, rows):
        (landing / name).write_text("\n".join(json.dumps(dict(zip(("id", "text_original", "views", "_ord"), r, strict=True))) for r in rows))
        ingest.merge_stream(ingest.stream_windows(spark, str(landing), schema), "id", table, str(tmp_path / "ck")).awaitTermination()

    land("1.json", [("a", "hi", "", 1)])
    land("2.json", [("a", "hi there", "5", 2), ("b", "x", "1", 3)])
    rows = {r["id"]: r for r in ingest.current(spark, table, "id").collect()}
    assert (rows["a"]["text_original"], rows["a"]["views"]) == ("hi there", "5") and len(rows) == 2
    land("3.json", [])
    assert ingest.current(spark, table, "id").count() == 2


def test_merge_stream_is_replayed_and_compacts(spark, tmp_path, monkeypatch):
    """Batches that are lost before the manifest, or between it and the clean-up, and come again give what one merge of all
    rows gives; what is written follows the batches, and old parts go."""
    landing, table = tmp_path / "landing", str(tmp_path / "table")
    landing.mkdir()
    schema, every, written = "id string, text_original string, views string, _ord long", [], []
    lose = {2: (ingest.sinks, "write_json"), 4: (ingest, "_clean")}

    def lost(*args):
        raise RuntimeError("lost")

    def run():
        ingest.merge_stream(ingest.stream_windows(spark, str(landing), schema), "id", table, str(tmp_path / "ck")).awaitTermination()

    for n in range(7):
        rows = [(f"k{n % 3}", "x" * ((n * 5) % 7), str(n) if n % 2 else "", n), (f"only{n}", "t", "", 100 + n)]
        rows += [(f"big{k}", "", "", 200 + k) for k in range(40)] if n == 0 else []
        every += rows
        (landing / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("id", "text_original", "views", "_ord"), r, strict=True))) for r in rows))
        if n in lose:
            with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
                m.setattr(*lose[n], lost)
                run()
        run()
        written.append(ingest._parts(spark, table, n)[-1][1])
        assert ingest._parts(spark, table, n)[0][0] == "part=000000000000"  # the large part is not written again
    want = dedup.merge_windows(spark.createDataFrame(every, schema), "id")
    got = ingest.current(spark, table, "id").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert max(written[1:]) <= 14 and len(ingest._manifests(spark, table)) == 2
    sizes = [size for _, size in ingest._parts(spark, table, 6)]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    kept = {name for k in (5, 6) for name, _ in ingest._parts(spark, table, k)}
    assert set(ingest.sinks.names_in(spark, table)) == kept | {"manifests"}


def test_stagnation_of_a_stream(spark, tmp_path):
    """Windows that land in any batches are told to be stagnant as they are when all are read at once."""
    shown = [(["a", "b"], 0), (["b", "c"], 1), (["c"], 1), (["c", "c"], 1), (["c"], 2), (["d"], 2), (["d"], 2), ([], 2), (["a"], 2)]
    landing, table = tmp_path / "landing", str(tmp_path / "table")
    landing.mkdir()
    windows = [{"site": s, "file": f"{n:03d}", "y": y, "h": 9, "keys": keys} for s in ("s", "t") for n, (keys, y) in enumerate(shown) if s == "s" or n % 2 == 0]
    for batch in ([w for w in windows if w["file"] < "002"], [w for w in windows if "002" <= w["file"] < "007"], [w for w in windows if w["file"] >= "007"]):
        (landing / f"{batch[0]['file']}.json").write_text("\n".join(map(json.dumps, reversed(batch))))
        stream = spark.readStream.schema("site string, file string, y long, h long, keys array<string>").json(str(landing))
        ingest.stagnant_stream(stream, "site", "keys", 2, str(tmp_path / "ck"), table).awaitTermination()
    for site in ("s", "t"):
        got = sorted((r["file"], r["seen"], r["quiet"], r["stopped"]) for r in spark.read.parquet(table).where(f"site = '{site}'").collect())
        mine = [w for w in windows if w["site"] == site]
        heads = spark.createDataFrame([(w["file"], w["y"], 9) for w in mine], "file string, scrollY long, scrollHeight long")
        items = spark.createDataFrame([(w["file"], k) for w in mine for k in w["keys"]], "file string, key string")
        assert got == sorted((r["file"], r["seen"], r["quiet"], r["stopped"]) for r in collect.quiet_windows(heads, items, "key", 2).collect())
        assert site == "t" or got[-1][3] is True
    names = {f.name for f in (tmp_path / "ck" / "state").rglob("*")}
    assert any(n.endswith(".zip") for n in names)  # RocksDB's


def test_collect_commands(spark, tmp_path):
    grid, talk = tmp_path / "grid", tmp_path / "talk"
    grid.mkdir()
    talk.mkdir()
    url = "https://www.tiktok.com/@ex/video/7416929728608701704"
    (grid / "1.json").write_text(json.dumps({"title": "t", "displayName": "Ex", "followersLabel": "7.6K", "items": [{"url": url, "viewsLabel": "1.2K"}]}))
    rows = [{"level": 1, "user": "ann", "text": "q", "likeLabel": "2"}, {"level": 2, "user": "ex", "text": "a", "creator": True, "parentUser": "ann", "parentText": "q"}]
    (talk / "1.json").write_text(json.dumps({"url": url, "metrics": {"likes": "45", "comments": "2", "shares": ""}, "rows": rows}))
    out, ws = str(tmp_path / "b"), str(tmp_path / "ws")
    assert cli.main(["init", "--workspace", ws, "--target", "Ex"], spark) == 0
    base = ["--company", "Ex", "--url", "@ex"]
    assert cli.main(["collect", "tiktok", "--landing", str(grid), "--output", out, *base, "--workspace", ws], spark) == 0
    (platform,) = csv.DictReader(open(f"{out}/platform_census.csv"))
    assert platform["followers"] == "7600" and platform["visible_items"] == "1"
    assert cli.main(["tiktok-comments", "--landing", str(talk), "--bundle", out], spark) == 0
    assert cli.main(["tiktok-comments", "--landing", str(talk), "--bundle", out], spark) == 0
    found = list(csv.DictReader(open(f"{out}/comments.csv")))
    assert len(found) == 2 and sorted(r["is_official"] for r in found) == ["false", "true"]
    (row,) = csv.DictReader(open(f"{out}/content.csv"))
    assert (row["views"], row["likes"], row["comments_count"], row["shares"]) == ("1200", "45", "2", "")
    assert json.load(open(f"{out}/run_manifest.json"))["counts"]["comments"] == 2
    (grid / "2.json").write_text(json.dumps({"title": "Captcha", "challenge": True, "items": []}))
    assert cli.main(["tiktok", "--landing", str(grid), "--output", str(tmp_path / "c"), *base, "--workspace", ws], spark) == 2
    assert cli.main(["tiktok", "--landing", str(grid), "--output", str(tmp_path / "d"), "--company", "Ex", "--url", "https://x.test/a"], spark) == 2
    assert cli.main(["analyze", "content", "--workspace", ws, "--target-language", "en"], spark) == 2  # the post has no text


def bundle_of(folder, rows):
    folder.mkdir()
    with (folder / "content.csv").open("w", newline="") as f:
        out = csv.DictWriter(f, ["record_id", "platform", "account", "channel_id", "url", "views", "likes", "comments_count", "shares"], restval="")
        out.writeheader()
        out.writerows(rows)
    (folder / "comments.csv").write_text(",".join(collect.COMMENT) + "\n")
    return str(folder)


def test_statuses_of_comment_panels(spark, tmp_path):
    """Each way in which a capture of comments ends, and its exit code; what was captured stays."""
    url = "https://www.tiktok.com/@ex/video/7416929728608701704"
    landing = tmp_path / "talk"
    landing.mkdir()
    out = bundle_of(tmp_path / "b", [{"record_id": "TT-7416929728608701704", "platform": "TikTok", "url": url, "views": "5"}])
    rows = [{"level": 1, "user": "ann", "text": "q", "likeLabel": "2"}]
    said = [({}, collect.COMPLETED, 0), ({"status": collect.INTERRUPTED}, collect.INTERRUPTED, 2), ({"status": collect.FAILED}, collect.FAILED, 2), ({"challenge": True}, collect.CHALLENGED, 2)]
    for extra, status, code in said:
        (landing / "1.json").write_text(json.dumps({"url": url, "rows": rows} | extra))
        got = collect.collect_comments(spark, "tiktok-comments", str(landing), out)
        assert got == {"status": status, "rows": 1, "exit_code": code}
        assert json.load(open(f"{out}/run_manifest.json"))["conversation_collection"]["status"] == status


def test_statuses_and_warnings_of_videos(spark, tmp_path):
    from pathlib import Path

    out = bundle_of(tmp_path / "b", [{"record_id": f"YT-v{k}", "platform": "YouTube", "url": f"https://www.youtube.com/watch?v=v{k}", "views": str(k)} for k in (1, 2, 3)])
    landing = tmp_path / "info"
    landing.mkdir()
    one = {"comments": [{"id": "c", "parent": "root", "author": "ann", "text": "q"}]}
    write = lambda k, value: Path(landing / f"v{k}.info.json").write_text(value if isinstance(value, str) else json.dumps({"id": f"v{k}"} | value))
    steps = [
        ((1, one), collect.COMPLETED, 0, []),
        ((2, one | {"warning": "slow\nsome replies are missing"}), collect.COMPLETED, 0, ["YT-v2: some replies are missing"]),
        ((3, {"error": "ERROR\nComments are turned off"}), collect.PARTIAL, 1, ["YT-v2: some replies are missing", "YT-v3: Comments are turned off"]),
        ((3, '{"id": "v3", "comm'), collect.PARTIAL, 1, ["YT-v2: some replies are missing", "YT-v3: not readable as JSON"]),
        ((9, {"error": "of a post that nobody asked for"}), collect.PARTIAL, 1, ["YT-v2: some replies are missing", "YT-v3: not readable as JSON"]),
        ((3, {"error": "Please verify you are human"}), collect.CHALLENGED, 2, ["YT-v2: some replies are missing", "YT-v3: Please verify you are human"]),
    ]
    for (k, value), status, code, warnings in steps:
        write(k, value)
        got = collect.collect_comments(spark, "youtube-comments", str(landing), out)
        assert (got["status"], got["exit_code"], got["rows"]) == (status, code, 1)
        assert json.load(open(f"{out}/run_manifest.json")).get("warnings", {}).get("youtube_comments", []) == warnings


def test_broken_lines_of_a_tab_are_warned_of(spark, tmp_path):
    for tab, lines in (("videos", ['{"id": "a", "title": "A"}', '{"id": "b", "ti', '{"title": "no id"}']), ("shorts", ['{"id": "c", "view_count": 3}'])):
        (tmp_path / "land" / tab).mkdir(parents=True)
        (tmp_path / "land" / tab / "1.json").write_text("\n".join(lines))
    got = collect.collect_profile(spark, "youtube", str(tmp_path / "land"), str(tmp_path / "out"), "Ex", "https://www.youtube.com/@ex", tabs="videos,shorts")
    manifest = json.load(open(tmp_path / "out" / "run_manifest.json"))
    assert got["rows"] == 2 and got["exit_code"] == 0
    assert manifest["warnings"] == {"videos": "1 lines could not be read in full"} and manifest["counts"]["by_tab"] == {"videos": 1, "shorts": 1}


def test_feeds_have_words_of_their_own(spark, tmp_path):
    (tmp_path / "land").mkdir()
    post = {"permalink": "https://www.facebook.com/Ex/posts/1", "text": "t", "publishedAt": "", "publishedLabel": "", "metricLabels": []}
    (tmp_path / "land" / "1.json").write_text(json.dumps({"title": "Ex", "articles": [post]}))
    got = collect.collect_profile(spark, "facebook", str(tmp_path / "land"), str(tmp_path / "out"), "Ex", "https://www.facebook.com/Ex", max_scrolls=0)
    assert got == {"status": "single_window_complete", "rows": 1, "exit_code": 0}
