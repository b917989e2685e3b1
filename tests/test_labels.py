import csv
import json
import sys

import pytest
from pyspark import cloudpickle

from tallyfold import cli
from tallyfold.operators import classify, packets
from tallyfold.schemas import ANALYTIC_CONTENT, COMMENT_PLAIN, PLATFORM
from tallyfold.sources.bundle import EvidenceError, read_csv, salvage_json


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def write(path, columns, rows):
    with path.open("w", newline="") as f:
        out = csv.DictWriter(f, columns, restval="")
        out.writeheader()
        out.writerows(rows)


@pytest.fixture
def bundle(tmp_path):
    views = ["4,400", "100", "", "300"]
    content = [
        {"record_id": f"R{k}", "platform": "x" if k < 2 else "y", "published_at": f"2026-0{k + 1}-03", "text_original": f"text {k}", "text_translation": f"say {k}", "views": v, "content_type": "unclassified" if k == 3 else "howto"}
        for k, v in enumerate(views)
    ]
    write(tmp_path / "content.csv", ANALYTIC_CONTENT, content)
    comments = [
        {"comment_id": "C1", "content_id": "R0", "commenter": "Ann", "is_official": "false", "text_original": "how much?", "likes": "1,200", "topic": "price"},
        {"comment_id": "C2", "content_id": "R1", "commenter": "Bob", "is_official": "false", "text_original": "broken", "topic": "fault"},
        {"comment_id": "C3", "content_id": "R1", "commenter": "Cy", "is_official": "false", "text_original": "price?", "topic": "price"},
        {"comment_id": "C4", "content_id": "R0", "parent_comment_id": "C1", "commenter": "Shop", "is_official": "yes", "text_original": "ten", "response_mode": "useful_answer"},
    ]
    write(tmp_path / "comments.csv", COMMENT_PLAIN, comments)
    write(tmp_path / "platform_census.csv", PLATFORM, [{"platform": "x", "deep_dive": "yes"}, {"platform": "y", "deep_dive": "no"}])
    (tmp_path / "run_manifest.json").write_text(json.dumps({"target": {"company": "Shop"}}))
    return tmp_path


def fill(folder, names, items, key, rows, columns, reps):
    taxonomy = json.loads((folder / names[0]).read_text())
    taxonomy |= {"derivation_notes": "read all", items: [{"id": i, "label": i.title(), "definition": "d", "inclusion_criteria": ["a"], "exclusion_criteria": ["b"], reps: r} for i, r in rows["taxonomy"].items()]}
    (folder / names[0]).write_text(json.dumps(taxonomy))
    write(folder / names[1], columns, rows["labels"])


def content_labels(**change):
    rows = [{"record_id": f"R{k}", "text_translation": "t", "content_type": "howto", "classification_confidence": "high"} for k in range(4)]
    rows[0] |= change
    return {"taxonomy": {"howto": ["R0"]}, "labels": rows}


def prepared(spark, bundle, mode):
    packets.prepare(spark, str(bundle), mode, "en")
    folder, names, items, key, columns, _ = packets.MODES[mode]
    return bundle / folder, names, items, key, columns


def test_content_packet(spark, bundle):
    raw = (bundle / "content.csv").read_bytes()
    folder, names, items, key, columns = prepared(spark, bundle, "content")
    assert [r["content_type"] for r in csv.DictReader((folder / names[1]).open())] == ["howto"] * 3 + [""]
    with pytest.raises(EvidenceError):
        packets.prepare(spark, str(bundle), "content", "en")
    fill(folder, names, items, key, content_labels(), columns, "representative_record_ids")
    assert cli.main(["apply-analysis", "--bundle", str(bundle)], spark) == 0
    assert (bundle / "content.csv").read_bytes() == raw
    summary = json.loads((folder / "summary.json").read_text())
    stat = summary["category_stats"][0]
    assert (stat["count"], stat["mean_views"], stat["median_views"], stat["view_coverage"], stat["evidence_ids"]) == (4, 1600, 300, 3, ["R0", "R3", "R1"])
    assert summary["topic_counts"] == {"price": 2, "fault": 1} and summary["deep_dive_channels"] == 1
    assert "R0" in (folder / "report.html").read_text()


@pytest.mark.parametrize(
    ("change", "said"),
    [({"record_id": "X"}, "X: is not in the source"), ({"classification_confidence": "low"}, "R0: low confidence needs notes"), ({"content_type": "other"}, "R0: content_type is not in the taxonomy"), ({"text_translation": " "}, "R0: text_translation is required")],
)
def test_broken_content_labels(spark, bundle, change, said):
    folder, names, items, key, columns = prepared(spark, bundle, "content")
    fill(folder, names, items, key, content_labels(**change), columns, "representative_record_ids")
    report = packets.validate(spark, str(bundle), "content")
    assert report["status"] == "failed" and said in report["errors"]


def test_stale_source(spark, bundle):
    folder, names, items, key, columns = prepared(spark, bundle, "content")
    fill(folder, names, items, key, content_labels(), columns, "representative_record_ids")
    with (bundle / "content.csv").open("a") as f:
        f.write("\n")
    assert cli.main(["apply-analysis", "--bundle", str(bundle)], spark) == 1
    assert not (folder / "summary.json").exists()


def test_voice_packet(spark, bundle):
    folder, names, items, key, columns = prepared(spark, bundle, "voice")
    labels = [
        {"comment_id": i, "text_translation": "t", "issue_type": t, "signal_type": "Question", "sentiment": "neutral", "severity": s, "analysis_confidence": "high", "analysis_notes": "n"}
        for i, t, s in (("C1", "price", "low"), ("C2", "fault", "critical"), ("C3", "price", "low"))
    ]
    fill(folder, names, items, key, {"taxonomy": {"price": ["C1"], "fault": ["C2"]}, "labels": labels}, columns, "representative_comment_ids")
    assert cli.main(["apply-voice", "--bundle", str(bundle)], spark) == 0
    rows = {r["comment_id"]: r for r in csv.DictReader((folder / "analyzed_voice.csv").open())}
    assert (rows["C1"]["official_reply_count"], rows["C1"]["official_response_modes"], rows["C1"]["official_reply_ids"]) == ("1", "useful_answer", "C4")
    assert rows["C2"]["official_reply_count"] == "0" and "Ann" not in (folder / "analyzed_voice.csv").read_text()
    summary = json.loads((folder / "summary.json").read_text())
    assert (summary["customer_signals"], summary["visible_response_count"], summary["useful_response_count"], summary["high_or_critical"]) == (3, 1, 1, 1)
    assert summary["issue_counts"] == {"price": 2, "fault": 1} and summary["context_month_counts"] == {"2026-01": 1, "2026-02": 2}
    assert (folder / "report.html").read_text().index("C2") > 0


class Fake:
    def __init__(self, wrong_once=False):
        self.wrong, self.calls = wrong_once, 0

    def chat_json(self, system, user, schema):
        self.calls += 1
        if "records" not in schema["properties"]:
            return {"categories": [{"id": "How To", "label": "How to"}, {"label": "How to"}]}
        rows = json.loads(user.split("\nRows: ")[1].split("\nYour")[0])
        found = [{"record_id": r["record_id"], "text_translation": "t", "content_type": "how_to", "classification_confidence": ".95", "classification_notes": ""} for r in rows]
        if self.wrong:
            self.wrong = False
            return {"records": found[1:]}
        return {"records": found}


def test_model_labels(spark, bundle):
    items = classify.merge_taxonomies(Fake(), "content", [{"categories": []}] * 8, "en")
    assert [i["id"] for i in items] == ["how_to", "how_to_2"] and items[0]["inclusion_criteria"]
    fake = Fake(wrong_once=True)
    rows = [{"record_id": "a"}, {"record_id": "b"}]
    got = classify.classify_batch(fake, "content", rows, items, "en")
    assert fake.calls == 2 and [r["record_id"] for r in got] == ["a", "b"]
    shaped = classify.answer_columns(spark.createDataFrame(got), "content").collect()
    assert [r["classification_confidence"] for r in shaped] == ["high", "high"]
    source = read_csv(spark, str(bundle / "content.csv"))
    labels = classify.classify_rows(source, Fake, "content", items, "en", rows=3)
    assert sorted(r["record_id"] for r in labels.collect()) == ["R0", "R1", "R2", "R3"]
    used = classify.with_representatives(items, labels, "content", source)
    assert [i["id"] for i in used] == ["how_to"] and used[0]["representative_record_ids"] == ["R0", "R1", "R2"]
    turned = source.withColumn("_ord", -source["_ord"])
    assert classify.with_representatives(items, labels, "content", turned)[0]["representative_record_ids"] == ["R3", "R2", "R1"]

    class Twice(Fake):
        def chat_json(self, system, user, schema):
            got = super().chat_json(system, user, schema)
            return {"records": [*got["records"], got["records"][0]]}

    with pytest.raises(classify.ModelError):
        classify.classify_batch(Twice(), "content", rows, items, "en")
    odd = labels.withColumn("content_type", classify.F.when(classify.F.col("record_id") == "R1", "elsewhere").otherwise(classify.F.col("content_type")))
    assert [(r["rule"], r["id"]) for r in classify.answer_violations(odd, "content", {"how_to"}).collect()] == [("unknown_category", "R1")]
    assert classify.distinct(["a", "a", "a_2", "a"]) == ["a", "a_2", "a_2_2", "a_3"]

    class Bad(Fake):
        def chat_json(self, system, user, schema):
            return {"records": []}

    with pytest.raises(classify.ModelError):
        classify.classify_batch(Bad(), "content", rows, items, "en")


def test_labelled_by_a_model(spark, bundle):
    done = packets.label_with_model(spark, str(bundle), "content", "en", Fake)
    assert done["report"]["status"] == "passed" and done["report"]["classification_coverage"] == 1
    assert done["summary"]["category_stats"][0]["category"] == "how_to"


def test_salvage():
    assert salvage_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert salvage_json('log line {"a": [1]} tail }') == {"a": [1]}
    with pytest.raises(EvidenceError):
        salvage_json("nothing")


def test_demo_command(spark, bundle, tmp_path):
    assert cli.main(["demo", "--input", str(bundle), "--output", str(tmp_path / "out")], spark) == 0
    assert "<table>" in (tmp_path / "out/report.html").read_text()
