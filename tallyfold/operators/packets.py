"""Label packets: what a person or model fills in, and how filled-in labels come back to a bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..schemas import ANALYTIC_CONTENT, ANALYZED_VOICE, COMMENT_PLAIN, CONTENT_LABELS, CONTENT_VERSION, VOICE_LABELS, VOICE_VERSION
from ..sources import sinks
from ..sources.bundle import EvidenceError, read_csv, read_manifest, require_columns
from . import classify, gates, joins, reports, stats, voice
from .diff import key_violations
from .ledger import now

# Per mode: folder, files (taxonomy, labels, manifest, task), key of the taxonomy's items, id, label columns, version.
MODES = {
    "content": ("analysis", ("taxonomy.json", "analysis_results.csv", "analysis_manifest.json", "analysis_task.md"), "categories", "record_id", CONTENT_LABELS, CONTENT_VERSION),
    "voice": ("voice", ("voice_taxonomy.json", "voice_results.csv", "voice_manifest.json", "voice_task.md"), "issues", "comment_id", VOICE_LABELS, VOICE_VERSION),
}

TASK = """# {title}

Rows to label: {rows}. Language of translations: {language}.

1. Read every row before naming {items}; let them come from the evidence, and say in `derivation_notes` how they did.
2. Fill `{taxonomy}`: per item an id (lower case), label, definition, inclusion and exclusion criteria, and up to three
   representative ids that carry its label.
3. Fill `{labels}`: one line per id, same columns, same order, no ids added or left out. Translate faithfully.
4. Confidence is high, medium or low; low needs notes{severity}.
5. Quote nothing that the evidence doesn't show. Blank metrics are unknown, not zero.
"""


def digest(spark: SparkSession, path: str) -> str:
    return sinks.sha256(spark, [path])


def templates(rows: DataFrame, mode: str) -> DataFrame:
    if mode == "content":
        kind = F.when(clean(F.col("content_type")) == "unclassified", "").otherwise(F.col("content_type"))
        values = {"record_id": F.col("record_id"), "text_translation": F.col("text_translation"), "content_type": kind}
    else:
        values = {"comment_id": clean(F.col("comment_id")), "text_translation": F.col("text_translation")}
    return rows.select(*[values.get(c, F.lit("")).alias(c) for c in MODES[mode][4]], "_ord")


def load_rows(spark: SparkSession, bundle: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """The rows to label and the whole table that they come from; broken tables are errors."""
    content = require_columns(read_csv(spark, f"{bundle}/content.csv"), ["record_id", "text_original", "content_type", "text_translation"], "content.csv", allow_empty=mode == "voice")
    if bad := key_violations(content, "record_id", "content").limit(10).collect():
        raise EvidenceError("; ".join(f"content.csv {r['id']}: {r['message']}" for r in bad))
    if mode == "content":
        if blank := content.where((clean(F.col("text_original")) == "")).select("record_id").limit(10).collect():
            raise EvidenceError(f"content.csv: no text in {', '.join(r[0] for r in blank)}")
        return content, content
    comments = require_columns(read_csv(spark, f"{bundle}/comments.csv"), COMMENT_PLAIN, "comments.csv", allow_empty=False)
    if bad := key_violations(comments, "comment_id", "comments").limit(10).collect():
        raise EvidenceError("; ".join(f"comments.csv {r['id']}: {r['message']}" for r in bad))
    rows = voice.customers(comments)
    if rows.isEmpty():
        raise EvidenceError("comments.csv: no customer rows")
    if not rows.where(clean(F.col("text_original")) == "").isEmpty():
        raise EvidenceError("comments.csv: customer rows without a text")
    return rows, comments


def prepare(spark: SparkSession, bundle: str, mode: str, language: str, force: bool = False) -> str:
    """Writes an empty packet beside the bundle; one that is there is kept unless ``force``."""
    folder, (taxonomy, labels, manifest, task), items, _, columns, version = MODES[mode]
    out = f"{bundle}/{folder}"
    rows, whole = load_rows(spark, bundle, mode)
    sinks.ensure_writable(spark, [f"{out}/{n}" for n in (taxonomy, labels, manifest, task)], force)
    sinks.make_dirs(spark, out)
    n = rows.count()
    sinks.write_json(spark, f"{out}/{taxonomy}", {"schema_version": version, "target_language": language, "derivation_notes": "", items: []})
    sinks.write_csv(templates(rows, mode), f"{out}/{labels}", columns, ["_ord"])
    source = "content.csv" if mode == "content" else "comments.csv"
    told = {
        "schema_version": version, "created_at": now(), "source_file": source, "source_sha256": digest(spark, f"{bundle}/{source}"), "source_rows": whole.count(),
        "target_language": language, "expected_outputs": [taxonomy, labels],
    }
    if mode == "voice":
        told |= {"research_mode": "customer_voice", "context_file": "content.csv", "context_sha256": digest(spark, f"{bundle}/content.csv"), "customer_rows": n}
    sinks.write_json(spark, f"{out}/{manifest}", told)
    more = ", and so does high or critical severity" if mode == "voice" else ""
    sinks.write_text(spark, f"{out}/{task}", TASK.format(title=f"Label {source}", rows=n, language=language, items=items, taxonomy=taxonomy, labels=labels, severity=more))
    return out


def label_with_model(spark: SparkSession, bundle: str, mode: str, language: str, make_client, force: bool = False) -> dict:
    """A packet prepared, labelled by a model and applied. Taxonomy batches come to the driver one at a time; rows are
    labelled on the executors."""
    out = prepare(spark, bundle, mode, language, force)
    _, (taxonomy_name, labels_name, *_), _, key, columns, _ = MODES[mode]
    rows, _ = load_rows(spark, bundle, mode)
    shown = [c for c in (key, "text_original", "text_translation", "platform", "topic", "content_type") if c in rows.columns]
    client = make_client()
    proposals, batch = [], []
    for row in rows.orderBy("_ord").select(*shown).toLocalIterator():
        batch.append(row.asDict())
        if len(batch) == classify.TAXONOMY_ROWS:
            proposals.append(client.chat_json(classify.SYSTEM, classify.taxonomy_prompt(mode, batch, language), classify.taxonomy_schema(mode)))
            batch = []
    if batch:
        proposals.append(client.chat_json(classify.SYSTEM, classify.taxonomy_prompt(mode, batch, language), classify.taxonomy_schema(mode)))
    items = classify.merge_taxonomies(client, mode, proposals, language)
    labelled = classify.classify_rows(rows.select(*shown, "_ord"), make_client, mode, items, language)
    sinks.write_csv(labelled, f"{out}/{labels_name}", columns, [key])  # written once: a model is asked once per row
    labels = read_csv(spark, f"{out}/{labels_name}")
    if bad := classify.answer_violations(labels, mode, {i["id"] for i in items}).limit(10).collect():
        raise classify.ModelError("; ".join(f"{r['id']}: {r['message']}" for r in bad))
    items = classify.with_representatives(items, labels, mode, rows)
    sinks.write_json(spark, f"{out}/{taxonomy_name}", classify.taxonomy_document(items, mode, language))
    return apply(spark, bundle, mode)


def validate(spark: SparkSession, bundle: str, mode: str) -> dict:
    folder, (taxonomy, labels, manifest, _), *_ = MODES[mode]
    rows, whole = load_rows(spark, bundle, mode)
    digests = {"source_sha256": digest(spark, f"{bundle}/{'content' if mode == 'content' else 'comments'}.csv")}
    if mode == "voice":
        digests["context_sha256"] = digest(spark, f"{bundle}/content.csv")
    own = f"{bundle}/{folder}"
    return gates.validate_labels(
        rows, read_csv(spark, f"{own}/{labels}"), read_manifest(spark, f"{own}/{manifest}"), read_manifest(spark, f"{own}/{taxonomy}"), digests, mode, whole.count()
    ) | digests | {"validated_at": now()}


def apply(spark: SparkSession, bundle: str, mode: str) -> dict:
    """Validates a filled packet and writes what comes of it; a failed one leaves its report and no dataset."""
    folder, (taxonomy_name, labels_name, *_), items, *_ = MODES[mode]
    out = f"{bundle}/{folder}"
    report = validate(spark, bundle, mode)
    sinks.write_json(spark, f"{out}/validation_report.json", report)
    if report["status"] != "passed":
        return {"report": report}
    labels = read_csv(spark, f"{out}/{labels_name}")
    content = read_csv(spark, f"{bundle}/content.csv")
    taxonomy = read_manifest(spark, f"{out}/{taxonomy_name}")
    manifest = read_manifest(spark, f"{bundle}/run_manifest.json") if sinks.exists(spark, f"{bundle}/run_manifest.json") else {}
    named = manifest.get("target") if isinstance(manifest.get("target"), dict) else {}
    target = str(named.get("company") or named.get("name") or named.get("brand") or bundle.rstrip("/").rsplit("/", 1)[-1])
    if mode == "voice":
        analyzed = voice.analyzed_voice(read_csv(spark, f"{bundle}/comments.csv"), labels)
        sinks.write_csv(analyzed, f"{out}/analyzed_voice.csv", ANALYZED_VOICE, ["_ord"])
        names = {str(i["id"]): str(i["label"]) for i in taxonomy[items]}
        summary = {"generated_at": now(), **voice.voice_summary(content, analyzed, names, target)}
        html = reports.voice_report(summary, [r.asDict() for r in voice.top_signals(analyzed).collect()])
    else:
        merged = joins.merge_labels(content, labels)
        extra = [c for c in CONTENT_LABELS if c not in content.columns]
        columns = [c for c in content.columns if c != "_ord"] + extra
        sinks.write_csv(merged, f"{out}/analyzed_content.csv", columns, ["_ord"])
        census = read_csv(spark, f"{bundle}/platform_census.csv")
        require_columns(merged, ANALYTIC_CONTENT, "analyzed_content.csv")
        summary = {"generated_at": now(), "dataset": target, **stats.analyze(census, merged, read_csv(spark, f"{bundle}/comments.csv"))}
        html = reports.baseline_report(summary)
    sinks.write_json(spark, f"{out}/summary.json", summary)
    sinks.write_text(spark, f"{out}/report.html", html)
    return {"report": report, "summary": summary}
