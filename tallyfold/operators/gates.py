"""Fail-closed gates: violations as rows (rule, id, message), and reports that hold them.

Rules over rows are DataFrames; rules over the small documents (manifest, taxonomy) are plain checks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..schemas import CONFIDENCE, CONTENT_LABELS, CONTENT_VERSION, SENTIMENTS, SEVERITIES, SIGNALS, VOICE_LABELS, VOICE_VERSION
from .joins import missing_and_unknown, representatives, unused
from .stats import coverage, duplicates, key_counts

ID_SHAPE = re.compile(r"[a-z0-9][a-z0-9_-]*")
SHOWN = 20  # violations of a kind that a report lists


def violations(df: DataFrame, key: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """A row per broken rule of each row, in one pass: (rule, id, message)."""
    hits = F.filter(
        F.array(*[F.when(broken, F.struct(F.lit(rule).alias("rule"), clean(F.col(key)).alias("id"), F.lit(text).alias("message"))) for rule, broken, text in rules]),
        lambda x: x.isNotNull(),
    )
    return df.select(F.explode(hits).alias("v")).select("v.*")


def content_label_rules(ids: set[str]) -> list[tuple[str, Column, str]]:
    kind, sure = clean(F.col("content_type")), F.lower(clean(F.col("classification_confidence")))
    return [
        ("translation", clean(F.col("text_translation")) == "", "text_translation is required"),
        ("category", kind.isin("", "unclassified"), "content_type must be classified"),
        ("unknown_category", ~kind.isin("", "unclassified") & ~kind.isin(*ids), "content_type is not in the taxonomy"),
        ("confidence", ~sure.isin(*CONFIDENCE), "confidence must be high, medium or low"),
        ("notes", (sure == "low") & (clean(F.col("classification_notes")) == ""), "low confidence needs notes"),
    ]


def voice_label_rules(ids: set[str]) -> list[tuple[str, Column, str]]:
    issue, sure = clean(F.col("issue_type")), F.lower(clean(F.col("analysis_confidence")))
    severity, blank_notes = F.lower(clean(F.col("severity"))), clean(F.col("analysis_notes")) == ""
    return [
        ("translation", clean(F.col("text_translation")) == "", "text_translation is required"),
        ("issue", issue == "", "issue_type is required"),
        ("unknown_issue", (issue != "") & ~issue.isin(*ids), "issue_type is not in the taxonomy"),
        ("signal", ~F.lower(clean(F.col("signal_type"))).isin(*SIGNALS), "unknown signal_type"),
        ("sentiment", ~F.lower(clean(F.col("sentiment"))).isin(*SENTIMENTS), "unknown sentiment"),
        ("severity", ~severity.isin(*SEVERITIES), "unknown severity"),
        ("confidence", ~sure.isin(*CONFIDENCE), "confidence must be high, medium or low"),
        ("notes", (sure == "low") & blank_notes, "low confidence needs notes"),
        ("severity_notes", severity.isin("high", "critical") & blank_notes, "high or critical severity needs notes"),
    ]


def coverage_rules(source: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Missing, unknown and repeated ids of a label table."""
    missing, unknown = missing_and_unknown(source, labels, key)
    ids = labels.select(clean(F.col(key)).alias(key))
    own = source.select(clean(F.col(key)).alias(key))
    found = [(missing, "missing_id", "has no label"), (unknown, "unknown_id", "is not in the source"), (duplicates(ids, key), "duplicate_label", "has several labels"), (duplicates(own, key), "duplicate_source", "appears several times")]
    out = None
    for df, rule, text in found:
        part = df.select(F.lit(rule).alias("rule"), F.col(key).alias("id"), F.lit(text).alias("message"))
        out = part if out is None else out.unionByName(part)
    return out


def taxonomy_errors(taxonomy: object, version: str, items_name: str, reps: str) -> tuple[list[str], list[dict]]:
    if not isinstance(taxonomy, dict):
        return ["the taxonomy must be a JSON object"], []

    def said(x: object) -> bool:
        return isinstance(x, str) and bool(x.strip())

    errors = [] if taxonomy.get("schema_version") == version else [f"taxonomy schema_version must be {version}"]
    errors += [f"taxonomy {f} is required" for f in ("target_language", "derivation_notes") if not said(taxonomy.get(f))]
    items = taxonomy.get(items_name)
    if not isinstance(items, list) or not items:
        return [*errors, f"taxonomy {items_name} must not be empty"], []
    good = [i for i in items if isinstance(i, dict)]
    errors += ["taxonomy items must be objects"] * (len(good) < len(items))
    for n, item in enumerate(good, 1):
        if not ID_SHAPE.fullmatch(str(item.get("id", "")).strip()):
            errors.append(f"taxonomy item {n}: bad id")
        errors += [f"taxonomy item {n}: {f} is required" for f in ("label", "definition") if not said(item.get(f))]
        for f in ("inclusion_criteria", "exclusion_criteria", reps):
            v = item.get(f)
            if not isinstance(v, list) or not v or not all(map(said, v)):
                errors.append(f"taxonomy item {n}: {f} must be a list of texts")
    ids = [str(i.get("id", "")).strip() for i in good]
    errors += [f"taxonomy id {i} is repeated" for i in sorted({i for i in ids if ids.count(i) > 1})]
    return errors, good


def validate_labels(
    source: DataFrame, labels: DataFrame, manifest: dict, taxonomy: object, digests: dict[str, str], mode: str, all_rows: int | None = None
) -> dict:
    """The report of a label packet against its source: status failed with every error, or passed.

    ``mode``: content or voice (whose source is the customers' rows; ``all_rows`` counts the whole table). ``digests``:
    source_sha256 and, for voice, context_sha256 of the files now.
    """
    spark = source.sparkSession
    voice = mode == "voice"
    key, columns, version = ("comment_id", VOICE_LABELS, VOICE_VERSION) if voice else ("record_id", CONTENT_LABELS, CONTENT_VERSION)
    items_name, reps, label = ("issues", "representative_comment_ids", "issue_type") if voice else ("categories", "representative_record_ids", "content_type")
    errors: list[str] = []
    if [c for c in labels.columns if c != "_ord"] != columns:
        return {"schema_version": version, "status": "failed", "errors": ["label columns or their order changed"], "warnings": []}
    n_source, n_labels = source.count(), labels.count()
    if n_source != n_labels:
        errors.append(f"{n_labels} labels for {n_source} rows")
    if manifest.get("schema_version") != version:
        errors.append(f"manifest schema_version must be {version}")
    if voice and manifest.get("research_mode") != "customer_voice":
        errors.append("manifest research_mode must be customer_voice")
    errors += [f"{k}: the source changed after the packet was prepared" for k, v in digests.items() if manifest.get(k) != v]
    if manifest.get("source_rows") != (all_rows if voice else n_source):
        errors.append("manifest source_rows does not match")
    if voice and manifest.get("customer_rows") != n_source:
        errors.append("manifest customer_rows does not match")
    more, items = taxonomy_errors(taxonomy, version, items_name, reps)
    errors += more
    if isinstance(taxonomy, dict) and taxonomy.get("target_language") != manifest.get("target_language"):
        errors.append("taxonomy target_language does not match the manifest")
    ids = {str(i.get("id", "")).strip() for i in items}
    rows = violations(labels, key, voice_label_rules(ids) if voice else content_label_rules(ids)).unionByName(coverage_rules(source, labels, key))
    pairs = [(str(i.get("id", "")).strip(), str(r).strip()) for i in items for r in (i.get(reps) if isinstance(i.get(reps), list) else [])]
    named = spark.createDataFrame(pairs, "id string, rep string")
    strangers, elsewhere = representatives(named, labels, key, label)
    for df, rule, text in ((strangers, "unknown_representative", "is not in the source"), (elsewhere, "other_category", "is assigned to another category")):
        rows = rows.unionByName(df.select(F.lit(rule).alias("rule"), F.col("rep").alias("id"), F.lit(text).alias("message")))
    counts = {r["rule"]: r["count"] for r in rows.groupBy("rule").count().collect()}
    for r in sorted(counts):
        some = rows.where(F.col("rule") == r).orderBy("id").limit(SHOWN).collect()
        errors += [f"{x['id']}: {x['message']}" for x in some] + [f"{r}: {counts[r]} in all"] * (counts[r] > SHOWN)
    idle = [r["id"] for r in unused(spark.createDataFrame([(i,) for i in ids], "id string"), labels, label).orderBy("id").collect()]
    rated = F.when(clean(F.col(label)) == "unclassified", "").otherwise(F.col(label))
    over = F.lit(n_labels if voice else n_source)
    shares = labels.agg(coverage(labels, F.col("text_translation"), over).alias("t"), coverage(labels, rated, over).alias("c")).first()
    return {
        "schema_version": version,
        "status": "failed" if errors else "passed",
        "source_rows": n_source,
        "analysis_rows": n_labels,
        "translation_coverage": shares["t"],
        ("issue_coverage" if voice else "classification_coverage"): shares["c"],
        items_name: {r["k"]: r["count"] for r in key_counts(labels, clean(F.col(label)), "k").collect()},
        "errors": errors,
        "warnings": [f"unused: {', '.join(idle)}"] if idle else [],
    }
