"""Change detection: ledger diffs over maps of fields, and the keyed merge of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, filled
from ..schemas import IGNORED, LEDGER_KINDS, MERGE_KINDS
from ..sources.bundle import EvidenceError


def field_diff(before: Column, after: Column, ignored: list[str] = IGNORED) -> Column:
    """Fields that differ, as a map to (before, after); a missing field is blank."""
    empty = F.create_map().cast("map<string,string>")
    pairs = F.map_zip_with(
        F.coalesce(before, empty),
        F.coalesce(after, empty),
        lambda k, x, y: F.struct(F.coalesce(x, F.lit("")).alias("before"), F.coalesce(y, F.lit("")).alias("after")),
    )
    return F.map_filter(pairs, lambda k, v: (v["before"] != v["after"]) & ~k.isin(*ignored))


def changed_fields(diff: Column) -> Column:
    return F.array_sort(F.map_keys(diff))


def change_kinds(fields: Column, kinds: dict[str, list[str]] = LEDGER_KINDS, default: str = "none") -> Column:
    """content, engagement, metadata: the kinds that a list of changed fields touches, in this order."""
    known = [F.when(F.arrays_overlap(fields, F.array(*map(F.lit, names))), kind) for kind, names in kinds.items()]
    listed = F.array(*[F.lit(n) for names in kinds.values() for n in names])
    rest = F.when(F.size(F.array_except(fields, listed)) > 0, "metadata")
    found = F.filter(F.array(*known, rest), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def change_type(before: Column, diff: Column) -> Column:
    return F.when(before.isNull(), "new").when(F.size(F.map_keys(diff)) > 0, "updated").otherwise("unchanged")


def row_map(df: DataFrame, leave_out: tuple[str, ...] = ("_ord",)) -> Column:
    return F.create_map(*[x for c in df.columns if c not in leave_out for x in (F.lit(c), filled(F.col(f"`{c}`")))])


def latest(observations: DataFrame, keys: list[str], order: str = "run_sequence") -> DataFrame:
    from .dedup import last_wins

    return last_wins(observations, keys, order)


def observed_changes(incoming: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """Each incoming row (keys, row) against the latest earlier one (keys, row, ref): change_type, changed_fields,
    change_kinds, changes, previous."""
    before = prior.select(*keys, F.col("row").alias("_before"), F.col("ref").alias("previous"))
    joined = incoming.join(before, keys, "left").withColumn("changes", field_diff(F.col("_before"), F.col("row")))
    joined = joined.withColumn("change_type", change_type(F.col("_before"), F.col("changes")))
    fields = F.when(F.col("change_type") == "updated", changed_fields(F.col("changes"))).otherwise(F.array().cast("array<string>"))
    kinds = F.when(F.col("change_type") == "updated", change_kinds(fields)).otherwise(F.array().cast("array<string>"))
    changes = F.when(F.col("change_type") == "updated", F.col("changes"))
    return joined.withColumn("changed_fields", fields).withColumn("change_kinds", kinds).withColumn("changes", changes).drop("_before")


def not_observed(previous_run: DataFrame, incoming: DataFrame, keys: list[str], kind: str = "entity_type") -> DataFrame:
    """Rows of the previous run in the scope that are missing now, for kinds of which anything came in."""
    came = incoming.select(kind).distinct()
    return previous_run.join(F.broadcast(came), kind, "left_semi").join(incoming, keys, "left_anti")


def all_run_changes(observations: DataFrame, keys: list[str], order: str, row: str) -> DataFrame:
    """Change types of every observation of every run in one pass: each row against the one before it of its key."""
    before = F.lag(row).over(Window.partitionBy(*keys).orderBy(order))
    return (
        observations.withColumn("_before", before)
        .withColumn("changes", field_diff(F.col("_before"), F.col(row)))
        .withColumn("change_type", change_type(F.col("_before"), F.col("changes")))
        .withColumn("changed_fields", changed_fields(F.when(F.col("_before").isNotNull(), F.col("changes")).otherwise(F.create_map().cast("map<string,struct<before:string,after:string>>"))))
        .drop("_before")
    )


def keyed_merge(base: DataFrame, incoming: DataFrame, key: str, ignored: list[str] = IGNORED, order: str = "_ord") -> DataFrame:
    """Both tables as one: incoming rows replace base rows of their key, the others of base stay, new ones follow.

    Adds merge_class (new, updated, unchanged, absent_from_incoming), changed_fields, change_kinds and ``_ord`` of the
    output. Headers must be equal; an ignored field that neither has is an error.
    """
    names = [c for c in base.columns if c != order]
    if names != [c for c in incoming.columns if c != order]:
        raise EvidenceError("the tables have different headers")
    if unknown := sorted(set(ignored) - set(names)):
        raise EvidenceError(f"unknown fields to ignore: {', '.join(unknown)}")
    b = base.select(F.col(key), F.struct(*names).alias("b"), F.col(order).alias("b_ord"))
    i = incoming.select(F.col(key), F.struct(*names).alias("i"), F.col(order).alias("i_ord"))
    joined = b.join(i, key, "full_outer")
    differs = [F.when(filled(F.col(f"b.{c}")) != filled(F.col(f"i.{c}")), F.lit(c)) for c in names if c not in ignored]
    fields = F.filter(F.array(*differs), lambda x: x.isNotNull())
    has_b, has_i = F.col("b_ord").isNotNull(), F.col("i_ord").isNotNull()
    joined = joined.withColumn("changed_fields", F.when(has_b & has_i, fields).otherwise(F.array().cast("array<string>")))
    kind = F.when(~has_b, "new").when(~has_i, "absent_from_incoming").when(F.size("changed_fields") > 0, "updated").otherwise("unchanged")
    place = F.struct(F.when(has_b, 0).otherwise(1).alias("late"), F.coalesce("b_ord", "i_ord").alias("at"))
    return joined.select(
        *[F.coalesce(F.col(f"i.{c}"), F.col(f"b.{c}")).alias(c) for c in names],
        kind.alias("merge_class"),
        "changed_fields",
        F.when(F.size("changed_fields") > 0, change_kinds(F.col("changed_fields"), MERGE_KINDS, "unknown")).otherwise(F.array().cast("array<string>")).alias("change_kinds"),
        place.alias(order),
    )


def merge_report(merged: DataFrame, key: str) -> dict:
    """Counts by class and the updated records."""
    from ..schemas import MERGE_VERSION

    counts = {r["merge_class"]: r["count"] for r in merged.groupBy("merge_class").count().collect()}
    updated = merged.where("merge_class = 'updated'").orderBy("_ord").select(key, "changed_fields", "change_kinds").collect()
    return {
        "schema_version": MERGE_VERSION,
        "counts": {k: counts.get(k, 0) for k in ("new", "updated", "unchanged", "absent_from_incoming")},
        "updated_records": [{"id": r[key], "changed_fields": r["changed_fields"], "change_kinds": r["change_kinds"]} for r in updated],
    }


def key_violations(df: DataFrame, key: str, table: str) -> DataFrame:
    """Blank and repeated ids as (rule, entity, id, message)."""
    ids = df.select(clean(F.col(key)).alias("id"))
    blank = ids.where("id = ''").groupBy().count().where("count > 0").select(F.lit("blank_id").alias("rule"), F.lit(table).alias("entity"), F.lit("").alias("id"), F.concat(F.col("count").cast("string"), F.lit(" rows without an id")).alias("message"))
    twice = ids.where("id <> ''").groupBy("id").count().where("count > 1")
    return blank.unionByName(twice.select(F.lit("duplicate_id").alias("rule"), F.lit(table).alias("entity"), "id", F.concat(F.lit("appears "), F.col("count").cast("string"), F.lit(" times")).alias("message")))
