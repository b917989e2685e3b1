"""Commands over workspaces and bundles. Exit codes: 0 done, 1 failed validation, 2 bad input."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .operators import classify, collect, connectors, diff, packets, reports, stats
from .operators.ledger import Ledger, now
from .schemas import COMMENT_PLAIN
from .sources import sinks
from .sources.bundle import LEGACY_CENSUS, LEGACY_COMMENTS, LEGACY_VIDEOS, EvidenceError, read_csv, read_legacy

ALIASES = {"discover": "init", "refresh": "ingest", "snapshot": "export", "prepare-voice": "prepare-analysis", "apply-voice": "apply-analysis"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyfold", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *aliases: str, workspace: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, aliases=list(aliases))
        if workspace:
            p.add_argument("--workspace", required=True)
        return p

    init = add("init", "discover", workspace=True)
    init.add_argument("--target", required=True)
    for name in ("market", "mode", "purpose", "owner"):
        init.add_argument(f"--{name}", default="")
    ingest = add("ingest", "refresh", workspace=True)
    ingest.add_argument("--bundle", required=True)
    for name in ("label", "scope-key", "observed-at"):
        ingest.add_argument(f"--{name}")
    ingest.add_argument("--no-export", action="store_true")
    add("diff", workspace=True).add_argument("--run")
    add("export", "snapshot", workspace=True).add_argument("--output")
    add("validate", workspace=True)
    history = add("history", workspace=True)
    history.add_argument("--type", choices=["platform", "content", "comment"], required=True)
    history.add_argument("--id", required=True)
    merge = add("merge")
    for name in ("base", "incoming", "output", "report"):
        merge.add_argument(f"--{name}", required=True)
    merge.add_argument("--key", default="record_id")
    merge.add_argument("--ignore", action="append")
    demo = add("demo")
    demo.add_argument("--input", required=True)
    demo.add_argument("--output", required=True)
    for name, mode in (("prepare-analysis", "content"), ("prepare-voice", "voice")):
        p = add(name)
        p.add_argument("--bundle", required=True)
        p.add_argument("--target-language", required=True)
        p.add_argument("--force", action="store_true")
        p.set_defaults(packet=mode)
    for name, mode in (("apply-analysis", "content"), ("apply-voice", "voice")):
        p = add(name)
        p.add_argument("--bundle", required=True)
        p.set_defaults(packet=mode)
    for site in ("tiktok", "facebook", "linkedin", "youtube"):
        p = add(site)
        for name in ("landing", "output", "company", "url"):
            p.add_argument(f"--{name}", required=True)
        p.add_argument("--limit", type=int, default=0)
        p.add_argument("--max-scrolls", type=int)
        for name in ("since", "workspace", "ingest-label"):
            p.add_argument(f"--{name}")
        p.add_argument("--tabs", default="")
    for site in ("tiktok-comments", "youtube-comments"):
        p = add(site)
        for name in ("landing", "bundle"):
            p.add_argument(f"--{name}", required=True)
        p.add_argument("--owner", action="append", default=[])
        p.add_argument("--top", type=int, default=30)
        p.add_argument("--video", action="append", default=[], help="a post's URL, in place of the most viewed posts")
        p.add_argument("--resume", action="store_true", help="keep the comments that the bundle has")
        for name in ("workspace", "ingest-label"):
            p.add_argument(f"--{name}")
    analyze = add("analyze")
    analyze.add_argument("mode", choices=["content", "customer-voice"])
    place = analyze.add_mutually_exclusive_group(required=True)
    place.add_argument("--workspace")
    place.add_argument("--bundle")
    analyze.add_argument("--target-language", required=True)
    analyze.add_argument("--force", action="store_true")
    local = add("local-analysis")
    local.add_argument("--bundle", required=True)
    local.add_argument("--mode", choices=["content", "customer-voice"], required=True)
    local.add_argument("--target-language", default="English")
    local.add_argument("--host", default="http://127.0.0.1:11434/api/chat")
    local.add_argument("--model")
    local.add_argument("--force", action="store_true")
    legacy = add("migrate-legacy-tiktok")
    for name in ("videos", "comments", "census", "output", "company"):
        legacy.add_argument(f"--{name}", required=True)
    legacy.add_argument("--language", default="my")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] == ["collect"]:  # collect <site> is the site's command, with --workspace to ingest what it made
        argv = argv[1:]
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyfold").getOrCreate()
    try:
        return run(args, ALIASES.get(args.command, args.command), spark)
    except EvidenceError as e:
        print(e, file=sys.stderr)
        return 2


def show(value: object) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2))


def run(args: argparse.Namespace, command: str, spark: SparkSession) -> int:
    if command in ("init", "ingest", "diff", "export", "validate", "history"):
        ledger = Ledger(spark, args.workspace)
        if command == "init":
            show(ledger.init({k: getattr(args, k) for k in ("target", "market", "mode", "purpose", "owner")}))
        elif command == "ingest":
            report = ledger.ingest(args.bundle, args.label, args.observed_at, args.scope_key, not args.no_export)
            show({k: report[k] for k in ("run_id", "counts", "duplicate_import") if k in report})
        elif command == "diff":
            show(ledger.report(run_id=args.run))
        elif command == "export":
            show(ledger.export(args.output or ledger.at("current"))["counts"])
        elif command == "validate":
            report = ledger.validate()
            show(report)
            return 0 if report["valid"] else 1
        else:
            show([{**r.asDict(), "row": dict(r["row"])} for r in ledger.history(args.type, args.id).collect()])
        return 0
    if command == "merge":
        sinks.not_inputs([args.base, args.incoming], [args.output, args.report])
        base, incoming = read_csv(spark, args.base), read_csv(spark, args.incoming)
        for df, name in ((base, args.base), (incoming, args.incoming)):
            if bad := diff.key_violations(df, args.key, name).limit(10).collect():
                raise EvidenceError("; ".join(f"{name} {r['rule']} {r['id']}" for r in bad))
        ignored = args.ignore if args.ignore is not None else ["collected_at"] if "collected_at" in base.columns else []
        merged = diff.keyed_merge(base, incoming, args.key, ignored)
        sinks.write_csv(merged, args.output, [c for c in base.columns if c != "_ord"], ["_ord"])
        report = diff.merge_report(merged, args.key)
        sinks.write_json(spark, args.report, report)
        show(report["counts"])
        return 0
    if command == "demo":
        tables = [read_csv(spark, f"{args.input}/{n}.csv") for n in ("platform_census", "content", "comments")]
        summary = {"generated_at": now(), "dataset": args.input, **stats.analyze(*tables)}
        sinks.make_dirs(spark, args.output)
        sinks.write_json(spark, f"{args.output}/summary.json", summary)
        sinks.write_text(spark, f"{args.output}/report.html", reports.baseline_report(summary))
        return 0
    if command == "prepare-analysis":
        print(packets.prepare(spark, args.bundle, args.packet, args.target_language, args.force))
        return 0
    if command == "apply-analysis":
        done = packets.apply(spark, args.bundle, args.packet)
        show(done["report"])
        return 0 if done["report"]["status"] == "passed" else 1
    if command == "analyze":
        bundle = args.bundle or f"{args.workspace.rstrip('/')}/current"
        print(packets.prepare(spark, bundle, "content" if args.mode == "content" else "voice", args.target_language, args.force))
        return 0
    if command == "local-analysis":
        model = classify.choose_model(args.model, os.environ.get("TALLYFOLD_MODEL"), [], "local")
        host = args.host
        done = packets.label_with_model(spark, args.bundle, "content" if args.mode == "content" else "voice", args.target_language, lambda: classify.LocalChat(host, model), args.force)
        show(done["report"])
        return 0 if done["report"]["status"] == "passed" else 1
    if command in ("tiktok", "facebook", "linkedin", "youtube"):
        made, bundle = collect.collect_profile(spark, command, args.landing, args.output, args.company, args.url, args.limit, args.since, args.tabs, args.max_scrolls), args.output
    elif command in ("tiktok-comments", "youtube-comments"):
        made, bundle = collect.collect_comments(spark, command, args.landing, args.bundle, args.owner, args.top, args.video, args.resume), args.bundle
    else:
        return migrate(args, spark)
    show(made)
    if args.workspace and made["exit_code"] == 0:
        show(Ledger(spark, args.workspace).ingest(bundle, args.ingest_label)["counts"])
    return made["exit_code"]


def migrate(args: argparse.Namespace, spark: SparkSession) -> int:
    from pyspark.sql import functions as F

    content = connectors.legacy_content(read_legacy(spark, args.videos, LEGACY_VIDEOS), args.company, args.language, now())
    comments = connectors.legacy_comments(read_legacy(spark, args.comments, LEGACY_COMMENTS)).select(*COMMENT_PLAIN, "_ord")
    census = read_legacy(spark, args.census, LEGACY_CENSUS)
    handle = census.where(F.col("deep_dive").isin("是", "yes")).select("handle", "url", "followers").first() or census.select("handle", "url", "followers").first()
    named = (handle["handle"], handle["url"], handle["followers"]) if handle else ("", "", "")
    platform = connectors.census_row(content, "TikTok", *named)
    manifest = {"schema_version": "1.0", "target": {"company": args.company}, "input_url": named[1], "collected_at": now(), "status": "completed_legacy_import", "counts": {"content": content.count(), "comments": comments.count()}}
    connectors.write_bundle(args.output, content, comments, platform, manifest)
    return 0


if __name__ == "__main__":
    sys.exit(main())
