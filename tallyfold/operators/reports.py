"""HTML reports over small summaries, rendered on the driver; every value is escaped."""

from __future__ import annotations

from html import escape

STYLE = "body{font:16px/1.5 sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ccc;padding:.3rem .6rem;text-align:left;vertical-align:top}"


def _page(title: str, parts: list[str]) -> str:
    return f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{''.join(parts)}</body></html>\n"


def _table(head: list[str], rows: list[list[object]]) -> str:
    def line(cells: list[object], tag: str) -> str:
        return "<tr>" + "".join(f"<{tag}>{escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"

    return "<table>" + line(list(head), "th") + "".join(line(r, "td") for r in rows) + "</table>"


def shown(value: int, available: bool) -> str:
    return f"{value:,}" if available else "n/a"


def share(part: float, whole: float) -> str:
    return f"{part / whole * 100:.0f}%" if whole else "n/a"


def _bars(title: str, counts: dict, total: int) -> str:
    """Counts as a table whose last cell is a bar in proportion to the greatest."""
    most = max(counts.values(), default=0)
    rows = "".join(
        f"<tr><td>{escape(str(k))}</td><td>{v:,}</td><td>{share(v, total)}</td><td><div style='background:#47a;height:.7rem;width:{100 * v / most if most else 0:.0f}%'></div></td></tr>" for k, v in counts.items()
    )
    return f"<h2>{escape(title)}</h2><table><tr><th>value</th><th>count</th><th>share</th><th></th></tr>{rows}</table>" if counts else f"<h2>{escape(title)}</h2><p>None in this capture.</p>"


def _notes(title: str, lines: list[str]) -> str:
    return f"<h2>{escape(title)}</h2><ul>{''.join(f'<li>{escape(x)}</li>' for x in lines)}</ul>"


def baseline_report(s: dict) -> str:
    """What the capture holds: totals with their coverage, categories, platforms, topics, responses, the most viewed rows, and
    how the numbers are to be read."""
    facts = ["content_rows", "comment_rows", "user_comments", "official_replies", "census_channels", "deep_dive_channels", "total_views", "mean_views", "median_views"]
    known = f"{s['view_coverage']} of {s['content_rows']}"
    parts = [f"<p>Made {escape(str(s.get('generated_at', '')))}.</p>", _table(["measure", "value"], [[f.replace("_", " "), f"{s[f]:,}"] for f in facts] + [["views known", known]])]
    if s["unclassified_only"]:
        parts.append("<p><strong>No row has been classified yet: the categories below say nothing of the content.</strong></p>")
    rows = [[c["category"].replace("_", " ").title(), c["count"], share(c["share"], 1), c["mean_views"], c["median_views"], f"{c['view_coverage']} of {c['count']}", ", ".join(c["evidence_ids"])] for c in s["category_stats"]]
    parts += ["<h2>Categories</h2>", _table(["category", "rows", "share", "mean views", "median views", "views known", "evidence"], rows)]
    top = max(s["category_stats"], key=lambda c: c["mean_views"], default=None)
    if top:
        parts.append(f"<p>Most viewed on average: {escape(top['category'].replace('_', ' '))}, {top['mean_views']:,} views a row over {top['view_coverage']} rows with known views.</p>")
    totals = {"Platforms": (s["platforms"], s["content_rows"]), "Topics that customers raise": (s["topic_counts"], s["user_comments"]), "Official responses": (s["response_counts"], s["official_replies"])}
    parts += [_bars(title, counts, total) for title, (counts, total) in totals.items()]
    if s["top_topic"]:
        parts.append(f"<p>Raised most often: {escape(str(s['top_topic']))}, in {s['topic_counts'][s['top_topic']]} of {s['user_comments']} customer comments.</p>")
    seen = [[e["record_id"], e["platform"], e["published_at"], e["text"], shown(e["views"], e["views_available"]), shown(e["likes"], e["likes_available"]), shown(e["comments"], e["comments_available"]), e["url"]] for e in s["evidence"]]
    parts += ["<h2>Evidence</h2>", _table(["id", "platform", "published", "text", "views", "likes", "comments", "url"], seen)]
    notes = [
        f"Views are known for {known} rows; the others count in no mean and no median.",
        "n/a is a number that the site did not show. It is not zero.",
        "Categories go by mean views, evidence by views and then by the order of the rows.",
        "This describes what was captured, not reach, sales or what customers think in general.",
        "Every id stands for a row of the evidence tables, with its address and time of capture.",
    ]
    return _page(f"Evidence: {s.get('dataset', '')}", [*parts, _notes("How to read this", notes)])


def voice_report(s: dict, top: list[dict]) -> str:
    """What customers say: issues with their evidence, kinds of signals, how severe, what was answered, and when."""
    n = s["customer_signals"]
    facts = [["signals", n], ["high or critical", f"{s['high_or_critical']} ({share(s['high_or_critical'], n)})"], ["answered in public", f"{s['visible_response_count']} ({share(s['visible_response_count'], n)})"], ["useful answers", s["useful_response_count"]], ["without a visible answer", n - s["visible_response_count"]]]
    parts = [f"<p>Made {escape(str(s.get('generated_at', '')))}.</p>", _table(["measure", "value"], facts)]
    issues = [[s["issue_labels"].get(k, k), v, share(v, n), ", ".join(s["issue_evidence"].get(k, []))] for k, v in s["issue_counts"].items()]
    parts += ["<h2>Issues</h2>", _table(["issue", "signals", "share", "evidence"], issues)]
    if issues:
        parts.append(f"<p>Raised most often: {escape(str(issues[0][0]))}, in {issues[0][1]} of {n} signals.</p>")
    parts += [_bars(t, s[k], n) for t, k in (("Signals", "signal_type_counts"), ("Sentiment", "sentiment_counts"), ("Severity", "severity_counts"), ("Responses", "response_mode_counts"))]
    parts.append(_bars("Months of the posts they stand under", s["context_month_counts"], sum(s["context_month_counts"].values())))
    rows = [[r["comment_id"], r["severity"], s["issue_labels"].get(r["issue_type"], r["issue_type"]), r["signal_type"], r["text_translation"], r["likes"] or "n/a", r["official_response_modes"], r["official_reply_ids"], r["analysis_notes"], r["url"]] for r in top]
    parts += ["<h2>Evidence</h2>", _table(["id", "severity", "issue", "signal", "text", "likes", "responses", "replies", "notes", "url"], rows)]
    notes = [
        "One comment is one signal; an official account's own rows are not signals.",
        "Customers' names are replaced by aliases; the same name has the same alias.",
        "A visible answer is a reply of an official account that was captured. No answer here may be an answer elsewhere.",
        "Severity says what a comment reports, not how it is put; evidence goes by severity, then likes, then id.",
        "Months are those of the posts; a comment's own time is not always shown.",
        "These are comments that were visible, not a sample of all customers.",
    ]
    return _page(f"Customer voice: {s['target']}", [*parts, _notes("How to read this", notes)])
