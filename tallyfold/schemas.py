"""Column lists (their order is part of the format), enumerated values and change kinds. Fixed values throughout."""

from __future__ import annotations

PLATFORM = ["platform", "handle", "url", "identity_status", "identity_evidence", "followers", "visible_items", "last_active_at", "deep_dive", "notes"]
CONTENT = [
    "record_id", "platform", "account", "published_at", "language", "text_original", "text_translation", "views", "likes",
    "comments_count", "shares", "url", "content_type", "brand", "collected_at", "retrieval_status",
]
COMMENT = [
    "comment_id", "content_id", "parent_comment_id", "commenter", "commenter_type", "is_official", "published_at",
    "text_original", "text_translation", "likes", "topic", "response_mode", "url",
]
COMMENT_PLAIN = [c for c in COMMENT if c != "published_at"]
ANALYTIC_CONTENT = CONTENT[:14]
VIDEO_EXTRAS = ["duration_seconds", "channel_id", "availability", "source_tab"]
LABEL_EXTRAS = ["published_label", "metric_labels"]
CONTENT_LABELS = ["record_id", "text_translation", "content_type", "classification_confidence", "classification_notes"]
VOICE_LABELS = ["comment_id", "text_translation", "issue_type", "signal_type", "sentiment", "severity", "analysis_confidence", "analysis_notes"]
ANALYZED_VOICE = [
    "comment_id", "content_id", "parent_comment_id", "commenter_alias", "commenter_type", "text_original", "text_translation", "likes",
    "issue_type", "signal_type", "sentiment", "severity", "analysis_confidence", "analysis_notes", "official_reply_count",
    "official_response_modes", "official_reply_ids", "url",
]
BUNDLE_FILES = ["platform_census.csv", "content.csv", "comments.csv", "run_manifest.json"]
ENTITIES = {"platform": ("platform_census.csv", None, PLATFORM), "content": ("content.csv", "record_id", CONTENT), "comment": ("comments.csv", "comment_id", COMMENT)}

CONFIDENCE = ["high", "medium", "low"]
SIGNALS = ["question", "complaint", "request", "praise", "experience", "other"]
SENTIMENTS = ["positive", "neutral", "negative", "mixed", "unclear"]
SEVERITIES = ["critical", "high", "medium", "low", "informational"]  # in order of rank
CHANGE_TYPES = ["new", "updated", "unchanged", "not_observed"]

LEDGER_KINDS = {
    "content": ["text_original", "text_translation", "content_type", "topic", "brand", "media_type"],
    "engagement": ["views", "likes", "comments_count", "shares", "followers", "visible_items"],
}
MERGE_KINDS = {
    "content": ["text_original", "text_translation", "content_type", "topic"],
    "engagement": ["views", "likes", "comments_count", "shares"],
}
IGNORED = ["collected_at"]
CONTENT_VERSION, VOICE_VERSION, LEDGER_VERSION, MERGE_VERSION = "0.3", "0.4", "1.0", "0.5"
