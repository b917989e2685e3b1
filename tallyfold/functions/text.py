"""Text, hash and identity expressions. Blank (``''``) means unavailable; nulls become blank at the edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode white space on either side (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    return strip(filled(c))


def clean_limited(c: Column, limit: int) -> Column:
    return F.substring(strip(F.replace(filled(c), F.lit("\u0000"), F.lit(" "))), 1, limit)


def present(c: Column) -> Column:
    return clean(c) != ""


def or_null(c: Column) -> Column:
    """Null in place of blank, for ``coalesce`` and aggregates."""
    return F.nullif(clean(c), F.lit(""))


def first_present(*cs: Column) -> Column:
    return F.coalesce(*map(or_null, cs), F.lit(""))


def slug(c: Column, default: str, joint: str = "-") -> Column:
    body = F.btrim(F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", joint), F.lit(joint))
    return F.when(body == "", F.lit(default)).otherwise(body)


def identity_name(c: Column) -> Column:
    """Lower-case ASCII letters and digits only: how handles are compared."""
    return F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", "")


def canonical_json(m: Column) -> Column:
    """A map as JSON with sorted keys and no spaces."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def sha256(c: Column, digits: int = 64) -> Column:
    return F.substring(F.sha2(filled(c), 256), 1, digits)


def platform_id(platform: Column, handle: Column, url: Column) -> Column:
    """Stable id of a platform row. Cases are folded by ``lower``: ids differ from casefold's for letters like ß."""
    parts = F.create_map(
        F.lit("handle"), F.lower(clean(handle)), F.lit("platform"), F.lower(clean(platform)), F.lit("url"), F.rtrim(F.lower(clean(url)), F.lit("/"))
    )
    return F.concat(F.lit("platform-"), sha256(canonical_json(parts), 20))


def pseudonym(c: Column) -> Column:
    return F.concat(F.lit("voice-"), sha256(clean(c), 10))


def comment_hash(content_id: Column, parent: Column, user: Column, text: Column) -> Column:
    return F.concat(F.lit("TTC-"), sha256(F.concat_ws("\n", filled(content_id), filled(parent), filled(user), filled(text)), 20))


def working_text(translation: Column, original: Column) -> Column:
    """The first line, to 180 characters, of the translation or else the original; blank where both are."""
    return F.substring(F.element_at(F.split(first_present(translation, original), r"\R"), 1), 1, 180)


# What an accessibility text puts before a caption, in the order they are tried.
CAPTION_MARKERS = ("创作的 ", " created by ", " posted by ")


def caption(c: Column, display_name: Column, handle: Column) -> Column:
    """The accessibility text behind its first known marker; blank where only the account's own name is left."""
    text = clean(c)
    cut = text
    for marker in reversed(CAPTION_MARKERS):
        at = F.instr(text, marker)
        cut = F.when(at > 0, F.substr(text, at + len(marker))).otherwise(cut)
    own = [filled(display_name), F.concat(F.lit("@"), filled(handle)), filled(handle)]
    is_own = own[0].isin("") & F.lit(False)
    for name in own:
        is_own = is_own | ((name != "") & (cut == name))
    return F.when(is_own, "").otherwise(strip(cut))


# Signs that a page asks for a person.
VERIFICATION_MARKERS = (
    "sign in to confirm you're not a bot",
    "sign in to confirm you’re not a bot",
    "captcha",
    "verify you are human",
    "verify you're human",
    "human verification",
)


def needs_person(c: Column, markers: Sequence[str] = VERIFICATION_MARKERS) -> Column:
    low = F.lower(filled(c))
    found = F.lit(False)
    for m in markers:
        found = found | low.contains(m)
    return found


def tagged_labels(*pairs: tuple[str, Column]) -> Column:
    """``tag:value`` joined by `` | `` for the values that are not blank."""
    kept = F.filter(F.array(*[F.when(clean(c) != "", F.concat(F.lit(tag), clean(c))) for tag, c in pairs]), lambda x: x.isNotNull())
    return F.array_join(kept, " | ")


def joined_labels(labels: Column) -> Column:
    return F.array_join(F.filter(F.transform(labels, clean), lambda x: x != ""), " | ")


def titled(c: Column) -> Column:
    return F.initcap(F.replace(filled(c), F.lit("_"), F.lit(" ")))


def html_escape(c: Column) -> Column:
    out = filled(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def truthy(c: Column) -> Column:
    """The one official-account predicate: true, 1, yes or 是, in any case, with white space around."""
    return F.lower(clean(c)).isin("true", "1", "yes", "是")


def valid_id(c: Column) -> Column:
    """Ids of categories and issues."""
    return F.rlike(filled(c), F.lit(r"^[a-z0-9][a-z0-9_-]*$"))
