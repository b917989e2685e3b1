"""Language by rank order: a document's most frequent letter n-grams against each language's, by out-of-place distance.

Grams are one to three letters long; a word's edges count as a blank, and no gram crosses a word. A profile is the
``profile`` most frequent grams of a language's training texts in order. A document's distance to a language is the sum,
over its own most frequent grams, of the difference in rank, or ``profile`` for a gram that the language's profile
lacks; ties in frequency go by code. ``score`` is one minus the distance's share of its greatest value.

Scale: training counts come from a bounded sample (``train_docs`` texts a language, drawn by a hash of the row) as
partial counts per task; only the languages' sizes and profiles (``profile`` rows a language) reach the driver. No text is
shuffled: the sample is a filter of the scan, and prediction one map over it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, bucket_of, columns

PROFILE = 400
TRAIN_DOCS = 1500
BITS = 21  # of a code point


def letter_table() -> np.ndarray:
    import sys

    held = sys.__dict__.setdefault("_tallyfold_letters", {})
    if "table" not in held:
        held["table"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return held["table"]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a text as packed codes, ascending, and their counts."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    cp = np.where(letter_table()[cp], cp, 0).astype(np.uint64)
    cp = np.concatenate([np.zeros(1, np.uint64), cp, np.zeros(1, np.uint64)])
    blank = cp == 0
    cp = cp[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(cp) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shift = np.uint64(BITS)
    two = (cp[:-1] << shift) | cp[1:]
    three = ((two[:-1] << shift) | cp[2:])[cp[1:-1] != 0]
    return np.unique(np.concatenate([cp[cp != 0], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, profile: int) -> np.ndarray:
    return codes[np.lexsort((codes, -counts))[:profile]]


def _count_task(batches):
    total: dict[str, dict[int, int]] = {}
    for batch in batches:
        for text, lang in columns(batch, "text", "lang"):
            codes, counts = gram_counts(text)
            mine = total.setdefault(lang, {})
            for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                mine[c] = mine.get(c, 0) + n
    for lang, mine in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(mine)), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], ["lang", "gram", "n"]
        )


def sample_counts(rows: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame | None:
    """lang, gram, n by task, from a sample of about ``train_docs`` texts a language, or all where it has no more; None where
    there is nothing to learn from."""
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().collect()  # a number for each language, as there is a profile for each
    if not sizes:
        return None
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, train_docs / r["count"])))])
    drawn = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003
    return rows.where(drawn).select("text", "lang").mapInArrow(_count_task, "lang string, gram long, n long")


def train_profiles(rows: DataFrame, train_docs: int = TRAIN_DOCS, profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from rows (doc_id, text, lang): at most about ``train_docs`` texts a language; null texts and langs are
    left out, and an empty table gives none. The driver gets ``profile`` grams of each language."""
    counts = sample_counts(rows, train_docs)
    if counts is None:
        return {}
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= profile)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranker:
    def __init__(self, profiles: dict[str, list[int]], profile: int):
        self.langs = sorted(profiles)
        self.profile = profile
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), 2 * profile, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            mine = np.array(profiles[lang], dtype=np.uint64)
            self.ranks[np.searchsorted(self.codes, mine), k] = np.arange(len(mine))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and its score; ``und`` and 0 for a null text, one without a letter, or no profiles."""
        if text is None or not self.langs:
            return "und", 0.0
        codes, counts = gram_counts(text)
        if not len(codes):
            return "und", 0.0
        mine = ranked(codes, counts, self.profile)
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != mine] = len(self.codes)
        far = np.minimum(np.abs(self.ranks[at] - np.arange(len(mine))[:, None]), self.profile).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (self.profile * len(mine))


def add_language(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out: tuple[int, int] = (5, 0),
    train_docs: int = TRAIN_DOCS,
    profile: int = PROFILE,
    added: tuple[str, str] = ("_lang_pred", "_lang_score"),
) -> DataFrame:
    """The input's rows with the columns ``added`` behind all of theirs; see ``language_id``. The names must be free."""
    known = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    profiles = train_profiles(known.where(bucket_of("doc_id", held_out[0]) != held_out[1]), train_docs, profile)

    def make():
        ranker = Ranker(profiles, profile)

        def predict(batch):
            got = [ranker.predict(t) for t in batch.column(text_col).to_pylist()]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

        return predict

    return append_columns(df, f"`{added[0]}` string, `{added[1]}` double", make)


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (5, 0), **settings) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32(id) mod held_out[0] is not held_out[1]. Null or letterless texts are ``und`` with score
    0, as is everything where there is nothing to learn from; equal distances go to the first language by name.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    told = add_language(rows, "doc_id", "text", "lang", held_out, **settings)
    out = bucket_of("doc_id", held_out[0]) == held_out[1]
    return told.select("doc_id", out.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))
