"""A corpus pipeline over documents: language, quality, boilerplate lines, near-duplicates, packing.

Each stage takes the documents that the one before kept, as a written table, and all but the last return documents'
columns. No stage has SQL: learned models and the n-gram join can't be said in it; tests hold them to brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import free_names, kept_table
from tallyfold.llm.langid import add_language
from tallyfold.llm.line_dedup import line_dedup
from tallyfold.llm.ngram_join import without_near_copies
from tallyfold.llm.packing import pack_documents
from tallyfold.llm.quality import add_quality

MIN_LANGUAGE_SCORE = 0.3  # of one minus the out-of-place distance's share; texts in a learned language stand well above


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or near no language, go.

    Repeated rows each stay or go; ids may be null or repeat; an empty table stays empty. Without a learned language
    there is nothing to be near to, and all documents go.
    """
    pred, score = free_names(docs, "_lang_pred", "_lang_score")
    told = add_language(docs, added=(pred, score))
    return told.where((F.col(pred) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 0 (a score under 0.5) go; a score of 0.5 stays.

    A null text is scored as the empty text, which has the classifier's bias alone. Without labels every score is 0.5 and
    all documents stay. Repeated rows each stay or go; an empty table stays empty.
    """
    (score,) = free_names(docs, "_quality")
    told = add_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score_col=score)
    return told.where(F.col(score) >= 0.5).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; documents of which nothing is left go; n_chars follows the text.

    A null text stays null with a null n_chars; a text that had no word stays. Null and empty sources are one site.
    Repeated rows are one document to the sites and each stay or go. An empty table stays empty.
    """
    added = tuple(free_names(docs, "_n_lines", "_n_removed", "_kept"))
    told = line_dedup(docs, every_line=True, added=added).where(F.col(added[2]))
    return told.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates its least row (by id, then by a hash of the text) stays, once.

    Texts without a word, null ones too, are copies of each other. Ids may repeat with other texts; null ids come last.
    An empty table stays empty.
    """
    return without_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A null or empty text is its end id alone; repeated rows are packed each for itself; texts of any length are
    cut over sequences; an empty table gives no piece. Columns beside doc_id and text are not looked at.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
