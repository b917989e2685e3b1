"""The registered queries opN_<name> over the tables in a folder, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .bpe import bpe_round_trip
from .dac import token_ids_round_trip
from .exact_dedup import exact_dedup
from .langid import language_id
from .line_dedup import LG_K, MIN_SITES, line_dedup
from .lm import score_texts
from .media import audio_features, stored_media
from .ngram_join import ngram_join
from .packing import pack_documents
from .quality import quality_score
from .search import ranked_search
from .token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents"), min_sites=MIN_SITES, lg_k=LG_K)
    return cleaned.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_kept").alias("kept"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"),
    )


OP2_SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, pos, trim(line, ' ') AS line, line AS raw
  FROM (SELECT doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos)
), spread AS (
  SELECT line, count(DISTINCT source) AS sites, min(doc_id * 1000000 + pos) AS first
  FROM lines WHERE regexp_matches(line, '\S\s+\S+\s+\S') GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.doc_id, l.pos, l.raw, s.line IS NOT NULL AND l.doc_id * 1000000 + l.pos <> s.first AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line
), clean AS (
  SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_removed,
         coalesce(string_agg(CASE WHEN gone THEN NULL ELSE raw END, chr(10) ORDER BY pos), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, n_removed = 0 OR regexp_matches(text, '\S') AS kept, sha256(text) AS clean_sha256 FROM clean
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids_round_trip(table(spark, sf_dir, "documents"))


def op5_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(stored_media(table(spark, sf_dir, "documents")))


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM n
"""


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), words AS (SELECT doc_id, unnest(terms) AS term FROM docs
), size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size
), posting AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weighed AS (
  SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM posting, total WHERE term IN (SELECT term FROM asked) GROUP BY term
), scored AS (
  SELECT item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked a JOIN weighed USING (term) JOIN posting p USING (term) JOIN size s ON s.doc_id = p.doc_id, total
  GROUP BY item_id, p.doc_id
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_ids": op4_token_ids,
    "op5_bm25_packing": op5_bm25_packing,
    "op6_audio_features": op6_audio_features,
    "op7_content_sort": op7_content_sort,
    "op8_bpe_automaton": op8_bpe_automaton,
    "op9_language_id": op9_language_id,
    "op10_ngram_join": op10_ngram_join,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_counts": op12_token_counts,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op7_content_sort": OP7_SQL, "op11_ranked_search": OP11_SQL}
