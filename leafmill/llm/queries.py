"""The registered queries of the training-data operators, and their check SQL where SQL can express one."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import held_out, saved, table
from leafmill.llm.decontamination import decontaminate
from leafmill.llm.fingerprints import fingerprints
from leafmill.llm.html_text import extract_text
from leafmill.llm.language_id import identify, learn_profiles
from leafmill.llm.licences import license_scan, license_sql
from leafmill.llm.merkle import merkle_report, merkle_sql
from leafmill.llm.ngram_join import ngram_join
from leafmill.llm.pieces import encode_pieces
from leafmill.llm.prefix_trie import prefix_trie, trie_sql
from leafmill.llm.quality import learn_quality, score_quality
from leafmill.llm.token_counts import token_counts
from leafmill.llm.toxicity import learn_scorer, score_toxicity
from leafmill.llm.warc import read_archives, write_archives
from leafmill.session import configure

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 1


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digest(docs, public_tokenizers.path(PIECES))


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """One pass encodes every text and decodes its ids again: one Python worker a task, not two."""
    return encode_pieces(docs, model, SEED, DROPOUT, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and whole lines that are known licence texts or notices."""
    return license_scan(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every document."""
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a shingle Jaccard of 0.8 or more."""
    return ngram_join(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = learn_scorer(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, scorer, "score", "clauses").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses"
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "expected_grade", "tail_probability", "keep")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, which are stored, and read back from there."""
    return read_archives(saved(write_archives(table(spark, sf_dir, "pages")), "archives")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn_profiles(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaf, proof and tampering test of every document."""
    return merkle_report(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def configured(query):
    """The query on a session with the library's settings: the same before every query."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        return query(configure(spark), *args)

    return run


QUERIES = {
    f.__name__: configured(f)
    for f in (
        op1_decontamination,
        op2_sentencepiece,
        op3_licenses,
        op4_html_text,
        op5_token_counts,
        op6_ngram_join,
        op7_toxicity,
        op8_fingerprints,
        op9_quality,
        op10_warc,
        op11_language_id,
        op12_merkle_manifest,
        op13_prefix_trie,
    )
}

WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to,
       TRUE AS intact
FROM p LEFT JOIN f USING (payload_digest)
"""

CHECKS = {
    "op3_licenses": license_sql(),
    "op10_warc": WARC_SQL,
    "op12_merkle_manifest": merkle_sql(),
    "op13_prefix_trie": trie_sql(),
}
