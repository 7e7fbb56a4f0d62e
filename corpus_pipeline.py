"""The corpus pipeline: toxicity, quality, near duplicates, decontamination, SentencePiece.

Every stage works on all that its predecessor kept.  ``run`` writes each result as Parquet to the shared folder of
the session and reads it again, so lineage is cut and lost executors cost one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import saved, table
from leafmill.llm.decontamination import decontaminate
from leafmill.llm.ngram_join import ngram_join
from leafmill.llm.pieces import encode_pieces
from leafmill.llm.quality import learn_quality, score_quality
from leafmill.llm.queries import DROPOUT, PIECES, SEED, configured
from leafmill.llm.toxicity import learn_scorer, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; null and empty texts have no toxic clause."""
    scorer = learn_scorer(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, scorer, "toxicity_").filter("toxicity_ < 0.5").drop("toxicity_")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).filter("keep").drop("expected_grade", "tail_probability", "keep")


def row_key(side: int = 0) -> Column:
    """A key of a row: 64-bit hash of id and text, since ids may be null or repeat.  Equal rows share it."""
    return F.xxhash64(*([F.lit(side)] if side else []), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, of these the smallest row key.

    A row without a doc_id stays only if no row of its group has one.  Different documents with one doc_id are documents
    of their own; rows of equal id and text are one, that with the smallest other columns as JSON.  Two rows are told apart by
    128 bits, so different documents whose first keys collide both stay.
    """
    key = unused(docs, "row_key")
    keyed = docs.withColumn(key, row_key())
    groups = ngram_join(keyed.select(F.col(key).alias("doc_id"), "text")).select(
        F.col("doc_id").alias("row_key"), F.col("component_id").alias("group")
    )
    ids = keyed.select(F.col(key).alias("row_key"), "doc_id").distinct()
    low = (
        groups.distinct()
        .join(ids, "row_key")
        .groupBy("group")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("first"))
        .select(F.col("first.row_key").alias(key))
    )
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    row = F.min_by(F.struct(*docs.columns), order).alias("row")
    kept = keyed.join(low, key, "left_semi").groupBy(key, row_key(1).alias("second_key")).agg(row)
    return kept.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text."""
    key = unused(docs, "row_key")
    keyed = docs.withColumn(key, row_key())
    texts = keyed.select(F.col(key).alias("doc_id"), "text")
    found = decontaminate(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(*docs.columns)


ENCODED = ("piece_ids", "n_pieces", "lossless")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: every document left with all its columns, its piece ids under merge-dropout, their number, and whether they
    decode to the text again (a null text is empty).  Columns of these names are replaced."""
    rows = docs.drop(*ENCODED)
    back = unused(rows, "decoded")
    coded = encode_pieces(rows, public_tokenizers.path(PIECES), SEED, DROPOUT, into="piece_ids", decoded=back)
    return coded.select(
        *rows.columns,
        "piece_ids",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        (F.col(back) == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


STAGES = [
    (stage.__name__, configured(stage))
    for stage in (toxicity, quality, near_duplicates, decontamination, sentencepiece)
]

# learned weights and seeded merges are not SQL: tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
