"""Readers of the corpus tables.  Every reader is a plain columnar scan; callers prune columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import col, url_path

# --- fixed values: source routing ---
MAX_INPUT_BYTES = 32 * 1024 * 1024
LINES_PER_PAGE = 40
DEFAULT_PAGE_TITLE = "Remote PDF"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than the session has cores.

    Text work is heavy per row, and a small file is one task.  A corpus of many files has more
    partitions than cores already and is left as it is, without an exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file; the file name is the source label."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")
    )


def title_from_url(url) -> Column:
    """Decoded last path segment, or the default title when the path ends in '/'."""
    last = F.regexp_extract(url_path(url), r"([^/]*)$", 1)
    return F.when(F.trim(last) != "", F.coalesce(F.try_url_decode(last), last)).otherwise(
        F.lit(DEFAULT_PAGE_TITLE)
    )


def document_kind(label) -> Column:
    """PDF for device content, files and .pdf labels; WEB otherwise."""
    label = col(label)
    return F.when(
        label.rlike("^(?:content|file)://") | F.lower(label).endswith(".pdf"), "PDF"
    ).otherwise("WEB")


def session_is_pdf(label) -> Column:
    """The wider rule of capture sessions: any letter case, and a '/pdf/' folder counts."""
    return F.lower(F.trim(col(label))).rlike(r"^(?:content|file)://|\.pdf$|/pdf/")


def split_oversize(
    df: DataFrame, body: str, limit: int = MAX_INPUT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by the size of the raw input in bytes."""
    size = F.octet_length(F.col(body))
    return df.filter(size <= limit), df.filter(size > limit)


def binary_inputs(spark: SparkSession, path: str, limit: int = MAX_INPUT_BYTES) -> DataFrame:
    """File listing with the size gate; ``length`` prunes before any content is read."""
    return (
        spark.read.format("binaryFile")
        .load(path)
        .filter(F.col("length") <= limit)
        .select("path", "modificationTime", "length", "content")
    )


def page_lines(docs: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """(doc_id, page, line, text): pages are runs of ``per_page`` lines; ``line`` counts inside the page."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select(
        "doc_id",
        F.floor(F.col("n") / per_page).cast("int").alias("page"),
        (F.col("n") % per_page).alias("line"),
        "text",
    )
