"""Running a stream to completion into a table on the shared folder."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import checkpoint_root

# --- fixed values: schemas of the streamed tables ---
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)


FILES_PER_BATCH = 64


def _source(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType, files: int = FILES_PER_BATCH) -> DataFrame:
    """A table as a file stream: one file, or a folder of part files; the pattern names it alone, not its neighbours.

    ``files`` bounds a batch; no result depends on it, nor on the order in which files arrive.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]")


def stream_events(spark: SparkSession, sf_dir: str, files: int = FILES_PER_BATCH) -> DataFrame:
    """events as a file stream; ts becomes a zoned timestamp, because watermarks refuse TIMESTAMP_NTZ."""
    raw = _source(spark, sf_dir, "events", EVENTS, files)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir, "documents", DOCUMENTS)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, name: str, mode: str = "append", sink=None, folder: str | None = None) -> str:
    """Process everything available and stop.  Returns the folder of the written table.

    Batches are written under their batch id, so a batch that is run again after a failure
    overwrites its own files and nothing is counted twice.  With the ``folder`` of an earlier run that run goes on.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)
    target = f"{folder}/table"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink(target) if sink else write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target


#: Time of the row that ends a closed corpus, the last year that pandas has; delays of a century leave all earlier rows in time.
END = datetime(2262, 1, 1)


def run_to_end(spark: SparkSession, events: DataFrame, job, name: str) -> DataFrame:
    """Rows of ``job(events)`` for a stream of a closed corpus whose rows wait for the watermark.

    When all is read, one row of the year 2262 moves the watermark past everything: the same query goes on from its
    checkpoint and gives out what still waits.  That row itself waits for ever.
    """
    folder, closing = new_folder(spark, name), new_folder(spark, f"{name}-end")
    end = spark.createDataFrame([(-1, END, -1, None, None, None)], EVENTS)
    end.limit(0).write.parquet(closing)
    last = spark.readStream.schema(EVENTS).parquet(closing)
    last = last.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.lit(None).cast("int"))
    stream = job(events.unionByName(last))
    run_once(stream, name, folder=folder)
    end.write.mode("append").parquet(closing)
    return read_back(spark, run_once(stream, name, folder=folder)).drop("batch")


def read_back(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Update-mode output to one row per key: the row of the last batch."""
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
