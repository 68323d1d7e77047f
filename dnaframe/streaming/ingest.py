"""W1 for arriving files: a landing folder of delimited files streamed into a stored dataset.

The reference ingests one upload at a time. Here new files in a landing folder are picked up
by Structured Streaming's file source, normalised, and written with their class counts (A1) by
``foreachBatch``. Progress lives in the query's checkpoint location (a shared folder on a
cluster). Each micro-batch writes only its own ``(dataset_id, epoch_id)`` partition with dynamic
partition overwrite, so a batch that is retried after a failure replaces what it wrote before:
no duplicates, no lost rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dnaframe.functions.sequence import gc_content, normalize
from dnaframe.sources import store


def stream_delimited(spark: SparkSession, landing: str, schema: str, sep: str = ",") -> DataFrame:
    """Streaming scan of a landing folder; an explicit schema is required for streams."""
    return (spark.readStream.schema(schema).option("header", True).option("sep", sep)
            .option("maxFilesPerTrigger", 1000).csv(landing)
            .withColumn("source_file", F.col("_metadata.file_path")))


def start_ingest(spark: SparkSession, landing: str, root: str, dataset_id: str, schema: str,
                 checkpoint: str, sequence_col: str = "sequence", target_col: str | None = None,
                 sep: str = ",", available_now: bool = True) -> StreamingQuery:
    """Start the ingest query; ``available_now`` processes what is there and stops."""
    src = stream_delimited(spark, landing, schema, sep)
    src = src.withColumn("sequence_normalized", normalize(sequence_col))
    src = src.withColumn("gc_content", gc_content("sequence_normalized"))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        rows = batch.withColumn("row_id", F.concat_ws(":", F.lit(str(epoch_id)), F.col("source_file"),
                                                      F.monotonically_increasing_id().cast("string")))
        rows = rows.withColumn("dataset_id", F.lit(dataset_id)).withColumn("epoch_id", F.lit(int(epoch_id)))
        rows = rows.persist()
        _overwrite_partition(rows, f"{root}/datasets/stream")
        if target_col:
            counts = (rows.filter(F.col(target_col).isNotNull())
                      .groupBy("dataset_id", "epoch_id", F.col(target_col).cast("string").alias("class")).count())
            _overwrite_partition(counts, f"{root}/datasets/class_counts_stream")
        rows.unpersist()

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _overwrite_partition(df: DataFrame, path: str) -> None:
    """Replace exactly the (dataset_id, epoch_id) partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("dataset_id", "epoch_id").parquet(path))


def load_streamed(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Rows of a streamed dataset (partition pruning on dataset_id)."""
    t = store.read_table(spark, root, "datasets", "stream")
    return t.filter(F.col("dataset_id") == dataset_id)


def class_totals(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Class counts over all ingested batches."""
    t = store.read_table(spark, root, "datasets", "class_counts_stream")
    return t.filter(F.col("dataset_id") == dataset_id).groupBy("class").agg(F.sum("count").alias("count"))
