"""Streaming ingest of a landing folder (W1 for arriving files)."""

import os

from pyspark.sql import functions as F

from dnaframe.streaming import class_totals, load_streamed, start_ingest


def test_stream_ingest_two_batches(spark, tmpdir_path):
    landing = os.path.join(tmpdir_path, "landing")
    os.makedirs(landing)
    root = os.path.join(tmpdir_path, "store")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    with open(os.path.join(landing, "a.csv"), "w") as fh:
        fh.write("sequence,label\nacgt,1\nGGCC,0\n")
    q = start_ingest(spark, landing, root, "ds1", "sequence string, label int", ckpt, target_col="label")
    q.awaitTermination(120)
    with open(os.path.join(landing, "b.csv"), "w") as fh:
        fh.write("sequence,label\nAT GC,1\n")
    q = start_ingest(spark, landing, root, "ds1", "sequence string, label int", ckpt, target_col="label")
    q.awaitTermination(120)
    rows = load_streamed(spark, root, "ds1")
    got = sorted((r.sequence_normalized, r.label) for r in rows.collect())
    assert got == [("ACGT", 1), ("ATNGC", 1), ("GGCC", 0)]
    totals = {r["class"]: r["count"] for r in class_totals(spark, root, "ds1").collect()}
    assert totals == {"1": 2, "0": 1}


def test_stream_batch_retry_is_idempotent(spark, tmpdir_path):
    """Writing the same epoch twice (a retried micro-batch) leaves one copy."""
    from dnaframe.streaming.ingest import _overwrite_partition

    root = os.path.join(tmpdir_path, "store")
    df = spark.createDataFrame([("ds", 3, "ACGT")], "dataset_id string, epoch_id int, sequence string")
    _overwrite_partition(df, f"{root}/datasets/stream")
    _overwrite_partition(df, f"{root}/datasets/stream")
    _overwrite_partition(df.withColumn("epoch_id", F.lit(4)), f"{root}/datasets/stream")
    assert load_streamed(spark, root, "ds").count() == 2
