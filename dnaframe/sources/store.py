"""Dataset and run registry as partitioned tables.

Layout under a root folder (a shared file system or object store on a cluster):

    datasets/data          rows of every dataset, partitioned by dataset_id         (K1, S8)
    datasets/manifest      one row per dataset                                      (K4, S9)
    datasets/class_counts  (dataset_id, class, count)                               (K4)
    runs/registry          one row per run, nested config sections                  (K5, S10)
    runs/predictions       partitioned by run_id, model                             (K2, S11)
    runs/metrics           one row per (run, model)                                 (K3)
    runs/models/<run>/<model>  saved Spark ML models                                (K6)
    runs/configs           the nested configuration of each run, as JSON            (K5, W7)
    runs/replays           one row per replay                                       (K7)

Every table is partitioned by its id and written with dynamic partition overwrite: a write that
is retried after a failure replaces exactly the partitions it owns (no duplicate rows), and
lookups by id prune to one folder.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _p(root: str, *parts: str) -> str:
    return os.path.join(root, *parts)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def qualified(spark: SparkSession, path: str) -> str:
    """The path's full name on its file system, as Spark's ``binaryFile`` gives it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hpath).toString()


def is_folder(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hpath).isDirectory()


def suffixes(spark: SparkSession, path: str) -> set[str]:
    """Lower-case suffixes of the files of a path: a file, a glob, or a folder (hidden files aside)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for found in fs.globStatus(hpath) or []:
        listed = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
        names += [f.getPath().getName() for f in listed]
    return {os.path.splitext(n)[1].lower() for n in names if not n.startswith((".", "_"))}


def write_partitions(df: DataFrame, root: str, *parts: str, keys=("dataset_id",)) -> None:
    """Idempotent sink: replace only the ``keys`` partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*keys).parquet(_p(root, *parts)))


def write_json(spark: SparkSession, value: dict, root: str, *parts: str) -> None:
    """One JSON document in a folder of its own, on any file system."""
    text = json.dumps(value, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(_p(root, *parts))


def read_json(spark: SparkSession, root: str, *parts: str) -> dict:
    return json.loads(spark.read.text(_p(root, *parts)).first()[0])


def write_dataset(df: DataFrame, root: str, dataset_id: str) -> None:
    """K1: store the table once, in its own partition."""
    write_partitions(df.withColumn("dataset_id", F.lit(dataset_id)), root, "datasets", "data")


def load_dataset(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Rows of one dataset in its own columns and types: only its folder is read."""
    return spark.read.parquet(_p(root, "datasets", "data", f"dataset_id={dataset_id}"))


def read_table(spark: SparkSession, root: str, *parts: str) -> DataFrame | None:
    """A whole table; runs of different kinds have different columns, so all files' columns are merged."""
    path = _p(root, *parts)
    return spark.read.option("mergeSchema", True).parquet(path) if _exists(spark, path) else None


def read_partition(spark: SparkSession, root: str, *parts: str, key: str, value: str) -> DataFrame | None:
    """The rows of one partition with the columns they were written with, and the key beside them."""
    path = _p(root, *parts, f"{key}={value}")
    return spark.read.parquet(path).withColumn(key, F.lit(value)) if _exists(spark, path) else None


def list_datasets(spark: SparkSession, root: str) -> DataFrame | None:
    """All dataset manifests by id."""
    m = read_table(spark, root, "datasets", "manifest")
    return m.orderBy("dataset_id") if m is not None else None


def list_runs(spark: SparkSession, root: str) -> DataFrame | None:
    """All run rows by id."""
    r = read_table(spark, root, "runs", "registry")
    return r.orderBy("run_id") if r is not None else None


def get_run(spark: SparkSession, root: str, run_id: str, preview_rows: int | None = 100) -> dict:
    """One run: its registry row, its metrics and its first predictions (pruned to the run; with None all of them).

    Without a registry row, which is written last, there is no run: what an unfinished one has left stays unseen.
    """
    if not _exists(spark, _p(root, "runs", "registry", f"run_id={run_id}")):
        return {"run": None, "metrics": None, "predictions": None}
    found = {name: read_partition(spark, root, "runs", table, key="run_id", value=run_id)
             for name, table in (("run", "registry"), ("metrics", "metrics"), ("predictions", "predictions"))}
    if found["predictions"] is not None and preview_rows is not None:
        found["predictions"] = found["predictions"].orderBy("model", "row_id").limit(preview_rows)
    return found


def save_model(model, root: str, run_id: str, name: str) -> str:
    """K6: persist a fitted Spark ML model; a ``StoredForest`` becomes one model per group of trees."""
    path = _p(root, "runs", "models", run_id, name)
    model.write().overwrite().save(path)
    return path


def reproducibility_status(runs: DataFrame, datasets: DataFrame | None) -> DataFrame:
    """``missing_config`` without a saved config; ``partial`` when the source was removed, the
    dataset is gone or its digest differs; else ``complete``. One left join on dataset_id."""
    if datasets is None:
        j = runs.withColumn("_sha", F.lit(None).cast("string"))
    else:
        j = runs.join(datasets.select("dataset_id", F.col("sha256").alias("_sha")), "dataset_id", "left")
    status = (F.when(~F.col("has_config"), F.lit("missing_config"))
               .when(F.col("source_dataset_removed_after_run"), F.lit("partial"))
               .when(F.col("_sha").isNotNull() & (F.col("_sha") == F.col("dataset_sha256")), F.lit("complete"))
               .otherwise(F.lit("partial")))
    return j.withColumn("reproducibility_status", status).drop("_sha")
