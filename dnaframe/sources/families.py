"""J1 in its stored form: feature families as bucketed tables that join on ``row_id`` without an exchange.

Each family is computed once and stored by itself, so a run that needs other families, or a family that is
added later, reads what is there instead of computing all again. All tables are bucketed and sorted by
``row_id`` into the same number of buckets: a join reads bucket by bucket, whatever the number of rows.
A small description beside the tables lets another session read them with their buckets.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnaframe.functions.sequence import gc_content, kmer_denominator, kmer_slot, normalize, one_hot, runs_of_sorted, sorted_windows, to_numeric
from dnaframe.operators.features import FeatureConfig
from dnaframe.sources import store

#: Rows of a bucket: a task that joins families sorts one bucket of each.
BUCKET_ROWS = 1 << 17
FAMILIES = ("target", "gc", "kmers", "one_hot")


def family_frames(df: DataFrame, seq_col: str, config: FeatureConfig, target_col: str | None = None) -> dict[str, DataFrame]:
    """The families that ``config`` asks for: gc_content; slots and values of the k-mers; one_hot; y of rows with a numeric target."""
    base = df.select("row_id", normalize(seq_col).alias("_s"))
    out = {}
    if target_col:
        out["target"] = df.select("row_id", to_numeric(target_col).alias("y")).filter("y is not null")
    if config.use_gc:
        out["gc"] = base.select("row_id", gc_content("_s").alias("gc_content"))
    if config.use_kmers:
        k = config.kmer_size
        w = base.select("row_id", kmer_denominator("_s", k).cast("double").alias("_den"), sorted_windows("_s", k).alias("_w"))
        # a row without a k-mer has one run of nothing
        runs = w.select("row_id", "_den", F.filter(runs_of_sorted("_w"), lambda r: r["kmer"].isNotNull()).alias("_r"))
        size = F.col("_den") if config.normalize_kmers else F.lit(1.0)
        out["kmers"] = runs.select("row_id", size.alias("_by"), "_r").select(
            "row_id", F.transform("_r", lambda r: kmer_slot(r["kmer"])).alias("slots"),
            F.transform("_r", lambda r: r["n"] / F.col("_by")).alias("values"))
    if config.use_one_hot:
        out["one_hot"] = base.select("row_id", one_hot("_s", config.sequence_length).alias("one_hot"))
    return out


def store_families(frames: dict[str, DataFrame], root: str, buckets: int = 64) -> None:
    """Writes or replaces families. ``buckets`` is the least number of a table's parallel parts, some 1 to 4 per core of
    the cluster; it grows with the rows, so that a part keeps to about ``BUCKET_ROWS`` rows. Families join without an
    exchange if they have the same number, so one that is added later takes that of the families beside it, if larger."""
    for name in frames:
        if name not in FAMILIES:
            raise ValueError(f"unknown family {name!r}; known are {list(FAMILIES)}")
    for frame in frames.values():
        buckets = max([buckets, -(-frame.count() // BUCKET_ROWS), *_buckets_beside(frame.sparkSession, root, frames)])
    for name, frame in frames.items():
        spark = frame.sparkSession
        path, table = os.path.join(root, "families", name), f"family_{uuid.uuid4().hex}"
        # one file per bucket: rows are dealt by the bucket's own rule before they are written
        dealt = frame.repartition(buckets, "row_id")
        dealt.write.format("parquet").bucketBy(buckets, "row_id").sortBy("row_id").option("path", path).mode("overwrite").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the files stay, they are the store's
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        store.write_json(spark, {"buckets": buckets, "fields": fields}, root, "families", f"{name}.description")


def _buckets_beside(spark: SparkSession, root: str, names) -> list[int]:
    """Bucket numbers of the stored families that are not in ``names``."""
    beside = [n for n in FAMILIES if n not in names and store._exists(spark, os.path.join(root, "families", f"{n}.description"))]
    return [int(store.read_json(spark, root, "families", f"{n}.description")["buckets"]) for n in beside]


def load_family(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored family with its buckets."""
    about = store.read_json(spark, root, "families", f"{name}.description")
    table = f"family_{uuid.uuid4().hex}"
    path = store.qualified(spark, os.path.join(root, "families", name)).replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({about['fields']}) USING parquet CLUSTERED BY (row_id) SORTED BY (row_id) "
              f"INTO {int(about['buckets'])} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def join_families(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """The families side by side, rows that all of them hold: a merge of equal buckets, no row changes its task."""
    out = None
    for name in names:
        one = load_family(spark, root, name).hint("merge")
        out = one if out is None else out.join(one, "row_id")
    return out
