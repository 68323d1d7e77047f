"""Delimited files. ``,`` for .csv; tab for .tsv and .txt (fixed rule of the tool)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TAB_SUFFIXES = (".tsv", ".txt")


def separator_for(path: str) -> str:
    return "\t" if path.lower().endswith(TAB_SUFFIXES) else ","


def with_file_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """H1: the row's place, from 0, when the files are read one after the other by name.

    Taken right at a file scan. A scan cuts files into blocks in whatever way its settings say; a
    block's first row is numbered by the rows of all blocks before it (one small row per block), so the
    ids are the same under any split size and on any cluster.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_scan"))
    blocks = at.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_scan").alias("_first"))
    # rows of a file's blocks, then of the files: no window holds more than a file's blocks or all files
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    by_name = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_rows").over(by_name), F.lit(0)).alias("_base"))
    starts = blocks.join(files, "_file").select("_file", "_block", (F.col("_base") + F.col("_before") - F.col("_first")).alias("_shift"))
    return at.join(starts, ["_file", "_block"]).withColumn(out, (F.col("_scan") + F.col("_shift")).cast("bigint")).drop(
        "_file", "_block", "_scan", "_shift")


def numbered(df: DataFrame, *order: str, out: str = "row_id") -> DataFrame:
    """The row's place, from 0, in the order of columns that name it (a file and a record in it)."""
    first, *rest = order
    inner = Window.partitionBy(first).orderBy(*(rest or [first]))
    rows = df.withColumn("_in", F.row_number().over(inner) - 1)
    sizes = df.groupBy(F.col(first).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(sizes, F.col(first) == F.col("_of")).withColumn(out, (F.col("_base") + F.col("_in")).cast("bigint")).drop(
        "_in", "_of", "_base")


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, schema: StructType | str | None = None,
                   header: bool = True, row_id: str | None = "row_id") -> DataFrame:
    """Header + inferred types (or an explicit schema, which is what to use at scale)."""
    reader = spark.read.option("header", header).option("sep", sep or separator_for(path)).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return with_file_row_id(df, row_id) if row_id else df
