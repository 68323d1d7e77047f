"""Seeded, partition-independent row hashes and order-free table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnaframe.functions._col import as_col


def rank_hash(seed, row_id) -> Column:
    """``md5(seed || ':' || row_id)`` as 32 hex chars.

    The same text hash exists in DuckDB and most engines, so a seeded order is portable and does
    not depend on partitioning or on file order (H1, H3).
    """
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed_col.cast("string"), F.lit(":"), as_col(row_id).cast("string")))


def row_text(columns: list[str]) -> Column:
    """A row as text that no other row of these columns shares: nulls, values and places are told apart."""
    parts = []
    for c in columns:
        v = F.col(f"`{c}`").cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)))
    return F.concat_ws(",", *parts)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """F11 at table scale: order-free ``(rows, content_hash)``, the sum of 60 bits of every row's md5.

    Two tables with equal rows in any order and partitioning give the same pair; values that change
    places between rows or nullable columns change it. One pass, partial aggregation on the map side.
    """
    h = F.conv(F.substring(F.md5(row_text(df.columns)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("content_hash"))
