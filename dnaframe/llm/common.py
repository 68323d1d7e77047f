"""Helpers shared by the operators: word rules, intermediate tables, running totals, byte hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed by the query contracts: a word is a run of characters outside this white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session (tests, bench) may have none; it gets a folder of its own. On a
    cluster a missing setting is an error, as a machine-local folder would lose rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="dnaframe-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the stages before)
    and computes costly columns once however often they are used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is computed once per row.

    A lambda that names a computed column may get that column's whole expression inlined and
    evaluated per element; a lambda variable can not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: str | Column) -> Column:
    """Number of words of a text as long, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offsets(df: DataFrame, keys: list[str], piece: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before, per ``keys``, by (``piece``, ``order``).

    A hot key never meets in one task: rows are summed within (keys, piece), and only the
    pieces' totals, one row each, are summed within a key.
    """
    inner = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = (df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(piece).alias("_p"))
            .agg(F.sum(value).alias("_n")))
    if keys:
        before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_p").rowsBetween(
            Window.unboundedPreceding, -1)
    else:
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long")).drop("_n")
    on = F.col(piece) == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # sizes of generated rows are guessed far too low, so a broadcast is never left to that guess
    return (rows.join(base.hint("merge"), on).withColumn(out, F.col("_in") + F.col("_base"))
            .drop("_in", "_base", "_p", *[f"_k{i}" for i in range(len(keys))]))


RUN = 4096


def unrolled(df: DataFrame, count: str, out: str) -> DataFrame:
    """One row per number below ``count``, in runs of ``RUN`` so that no array grows with the data."""
    runs = df.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col(count) - 1) / RUN).cast("long"))))
    at = F.col("_run") * RUN
    return runs.withColumn(out, F.explode(F.sequence(at, F.least(at + RUN, F.col(count)) - 1))).drop("_run")


def _hashable(field: T.StructField) -> Column:
    """A column as ``xxhash64`` takes it: maps, which it refuses, as JSON text with a map's keys in order."""
    col = F.col("`" + field.name.replace("`", "``") + "`")
    if isinstance(field.dataType, T.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(col)), lambda k: F.struct(k.alias("k"), F.element_at(col, k).alias("v")))
        return F.to_json(F.struct(pairs.alias("map")))
    return F.to_json(F.struct(col)) if "map<" in field.dataType.simpleString() else col


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns. Equal rows share it; maps inside other columns count as equal if their entries have one order."""
    return F.xxhash64(*[_hashable(f) for f in docs.schema.fields])


def by_content(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, h, doc: the rows of ``docs`` as a struct, named by id and a hash of all their columns.

    The name depends on the row alone, never on how the table is split; equal rows share it.
    """
    return docs.select(F.col(id_col).alias("id"), row_hash(docs).alias("h"), F.struct("*").alias("doc"))


def one_of_each(rows: DataFrame) -> DataFrame:
    """The rows of ``by_content`` without repeats (combined before the exchange)."""
    return rows.groupBy("id", "h").agg(F.first("doc").alias("doc"))


# ---- bytes in tasks (numpy) -------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class ByteHash:
    """64-bit hashes of any slices of a byte string, after one pass over it."""

    def __init__(self, seed: int = 1) -> None:
        self.table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))
        self.base = (_BASE * (2 * seed + 1)) & (2**64 - 1)
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.empty(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = max(len(data) + 1, 2 * len(self.up), 1 << 16)
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (sums[end] - sums[start]) * self.down[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(_BASE))

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """The hash of every slice of ``width`` bytes."""
        n = len(sums) - width
        return mix64((sums[width:] - sums[:n]) * self.down[:n] + np.uint64(width * _BASE & (2**64 - 1)))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte string."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def batches(texts: list, limit: int = 4 << 20):
    """Slices of ``texts`` (byte strings) of about ``limit`` bytes each, one text at least: (from, to)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
