"""File digests of any size and the checksum gate.

* Files below ``whole`` bytes are hashed by Spark from their content, one row per file.
* Larger ones are read as lines in many tasks, by any file system that Spark reads, and put together again byte
  by byte: ``file_digests`` streams a file's lines, packed in runs of ``RUN`` bytes, in order through one task, which
  sorts little more than the file's bytes and holds only the state of the digest (SHA-256 is one chain); ``tree_digests`` hashes blocks of fixed size in parallel and then the blocks'
  digests, so no task sees more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Files from here on are read in lines (``binaryFile`` holds a file in one array, 2 GB at most).
WHOLE = 1 << 30
#: Bytes of neighbouring lines that go as one row; a line by itself would take many times its own bytes in a sort.
RUN = 4096
BOM = bytearray(b"\xef\xbb\xbf")
_LEAST = len(BOM) + 1  # a file of nothing but the mark has no lines


def file_digests(spark: SparkSession, path: str | list[str], whole: int = WHOLE) -> DataFrame:
    """SHA-256 of each file's bytes: ``(path, size_bytes, sha256)``.

    A large file that is stored compressed under a codec's suffix is unpacked by the scan, so its bytes can't be
    had; its digest is null. Spark's scans pass over empty files: they have no row. For a whole table use ``functions.hashing.table_fingerprint`` (order-free).
    """
    whole = max(whole, _LEAST)
    small = content_digests(spark.read.format("binaryFile").load(path).filter(F.col("length") < whole))
    rows = _byte_lines(spark, path, whole).repartition("file").sortWithinPartitions("file", "block", "at")
    large = rows.select("file", "size", "fits", "bytes").mapInArrow(_chain, "path string, size_bytes bigint, sha256 string")
    return small.unionByName(large)


def tree_digests(spark: SparkSession, path: str | list[str], block: int = 4 << 20) -> DataFrame:
    """``(path, size_bytes, blocks, tree_sha256)``: SHA-256 of blocks of ``block`` bytes, then of runs of 1024 digests,
    until one is left. The result depends on the bytes and on ``block`` (``_LEAST`` at least) alone."""
    if block < _LEAST:
        raise ValueError(f"a block has {_LEAST} bytes at least")
    x = _byte_lines(spark, path, _LEAST, min(block, RUN))
    x = x.withColumn("n", F.octet_length("bytes").cast("bigint"))
    inner = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    last = F.greatest(F.col("start"), F.col("start") + F.col("n") - 1)
    x = x.withColumn("piece", F.explode(F.sequence((F.col("start") / block).cast("bigint"), (last / block).cast("bigint"))))
    low = F.greatest(F.col("start"), F.col("piece") * block)
    high = F.least(F.col("start") + F.col("n"), (F.col("piece") + 1) * block)
    cut = F.substring("bytes", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    x = x.select("file", "size", "fits", "piece", low.alias("low"), cut.alias("cut"))
    tops = x.groupBy("file", "size", "fits", "piece").applyInArrow(_block, "file string, size bigint, fits boolean, piece bigint, sha string")
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    left = -(-longest // block)
    counts = F.ceil(F.col("size") / block).cast("bigint")
    level = counts  # digests that a file still has
    while left > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("piece", "sha"))), lambda p: p["sha"])
        tops = tops.groupBy("file", "size", "fits", F.shiftright("piece", 10).alias("piece")).agg(
            F.first("sha").alias("sha"), F.sha2(F.unhex(F.array_join(run, "")), 256).alias("of"))
        tops = tops.withColumn("sha", F.when(level > 1, F.col("of")).otherwise(F.col("sha"))).drop("of")
        level = F.ceil(level / 1024).cast("bigint")
        left = -(-left // 1024)
    lone = tops.select(F.col("file").alias("path"), F.col("size").alias("size_bytes"), counts.alias("blocks"),
                       F.when(F.col("fits"), F.col("sha")).alias("tree_sha256"))
    tiny = spark.read.format("binaryFile").load(path).filter(F.col("length") < _LEAST).select(
        "path", F.col("length").alias("size_bytes"), F.lit(1).cast("bigint").alias("blocks"), F.sha2("content", 256).alias("tree_sha256"))
    return lone.unionByName(tiny)


def _byte_lines(spark: SparkSession, path: str | list[str], least: int, run: int = RUN) -> DataFrame:
    """``(file, size, fits, block, at, base, bytes)``: the lines of all files of ``least`` bytes and more, line ends included.

    Neighbouring lines share a row of about ``run`` bytes; ``at`` is the first one's place.
    ``base``: bytes of the file before the block's first line; ``fits`` is false if lines and file size disagree.
    """
    m = "_metadata.file_"
    # the name as binaryFile gives it: not percent-encoded, one slash
    name = F.regexp_replace(F.url_decode(F.regexp_replace(F.col(m + "path"), r"\+", "%2B")), "^file:/+", "file:/")
    raw = spark.read.option("lineSep", "\n").text(path).filter(F.col(m + "size") >= least).select(
        name.alias("file"), F.col(m + "size").alias("size"), F.col(m + "block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    blocks = raw.groupBy("file", "size", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"),
                                                      F.sum(F.octet_length("line") + 1).alias("n"))
    file = Window.partitionBy("file")
    over = F.sum("n").over(file) - F.col("size")  # 0: the last line has an end; 1: none; 3 less: a byte order mark
    blocks = blocks.select("file", "block", "first", "last", over.alias("over"), (F.max("block").over(file) == F.col("block")).alias("final"),
                           F.coalesce(F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    mark = F.col("over").isin(-3, -2)
    blocks = blocks.select("*", F.col("over").isin(0, 1, -3, -2).alias("fits"), F.min("block").over(file).alias("begin"),
                           (F.col("before") + F.when(mark & (F.col("before") > 0), 3).otherwise(0)).alias("base"))
    x = raw.join(F.broadcast(blocks), ["file", "block"])  # one row per block of a file; the lines stay where they are
    none = F.lit(bytearray())
    head = F.when(mark & (F.col("block") == F.col("begin")) & (F.col("at") == F.col("first")), F.lit(BOM)).otherwise(none)
    bare = F.col("final") & (F.col("at") == F.col("last")) & F.col("over").isin(1, -2)
    tail = F.when(bare, none).otherwise(F.lit(bytearray(b"\n")))
    x = x.select("file", "size", "fits", "block", "at", "base", F.concat(head, "line", tail).alias("bytes"))
    return x.mapInArrow(_runs(run), x.schema)


def _runs(size: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            if not b.num_rows:
                continue
            file = b.column("file").dictionary_encode().indices.to_numpy()
            block, at = b.column("block").to_numpy(), b.column("at").to_numpy()
            part = np.cumsum(pc.binary_length(b.column("bytes")).to_numpy(), dtype=np.int64) // size
            # only lines that follow each other in one block are put together, whatever the order of the rows
            new = (np.diff(file) != 0) | (np.diff(block) != 0) | (np.diff(at) != 1) | (np.diff(part) != 0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            lines = b.column("bytes").to_pylist()
            packed = pa.array([b"".join(lines[i:j]) for i, j in zip(edges, edges[1:])], b.column("bytes").type)
            out = b.take(pa.array(edges[:-1]))
            yield out.set_column(out.schema.get_field_index("bytes"), "bytes", packed)

    return run


_DIGEST = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("sha256", pa.string())])


def _chain(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per file; lines come sorted, a file's state goes on over batches."""
    at = state = None
    for b in rows:
        out = []
        for file, size, fits, data in zip(*(c.to_pylist() for c in b.columns)):
            if at is None or file != at[0]:
                if at:
                    out.append({"path": at[0], "size_bytes": at[1], "sha256": state.hexdigest() if at[2] else None})
                at, state = (file, size, fits), hashlib.sha256()
            state.update(data)
        yield pa.RecordBatch.from_pylist(out, _DIGEST)
    if at:
        yield pa.RecordBatch.from_pylist([{"path": at[0], "size_bytes": at[1], "sha256": state.hexdigest() if at[2] else None}], _DIGEST)


def _block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("low")
    state = hashlib.sha256()
    for data in rows["cut"].to_pylist():
        state.update(data)
    return rows.select(["file", "size", "fits", "piece"]).slice(0, 1).append_column("sha", pa.array([state.hexdigest()]))


def path_digest(spark: SparkSession, path: str) -> tuple[str | None, int]:
    """One SHA-256 and the bytes of a path: a file's own digest, or that of a folder's files.

    A folder's digest covers every file's name below it, folders included, and its bytes. Names and digests
    are joined in 4096 parts first, so no row holds them all.
    """
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hpath).toUri().getPath()
    files = file_digests(spark, path)
    plain = F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?(/+)", "/")
    name = F.when(plain.startswith(root.rstrip("/") + "/"), F.substring(plain, len(root.rstrip("/")) + 2, 2**31 - 1)).otherwise(plain)
    joined = F.array_join(F.array_sort(F.collect_list(F.concat(F.col("name"), F.lit(":"), F.coalesce("sha256", F.lit(""))))), "\n")
    parts = files.withColumn("name", name).groupBy(F.substring(F.sha2("name", 256), 1, 3).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.first("sha256").alias("sha"), F.sha2(joined, 256).alias("of"))
    row = parts.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.first("sha").alias("sha"), F.sha2(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "of"))), lambda p: p["of"]), "\n"), 256).alias("all")).first()
    return (None if not row["n"] else row["sha"] if row["n"] == 1 else row["all"]), int(row["bytes"] or 0)


def content_digests(files: DataFrame) -> DataFrame:
    """SHA-256 and size of byte contents ``(path, content)``."""
    return files.select("path", F.octet_length("content").cast("bigint").alias("size_bytes"),
                        F.sha2(F.col("content"), 256).alias("sha256"))


def checksum_status(digests: DataFrame, expected: DataFrame, on: str = "path") -> DataFrame:
    """M22, three-valued: true / false, or null when the file is missing or no digest was saved.

    ``expected`` has ``(path, expected_sha256)``; files are matched on ``path``.
    """
    j = expected.join(digests, on, "left")
    ok = F.when(F.col("expected_sha256").isNull() | F.col("sha256").isNull(), F.lit(None).cast("boolean")) \
          .otherwise(F.col("sha256") == F.col("expected_sha256"))
    return j.select(on, "expected_sha256", "sha256", ok.alias("checksum_verified"))
