"""S3: FASTA files -> ``(file, record, id, sequence)`` with the sequence normalised.

Rules: a header is a line whose stripped text starts with ``>``; the id is the rest of that
line, stripped; a blank id becomes ``sequence_<n>`` (n = 1-based record number in its file);
text before the first header is dropped; body lines are stripped and joined; a file without a
header yields no record.

Three readers:
* ``read_fasta`` reads each file whole (many small files; one task per file).
* ``read_fasta_split`` reads files of any size in parallel byte blocks with ``lineSep = '\\n>'``, a
  row per record; record numbers come from per-block counts. Ingest takes this one.
* ``read_fasta_pieces`` cuts records of any length into pieces of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnaframe.functions.sequence import STRIP_CHARS, normalize

#: Lines that ``read_fasta_pieces`` sums up in one window; a power of two, so that no run goes over two parts of a scan.
RUN = 1 << 16
_LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
_WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in STRIP_CHARS) + "]"
_LB = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _LINE_BREAKS) + "]"
_INLINE_WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in STRIP_CHARS if c not in _LINE_BREAKS) + "]"
# a header starts at the text start or after a line break, after optional in-line blanks
_HEADER_SPLIT = f"(?:\\A|{_LB}){_INLINE_WS}*>"


def _record_columns(rec: Column, number: Column) -> list[Column]:
    """Split one record's text (after its ``>``) into the id and the normalised sequence."""
    header = F.regexp_extract(rec, f"^([^{_LB[1:-1]}]*)", 1)
    body = F.regexp_replace(rec, f"^[^{_LB[1:-1]}]*", "")
    joined = F.regexp_replace(body, f"{_WS}*{_LB}{_WS}*", "")
    rid = F.btrim(header, F.lit(STRIP_CHARS))
    return [
        F.when(rid == "", F.concat(F.lit("sequence_"), number.cast("string"))).otherwise(rid).alias("id"),
        normalize(joined).alias("sequence"),
    ]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file reader: one row per record ``(file, record, id, sequence)``."""
    return parse_fasta(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def parse_fasta(raw: DataFrame) -> DataFrame:
    """The records of whole FASTA texts ``(file, value)``."""
    text = F.regexp_replace("value", r"\A\x{FEFF}", "")  # a byte order mark is not read
    parts = raw.select("file", F.posexplode_outer(F.split(text, _HEADER_SPLIT)).alias("record", "rec"))
    recs = parts.filter(F.col("record") > 0)
    return recs.select("file", "record", *_record_columns(F.col("rec"), F.col("record")))


def read_fasta_split(spark: SparkSession, path: str) -> DataFrame:
    """Files of any size, each in many tasks: ``(file, record, id, sequence, row_id)``, nothing shuffled but places.

    The scan cuts files into byte blocks and gives one row per text between two ``\n>``. Headers that
    such a cut does not see (indented ones, other line breaks) are split inside the row. A record's
    number is its place in the block plus the records of all blocks before, from a table of one row per
    block that is joined; ``row_id`` counts on over all files by name. Every row is one record; for records
    too long for a row see ``read_fasta_pieces``.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    inner = f"{_LB}{_INLINE_WS}*>"
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.col("_metadata.file_size").alias("_bytes"), F.monotonically_increasing_id().alias("_at"), "value",
                      (F.size(F.split("value", inner)) - 1).alias("_more"))
    # the first text of a file is a record only if it begins with a header
    leads = F.col("value").rlike(f"\\A{_INLINE_WS}*>")
    blocks = rows.groupBy("file", "block").agg(
        F.min("_at").alias("_first"), F.min_by(leads, "_at").alias("_leads"), F.count(F.lit(1)).alias("_n"),
        F.sum("_more").alias("_mores"), F.sum(F.octet_length("value") + 2).alias("_read"), F.max("_bytes").alias("_bytes"))
    here = F.col("_n") + F.col("_mores") - F.when((F.col("block") == 0) & ~F.col("_leads"), 1).otherwise(0)
    # a file that ends right behind a cut holds one more, empty record (a byte order mark is not read)
    whole = Window.partitionBy("file")
    ends = F.sum("_read").over(whole).isin(F.col("_bytes"), F.col("_bytes") - 3) & (F.max("block").over(whole) == F.col("block"))
    blocks = blocks.select("*", here.alias("_here"), ends.cast("int").alias("_empty"))
    files = blocks.groupBy("file").agg(F.sum(F.col("_here") + F.col("_empty")).alias("_records"))
    files = files.select("file", F.coalesce(F.sum("_records").over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    before = F.coalesce(F.sum("_here").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = blocks.withColumn("_before", before).join(files, "file").select(
        "file", "block", "_first", "_leads", "_before", "_base", "_here", "_empty", "_mores")
    x = rows.join(places.drop("_here", "_empty"), ["file", "block"])
    # only where a block holds headers that the cuts miss, its rows are counted one by one
    in_block = Window.partitionBy("file", "block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    plain = x.filter("_mores = 0").withColumn("_in", F.lit(0).cast("bigint"))
    mixed = x.filter("_mores > 0").withColumn("_in", F.coalesce(F.sum("_more").over(in_block), F.lit(0)))
    x = plain.unionByName(mixed)
    opens = (F.col("block") == 0) & (F.col("_at") == F.col("_first"))
    text = F.when(opens & F.col("_leads"), F.regexp_replace("value", f"\\A{_INLINE_WS}*>", "")).otherwise(F.col("value"))
    lost = (F.col("block") == 0) & ~F.col("_leads")  # what precedes the first header is no record
    number = F.col("_before") + F.col("_at") - F.col("_first") + F.col("_in") - lost.cast("int")
    x = x.select("file", "_base", number.alias("_number"), (opens & lost).alias("_skip"), F.posexplode(F.split(text, inner)).alias("_pos", "rec"))
    x = x.filter(~(F.col("_skip") & (F.col("_pos") == 0))).select("file", "_base", (F.col("_number") + F.col("_pos") + 1).alias("record"), "rec")
    last = places.filter("_empty = 1").select("file", "_base", (F.col("_before") + F.col("_here") + 1).alias("record"), F.lit("").alias("rec"))
    x = x.unionByName(last)
    return x.select("file", "record", *_record_columns(F.col("rec"), F.col("record")), (F.col("_base") + F.col("record") - 1).alias("row_id"))


def read_fasta_pieces(spark: SparkSession, path: str, size: int = 1 << 20, halo: int = 0) -> DataFrame:
    """Records of any length in pieces: ``(file, record, id, piece, start, length, sequence)``.

    Piece p holds the record's bases from p * ``size`` on, ``size`` at most (``length``), and then the first
    ``halo`` bases of the next piece, so that every window of ``halo`` + 1 bases lies whole in the piece it
    begins in. No row is longer than a line or a piece. A line's place in its record comes from running
    totals: in its run of ``RUN`` lines by a window, and over runs by a table of one row per run; no task
    holds a whole block of a file. Lines are exchanged once, by their run, which is where the pieces of the
    records inside it are put together; only records that go over the end of a run are exchanged again, by pieces.
    A record without bases has one empty piece.
    """
    if not 0 <= halo <= size:
        raise ValueError("halo is 0 at least and size at most")
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                       F.monotonically_increasing_id().alias("at"), "value").withColumn("run", F.shiftright("at", RUN.bit_length() - 1))
    # every step below reads the lines as this one exchange leaves them
    raw = raw.repartition("run", "file", "block")
    parts = F.when(F.col("value").rlike(_LB), F.split("value", _LB)).otherwise(F.array("value"))
    line = F.btrim("line", F.lit(STRIP_CHARS))
    x = raw.select("file", "block", "run", "at", F.posexplode(parts).alias("sub", "line")).withColumn("line", line)
    x = x.withColumn("head", F.col("line").startswith(">"))
    x = x.select("file", "block", "run", "at", "sub", "head", F.when(F.col("head"), F.btrim(F.substring("line", 2, 2**31 - 1), F.lit(STRIP_CHARS))).alias("id"),
                 F.when(F.col("head"), F.lit("")).otherwise(normalize("line")).alias("bases"))
    x = x.withColumn("n", F.length("bases").cast("bigint"))
    run = Window.partitionBy("run", "file", "block").orderBy("at", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("sum", F.sum("n").over(run)).withColumn("record", F.sum(F.col("head").cast("bigint")).over(run)).withColumn(
        "from", F.max(F.when(F.col("head"), F.col("sum"))).over(run)).withColumn("name", F.last("id", ignorenulls=True).over(run))
    runs = x.groupBy("run", "file", "block").agg(
        F.sum("n").alias("all"), F.sum(F.col("head").cast("bigint")).alias("own"), F.max("from").alias("last"), F.max_by("name", "record").alias("name"))
    past = Window.partitionBy("file").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("all").over(past), F.lit(0))).withColumn(
        "heads", F.coalesce(F.sum("own").over(past), F.lit(0))).withColumn("open", F.max(F.col("base") + F.col("last")).over(past)).withColumn(
        "opened", F.last("name", ignorenulls=True).over(past))
    x = x.join(runs.select("run", "file", "block", "base", "own", "heads", "open", "opened"), ["run", "file", "block"])
    # a record with a header before and behind it in its run lies whole in it
    x = x.withColumn("whole", (F.col("record") > 0) & (F.col("record") < F.col("own")))
    x = x.withColumn("record", F.col("record") + F.col("heads")).filter("record > 0 and (head or n > 0)")
    x = x.withColumn("start", F.col("base") + F.col("sum") - F.col("n") - F.coalesce(F.col("base") + F.col("from"), "open"))
    # a line that crosses the end of a piece is cut there; what lies in the halo of the piece before goes to both
    first = F.greatest(F.lit(0), F.floor((F.col("start") - halo) / size)).cast("bigint")
    final = F.floor(F.greatest(F.col("start"), F.col("start") + F.col("n") - 1) / size).cast("bigint")
    x = x.withColumn("piece", F.explode(F.when(F.col("head"), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(first, final))))
    low = F.greatest(F.col("start"), F.col("piece") * size)
    high = F.least(F.col("start") + F.col("n"), (F.col("piece") + 1) * size + halo)
    cut = F.substring("bases", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    x = x.select("run", "file", "block", "record", "piece", "whole", F.coalesce("name", "opened").alias("id"), low.alias("low"), cut.alias("cut"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("cut") != "", F.struct("low", "cut")))), lambda c: c["cut"]), "")
    found = [joined.alias("sequence"), F.max("id").alias("id")]
    # pieces of whole records are put together where their run is; only the others' lines are dealt again
    near = x.filter("whole").groupBy("run", "file", "block", "record", "piece").agg(*found)
    far = x.filter("not whole").groupBy("file", "record", "piece").agg(*found)
    out = near.drop("run", "block").unionByName(far)
    name = F.when(F.col("id") == "", F.concat(F.lit("sequence_"), F.col("record").cast("string"))).otherwise(F.col("id"))
    return out.select("file", "record", name.alias("id"), "piece", (F.col("piece") * size).alias("start"),
                      F.least(F.length("sequence"), F.lit(size)).alias("length"), "sequence")
