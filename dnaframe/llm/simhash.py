"""(2) SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints: XXH64 of every shingle of ``shingle`` words; a bit is 1 if it is set in more than
half of the hashes. Texts without a word have fingerprint zero and are linked like any other.

Candidates: a random map gives every bit position a vector of ``radius`` + 1 bits. Table v, for
each of the 2**(radius + 1) - 1 non-zero vectors, keeps the positions whose vector has an odd
product with v. Any ``radius`` positions leave some v that is orthogonal to all their vectors, so
two fingerprints that differ in at most ``radius`` bits agree in all positions of that table: every
such pair meets in some bucket, none is missed. Inside a bucket true distances are taken.

Only distinct fingerprints are hashed into tables, so copies cost nothing there. A bucket gives
no pairs but a forest: each of its linked groups hangs from its smallest member. A bucket of more
than ``split`` fingerprints is covered again on the positions that its table does not keep, which
misses no pair either, until it is small; after three coverings at most a few free positions, and
so a few dozen fingerprints, are left.

Components: rounds of large-star and small-star joins over the distinct fingerprints' links. Rows
of one fingerprint are linked by definition, so repeated rows and rows of one id share a
component. ``component_id`` is the smallest id reachable (null ids count last). Empty tables give
empty results; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnaframe.llm.common import by_content, kept, one_of_each

BITS = 64
SEED = 42
#: Rows of the tables handed to a task at once, so groups grow in number with the data, not in size.
GROUP = 1 << 18


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = text.lower().split() if text else []  # bytes: A-Z and the contract's white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    ones, h = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):  # so that a very long text needs no more memory
        block = np.array([h(joined[a:b], SEED) for a, b in zip(starts[at: at + (1 << 16)], ends[at: at + (1 << 16)])], np.uint64)
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    out = np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0]
    return int(out)


def _fingerprints(shingle: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())],
                                             names=[*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, key: str | Column = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """key, fp: the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(key) if isinstance(key, str) else key, F.col(text).cast("string").alias("text"))
    kind = rows.schema[0]
    return rows.mapInArrow(_fingerprints(shingle), f"`{kind.name}` {kind.dataType.simpleString()}, fp long")


def covering(radius: int, positions: int, seed: int) -> list[int]:
    """The tables' masks: bits 0 .. positions - 1, one mask per non-zero vector."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), positions)
    return [sum(1 << i for i, m in enumerate(vectors.tolist()) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) of the groups that links of at most ``radius`` bits form within a bucket."""
    out, left = [], np.sort(x)
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:].copy()
        while front and len(left):
            near = np.bitwise_count((left ^ front.pop()).view(np.uint64)) <= radius
            if near.any():
                reached = left[near].tolist()
                out += [(m, int(root)) for m in reached]
                front += [np.int64(m) for m in reached]
                left = left[~near]
    return out


def _links(radius: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mask, key, fp = (frame[c].to_numpy() for c in ("mask", "key", "fp"))
        order = np.lexsort((key, mask))
        mask, key, fp = mask[order], key[order], fp[order]
        edge = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]), [True])))
        found = []
        for at in np.flatnonzero(np.diff(edge) > 1):  # buckets of two and more
            found += _forest(fp[edge[at]: edge[at + 1]], radius)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_links(fps: DataFrame, radius: int = 4, split: int = 2048, seed: int = 7) -> DataFrame:
    """a, b: links that connect all fingerprints (column fp, distinct) within ``radius`` bits of each other."""
    spark = fps.sparkSession
    masks = F.array(*[F.lit(_signed(m)) for m in covering(radius, BITS, seed)])
    table = fps.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    links = None
    for level in range(3):
        table = kept(table, f"simhash-tables-{level}")
        large = kept(table.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > split), f"simhash-large-{level}")
        crowded = not large.isEmpty() and level < 2
        small = table.join(large.drop("n"), ["mask", "key"], "left_anti") if crowded else table
        # buckets of a partition are handled together; which buckets share one does not matter
        n = max(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // GROUP))
        parts = small.withColumn("part", F.pmod(F.xxhash64("mask", "key"), F.lit(n)))
        alone = parts.select("fp", "mask", "key", "part")
        found = alone.groupBy("part").applyInPandas(_links(radius), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not crowded:
            break
        # the bits that the table leaves free are covered again: every near pair agrees on the kept
        # ones and differs in at most ``radius`` of the free ones
        again = F.array(*[F.lit(_signed(m)) for m in covering(radius, BITS, seed + level + 1)])
        table = (table.join(large.drop("n"), ["mask", "key"], "left_semi").select("fp", "mask", F.explode(again).alias("more"))
                 .select("fp", F.col("mask").bitwiseOR(F.col("more")).alias("mask")).distinct()
                 .withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))))
    return links.distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root: the smallest node of every linked node's component (a hub's links never meet in one task).

    Each round hangs every node's larger neighbours, then the smaller ones, on the smallest
    neighbour; neighbourhoods are only ever aggregated to their minimum and joined back.
    """
    edges = kept(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-0")
    for i in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = kept(large.filter("u <> v"), f"cc-{i}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                               F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").filter("u <> v").distinct())
        small = kept(small, f"cc-{i}-small")
        # done when every node hangs on one that hangs on nothing
        stable = small.join(small.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and small.groupBy("u").agg(
            F.count("*").alias("n")).filter("n > 1").isEmpty()
        edges = small
        if stable:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """id, fp, component_id of every row."""
    rows = kept(fingerprints(docs, id_col, text, shingle), "simhash-rows")
    fps = kept(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-fps")
    groups = components(near_links(fps.select("fp"), radius))
    named = fps.join(groups, fps["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(id_col, "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component of ``docs``: that of the smallest doc_id, of several such the one of
    the smallest row hash, of equal rows one. Null ids count last."""
    rows = by_content(docs)
    key = F.struct(F.col("id").isNull().alias("none"), "id", "h").alias("key")
    found = near_duplicates(rows.select(key, "doc.text"), "key", "text", shingle, radius)
    best = found.select("component_id.id", "component_id.h").distinct().withColumnsRenamed({"id": "best_id", "h": "best_h"})
    stay = rows.join(best, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("h") == F.col("best_h")), "left_semi")
    return one_of_each(stay).select("doc.*")
