"""(3) Conflict-constrained best-fit packing.

Documents are cut into pieces of at most ``capacity`` words and packed into bins of that size. Two
pieces conflict if they share a source or a duplicate cluster; a bin never holds a conflict. Bins
are kept in the order of their residual room and carry a bitmap of their sources and one of their
clusters: the search starts at the tightest bin with room enough and goes on to the next larger
residual until a bin without conflict is found, else a new bin opens. Pieces come largest first.

Pieces are dealt at random to packing shards of about ``bins`` bins or 4 * ``bins`` pieces each, so a task's memory does not
depend on the table, and a source or cluster with a third of all rows is spread over all shards. With
one source per bin, that source alone may need more bins than all words together would fill:
``by_source=False`` leaves clusters as the only conflict.

A duplicate cluster is a component of near copies: texts of equal words, whatever the case and white
space, and texts whose sets of ``SHINGLE``-word shingles have a Jaccard similarity of about 0.8 and more.
Such pairs meet by MinHash: they share one of ``BANDS`` bands of 4 of 64 minima with probability 0.9997, and are
linked if at least ``AGREE`` minima agree (99.8 % of pairs at 0.8, less than 1 % of those at 0.5). In a bucket
every two texts are compared, so no link depends on a third text; a bucket gives one row per linked text, no
pairs. A crowded bucket is cut into blocks, each two of which meet in some task.

Pieces of one document share its cluster; in ``packed_documents``, all rows of one id do. A null source conflicts with nothing, a null cluster
means the row is its own. Null and empty texts give one row with piece 0, no words and no bin.
Equal rows are packed one by one. Ties: the smaller id, then the row hash. Empty tables give empty
results; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnaframe.llm.common import WORD, ByteHash, by_content, kept, let, mix64, n_words, one_of_each, unrolled, word_bounds
from dnaframe.llm.pstable import _groups as linked_groups
from dnaframe.llm.simhash import components

#: Words of a shingle, bands of 4 minima, and minima that near copies must share.
SHINGLE, BANDS, AGREE = 5, 16, 42
#: Texts of a block; rows that a task compares.
BLOCK, TASK = 1024, 32768


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each item (words, source, cluster), taken in the given order; None conflicts with nothing."""
    codes: dict[tuple[str, object], int] = {}
    room: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for words, source, cluster in items:
        s = 0 if source is None else 1 << codes.setdefault(("s", source), len(codes))
        c = 0 if cluster is None else 1 << codes.setdefault(("c", cluster), len(codes))
        at = bisect_left(room, (words, -1))
        while at < len(room) and (sources[room[at][1]] & s or clusters[room[at][1]] & c):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        if left > words:
            insort(room, (left - words, b))
        out.append(b)
    return out


def _pack(capacity: int, by_source: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["words", "id", "h", "copy", "piece"], ascending=[False, True, True, True, True],
                                  na_position="last", kind="stable").reset_index(drop=True)
        # a cluster seen once in the shard can't conflict, so it takes no bit
        twice = frame["cluster"].duplicated(keep=False) & frame["cluster"].notna()
        clusters = [c if t else None for c, t in zip(frame["cluster"], twice)]
        sources = [s if by_source and isinstance(s, str) else None for s in frame["source"]]
        frame["bin"] = best_fit(list(zip(frame["words"].tolist(), sources, clusters)), capacity)
        frame["start"] = frame.groupby("bin")["words"].cumsum() - frame["words"]
        return frame[["row", "piece", "first", "words", "shard", "bin", "start"]]

    return run


def pack(sizes: DataFrame, capacity: int = 2048, bins: int = 1024, by_source: bool = True, seed: int = 42) -> DataFrame:
    """row, piece, first, words, shard, bin, start for every row of ``sizes`` (id, h, copy, row, source, cluster, size).

    ``first``: the piece's first word in its document; ``start``: its place in the bin.
    """
    sized = sizes.filter("size > 0").withColumn("n", F.ceil(F.col("size") / F.lit(capacity)).cast("long"))
    words, n = sized.agg(F.sum("size"), F.sum("n")).first()
    shards = max(1, -(-(words or 0) // (capacity * bins)), -(-(n or 0) // (4 * bins)))
    pieces = unrolled(sized, "n", "piece")
    first = F.col("piece") * capacity
    pieces = pieces.select("id", "h", "copy", "row", "source", "cluster", "piece", first.alias("first"),
                           F.least(F.lit(capacity), F.col("size") - first).cast("long").alias("words"),
                           F.pmod(F.xxhash64(F.lit(seed), "id", "h", "copy", "piece"), F.lit(shards)).alias("shard"))
    packed = pieces.groupBy("shard").applyInPandas(
        _pack(capacity, by_source), "row long, piece long, first long, words long, shard long, bin long, start long")
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    empty = sizes.filter("size = 0").select("row", zero.alias("piece"), zero.alias("first"), zero.alias("words"),
                                            none.alias("shard"), none.alias("bin"), none.alias("start"))
    return packed.unionByName(empty)


def measured(rows: DataFrame, source: Column, cluster: Column, text: Column) -> DataFrame:
    """The sizes table of ``pack`` from the rows of ``by_content``."""
    each = rows.select("id", "h", source.cast("string").alias("source"), cluster.alias("cluster"), n_words(text).alias("size"))
    each = each.groupBy("id", "h", "source", "cluster", "size").agg(F.count("*").alias("copies"))
    return kept(unrolled(each, "copies", "copy").drop("copies").withColumn("row", F.monotonically_increasing_id()), "pack-sizes")


def text_cluster(text: Column) -> Column:
    """Name of a text's cluster of exact copies: equal words in order, whatever the case and white space; null without a word."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(plain) > 0, F.md5(plain.cast("binary")))


def minima(texts: list[bytes]) -> np.ndarray:
    """texts x 4 * BANDS: the least value of the shingles' hashes under as many hash functions, cut to 32 bits."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    start, end = word_bounds(data)
    hasher = ByteHash(11)
    word = hasher.slices(hasher.sums(data), start, end)
    size = np.array([len(t) + 1 for t in texts])
    first = np.searchsorted(start, np.cumsum(size) - size)
    n = np.diff(np.append(first, len(start)))
    # a text of fewer words is one shingle; places beyond a text's last shingle are left out
    nth = np.arange(len(start)) - np.repeat(first, n)
    left = np.repeat(n, n) - nth
    grams = np.zeros(len(start), np.uint64)
    for j in range(SHINGLE):
        there = np.flatnonzero(left > j)
        grams[there] += mix64(word[there + j] + np.uint64(j))
    grams = mix64(grams)[(left >= SHINGLE) | (nth == 0)]
    count = np.maximum(1, n - SHINGLE + 1) * (n > 0)
    out = np.zeros((len(texts), 4 * BANDS), np.int64)
    some = count > 0
    if some.any():
        at = (np.cumsum(count) - count)[some]
        for k in range(4 * BANDS):
            salt = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
            out[some, k] = np.minimum.reduceat(mix64(grams ^ salt) >> np.uint64(32), at).astype(np.int64)
    return out


def _minima(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cluster (as ``text_cluster`` names it), sig (the minima, 4 bytes each), keys (one per band) of texts with a word."""
    for batch in rows:
        column = batch.column("text").cast(pa.binary())
        total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        # a word takes some 50 bytes as an object, so only a part of the batch is in words at a time
        edges = [0, *(np.flatnonzero(np.diff(total >> 20)) + 1).tolist(), len(column)]
        for at, to in zip(edges, edges[1:]):
            words = map(bytes.split, (x or b"" for x in column.slice(at, to - at).to_pylist()))
            texts = [b" ".join(w) for w in words if w]
            if not texts:
                continue
            least = minima(texts)
            keys = np.zeros((len(least), BANDS), np.uint64)
            for i in range(BANDS):
                for j in range(4):
                    keys[:, i] = mix64(keys[:, i] * np.uint64(31) + least[:, 4 * i + j].astype(np.uint64) + np.uint64(i + 1))
            names = pa.array([hashlib.md5(t).hexdigest() for t in texts], pa.string())
            sig = pa.array([x.tobytes() for x in least.astype("<u4")], pa.binary())
            yield pa.RecordBatch.from_arrays([names, sig, pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                                             names=["cluster", "sig", "keys"])


def _near(rows: pa.Table) -> pa.Table:
    """a, b: every text that is near another one in a bucket, and the first text of its linked group."""
    col = {c: rows[c].to_numpy() for c in ("band", "key", "i", "j", "blk", "node")}
    order = np.lexsort([col[c] for c in ("node", "j", "i", "key", "band")])
    col = {c: x[order] for c, x in col.items()}
    sigs = np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u4").reshape(-1, 4 * BANDS)[order]
    new = np.ones(len(order), bool)
    new[1:] = np.any([col[c][1:] != col[c][:-1] for c in ("band", "key", "i", "j")], axis=0)
    edge = np.append(np.flatnonzero(new), len(order))
    found = [np.zeros((2, 0), np.int64)]
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a < 2:
            continue
        same = np.zeros((b - a, b - a), np.uint8)
        for k in range(4 * BANDS):
            same += sigs[a:b, k, None] == sigs[None, a:b, k]
        near = same >= AGREE
        np.fill_diagonal(near, False)
        if col["i"][a] != col["j"][a]:  # two blocks: pairs within one are another task's
            near &= col["blk"][a:b, None] != col["blk"][None, a:b]
        hit = np.flatnonzero(near.any(axis=1))
        if len(hit):
            node = col["node"][a + hit]
            root = node[linked_groups(near[np.ix_(hit, hit)])]
            found.append(np.stack([node, root])[:, node != root])
    out = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def near_copies(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links between the clusters of ``texts`` (text, in lower case) that are near copies."""
    sigs = texts.select("text").mapInArrow(_minima, "cluster string, sig binary, keys array<long>")
    sigs = kept(sigs.groupBy("cluster").agg(F.first(F.struct("sig", "keys")).alias("s")).select(
        "cluster", "s.*", F.monotonically_increasing_id().alias("node")), "pack-minima")
    keys = sigs.select("node", F.posexplode("keys").alias("band", "key"))
    # texts that are alone in a bucket go no further, and no signature has moved yet
    shared = kept(keys.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select(
        "band", "key", "n", F.ceil(F.col("n") / F.lit(block)).cast("long").alias("blocks")), "pack-buckets")
    total = shared.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    rows = keys.join(shared.drop("n"), ["band", "key"]).withColumn("blk", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "band", "key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node")
    rows = rows.join(sigs.select("node", "sig"), "node").withColumn(
        "task", F.pmod(F.xxhash64("band", "key", "i", "j"), F.lit(max(1, -(-total // TASK)))))
    links = kept(rows.groupBy("task").applyInArrow(_near, "a long, b long"), "pack-links").distinct()
    names = sigs.select("node", "cluster")
    return (links.join(names.select(F.col("node").alias("a"), F.col("cluster").alias("one")), "a")
            .join(names.select(F.col("node").alias("b"), F.col("cluster").alias("two")), "b")
            .select(F.col("one").alias("a"), F.col("two").alias("b")))


def clustered(sizes: DataFrame, rows: DataFrame, text: Column, by_id: bool) -> DataFrame:
    """``sizes`` with the near-duplicate component in place of each text's own cluster; ``by_id`` joins all rows of one id."""
    links = near_copies(rows.select(F.lower(text).alias("text")))
    if by_id:
        least = sizes.filter("id is not null and cluster is not null").groupBy("id").agg(
            F.min("cluster").alias("a"), F.max("cluster").alias("z")).filter("a <> z").select(F.col("id").alias("of"), "a")
        same = sizes.filter("cluster is not null").join(least, F.col("id") == F.col("of")).filter("cluster <> a")
        links = links.unionByName(same.select("a", F.col("cluster").alias("b"))).distinct()
    groups = components(links)
    found = sizes.join(groups, sizes["cluster"] == groups["node"], "left")
    return found.withColumn("cluster", F.coalesce("root", "cluster")).drop("node", "root")


def packing_query(docs: DataFrame) -> DataFrame:
    """doc_id, piece, first, words, shard, bin, start for every document (a row per piece)."""
    rows = by_content(docs.select("doc_id", "source", "text"))
    sizes = measured(rows, F.col("doc.source"), text_cluster(F.col("doc.text")), F.col("doc.text"))
    packed = pack(clustered(sizes, rows, F.col("doc.text"), by_id=False))
    return sizes.select("row", F.col("id").alias("doc_id")).join(packed, "row").drop("row")


def packed_documents(docs: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    """shard, bin, start, doc_id, source, piece, words, text: the content of every bin.

    A document in one piece keeps its text; the pieces of a longer one are its words joined by spaces.
    """
    rows = by_content(docs)
    sizes = measured(rows, F.col("doc.source"), text_cluster(F.col("doc.text")), F.col("doc.text"))
    packed = pack(clustered(sizes, rows, F.col("doc.text"), by_id=True), capacity, **options)
    placed = sizes.select("row", "id", "h", "size").join(packed, "row").withColumnsRenamed(
        {"id": "at_id", "h": "at_h"})
    found = one_of_each(rows).join(placed, F.col("id").eqNullSafe(F.col("at_id")) & (F.col("h") == F.col("at_h")))
    some = let(F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0)), lambda w: F.array_join(
        F.slice(w, (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " "))
    return found.select("shard", "bin", "start", F.col("id").alias("doc_id"), "doc.source", "piece", "words",
                        F.when(F.col("words") < F.col("size"), some).otherwise(F.col("doc.text")).alias("text"))
