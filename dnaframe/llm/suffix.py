"""(9) Suffix-array dedup: strings of ``length`` bytes that occur more than once.

A position whose longest previous factor reaches ``length`` starts a string that occurred earlier;
its mirror image, the longest next factor, tells of later ones. ``keep="first"`` removes the bytes of
later copies only, ``keep="none"`` those of every copy.

No suffix array of the whole table is built. Every window of ``length`` bytes has a key, the smallest
hash of its ``K``-byte substrings, which equal windows share; stretches of windows with one place of that
hash (runs) are what Spark groups:

1. runs whose key occurs once have no copy anywhere and go;
2. runs that are equal as a whole are copies of each other: one stands for all;
3. the different runs of a key meet in a bucket, where the window starts are put in suffix order
   (prefix doubling, ties by position). The nearest neighbours in that order with a smaller position
   give every window's longest previous factor, those with a greater one its longest next factor,
   both up to ``length`` bytes: a window whose factor reaches ``length`` is a copy. Buckets hold many
   keys and about ``BUCKET`` bytes.

A key of more than ``CROWD`` different runs (a short passage in very many surroundings) is cut by content
before it meets: its substring is lengthened by half of what its windows hold before or behind it, which
equal windows share too, and the runs, cut alike, go through steps 2 and 3 again under their longer keys.
After eight such cuts a substring is a whole window, and all runs of a key are equal.

Strings are UTF-8 bytes of whole texts; matches never cross documents. Null and empty texts have no
bytes. Runs are told apart by two 64-bit hashes. Where ids are null or repeat, rows are numbered in
a stored copy, so repeated rows are copies of each other. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnaframe.llm.common import ByteHash, batches, kept

K, BUCKET, CROWD = 64, 1 << 19, 4096


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def runs(texts: list[bytes], length: int, by_key: ByteHash, by_run: ByteHash):
    """text number, first window, windows, key and content hash of every run of every text."""
    size = np.array([len(t) for t in texts], np.int64)
    if not len(size) or size.max() < length:
        return [np.zeros(0, np.int64)] * 5
    data = np.frombuffer(b"".join(texts), np.uint8)
    k = min(K, length)
    hashes = by_key.windows(by_key.sums(data), k)
    key = sliding_min(hashes, length - k + 1)
    n = len(key)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts)), size)[:n]
    inside = np.arange(n) + length <= (begin + size)[owner]
    # a run ends where its first smallest hash is passed, so that no two windows of a run are equal
    edge = np.flatnonzero((key[1:] != key[:-1]) | (hashes[: n - 1] == key[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])) + 1
    first = np.concatenate(([0], edge))
    last = np.concatenate((edge, [n]))
    good = inside[first]
    first, last = first[good], last[good]
    content = by_run.slices(by_run.sums(data), first, last - 1 + length)
    return owner[first], first - begin[owner[first]], last - first, key[first].view(np.int64), content.view(np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _run_rows(length: int, with_content: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key, by_run = ByteHash(1), ByteHash(2)
        for batch in rows:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), _bytes(batch.column(1))
            for a, b in batches(texts, 1 << 20):
                owner, first, n, key, content = runs(texts[a:b], length, by_key, by_run)
                if not with_content:
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64())], names=["key"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in (key, content, ids[a:b][owner] if len(owner) else owner, first, n)],
                        names=["key", "content", "row", "first", "n"])

    return run


def suffix_ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The 8 bytes at every position as a number, and its ranks by its first 8, 16, ... bytes (prefix doubling up to ``length``)."""
    if length < 8:
        raise ValueError("length is 8 at least")
    n, width = len(data), 8
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | padded[j: j + n]
    levels = [(8, np.unique(eight, return_inverse=True)[1].astype(np.int32))]
    while 2 * width <= length:
        rank = np.unique(_joined(levels[-1][1], np.arange(n), width), return_inverse=True)[1]
        width *= 2
        levels.append((width, rank.astype(np.int32)))
    return eight, levels


def _joined(rank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """One number for the ranks at a position and ``step`` bytes behind it."""
    return rank[at].astype(np.int64) * (int(rank.max()) + 1) + rank[np.minimum(at + step, len(rank) - 1)]


def common_prefix(eight: np.ndarray, levels: list, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes the windows at ``a`` and ``b`` have in common from their start, ``length`` at most."""
    got, last = np.zeros(len(a), np.int64), len(eight) - 1
    for width, rank in reversed(levels):
        same = rank[np.minimum(a + got, last)] == rank[np.minimum(b + got, last)]
        got += width * (same & (got + width <= length))
    differ = eight[np.minimum(a + got, last)] ^ eight[np.minimum(b + got, last)]
    rest = np.zeros(len(a), np.int64)
    for j in range(1, 8):
        rest += (differ >> np.uint64(64 - 8 * j)) == 0
    return np.minimum(got + rest, length)


def before_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest value before each of ``x`` (0 or more) that is smaller, -1 if none is: pointers jump along pointers."""
    y = np.concatenate(([-1], x))
    link = np.maximum(np.arange(len(y)) - 1, 0)
    live = np.arange(1, len(y))
    while len(live := live[y[link[live]] >= y[live]]):
        link[live] = link[link[live]]
    return link[1:] - 1


def factors(data: np.ndarray, starts: np.ndarray, length: int, later: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Longest previous and next factor, up to ``length``, of the windows data[s : s + length] among each other.

    ``starts`` ascend. Of windows that are equal, all but the first have a previous factor of ``length``
    (their neighbour in suffix order is the previous smaller position). The first of each kind looks to
    the nearest kinds on either side that begin at a smaller position. Next factors mirror this.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64) if later else None
    eight, levels = suffix_ranks(data, length)
    whole = _joined(levels[-1][1], starts, length - levels[-1][0])
    order = np.lexsort((starts, whole))
    new = np.concatenate(([True], whole[order][1:] != whole[order][:-1]))

    def longest(of_kind: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), length, np.int64)
        best = np.zeros(len(of_kind), np.int64)
        behind = len(place) - 1 - before_smaller(place[::-1])[::-1]
        for near in (before_smaller(place), np.where(behind < len(place), behind, -1)):
            has = np.flatnonzero(near >= 0)
            best[has] = np.maximum(best[has], common_prefix(eight, levels, starts[of_kind[has]], starts[of_kind[near[has]]], length))
        out[of_kind] = best
        return out

    first = order[new]
    if not later:
        return longest(first, first), None
    last = order[np.concatenate((new[1:], [True]))]
    return longest(first, first), longest(last, len(starts) - 1 - last)


def spans_of(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches of bytes covered by the windows that are marked."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


def _bucket(length: int, keep: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "first"]).reset_index(drop=True)
        size = frame["bytes"].map(len).to_numpy()
        data = np.frombuffer(b"".join(frame["bytes"]), np.uint8)
        begin = np.cumsum(size) - size
        n = size - length + 1
        starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        previous, following = factors(data, starts, length, later=keep != "first")
        hit = previous >= length if following is None else (previous >= length) | (following >= length)
        out, at = [], 0
        for row, first, count in zip(frame["row"], frame["first"], n):
            out += [(row, first + a, first + b) for a, b in spans_of(hit[at: at + count], length)]
            at += count
        return pd.DataFrame(out, columns=["row", "start", "end"], dtype="int64")

    return run


def packed(rows: DataFrame) -> DataFrame:
    """row, size, text of ``rows`` with the bytes compressed: texts cross two exchanges, which they dominate."""
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            texts = _bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(
                [pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary())], names=["row", "size", "text"])

    return rows.mapInArrow(run, "row long, size long, text binary")


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    return [pa.decompress(t, decompressed_size=n, codec="zstd", asbytes=True) if n else b""
            for n, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]


def _fetch(length: int):
    """The bytes of a document's runs."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row, text, wanted in zip(batch.column(0).to_pylist(), _unpacked(batch), batch.column(3).to_pylist()):
                cut = [(r["key"], row, r["first"], text[r["first"]: r["first"] + r["n"] - 1 + length]) for r in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*cut), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["key", "row", "first", "bytes"])

    return run


def halves(texts: list[bytes], first: np.ndarray, key: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None, length: int,
           by_key: ByteHash, by_run: ByteHash):
    """key, content, run, first, n, lo, hi of runs (bytes, first window, key) cut by content.

    [lo, hi) is the substring that all windows of a run hold; unknown, it is the first one whose hash is
    the key. Windows that hold at least half of their other bytes before it share these bytes as well, the
    others those behind it: each part gets the longer substring's hash as its key.
    """
    size = np.array([len(t) for t in texts], np.int64)
    n, begin = size - length + 1, np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    key_sums, run_sums = by_key.sums(data), by_run.sums(data)
    if lo is None:
        k = min(K, length)
        hashes = by_key.windows(key_sums, k).view(np.int64)
        at = np.flatnonzero(hashes == np.repeat(key, size)[: len(hashes)])
        lo = first + at[np.searchsorted(at, begin)] - begin
        hi = lo + k
    slack = length - (hi - lo)
    half, last = (slack + 1) // 2, first + n - 1
    split = lo - half
    out = []
    for a, b, low, high in ((first, np.minimum(last, split), split, hi), (np.maximum(first, split + 1), last, lo, hi + slack - half + 1)):
        some = np.flatnonzero(a <= b)
        move = (begin - first)[some]
        a, b, low, high = a[some], b[some], low[some], high[some]
        out.append((by_key.slices(key_sums, low + move, high + move).view(np.int64),
                    by_run.slices(run_sums, a + move, b + length + move).view(np.int64), some, a, b - a + 1, low, high))
    return [np.concatenate(x) for x in zip(*out)]


def _halved(length: int):
    """The parts of a document's runs, cut by content."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key, by_run = ByteHash(1), ByteHash(2)
        for batch in rows:
            for row, text, wanted in zip(batch.column(0).to_pylist(), _unpacked(batch), batch.column(3).to_pylist()):
                for a in range(0, len(wanted), 4096):
                    some = wanted[a: a + 4096]
                    first, key = (np.array([r[c] for r in some], np.int64) for c in ("first", "key"))
                    lo, hi = (np.array([r[c] for r in some], np.int64) if c in some[0] else None for c in ("lo", "hi"))
                    key, content, of, first, n, lo, hi = halves(
                        [text[r["first"]: r["first"] + r["n"] - 1 + length] for r in some], first, key, lo, hi, length, by_key, by_run)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, content, np.full(len(of), row), first, n, lo, hi)],
                                                     names=["key", "content", "row", "first", "n", "lo", "hi"])

    return run


def repeats(rows: DataFrame, length: int = 200, keep: str = "first") -> DataFrame:
    """row, start, end: byte stretches to remove (they may overlap) from ``rows`` (row, text; row unique)."""
    # 1. keys that occur again
    keys = rows.mapInArrow(_run_rows(length, False), "key long").groupBy("key").agg(F.count("*").alias("total"))
    keys = kept(keys.filter("total > 1").select("key"), "suffix-keys")
    again = rows.mapInArrow(_run_rows(length, True), "key long, content long, row long, first long, n long")
    again = kept(again.join(keys.hint("merge"), "key"), "suffix-runs")
    place, out = ["row", "first", "n"], []

    def wanted(reps: DataFrame) -> DataFrame:
        some = reps.groupBy("row").agg(F.collect_list(F.struct("key", *place[1:])).alias("runs"))
        return packed(rows).join(some.hint("merge"), "row").select("row", "size", "text", "runs")

    while True:
        # 2. equal runs: the first stands for all of them
        kinds = kept(again.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct(*place)).alias("rep")),
                     "suffix-kinds")
        several = again.join(kinds.filter("copies > 1").select("key", "content", "rep").hint("merge"), ["key", "content"])
        if keep == "first":
            several = several.filter((F.col("row") != F.col("rep.row")) | (F.col("first") != F.col("rep.first")))
        out.append(several.select("row", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + length).alias("end")))
        # 3. different runs of a key
        mixed = kept(kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "suffix-mixed")
        reps = kept(kinds.join(mixed.hint("merge"), "key").select("key", "rep.*", (F.col("kinds") > CROWD).alias("crowded")), "suffix-reps")
        load = reps.filter("not crowded").agg(F.sum(F.col("n") - 1 + length)).first()[0] or 0
        buckets = max(1, -(-load // BUCKET))
        parts = wanted(reps.filter("not crowded")).mapInArrow(_fetch(length), "key long, row long, first long, bytes binary")
        parts = parts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        out.append(parts.groupBy("bucket").applyInPandas(_bucket(length, keep), "row long, start long, end long"))
        crowded = reps.filter("crowded")
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, out)
        again = kept(wanted(crowded).mapInArrow(
            _halved(length), "key long, content long, row long, first long, n long, lo long, hi long"), "suffix-halves")
        place = ["row", "first", "n", "lo", "hi"]


def _cut(keep_text: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for text, spans in zip(_unpacked(batch), batch.column(3).to_pylist()):
                joined: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in spans or []):
                    if joined and s[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s[1])
                    else:
                        joined.append(list(s))
                left, at = [], 0
                for a, b in joined:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                rest = b"".join(left)
                out.append((len(text), len(text) - len(rest), len(joined), hashlib.sha256(rest).hexdigest(),
                            rest if keep_text else None))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, (
                pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200, keep: str = "first",
                    keep_text: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining bytes (``rest``) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    ids = rows.groupBy("id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("id").isNull())
    if ids.isEmpty() and rows.schema["id"].dataType.simpleString() in ("bigint", "int", "smallint"):
        rows = rows.select(F.col("id").cast("long").alias("row"), "text")
        named = None
    else:
        rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "suffix-docs")
        named, rows = rows.select("row", "id"), rows.select("row", "text")
    spans = repeats(rows, length, keep).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    done = (packed(rows).join(spans.hint("merge"), "row", "left").select("row", "size", "text", "spans").mapInArrow(
        _cut(keep_text), "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, rest binary"))
    done = done.withColumn("id", F.col("row")) if named is None else done.join(named, "row")
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest")


def suffix_query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document: all copies of repeated strings go."""
    return without_repeats(docs, keep="none", keep_text=False).drop("rest")
