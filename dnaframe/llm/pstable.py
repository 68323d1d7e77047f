"""(11) Embedding near-dedup with Euclidean p-stable hashing.

Vectors are scaled to length 1, so that a cosine of c is a distance of sqrt(2 - 2c). A hash is
floor((a.x + b) / w) with Gaussian (2-stable) a and a random shift b; a table's key joins ``per_table``
of them. ``plan`` takes the width, the hashes of a table and the number of tables from the row
count: as few tables as keep unrelated vectors to about ``crowd`` a bucket and miss a pair at the very
threshold with probability ``miss`` at most (closer pairs are missed far less). Vectors that share a
bucket get their exact cosine in double precision.

No pair leaves its bucket. A pair counts in the first table in which its keys agree, so that a
bucket sends one row per vector: how many links it found there, and the smallest vector of its
linked group. Hashes are whole-number sums, the same wherever they are computed. Buckets above
``BLOCK`` vectors are cut into blocks, each two of which meet in some task, so no task holds a crowded
bucket and none of its pairs is left out. Equal vectors are one node with a count; copies cost
nothing.

Null, empty, zero vectors and those that hold a null or non-finite component link with nothing, and are
a component of their own. Shorter vectors count as padded with zeros. Every row is a vector of its own,
also when ids repeat; a null id counts last in ``component_id`` and is never kept. Empty tables give
empty results; only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnaframe.llm.common import kept, mix64
from dnaframe.llm.simhash import components

#: Vectors of a block; rows that a task works on together.
BLOCK, TASK = 1024, 32768
#: Bits of a component and of a projection's weight: products and their sums stay exact in a double.
_X, _A = 20, 12


def collision(width: float, distance: float) -> float:
    """The chance that one p-stable hash of ``width`` agrees for two vectors at ``distance``."""
    r = width / distance
    tail = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, crowd: int = 512, miss: float = 1e-3) -> tuple[float, int, int]:
    """width, hashes per table, tables: as few tables as the two bounds allow for ``n`` vectors."""
    near, far = math.sqrt(max(1e-6, 2 - 2 * cosine)), math.sqrt(2)
    best = None
    for step in range(1, 60):
        width = near * step / 8
        p, q = collision(width, near), collision(width, far)
        if not 1e-6 < q < p < 1:
            continue
        per = max(1, math.ceil(math.log(max(n / crowd, 1)) / -math.log(q)))
        tables = math.ceil(math.log(miss) / math.log1p(-p**per))
        if best is None or (tables, per) < (best[2], best[1]):
            best = width, per, tables
    return best


class Hashes:
    """The keys of unit vectors in every table."""

    def __init__(self, dim: int, width: float, per_table: int, tables: int, seed: int) -> None:
        self.dim, self.per, self.tables, self.seed = dim, per_table, tables, seed
        self.width = round(width * 2 ** (_X + _A))
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, whole: np.ndarray, table: int) -> np.ndarray:
        """One key per row of ``whole`` (components times 2**20, rounded)."""
        if table not in self.made:
            rng = np.random.default_rng([self.seed, table])
            weights = np.rint(rng.standard_normal((self.dim, self.per)) * 2**_A)
            if self.dim * self.per * len(self.made) < 1 << 22:
                self.made[table] = weights, rng.integers(0, self.width, self.per)
            else:
                self.made = {table: (weights, rng.integers(0, self.width, self.per))}
        weights, shift = self.made[table]
        slots = ((whole @ weights).astype(np.int64) + shift) // self.width
        out = np.zeros(len(whole), np.uint64)
        for j in range(self.per):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + slots[:, j].view(np.uint64) + np.uint64(j + 1))
        return out.view(np.int64)


def _units(raw: pa.Array, kind: str, dim: int) -> np.ndarray:
    """The rows' vectors in double precision, scaled to length 1."""
    x = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _hashed(dim: int, kind: str, hashes: Hashes):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            v = b.column(2)
            ends = np.cumsum(np.concatenate(([0], v.value_lengths().to_numpy())))
            flat = v.flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((len(v), dim), kind)
            at = np.repeat(np.arange(len(v)), np.diff(ends))
            x[at, np.arange(len(flat)) - ends[at]] = flat
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            if len(v):
                whole = np.rint(_units(raw, kind, dim) * 2**_X)
                keys = np.stack([hashes.keys(whole, t) for t in range(hashes.tables)], axis=1)
            else:
                keys = np.zeros((0, hashes.tables), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw, pa.array(list(keys), pa.list_(pa.int64()))],
                                             names=["node", "size", "raw", "keys"])

    return run


def _groups(near: np.ndarray) -> np.ndarray:
    """The first member of each row's linked group, rows in order."""
    root = np.full(len(near), -1)
    for s in range(len(near)):
        if root[s] < 0:
            root[s] = s
            front = np.array([s])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
                root[front] = s
    return root


def _linked(dim: int, kind: str, hashes: Hashes, cosine: float):
    """One row (node, links, root) per vector that has links in a bucket."""
    def run(rows: pa.Table) -> pa.Table:
        col = {c: rows[c].to_numpy() for c in ("t", "key", "i", "j", "blk", "node", "size")}
        order = np.lexsort([col[c] for c in ("node", "j", "i", "key", "t")])
        col = {c: x[order] for c, x in col.items()}
        unit = _units(rows["raw"].combine_chunks().take(pa.array(order)), kind, dim)
        new = np.ones(len(order), bool)
        new[1:] = np.any([col[c][1:] != col[c][:-1] for c in ("t", "key", "i", "j")], axis=0)
        edge = np.append(np.flatnonzero(new), len(order))
        found = [np.zeros((3, 0), np.int64)]
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a < 2:
                continue
            near = unit[a:b] @ unit[a:b].T >= cosine
            np.fill_diagonal(near, False)
            if col["i"][a] != col["j"][a]:  # two blocks: pairs within one are another task's
                near &= col["blk"][a:b, None] != col["blk"][None, a:b]
            hit = np.flatnonzero(near.any(axis=1))
            if not len(hit):
                continue
            near = near[np.ix_(hit, hit)]
            whole = np.rint(unit[a + hit] * 2**_X)
            for t in range(int(col["t"][a])):  # a pair counts in the first table that brings it together
                key = hashes.keys(whole, t)
                near &= key[:, None] != key[None, :]
            node, size = col["node"][a + hit], col["size"][a + hit]
            links, root = near @ size, node[_groups(near)]
            some = links > 0
            found.append(np.stack([node[some], links[some], root[some]]))
        out = np.concatenate(found, axis=1)
        return pa.table({"node": pa.array(out[0], pa.int64()), "links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.int64())})

    return run


def vector_links(nodes: DataFrame, cosine: float, kind: str, crowd: int, miss: float, seed: int, block: int) -> DataFrame:
    """node, links, root: a row for every node (node, size, v) and bucket that links it; ``links`` adds up."""
    n, dim = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = dim or 1
    hashes = Hashes(dim, *plan(n, cosine, crowd, miss), seed)
    table = kept(nodes.select("node", "size", "v").mapInArrow(
        _hashed(dim, kind, hashes), "node long, size long, raw binary, keys array<long>"), "pstable-keys")
    buckets = table.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count("*").alias("n"))
    large = kept(buckets.filter(F.col("n") > block).select("t", "key", F.ceil(F.col("n") / F.lit(block)).cast("long").alias("blocks")),
                 "pstable-large")
    rows = table.select("node", "size", "raw", F.posexplode("keys").alias("t", "key")).join(large, ["t", "key"], "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn(
        "blk", F.pmod(F.xxhash64("node"), "blocks"))
    # block b of a bucket meets every block, itself too, in the task of the two
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "t", "key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node", "size", "raw")
    again = large.agg(F.sum((F.col("blocks") - 1) * F.col("blocks") * block)).first()[0] or 0
    tasks = max(1, -(-(n * hashes.tables + again) // TASK))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("t", "key", "i", "j"), F.lit(tasks)))
    return rows.groupBy("task").applyInArrow(_linked(dim, kind, hashes, cosine), "node long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.9,
                           crowd: int = 512, miss: float = 1e-3, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """id, n_links, component_id, kept for every row of ``vectors``."""
    x = F.col(vector)
    value = x.getItem(0)
    kind = "<f4" if vectors.select(value.alias("x")).schema[0].dataType.simpleString() == "float" else "<f8"
    plain = F.transform(x, lambda c: c.cast("float" if kind == "<f4" else "double"))
    usable = F.coalesce(F.forall(plain, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
                        & F.exists(plain, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, plain).alias("v"))
    # a vector is known by two hashes of its components
    rows = kept(rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v")), "pstable-rows")
    nodes = rows.filter("v is not null").groupBy("h", "g").agg(
        F.first("v").alias("v"), F.count("*").alias("size"), F.min("id").alias("least"))
    nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()), "pstable-nodes")
    found = kept(vector_links(nodes, cosine, kind, crowd, miss, seed, block), "pstable-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (nodes.select("h", "g", "node", "size", "least").join(counts, "node", "left")
             .join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), "component")
    linked = rows.filter("v is not null").select("id", "h", "g").join(named, ["h", "g"]).select(
        "id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def pstable_query(vectors: DataFrame) -> DataFrame:
    """The contract's columns for every vector."""
    return near_duplicate_vectors(vectors).withColumnRenamed("id", "vec_id")


#: Every pair by its exact cosine, every component by its reachable ids.
ORACLE_SQL = """
WITH RECURSIVE rows AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, [x::DOUBLE FOR x IN embedding] AS v,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings
), links AS (
  SELECT a.r AS a, b.r AS b FROM rows a JOIN rows b ON a.r <> b.r AND a.usable AND b.usable
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT r, r AS to_r FROM rows UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.to_r
), groups AS (
  SELECT reach.r, min(rows.vec_id) AS component_id FROM reach JOIN rows ON rows.r = reach.to_r GROUP BY reach.r
)
SELECT rows.vec_id, (SELECT count(*) FROM links WHERE links.a = rows.r)::BIGINT AS n_links, component_id,
       coalesce(rows.vec_id = component_id, false) AS kept
FROM rows JOIN groups USING (r)
"""
