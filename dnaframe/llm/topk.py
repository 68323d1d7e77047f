"""(7) Exact top-k inner products over norm-sorted vectors.

Vectors are rotated by the right singular vectors of the whole table (from its Gram matrix, which
is summed in Spark and has one row per component), so that the first few rotated components hold
most of every length. Candidates lie in blocks by descending length. A query's floor is the k-th
best score among the longest candidates; from then on Cauchy-Schwarz bounds prune against it:

* a block whose longest vector times the query's length stays below the floor is never sent to it;
* inside a block, the partial sum over the first rotated components plus the product of both
  residual lengths bounds a score; only pairs above the floor get their exact score.

Bounds are floating point with a margin; scores that count are inner products of the integer
vectors, exact in doubles while the longest vectors keep them below 2**53. Above, they are taken in Python's
whole numbers and ranked exactly up to 38 digits; a score outside the range of a long is returned as its
nearest end. Ties go to the smaller id.

Components are floor(``scale`` * x). Vectors that are null or hold a null or non-finite component
(before or after scaling) take no part; shorter vectors count as padded with zeros. Rows of a null id take
no part. Rows are known by a number of their own: rows that share an id, and equal rows, are queries and
candidates each for itself, and a query leaves out its own row alone. Fewer candidates than k give
all of them. Empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnaframe.llm.common import kept

#: Candidates in a block, queries in a block, longest candidates that set the floors, ranges of lengths.
BLOCK, QUERIES, HEAD, RANGES = 8192, 1024, 2048, 1024


def integer_vectors(vectors: DataFrame, is_query: Column, id_col: str, vector: str, scale: float) -> DataFrame:
    """id, asks, v: the usable vectors, whole-numbered."""
    x = F.col(vector)
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(scaled(c)) | (F.abs(scaled(c)) == float("inf")))
    # floor() of a double is a long, which ends at 2**63; larger doubles are whole already
    whole = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < 2.0**53, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    return (vectors.filter(x.isNotNull() & F.col(id_col).isNotNull()).filter(~bad)
            .select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("v")))


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of the table as columns, largest singular value first."""
    def partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in rows:
            x = _matrix(batch.column(0), dim)
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(gram))], names=["i", "g"])

    sums = [F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(dim)]
    rows = vectors.select("v").mapInArrow(partial, "i int, g array<double>").groupBy("i").agg(*sums).collect()
    gram = np.zeros((dim, dim))
    for r in rows:
        gram[r[0]] = r[1:]
    return np.linalg.eigh(gram)[1][:, ::-1]


class Block:
    """Candidates with their rotated heads and residual lengths."""

    def __init__(self, rows: pd.DataFrame, turn: np.ndarray, head: int) -> None:
        self.rows, self.ids, self.v = rows["row"].to_numpy(), rows["id"].to_numpy(), _matrix(rows["v"], len(turn))
        self.norm = np.sqrt(np.sum(self.v**2, axis=1))
        r = self.v @ turn
        self.head, self.rest = r[:, :head], np.sqrt(np.sum(r[:, head:] ** 2, axis=1))


def _exact(q: np.ndarray, c: np.ndarray) -> list[int]:
    """Inner products of the rows of ``q`` and ``c`` in Python's whole numbers, cut to 38 digits."""
    most = 10**38 - 1
    return [max(-most, min(most, sum(int(x) * int(y) for x, y in zip(a, b)))) for a, b in zip(q.tolist(), c.tolist())]


def _search(turn: np.ndarray, head: int, k: int, large: bool):
    """``large``: scores may leave the whole numbers that doubles hold."""
    def run(key, queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "query_id", "vec_id", "score"]
        if not len(queries) or not len(cands):
            return pd.DataFrame({n: [] for n in names}).astype({n: "int64" for n in names[:3]} | ({} if large else {"score": "int64"}))
        q, c = Block(queries, turn, head), Block(cands, turn, head)
        floor = queries["floor"].to_numpy()
        bound = q.head @ c.head.T + q.rest[:, None] * c.rest[None, :] + 1e-9 * q.norm[:, None] * c.norm[None, :]
        hit = bound >= (floor - 1e-6 * (1 + np.abs(floor)))[:, None]
        hit &= q.rows[:, None] != c.rows[None, :]
        i, j = np.nonzero(hit)
        if len(i) > 0.02 * hit.size:  # too few pruned to gather pairs: one product for all of them
            score = (q.v @ c.v.T)[i, j]
        else:
            score = np.concatenate([np.einsum("nd,nd->n", q.v[i[a: a + 65536]], c.v[j[a: a + 65536]])
                                    for a in range(0, len(i), 65536)] or [np.zeros(0)])
        # in the large case scores, like the floors, are only close: nothing near a floor is let go
        slack = 1e-9 * q.norm[i] * c.norm[j] if large else 0
        good = score >= floor[i] - slack
        i, j, score = i[good], j[good], score[good]
        if large:
            order, places = [], np.searchsorted(i, np.arange(len(q.ids) + 1))
            exact = _exact(q.v[i], c.v[j])
            for a, b in zip(places[:-1], places[1:]):
                order += sorted(range(a, b), key=lambda n: (-exact[n], c.ids[j[n]]))[:k]
            order = np.array(order, np.int64)
            score = [Decimal(exact[n]) for n in order]
        else:
            order = np.lexsort((c.ids[j], -score, i))
            place = np.arange(len(i)) - np.searchsorted(i, i)
            order = order[place < k]
            score = score[order].astype(np.int64)
        i, j = i[order], j[order]
        return pd.DataFrame({"query": q.rows[i], "query_id": q.ids[i], "vec_id": c.ids[j], "score": score})

    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20,
          scale: float = 64.0, head: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every row for which ``is_query`` holds."""
    rows = integer_vectors(vectors, is_query, id_col, vector, scale)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    rows = kept(rows.withColumn("norm", norm).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    total, dim, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    large = (longest or 0.0) ** 2 >= 2.0**52
    dim = max(1, dim or 1)
    turn = rotation(rows, dim)
    head = head or max(1, dim // 4)

    # floors: the k-th best among the longest candidates, a table of at most HEAD vectors
    ahead = rows.orderBy(F.desc("norm"), "row").limit(HEAD).select("row", "v").collect()
    first = np.array([r["row"] for r in ahead], np.int64)
    lead = _matrix(pd.Series([r.v for r in ahead]), dim)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, q = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(2), dim)
            found = q @ lead.T if len(first) else np.zeros((len(q), 0))
            found[own[:, None] == first[None, :]] = -np.inf
            n = found.shape[1]
            low = np.partition(found, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
            if large:
                low = low - 1e-9 * np.sqrt(np.sum(q**2, axis=1)) * longest
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low)], names=["row", "id", "v", "norm", "floor"])

    queries = rows.filter("asks").select("row", "id", "v", "norm").mapInArrow(
        floors, "row long, id long, v array<double>, norm double, floor double")
    asked = rows.filter("asks").count()
    groups = max(1, -(-asked // QUERIES))
    queries = kept(queries.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(groups))), "topk-queries")

    # blocks by descending length: at most RANGES ranges between quantiles of the length, each dealt
    # to as many blocks as it needs
    n_ranges = min(RANGES, max(1, -(-total // BLOCK)))
    cuts = rows.approxQuantile("norm", [i / n_ranges for i in range(1, n_ranges)], 0.2 / n_ranges) if n_ranges > 1 else []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts), reverse=True)]).cast("array<double>")
    parts = rows.select("row", "id", "v", "norm", F.size(F.filter(cuts, lambda c: c > F.col("norm"))).alias("range"))
    sizes = parts.groupBy("range").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    ranges = F.array(*[F.struct(F.lit(r["range"]).alias("range"), F.lit(-(-r["n"] // BLOCK)).cast("long").alias("blocks"),
                                F.lit(float(r["longest"])).alias("longest")) for r in sizes])
    if not sizes:
        return queries.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"),
                              F.lit(0).cast("long").alias("score"))
    block = F.aggregate(ranges, F.lit(1).cast("long"), lambda a, r: F.when(r["range"] == F.col("range"), r["blocks"]).otherwise(a))
    parts = parts.withColumn("block", F.pmod(F.xxhash64("row"), block))
    # a range goes to the query blocks that it may still serve
    length = F.when(F.col("norm") > 0, F.col("norm")).otherwise(1e-300)
    need = queries.groupBy("qb").agg(F.min(F.col("floor") / length).alias("least"), F.min("floor").alias("low"))
    send = need.select("qb", F.explode(F.filter(ranges, lambda r: (F.col("low") <= 0) | (
        r["longest"] * (1 + 1e-6) >= F.col("least")))).alias("r"))
    send = kept(send.select("qb", "r.range", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r.blocks") - 1)).alias("block")),
                "topk-send")
    cands = parts.join(send.hint("merge"), ["range", "block"]).select("qb", "range", "block", "row", "id", "v")
    asks = queries.join(send.hint("merge"), "qb").select("qb", "range", "block", "row", "id", "v", "floor")
    found = (asks.groupBy("qb", "range", "block").cogroup(cands.groupBy("qb", "range", "block"))
             .applyInPandas(_search(turn, head, k, large),
                            f"query long, query_id long, vec_id long, score {'decimal(38,0)' if large else 'long'}"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    end = F.lit(2**63 - 1).cast("decimal(38,0)")
    score = F.greatest(F.least("score", end), -end - 1).cast("long") if large else F.col("score")
    return best.select("query_id", "rank", "vec_id", score.alias("score"))


def topk_query(vectors: DataFrame) -> DataFrame:
    """The contract's columns for every vector whose id is divisible by 20."""
    return top_k(vectors, F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, row_number() OVER () AS r, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum([x * c.v[i] FOR x, i IN q.v])::BIGINT AS score
  FROM usable q JOIN usable c ON q.r <> c.r WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
