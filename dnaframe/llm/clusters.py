"""(13) Centroid clustering with equal-average equal-variance search.

k-means over whole-number vectors. The centroids are sorted by component mean. A vector's search starts at
its own mean and goes outward, nearer mean first, with two tests against the best distance so far:

* d times the squared difference of the means is a lower bound of the squared distance. When it is
  above the best, so it is for all centroids further out on both sides: the search ends;
* that bound plus the squared difference of the deviations (the lengths of the vectors less their
  means) is one too. When it is above the best, this centroid is passed over.

Both bounds are doubles that give way by more than their rounding; what they leave gets its distance in
whole numbers, so clusters, ties (the smaller number) and distances are exact. A round is one pass over
the vectors: every task sums its vectors per centroid, Spark adds the sums up, and the driver receives
one number per centroid and component. Sums travel in digits of 32 bits and are exact at any size.
The driver and the tasks hold the centroids, ``k`` rows; nothing else leaves Spark.

Components become floor(``scale`` * x). Vectors take part if they have exactly ``dim`` components, none
null and none whose product is not finite; all others have no row in the result. The first centroids are
the vectors with the smallest ``sha256("<seed>:<id>")``; a null id comes last, of equal ids the smaller
vector comes first. Fewer than ``k`` vectors give as many centroids. Rows of one id, and equal rows, are
vectors of their own. Squared distances and their sums above 2**63 - 1 are returned as that number. Empty
tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnaframe.llm.common import kept

#: Below this every difference squares and sums up within 64 bits (for up to 64 components); above it Python's numbers take over.
_PLAIN = 1 << 27
_MOST = 2**63 - 1


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers, or as Python's if they are too large."""
    x = np.floor(scale * x.astype(np.float64))
    if x.size and np.abs(x).max() >= _PLAIN or x.shape[1] > 64:
        return np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)
    return x.astype(np.int64)


class Search:
    """Nearest centroids by means and deviations; ``compared`` counts the exact distances taken."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.plain = all(abs(c) < _PLAIN for row in centroids for c in row)
        c = np.array(centroids, object)
        self.total, self.spread, self.size = self._stats(c)
        self.number = np.argsort(self.total, kind="stable")
        self.total, self.spread = self.total[self.number], self.spread[self.number]
        self.rows = c[self.number]
        self.compared = 0

    @staticmethod
    def _stats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums, deviations, and sums of absolute values."""
        f = x.astype(np.float64)
        total = f.sum(axis=1)
        return total, np.sqrt(((f - total[:, None] / f.shape[1]) ** 2).sum(axis=1)), np.abs(f).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of every row of ``x``."""
        plain = self.plain and x.dtype == np.int64
        cents = self.rows.astype(np.int64) if plain else self.rows
        x = x if plain else x.astype(object)
        n, dim, k = len(x), x.shape[1], len(cents)
        total, spread, size = self._stats(x)
        slack = 1e-12 * (size + self.size.max())
        best = np.full(n, np.inf)
        exact = np.zeros(n, x.dtype)
        cluster = np.full(n, k)
        right = np.searchsorted(self.total, total)
        left = right - 1
        live = np.arange(n)
        while len(live):
            lo, hi = left[live], right[live]
            down = np.where(lo >= 0, total[live] - self.total[np.maximum(lo, 0)], np.inf)
            up = np.where(hi < k, self.total[np.minimum(hi, k - 1)] - total[live], np.inf)
            below = down <= up
            at = np.where(below, lo, hi)
            left[live[below]] -= 1
            right[live[~below]] += 1
            bound = np.maximum(0, np.minimum(down, up) - slack[live]) ** 2 / dim
            limit = best[live] * (1 + 1e-9) + 0.5  # distances are whole: half a unit tells them apart
            go = bound <= np.where(np.isinf(limit), np.finfo(float).max, limit)
            live, at, bound, limit = live[go], at[go], bound[go], limit[go]
            apart = np.maximum(0, np.abs(spread[live] - self.spread[at]) - 2 * slack[live])
            close = bound + apart**2 <= limit
            row, at = live[close], at[close]
            diff = x[row] - cents[at]
            dist = (diff * diff).sum(axis=1)
            self.compared += len(row)
            number = self.number[at]
            seen = cluster[row] < k
            better = ~seen | (dist < exact[row]) | ((dist == exact[row]) & (number < cluster[row]))
            row, better = row[better], np.flatnonzero(better)
            exact[row], cluster[row] = dist[better], number[better]
            best[row] = dist[better].astype(np.float64)
        return cluster, exact


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _sums(centroids: list[list[int]], dim: int, scale: float):
    """Rows (cluster, place, digit, value): a task's sums per centroid, the count at place -1."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        sums = np.zeros((len(centroids), dim + 1), object)
        for b in rows:
            x = whole(_vectors(b.column(0), dim), scale)
            cluster, _ = search.nearest(x)
            part = np.zeros((len(centroids), dim + 1), x.dtype)
            np.add.at(part[:, 1:], cluster, x)
            part[:, 0] = np.bincount(cluster, minlength=len(centroids))
            sums = sums + part.astype(object)
        out = []
        for (c, j), value in np.ndenumerate(sums):
            sign, value, digit = (-1 if value < 0 else 1), abs(int(value)), 0
            while value:
                out.append((c, j - 1, digit, sign * (value & 0xFFFFFFFF)))
                value, digit = value >> 32, digit + 1
        cols = np.array(out, np.int64).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cluster", "place", "digit", "value"])

    return run


def moved(vectors: DataFrame, centroids: list[list[int]], scale: float) -> list[list[int]]:
    """The centroids after one round over ``vectors`` (column v)."""
    dim = len(centroids[0])
    parts = vectors.select("v").mapInArrow(_sums(centroids, dim, scale), "cluster long, place long, digit long, value long")
    sums: dict[tuple[int, int], int] = {}
    for c, j, digit, value in parts.groupBy("cluster", "place", "digit").agg(F.sum("value")).collect():
        sums[c, j] = sums.get((c, j), 0) + (value << (32 * digit))
    return [[sums.get((c, j), 0) // sums[c, -1] for j in range(dim)] if sums.get((c, -1)) else row for c, row in enumerate(centroids)]


def _assigned(centroids: list[list[int]], dim: int, scale: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for b in rows:
            cluster, dist = search.nearest(whole(_vectors(b.column(1), dim), scale))
            dist = pa.array([min(int(d), _MOST) for d in dist.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), dist], names=["id", "cluster", "distance"])

    return run


def usable_vectors(vectors: DataFrame, id_col: str, vector: str, dim: int, scale: float) -> DataFrame:
    """id, v: the vectors that take part."""
    x = F.col(vector)
    fine = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (
        F.abs(F.lit(float(scale)) * c.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def k_means(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64,
            scale: float = 1024.0, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance of every vector that takes part; the final centroids)."""
    rows = kept(usable_vectors(vectors, id_col, vector, dim, scale), "clusters-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    centroids = [[int(c) for c in whole(np.array([r.v]), scale)[0].tolist()] for r in first]
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    found = rows.mapInArrow(_assigned(centroids, dim, scale), "id long, cluster int, distance long")
    return kept(found, "clusters-found"), centroids


def clusters_query(vectors: DataFrame) -> DataFrame:
    """The contract's columns for every vector that takes part."""
    found, centroids = k_means(vectors)
    by = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("string")).collect())
    inertia = {c: int(x) for c, x in by.items()}
    each = F.array(*[F.lit(min(inertia.get(c, 0), _MOST)).cast("long") for c in range(len(centroids))]).cast("array<long>")
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]).cast("array<string>")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"),
                        F.lit(min(sum(inertia.values()), _MOST)).cast("long").alias("inertia"),
                        F.get(names, F.col("cluster")).alias("centroid_sha256"))


def _oracle(k: int = 8, rounds: int = 10) -> str:
    steps = []
    for i in range(rounds + 1):
        # the pair (distance, number) as one number: its minimum is the nearest, ties to the smaller
        steps.append(f"""d{i} AS MATERIALIZED (
  SELECT r, min(list_sum([(x - c.v[i]) * (x - c.v[i]) FOR x, i IN k.v])::BIGINT * {k} + c.c) AS best FROM k, c{i} c GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY j) AS v FROM (
      SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (
        SELECT best % {k} AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM d{i} JOIN k USING (r))
      GROUP BY c, j) GROUP BY c) n USING (c)
)""")
    return f"""WITH k AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM k ORDER BY h LIMIT {k})
), {", ".join(steps)}
SELECT vec_id, (best % {k})::INTEGER AS cluster, best // {k} AS distance,
       (sum(best // {k}) OVER (PARTITION BY best % {k}))::BIGINT AS cluster_inertia, (sum(best // {k}) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM d{rounds} JOIN k USING (r) JOIN c{rounds} c ON c.c = best % {k}"""


ORACLE_SQL = _oracle()
