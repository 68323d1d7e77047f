"""Exact-size seeded sampling and splitting without a one-partition sort.

Every row gets the key ``md5(seed:row_id)``. "The first c rows in seeded order" is the set of
rows whose key is at most the c-th smallest key. That key is found with a histogram over the
first 4 hex digits of the hash (65536 buckets per group, map-side combined, kept in Spark; a
cumulative window finds the bucket holding the c-th row and only that row reaches the driver),
then a rank inside that one bucket (about rows / 65536 rows). Beyond ~65 billion rows a second
histogram level over 8 hex digits narrows the bucket first. Tagging is then a narrow projection
that compares each key with a few literals: no exchange, no global sort, and the same rows
under any partitioning.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnaframe.functions.hashing import rank_hash
from dnaframe.functions.sequence import to_numeric

_LEVELS = (4, 8)  # hex digits per histogram level
RANK_DIRECTLY = 1_000_000  # a boundary bucket up to this size is ranked without another level
ALL = "all"
NONE = "none"


def _key_frame(df: DataFrame, seed, row_id: str, group: Column | None = None) -> DataFrame:
    g = group if group is not None else F.lit(0)
    return df.select(g.alias("_g"), rank_hash(seed, row_id).alias("_h"), F.col(row_id).alias("_rid"))


def _or_all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def _locate(hist: DataFrame, tasks: list) -> None:
    """For every task ``[g, cut, prefix, residual]`` find the bucket of ``hist`` (``_g, _b,
    count``; only buckets under ``prefix``) that holds its residual-th row, by a cumulative
    window over the small histogram. Only one row per task reaches the driver."""
    w = Window.partitionBy("_g", "_parent").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plen = len(tasks[0][2])
    cum = hist.withColumn("_parent", F.substring("_b", 1, plen) if plen else F.lit("")) \
              .withColumn("_cum", F.sum("count").over(w))
    hit = _or_all([(F.col("_g") == F.lit(g)) & (F.col("_parent") == F.lit(p)) & (F.col("_cum") >= F.lit(res))
                   & (F.col("_cum") - F.col("count") < F.lit(res)) for g, _, p, res in tasks])
    found = {}
    for r in cum.filter(hit).collect():
        found.setdefault((r["_g"], r["_parent"]), []).append((r["_cum"] - r["count"], r["_cum"], r["_b"]))
    for t in tasks:
        for before, upto, b in found[(t[0], t[2])]:
            if before < t[3] <= upto:
                t[2], t[3] = b, t[3] - before
                break


def find_thresholds(keyed: DataFrame, cuts) -> tuple[dict, dict]:
    """Key of the c-th smallest row for every group and cut.

    ``keyed`` has ``_g, _h, _rid``; ``cuts`` maps group -> list of counts, or is a callable
    that builds that map from the group sizes (so one histogram pass gives sizes and cuts).
    Returns ``({(g, c): (h, rid) | ALL | NONE}, {g: rows})``. The driver receives the group
    sizes and one row per cut and level, never a whole histogram.
    """
    from pyspark import StorageLevel

    result: dict = {}
    hist = keyed.groupBy("_g", F.substring("_h", 1, _LEVELS[0]).alias("_b")).count() \
                .persist(StorageLevel.MEMORY_AND_DISK)  # at most 65536 rows per group
    try:
        totals = {r["_g"]: r["n"] for r in hist.groupBy("_g").agg(F.sum("count").alias("n")).collect()}
        if callable(cuts):
            cuts = cuts(dict(totals))
        tasks = []  # [g, cut, prefix, residual]
        for g, cs in cuts.items():
            for c in cs:
                if c <= 0:
                    result[(g, c)] = NONE
                elif c >= totals.get(g, 0):
                    result[(g, c)] = ALL
                else:
                    tasks.append([g, c, "", c])
        if tasks:
            _locate(hist, tasks)
            sizes = hist.filter(_or_all([(F.col("_g") == F.lit(t[0])) & (F.col("_b") == F.lit(t[2])) for t in tasks])) \
                        .agg(F.max("count")).first()[0]
    finally:
        hist.unpersist()
    final_plen = _LEVELS[0]
    if tasks and sizes > RANK_DIRECTLY:
        # second level inside the boundary buckets only
        final_plen = _LEVELS[1]
        wanted = {(t[0], t[2]) for t in tasks}
        cond = _or_all([(F.col("_g") == F.lit(g)) & F.col("_h").startswith(p) for g, p in wanted])
        hist2 = keyed.filter(cond).groupBy("_g", F.substring("_h", 1, final_plen).alias("_b")).count()
        _locate(hist2, tasks)
    if tasks:
        plen = final_plen
        wanted = {(t[0], t[2]) for t in tasks}
        cond = _or_all([(F.col("_g") == F.lit(g)) & (F.substring("_h", 1, plen) == p) for g, p in wanted])
        w = Window.partitionBy("_g", F.substring("_h", 1, plen)).orderBy("_h", "_rid")
        ranked = keyed.filter(cond).withColumn("_p", F.substring("_h", 1, plen)).withColumn("_rn", F.row_number().over(w))
        pick = _or_all([(F.col("_g") == F.lit(t[0])) & (F.col("_p") == t[2]) & (F.col("_rn") == t[3]) for t in tasks])
        found = {(r["_g"], r["_p"], r["_rn"]): (r["_h"], r["_rid"]) for r in ranked.filter(pick).collect()}
        for g, c, p, residual in tasks:
            result[(g, c)] = found[(g, p, residual)]
    return result, dict(totals)


def _at_or_below(threshold, h: Column, rid: Column) -> Column:
    if threshold == ALL:
        return F.lit(True)
    if threshold == NONE:
        return F.lit(False)
    th, trid = threshold
    return (h < F.lit(th)) | ((h == F.lit(th)) & (rid <= F.lit(trid)))


def _per_group(group: Column | None, thresholds_by_group: dict, h: Column, rid: Column) -> Column:
    """Condition ``key <= threshold(group)``, a CASE over the (few) groups."""
    if group is None:
        return _at_or_below(next(iter(thresholds_by_group.values())), h, rid)
    expr = None
    for g, th in thresholds_by_group.items():
        cond = _at_or_below(th, h, rid)
        expr = F.when(group == F.lit(g), cond) if expr is None else expr.when(group == F.lit(g), cond)
    return expr.otherwise(F.lit(False)) if expr is not None else F.lit(False)


def holdout_sizes(n: int, test_size: float, validation_size: float = 0.0) -> tuple[int, int, int]:
    """test = ceil(t*n) in DOUBLE arithmetic, validation = ceil(v*n), train = the rest."""
    n_test = int(math.ceil(float(test_size) * n)) if n else 0
    n_val = int(math.ceil(float(validation_size) * n)) if (n and validation_size) else 0
    n_val = min(n_val, n - n_test)
    return n - n_test - n_val, n_val, n_test


def holdout_split(df: DataFrame, test_size: float, seed: int, row_id: str = "row_id",
                  validation_size: float = 0.0, out: str = "split") -> DataFrame:
    """Exact-size seeded split; ``out`` is 'test', 'validation' or 'train'.

    The first ceil(t*n) rows in seeded order are test, the next ceil(v*n) validation.
    """
    keyed = _key_frame(df, seed, row_id)
    sizes = {}

    def cuts(totals):
        _, n_val, n_test = holdout_sizes(totals.get(0, 0), test_size, validation_size)
        sizes.update(n_val=n_val, n_test=n_test)
        return {0: [n_test, n_test + n_val]}

    th, _ = find_thresholds(keyed, cuts)
    n_val, n_test = sizes["n_val"], sizes["n_test"]
    h, rid = rank_hash(seed, row_id), F.col(row_id)
    tag = F.when(_at_or_below(th[(0, n_test)], h, rid), F.lit("test"))
    if n_val:
        tag = tag.when(_at_or_below(th[(0, n_test + n_val)], h, rid), F.lit("validation"))
    return df.withColumn(out, tag.otherwise(F.lit("train")))


def kfold_sizes(n: int, k: int) -> list[int]:
    """Fold sizes of a shuffled k-fold: the first n % k folds hold one row more."""
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


def kfold(df: DataFrame, k: int, seed: int, row_id: str = "row_id", out: str = "fold") -> DataFrame:
    """Exact-size seeded folds 0..k-1 (contiguous blocks of the seeded order)."""
    if k < 2:
        raise ValueError("k must be >= 2")
    keyed = _key_frame(df, seed, row_id)
    cut_list: list[int] = []

    def cuts(totals):
        sizes = kfold_sizes(totals.get(0, 0), k)
        cut_list.extend(sum(sizes[: i + 1]) for i in range(k - 1))
        return {0: cut_list}

    th, _ = find_thresholds(keyed, cuts)
    h, rid = rank_hash(seed, row_id), F.col(row_id)
    fold = reduce(lambda a, b: a + b, [F.when(_at_or_below(th[(0, c)], h, rid), 0).otherwise(1) for c in cut_list])
    return df.withColumn(out, fold.cast("int"))


def repeated_holdout(df: DataFrame, test_size: float, seeds: list[int], row_id: str = "row_id") -> DataFrame:
    """One exact split per seed; ``(seed, ..., split)``, one line per (seed, row).

    The seeds are a literal array expanded with a generator, not a cross join.
    """
    x = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    seed_col = F.col("seed")
    keyed = x.select(seed_col.alias("_g"), rank_hash(seed_col, row_id).alias("_h"), F.col(row_id).alias("_rid"))
    chosen: dict = {}

    def cuts(totals):
        chosen.update({int(s): holdout_sizes(totals.get(int(s), 0), test_size)[2] for s in seeds})
        return {g: [c] for g, c in chosen.items()}

    th, _ = find_thresholds(keyed, cuts)
    by_group = {g: th[(g, c)] for g, c in chosen.items()}
    is_test = _per_group(seed_col, by_group, rank_hash(seed_col, row_id), F.col(row_id))
    return x.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def split_manifest(df: DataFrame, seed: int, test_size: float, validation_size: float = 0.0,
                   folds: int = 5, row_id: str = "row_id") -> DataFrame:
    """``(row_id, seed, split, fold)``; write it once, models join it on row_id."""
    base = df.select(row_id)
    tagged = holdout_split(base, test_size, seed, row_id, validation_size)
    tagged = kfold(tagged, folds, seed, row_id)
    return tagged.select(row_id, F.lit(int(seed)).alias("seed"), "split", "fold")


def save_split_manifest(manifest: DataFrame, path: str) -> None:
    """Persist a manifest ``(row_id, seed, split, fold)``, one partition per seed (rewriting
    a seed replaces only that seed's rows)."""
    (manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("seed").parquet(path))


def load_split_manifest(spark, path: str, seed: int) -> DataFrame:
    """The saved manifest of one seed (partition pruning on seed)."""
    return spark.read.parquet(path).filter(F.col("seed") == int(seed))


def provided_split(train: DataFrame, validation: DataFrame | None, test: DataFrame) -> DataFrame:
    """Three given tables as one with a ``split`` literal."""
    parts = [train.withColumn("split", F.lit("train")), test.withColumn("split", F.lit("test"))]
    if validation is not None:
        parts.insert(1, validation.withColumn("split", F.lit("validation")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def undersample(df: DataFrame, target: str, seed: int, strategy: str = "undersample",
                row_id: str = "row_id", imbalance_below: float = 0.35) -> tuple[DataFrame, bool]:
    """B1 / B2: cut each class of a binary target to the minority size, seeded.

    Returns ``(rows, applied)``. Follows M14: nothing unless the strategy asks for it and the
    numeric target is binary with both classes; ``auto_undersample`` only when the minority
    share is below 0.35; null / unparsable targets are dropped when applied. The kept majority
    rows are those with the smallest ``md5(seed:row_id)``: a narrow filter, no per-class sort.
    """
    if strategy not in {"undersample", "auto_undersample"} or target not in df.columns:
        return df, False
    y = to_numeric(target)
    # one histogram pass over (class, hash prefix) gives the class sizes, the binary check
    # (any other numeric value lands in group -1) and the buckets of the majority class
    klass = F.when(y.isin(0.0, 1.0), y.cast("int")).otherwise(F.lit(-1))
    keyed = df.filter(y.isNotNull()).select(klass.alias("_g"), rank_hash(seed, row_id).alias("_h"),
                                            F.col(row_id).alias("_rid"))
    plan: dict = {}

    def cuts(totals):
        n0, n1 = totals.get(0, 0), totals.get(1, 0)
        if totals.get(-1, 0) or n0 == 0 or n1 == 0:
            return {}
        if strategy == "auto_undersample" and min(n0, n1) / (n0 + n1) >= imbalance_below:
            return {}
        plan.update(keep=min(n0, n1), major=0 if n0 > n1 else 1)
        return {plan["major"]: [plan["keep"]]}

    th, _ = find_thresholds(keyed, cuts)
    if not plan:
        return df, False
    major, keep = plan["major"], plan["keep"]
    kept_major = _at_or_below(th[(major, keep)], rank_hash(seed, row_id), F.col(row_id))
    out = df.filter(y.isNotNull() & ((y != F.lit(float(major))) | kept_major))
    return out, True


def seeded_order(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """Rows in seeded random order (a distributed range-partitioned sort)."""
    return df.orderBy(rank_hash(seed, row_id), F.col(row_id))


def seeded_rank(df: DataFrame, seed: int, row_id: str = "row_id", out: str = "rank") -> DataFrame:
    """The row's place, from 1, in seeded random order, without sorting all rows in one task.

    The order's first four hex digits cut it into 65536 stretches; a row's place is the sum of the
    stretches before its own, one row each, plus its place in its stretch.
    """
    key = rank_hash(seed, row_id)
    rows = df.withColumn("_k", key).withColumn("_s", F.substring("_k", 1, 4))
    sizes = rows.groupBy(F.col("_s").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_s").orderBy("_k", row_id))
    return (rows.withColumn("_in", inside).join(sizes, F.col("_s") == F.col("_of"))
            .withColumn(out, (F.col("_base") + F.col("_in")).cast("bigint")).drop("_k", "_s", "_in", "_of", "_base"))


def class_balanced_sample(df: DataFrame, target: str, seed: int, row_id: str = "row_id") -> DataFrame:
    """B1 + B3 in one call: balanced rows in seeded order."""
    rows, _ = undersample(df, target, seed, "undersample", row_id)
    return seeded_order(rows, seed, row_id)
