"""Target profiling, previews and the row cap.

All statistics are single-pass aggregates with map-side partial aggregation; nothing gathers
a column on the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from dnaframe.functions.sequence import to_numeric

# Fixed values that must equal the reference's for right results.
IMBALANCE_BELOW = 0.35
RECOMMEND_IMBALANCED = "Consider class balancing or class-weighted training."
RECOMMEND_BALANCED = "No strong class imbalance detected."
TARGET_CANDIDATES = ["target", "label", "y", "class", "promoter", "expression", "expn_med"]
SEQUENCE_CANDIDATES = ["sequence", "seq", "variant", "dna"]
LOCAL_ROW_LIMIT = 1000


def column_for_role(columns: list[str], role_names: list[str], wanted: str | None = None) -> str | None:
    """The column that plays a role: the wanted one if it is there, else the best by name (M8, M9).

    Names are ranked by their place in ``role_names`` whatever their case; of names that differ in
    case only, the last column counts.
    """
    if wanted in columns:
        return wanted
    ranked = [(role_names.index(c.lower()), -at, c) for at, c in enumerate(columns) if c.lower() in role_names]
    return min(ranked)[2] if ranked else None


def target_column(columns: list[str], wanted: str) -> str:
    found = column_for_role(columns, TARGET_CANDIDATES, wanted)
    if found is None:
        raise ValueError(f"no column {wanted!r} and none that looks like a target among {columns}")
    return found


def with_numeric_target(df: DataFrame, target: str, out: str = "y") -> DataFrame:
    """Coerced numeric target beside the original column."""
    return df.withColumn(out, to_numeric(target))


def valid_rows(df: DataFrame, target: str, out: str = "y") -> DataFrame:
    """Rows whose target parses as a number (a plain filter, pushed below features)."""
    return with_numeric_target(df, target, out).filter(F.col(out).isNotNull())


def is_binary_expr(num_col: str = "y"):
    """P5 / A4 as an aggregate: non-empty and every numeric value in {0, 1}."""
    y = F.col(num_col)
    return (F.count(y) > 0) & F.coalesce(F.bool_and(y.isNull() | y.isin(0.0, 1.0)), F.lit(False))


def is_binary(df: DataFrame, target: str) -> DataFrame:
    """P5: one-row DataFrame ``(binary_numeric)``."""
    return with_numeric_target(df, target).agg(is_binary_expr().alias("binary_numeric"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """A1: ``(class, count)`` over non-null targets; class is the value's text in its Spark type."""
    return (df.filter(F.col(target).isNotNull())
              .groupBy(F.col(target).cast("string").alias("class"))
              .agg(F.count(F.lit(1)).alias("count")))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """A2: one row: totals, class count, binary flag, minority fraction (4 places), imbalance, advice.

    Minority fraction is over all classes, strict ``< 0.35`` on the unrounded value, null with
    fewer than 2 classes (M12). Class counts stay a table (``class_counts``): a continuous target
    has as many classes as rows, so they are never folded into one row. The numeric value is a
    function of the class text, so the binary flag (M10) comes out of the same per-class table.
    """
    per_class = (df.filter(F.col(target).isNotNull())
                   .groupBy(F.col(target).cast("string").alias("class"))
                   .agg(F.count(F.lit(1)).alias("count"), F.first(to_numeric(target)).alias("y")))
    totals = per_class.agg(
        F.sum("count").alias("total"),
        F.count(F.lit(1)).alias("class_count"),
        F.min("count").alias("_min"),
        is_binary_expr("y").alias("binary_numeric"),
    )
    frac = F.when((F.col("class_count") >= 2) & (F.col("total") > 0), F.col("_min") / F.col("total"))
    imbalanced = F.coalesce(frac < IMBALANCE_BELOW, F.lit(False))
    return totals.select(
        F.lit(target).alias("target_col"),
        F.coalesce(F.col("total"), F.lit(0)).cast("bigint").alias("row_count_with_target"),
        F.col("class_count").cast("bigint").alias("class_count"),
        "binary_numeric",
        F.round(frac, 4).alias("minority_fraction"),
        imbalanced.alias("imbalance_detected"),
        F.when(imbalanced, F.lit(RECOMMEND_IMBALANCED)).otherwise(F.lit(RECOMMEND_BALANCED)).alias("recommendation"),
    )


def dataset_profile(df: DataFrame, limit: int = LOCAL_ROW_LIMIT) -> DataFrame:
    """A3: row count and the large-dataset flag (rows above the local run limit)."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", (F.col("row_count") > limit).alias("large_dataset_warning"), F.lit(limit).alias("local_row_limit")
    )


def preview(df: DataFrame, n: int, order_by: str = "row_id", round_cols=(), digits: int = 6,
            fill_blank: bool = False) -> DataFrame:
    """First ``n`` rows by an explicit order (TakeOrderedAndProject), rounded, nulls as ''."""
    x = df
    for c in round_cols:
        x = x.withColumn(c, F.round(c, digits))
    if fill_blank:
        x = x.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != order_by else F.col(c)
                       for c in x.columns])
    return x.orderBy(order_by).limit(n)


def cap_rows(df: DataFrame, max_rows: int, order_by: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """L1: the first ``max_rows`` rows by a unique ``order_by`` key; ``max_rows <= 0`` keeps all.

    Rows without a key have no place of their own: they come after all others, in the order of their content.

    The cut key is the exact ``max_rows``-th smallest id (scale-safe order statistic), so the
    capped table is a pushed-down filter rather than a single-task top-n of unbounded size.
    Returns ``(rows, flag)`` where ``flag`` is a one-row ``(row_cap_applied)`` DataFrame.
    """
    from dnaframe.operators.quantiles import order_statistics

    flag = df.agg((F.count(F.lit(1)) > F.lit(max_rows if max_rows > 0 else 2**62)).alias("row_cap_applied"))
    if max_rows <= 0:
        return df, flag
    kind, key = df.schema[order_by].dataType, F.col(order_by)
    n, nulls = df.agg(F.count(key), F.count_if(key.isNull())).first()
    if n + nulls <= max_rows:
        return df, flag
    if n <= max_rows:
        return df.filter(key.isNotNull()).unionByName(_first_by_content(df.filter(key.isNull()), max_rows - n)), flag
    if isinstance(kind, (StringType, BinaryType)):
        word = F.hex(key) if isinstance(kind, BinaryType) else key
        return df.filter(word <= F.lit(nth_word(df, word, max_rows))), flag
    cut = order_statistics(df, order_by, {None: [max_rows]})[(None, max_rows)]
    return df.filter(key <= F.lit(cut)), flag


def _first_by_content(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows in the order of a hash of all columns; of equal rows any."""
    from dnaframe.operators.quantiles import order_statistics

    if n <= 0:
        return df.limit(0)
    rows = df.withColumn("_h", F.xxhash64(F.to_json(F.struct("*"))))
    cut = order_statistics(rows, "_h", {None: [n]})[(None, n)]
    below = rows.filter(F.col("_h") < cut)
    return below.unionByName(rows.filter(F.col("_h") == cut).limit(n - below.count())).drop("_h")


def nth_word(df: DataFrame, word: Column, n: int, most: int = 10_000) -> str:
    """The ``n``-th smallest (from 1) of the non-null strings ``word``, at any size and any spread.

    The words are narrowed like a walk down a prefix tree: those with the prefix found so far are counted by
    their next two characters (combined before the exchange), and the group that holds the n-th gives the next
    prefix, as far as all of its words agree. At most ``most`` words, or one repeated word, end the walk.
    """
    prefix = ""
    words = df.select(word.alias("w")).filter("w is not null")
    while True:
        here = words.filter(F.col("w").startswith(prefix)) if prefix else words
        groups = here.groupBy(F.substring("w", len(prefix) + 1, 2).alias("next")).agg(
            F.count(F.lit(1)).alias("n"), F.min("w").alias("low"), F.max("w").alias("high"))
        upto = F.sum("n").over(Window.orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = groups.withColumn("upto", upto).filter(F.col("upto") >= n).orderBy("upto").first()
        n -= found["upto"] - found["n"]
        if found["low"] == found["high"]:
            return found["low"]
        inside = here.filter((F.col("w") >= F.lit(found["low"])) & (F.col("w") <= F.lit(found["high"])))
        if found["n"] <= most:
            return sorted(r[0] for r in inside.collect())[n - 1]
        prefix = os.path.commonprefix([found["low"], found["high"]])
        words = inside


def describe(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles (linear interpolation), max per column.

    Moments come from one aggregate pass; quartiles from scale-safe order statistics. The
    result has one row per described column.
    """
    from dnaframe.operators.quantiles import exact_quantiles

    spark = df.sparkSession
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"count{i}"), F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"),
                 F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")]
    m = df.agg(*aggs).first()  # moments of every column in one pass
    # quartiles of all columns in the same passes: stack them as (column, value) groups
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v"))
                                            for c in cols])))
    q = exact_quantiles(stacked, "_v", [0.25, 0.5, 0.75], group_col="_c")
    rows = []
    for i, c in enumerate(cols):
        rows.append((c, m[f"count{i}"], m[f"mean{i}"], m[f"std{i}"], m[f"min{i}"], q.get((c, 0.25)), q.get((c, 0.5)),
                     q.get((c, 0.75)), m[f"max{i}"]))
    schema = ("column string, count bigint, mean double, std double, min double, q25 double, q50 double, "
              "q75 double, max double")
    out = spark.createDataFrame(rows, schema)
    return out.select("column", "count", *[F.round(x, digits).alias(x) for x in
                                           ("mean", "std", "min", "q25", "q50", "q75", "max")])
