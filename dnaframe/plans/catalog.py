"""Registered queries: one per operator of the inventory, each with a DuckDB oracle where SQL can
express it. Every query reads the given tables through the fixture views (whole tables, whole
texts) so its work grows with them.

Doubles that come out of sums or ratios are rounded to 6 places on both sides (H6).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnaframe.functions.sequence import NUMERIC_TEXT, STRIP_CHARS, gc_content, normalize, pad
from dnaframe.operators import features as feat
from dnaframe.operators import metrics as met
from dnaframe.operators import profile as prof
from dnaframe.operators import sampling as smp
from dnaframe.operators import thresholds as thr
from dnaframe.plans import fixtures as fx
from dnaframe.plans.fixtures import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---- SQL building blocks (DuckDB dialect) ----------------------------------------------------

def norm_sql(x: str) -> str:
    """F1 in DuckDB: its upper() keeps 'ß', so expand it first (H3)."""
    return (f"regexp_replace(trim(upper(replace(coalesce({x}, ''), 'ß', 'ss')), '{STRIP_CHARS}'), "
            f"'[^ACGTN]', 'N', 'g')")


def gc_sql(s: str) -> str:
    return (f"CASE WHEN length({s}) = 0 THEN 0.0 ELSE "
            f"(length({s}) - length(replace(replace({s}, 'G', ''), 'C', ''))) / length({s}) END")


def pad_sql(s: str, L: int) -> str:
    p = f"({L} - length({s}))"
    left = f"({p} // 2 + CASE WHEN {p} % 2 = 1 AND {L % 2} = 1 THEN 1 ELSE 0 END)"
    return (f"CASE WHEN length({s}) > {L} THEN substring({s}, (length({s}) - {L}) // 2 + 1, {L}) "
            f"ELSE repeat('N', {left}) || {s} || repeat('N', {p} - {left}) END")


def slot_sql(kmer: str, k: int) -> str:
    terms = [f"(instr('ACGT', substring({kmer}, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k)]
    return "(" + " + ".join(terms) + ")"


def kmer_windows_sql(src: str, k: int, ids: str = "row_id") -> str:
    """Rows (ids, s, kmer) for every window without N."""
    return f"""(SELECT {ids}, s, kmer FROM (
    SELECT {ids}, s, substring(s, i, {k}) AS kmer FROM (
        SELECT {ids}, s, unnest(generate_series(1, length(s) - {k} + 1)) AS i
        FROM (SELECT {ids}, {norm_sql('sequence')} AS s FROM {src}) n
        WHERE length(s) >= {k}) w) x
  WHERE instr(kmer, 'N') = 0)"""


def rank_sql(seed, row_id: str = "row_id") -> str:
    return f"md5('{seed}' || ':' || CAST({row_id} AS VARCHAR))"


# ---- flagship: normalise -> GC -> per-label profile -------------------------------------------

def gc_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.seqs(spark, sf_dir).select("label", gc_content(normalize("sequence")).alias("gc"))
    return s.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("gc"), 6).alias("mean_gc"),
        F.round(F.min("gc"), 6).alias("min_gc"),
        F.round(F.max("gc"), 6).alias("max_gc"),
    )


query("gc_by_label", with_fixtures(f"""
SELECT label, count(*) AS n, round(avg(gc), 6) AS mean_gc, round(min(gc), 6) AS min_gc,
       round(max(gc), 6) AS max_gc
FROM (SELECT label, {gc_sql('s')} AS gc FROM (SELECT label, {norm_sql('sequence')} AS s FROM seqs) a) b
GROUP BY label""", "seqs"))(gc_by_label)


# ---- F1-F8 sequence functions ----------------------------------------------------------------

@query("normalize_text", with_fixtures(f"""
SELECT row_id, s AS sequence, CAST(length(s) AS INTEGER) AS length
FROM (SELECT row_id, {norm_sql('sequence')} AS s FROM seqs_dirty) a""", "seqs_dirty"))
def normalize_text(spark, sf_dir):
    d = fx.seqs_dirty(spark, sf_dir).select("row_id", normalize("sequence").alias("sequence"))
    return d.select("row_id", "sequence", F.length("sequence").alias("length"))


@query("pad_trim", with_fixtures(f"""
SELECT row_id, {pad_sql('s', 151)} AS padded
FROM (SELECT row_id, {norm_sql('sequence')} AS s FROM seqs_dirty) a""", "seqs_dirty"))
def pad_trim(spark, sf_dir):
    d = fx.seqs_dirty(spark, sf_dir)
    return d.select("row_id", pad(normalize("sequence"), 151).alias("padded"))


@query("gc_content", with_fixtures(f"""
SELECT row_id, round({gc_sql('s')}, 6) AS gc_content
FROM (SELECT row_id, {norm_sql('sequence')} AS s FROM seqs_mid) a""", "seqs_mid"))
def gc_content_q(spark, sf_dir):
    d = fx.seqs_mid(spark, sf_dir)
    return d.select("row_id", F.round(gc_content(normalize("sequence")), 6).alias("gc_content"))


def _kmer_long_sql(src: str, k: int) -> str:
    return f"""
SELECT row_id, kmer, CAST({slot_sql('kmer', k)} AS INTEGER) AS slot, count(*) AS n,
       round(count(*) / max(greatest(length(s) - {k} + 1, 1)), 6) AS freq
FROM {kmer_windows_sql(src, k)} w
GROUP BY row_id, kmer"""


@query("kmer_counts", with_fixtures(_kmer_long_sql("seqs", 3), "seqs"))
def kmer_counts(spark, sf_dir):
    x = feat.kmer_long(fx.seqs(spark, sf_dir), 3)
    return x.select("row_id", "kmer", "slot", "n", F.round("freq", 6).alias("freq"))


@query("kmer_counts_text", with_fixtures(_kmer_long_sql("seqs_dirty", 4), "seqs_dirty"))
def kmer_counts_text(spark, sf_dir):
    x = feat.kmer_long(fx.seqs_dirty(spark, sf_dir), 4)
    return x.select("row_id", "kmer", "slot", "n", F.round("freq", 6).alias("freq"))


@query("kmer_spectrum", with_fixtures(f"""
SELECT kmer, CAST({slot_sql('kmer', 6)} AS INTEGER) AS slot, count(*) AS n, count(DISTINCT row_id) AS rows
FROM {kmer_windows_sql('seqs_long', 6)} w
GROUP BY kmer""", "seqs_long"))
def kmer_spectrum(spark, sf_dir):
    return feat.kmer_spectrum(fx.seqs_long(spark, sf_dir), 6)


@query("kmer_row_totals", with_fixtures(f"""
SELECT a.row_id, CAST(length(a.s) AS INTEGER) AS length, CAST(greatest(length(a.s) - 5, 1) AS INTEGER) AS windows,
       coalesce(w.acgt_windows, 0) AS acgt_windows, coalesce(w.distinct_kmers, 0) AS distinct_kmers
FROM (SELECT row_id, {norm_sql('sequence')} AS s FROM seqs_dirty) a
LEFT JOIN (SELECT row_id, count(*) AS acgt_windows, count(DISTINCT kmer) AS distinct_kmers
           FROM {kmer_windows_sql('seqs_dirty', 6)} x GROUP BY row_id) w
ON a.row_id = w.row_id""", "seqs_dirty"))
def kmer_row_totals(spark, sf_dir):
    return feat.kmer_row_totals(fx.seqs_dirty(spark, sf_dir), 6)


@query("one_hot_positions", with_fixtures(f"""
SELECT row_id, CAST(i - 1 AS INTEGER) AS pos, substring(p, i, 1) AS base,
       CAST(5 * (i - 1) + instr('ACGTN', substring(p, i, 1)) - 1 AS INTEGER) AS idx
FROM (SELECT row_id, p, unnest(generate_series(1, 80)) AS i
      FROM (SELECT row_id, {pad_sql(norm_sql('sequence'), 80)} AS p FROM seqs) a) b""", "seqs"))
def one_hot_positions(spark, sf_dir):
    return feat.one_hot_long(fx.seqs(spark, sf_dir), 80)


@query("kmer_vector_stats", with_fixtures(f"""
SELECT a.row_id, coalesce(w.nnz, 0) AS nnz, round(coalesce(w.total, 0), 6) AS total
FROM seqs a LEFT JOIN (
  SELECT row_id, count(DISTINCT kmer) AS nnz, count(*) / max(greatest(length(s) - 2, 1)) AS total
  FROM {kmer_windows_sql('seqs', 3)} k GROUP BY row_id) w
ON a.row_id = w.row_id""", "seqs"))
def kmer_vector_stats(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    v = feat.kmer_vector(fx.seqs(spark, sf_dir), 3, "sequence", True, normalized=False)
    arr = vector_to_array("kmer_vec")
    return v.select(
        "row_id",
        F.size(F.filter(arr, lambda x: x != 0)).cast("bigint").alias("nnz"),
        F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query("feature_frame_stats", with_fixtures(f"""
SELECT a.row_id, 1 + 16 + 100 AS width,
       round({gc_sql(norm_sql('a.sequence'))} + coalesce(w.total, 0) + 20, 6) AS total
FROM seqs a LEFT JOIN (
  SELECT row_id, count(*) / max(greatest(length(s) - 1, 1)) AS total
  FROM {kmer_windows_sql('seqs', 2)} k GROUP BY row_id) w
ON a.row_id = w.row_id""", "seqs"))
def feature_frame_stats(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    cfg = feat.FeatureConfig(use_gc=True, use_kmers=True, kmer_size=2, use_one_hot=True, sequence_length=20)
    f = feat.build_features(fx.seqs(spark, sf_dir), "sequence", cfg)
    arr = vector_to_array("features")
    return f.select("row_id", F.size(arr).alias("width"),
                    F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# ---- P3-P8, A1-A4, A14, L1 -----------------------------------------------------------------

@query("numeric_tokens", f"""
SELECT doc_id AS row_id, count(t) AS tokens, count(v) AS numeric_tokens, min(v) AS numeric_min, max(v) AS numeric_max
FROM (SELECT doc_id, t, CASE WHEN regexp_full_match(t, '{NUMERIC_TEXT}') AND NOT isnan(TRY_CAST(trim(t) AS DOUBLE))
                             THEN TRY_CAST(trim(t) AS DOUBLE) END AS v
      FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS t FROM documents) a
      WHERE t <> '') b
GROUP BY doc_id""")
def numeric_tokens(spark, sf_dir):
    """P3 over every whitespace token of every document: how many parse, and their range."""
    from dnaframe.functions.sequence import to_numeric

    d = fx.table(spark, sf_dir, "documents")
    toks = F.filter(F.split(F.col("text"), "[ \\t\\n\\r]+"), lambda t: t != "")
    x = d.select(F.col("doc_id").alias("row_id"), toks.alias("toks"))
    x = x.select("row_id", F.size("toks").cast("bigint").alias("tokens"),
                 F.filter(F.transform("toks", lambda t: to_numeric(t)), lambda v: v.isNotNull()).alias("nums"))
    x = x.filter(F.col("tokens") > 0)
    return x.select("row_id", "tokens", F.size("nums").cast("bigint").alias("numeric_tokens"),
                    F.array_min("nums").alias("numeric_min"), F.array_max("nums").alias("numeric_max"))


def _dirty_target(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    return o.select(F.col("o_orderkey").alias("row_id"), text.alias("target"))


@query("valid_targets", """
SELECT o_orderkey AS row_id, o_totalprice AS y FROM orders WHERE o_orderstatus <> 'P'""")
def valid_targets(spark, sf_dir):
    return prof.valid_rows(_dirty_target(spark, sf_dir), "target").select("row_id", "y")


@query("binary_flags", with_fixtures("""
SELECT 'seqs.label' AS target, count(label) > 0 AND bool_and(label IN (0, 1)) AS binary_numeric FROM seqs
UNION ALL
SELECT 'seqs_mid.target', count(target) > 0 AND bool_and(target IN (0, 1)) FROM seqs_mid
UNION ALL
SELECT 'labels.toxic', count(toxic) > 0 AND bool_and(toxic IN (0, 1)) FROM labels""", "seqs", "seqs_mid"))
def binary_flags(spark, sf_dir):
    a = prof.is_binary(fx.seqs(spark, sf_dir), "label").select(F.lit("seqs.label").alias("target"), "binary_numeric")
    b = prof.is_binary(fx.seqs_mid(spark, sf_dir), "target").select(F.lit("seqs_mid.target").alias("target"), "binary_numeric")
    c = prof.is_binary(fx.table(spark, sf_dir, "labels"), "toxic").select(F.lit("labels.toxic").alias("target"), "binary_numeric")
    return a.unionByName(b).unionByName(c)


@query("class_counts", with_fixtures("""
SELECT CAST(label AS VARCHAR) AS class, count(*) AS count FROM seqs WHERE label IS NOT NULL GROUP BY 1""", "seqs"))
def class_counts_q(spark, sf_dir):
    return prof.class_counts(fx.seqs(spark, sf_dir), "label")


def _summary_sql(src: str, col: str, name: str) -> str:
    return f"""
SELECT '{name}' AS target_col, CAST(sum(c) AS BIGINT) AS row_count_with_target, count(*) AS class_count,
       count(y) > 0 AND bool_and(y IS NULL OR y IN (0, 1)) AS binary_numeric,
       CASE WHEN count(*) >= 2 THEN round(min(c) / sum(c), 4) END AS minority_fraction,
       coalesce(count(*) >= 2 AND min(c) / sum(c) < 0.35, false) AS imbalance_detected,
       CASE WHEN coalesce(count(*) >= 2 AND min(c) / sum(c) < 0.35, false)
            THEN '{prof.RECOMMEND_IMBALANCED}' ELSE '{prof.RECOMMEND_BALANCED}' END AS recommendation
FROM (SELECT CAST({col} AS VARCHAR) AS k, count(*) AS c,
             any_value(CASE WHEN regexp_full_match(CAST({col} AS VARCHAR), '{NUMERIC_TEXT}')
                            THEN TRY_CAST(trim(CAST({col} AS VARCHAR)) AS DOUBLE) END) AS y
      FROM {src} WHERE {col} IS NOT NULL GROUP BY 1) g"""


@query("target_summary", with_fixtures(
    _summary_sql("seqs", "label", "label") + "\nUNION ALL" + _summary_sql("orders", "o_orderpriority", "o_orderpriority"),
    "seqs"))
def target_summary_q(spark, sf_dir):
    a = prof.target_summary(fx.seqs(spark, sf_dir), "label")
    b = prof.target_summary(fx.table(spark, sf_dir, "orders"), "o_orderpriority")
    return a.unionByName(b)


@query("dataset_profile", "SELECT count(*) AS row_count, count(*) > 1000 AS large_dataset_warning, "
                          "1000 AS local_row_limit FROM orders")
def dataset_profile_q(spark, sf_dir):
    return prof.dataset_profile(fx.seqs_mid(spark, sf_dir)).withColumn("local_row_limit", F.col("local_row_limit").cast("int"))


@query("preview", with_fixtures(f"""
SELECT row_id, target, sequence, round({gc_sql('sequence')}, 6) AS gc_content
FROM seqs_mid ORDER BY row_id LIMIT 20""", "seqs_mid"))
def preview_q(spark, sf_dir):
    d = fx.seqs_mid(spark, sf_dir).withColumn("gc_content", gc_content("sequence"))
    return prof.preview(d, 20, "row_id", round_cols=["gc_content"])


@query("describe", with_fixtures(f"""
SELECT 'target' AS "column", count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
       round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
       round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max
FROM (SELECT target AS x FROM seqs_mid) a
UNION ALL
SELECT 'gc_content', count(x), round(avg(x), 6), round(stddev_samp(x), 6), round(min(x), 6),
       round(quantile_cont(x, 0.25), 6), round(quantile_cont(x, 0.5), 6), round(quantile_cont(x, 0.75), 6),
       round(max(x), 6)
FROM (SELECT {gc_sql('sequence')} AS x FROM seqs_mid) b""", "seqs_mid"))
def describe_q(spark, sf_dir):
    d = fx.seqs_mid(spark, sf_dir).withColumn("gc_content", gc_content("sequence"))
    return prof.describe(d, ["target", "gc_content"])


@query("row_cap", with_fixtures("SELECT row_id, target FROM seqs_mid ORDER BY row_id LIMIT 1000", "seqs_mid"))
def row_cap_q(spark, sf_dir):
    rows, _ = prof.cap_rows(fx.seqs_mid(spark, sf_dir).select("row_id", "target"), 1000)
    return rows


# ---- X1-X6, B1-B2, A12 -------------------------------------------------------------------

def _split_sql(src: str, seed: int, t: float, v: float = 0.0) -> str:
    return f"""
SELECT row_id, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'validation' ELSE 'train' END AS split
FROM (SELECT row_id, row_number() OVER (ORDER BY {rank_sql(seed)}, row_id) AS rn,
             ceil(CAST({t} AS DOUBLE) * count(*) OVER ()) AS n_test,
             CASE WHEN {v} > 0 THEN least(ceil(CAST({v} AS DOUBLE) * count(*) OVER ()),
                                         count(*) OVER () - ceil(CAST({t} AS DOUBLE) * count(*) OVER ())) ELSE 0 END AS n_val
      FROM {src}) r"""


@query("holdout_split", with_fixtures(_split_sql("seqs_mid", 42, 0.2), "seqs_mid"))
def holdout_split_q(spark, sf_dir):
    return smp.holdout_split(fx.seqs_mid(spark, sf_dir).select("row_id"), 0.2, 42)


@query("three_way_split", with_fixtures(_split_sql("seqs_mid", 11, 0.2, 0.1), "seqs_mid"))
def three_way_split_q(spark, sf_dir):
    return smp.holdout_split(fx.seqs_mid(spark, sf_dir).select("row_id"), 0.2, 11, validation_size=0.1)


def _fold_sql(src: str, seed: int, k: int) -> str:
    return f"""
SELECT row_id, CAST(CASE WHEN rn <= (n % {k}) * (n // {k} + 1) THEN (rn - 1) // (n // {k} + 1)
                         ELSE n % {k} + (rn - 1 - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS INTEGER) AS fold
FROM (SELECT row_id, row_number() OVER (ORDER BY {rank_sql(seed)}, row_id) AS rn, count(*) OVER () AS n FROM {src}) r"""


@query("kfold", with_fixtures(_fold_sql("seqs_mid", 5, 5), "seqs_mid"))
def kfold_q(spark, sf_dir):
    return smp.kfold(fx.seqs_mid(spark, sf_dir).select("row_id"), 5, 5)


@query("repeated_holdout", with_fixtures("""
SELECT seed, row_id, CASE WHEN rn <= ceil(CAST(0.25 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split
FROM (SELECT s.seed, q.row_id,
             row_number() OVER (PARTITION BY s.seed ORDER BY md5(CAST(s.seed AS VARCHAR) || ':' || CAST(q.row_id AS VARCHAR)), q.row_id) AS rn,
             count(*) OVER (PARTITION BY s.seed) AS n
      FROM seqs q, (VALUES (1), (2), (3)) s(seed)) r""", "seqs"))
def repeated_holdout_q(spark, sf_dir):
    return smp.repeated_holdout(fx.seqs(spark, sf_dir).select("row_id"), 0.25, [1, 2, 3]).select("seed", "row_id", "split")


@query("split_manifest", with_fixtures(f"""
SELECT s.row_id, 7 AS seed, s.split, f.fold
FROM ({_split_sql('seqs_mid', 7, 0.2, 0.1)}) s JOIN ({_fold_sql('seqs_mid', 7, 5)}) f ON s.row_id = f.row_id""", "seqs_mid"))
def split_manifest_q(spark, sf_dir):
    return smp.split_manifest(fx.seqs_mid(spark, sf_dir), 7, 0.2, 0.1, 5)


@query("split_counts", with_fixtures(f"SELECT split, count(*) AS rows FROM ({_split_sql('seqs_mid', 42, 0.2)}) s GROUP BY split",
                                     "seqs_mid"))
def split_counts_q(spark, sf_dir):
    return holdout_split_q(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def _undersample_sql(src: str, seed: int) -> str:
    return f"""
SELECT row_id, label FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {rank_sql(seed)}, row_id) AS rn,
         min(c) OVER () AS keep
  FROM (SELECT row_id, label, count(*) OVER (PARTITION BY label) AS c FROM {src} WHERE label IS NOT NULL) a) b
WHERE rn <= keep"""


@query("undersample", with_fixtures(_undersample_sql("seqs", 42), "seqs"))
def undersample_q(spark, sf_dir):
    rows, _ = smp.undersample(fx.seqs(spark, sf_dir).select("row_id", "label"), "label", 42, "undersample")
    return rows


@query("auto_undersample", with_fixtures(_undersample_sql("seqs", 7), "seqs"))
def auto_undersample_q(spark, sf_dir):
    rows, _ = smp.undersample(fx.seqs(spark, sf_dir).select("row_id", "label"), "label", 7, "auto_undersample")
    return rows


@query("provided_split", """
SELECT o_orderkey AS row_id,
       CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'P' THEN 'validation' ELSE 'test' END AS split
FROM orders WHERE o_orderstatus IN ('F', 'P', 'O')""")
def provided_split_q(spark, sf_dir):
    """Three given tables (orders by status) as one split table."""
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    part = {k: o.filter(F.col("o_orderstatus") == k).select("row_id") for k in ("F", "P", "O")}
    return smp.provided_split(part["F"], part["P"], part["O"])


_FINGERPRINT_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
_ROW_TEXT_SQL = " || ',' || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    for c in [*_FINGERPRINT_COLUMNS[:4], "nullif(l_returnflag, 'A')", "l_linestatus"])


@query("table_fingerprint", f"""
SELECT count(*) AS rows, CAST(sum(('0x' || substr(md5({_ROW_TEXT_SQL}), 1, 15))::BIGINT) AS VARCHAR) AS content_hash FROM lineitem""")
def table_fingerprint_q(spark, sf_dir):
    """F11 at table scale: order-free (rows, sum of row hashes) of every lineitem row, nulls included."""
    from dnaframe.functions.hashing import table_fingerprint

    li = fx.table(spark, sf_dir, "lineitem").select(*_FINGERPRINT_COLUMNS)
    return table_fingerprint(li.withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("A"))))


@query("table_fingerprint_whole")
def table_fingerprint_whole_q(spark, sf_dir):
    """F11 at table scale over every column of lineitem; doubles and dates as Spark writes them, so without SQL."""
    from dnaframe.functions.hashing import table_fingerprint

    return table_fingerprint(fx.table(spark, sf_dir, "lineitem"))


# ---- evaluation: A5-A13, T1-T7, J3, U1, W10 ------------------------------------------------

# Errors here are on the order-price scale (mse ~ 1e9): a double sum is exact to ~1e-6 relative
# only, and its last digits depend on summation order, so errors are compared at 2 decimals.
@query("regression_metrics", with_fixtures("""
SELECT model, count(*) AS test_rows, round(avg(abs(actual - prediction)), 2) AS mae,
       round(avg((actual - prediction) * (actual - prediction)), 2) AS mse,
       round(sqrt(avg((actual - prediction) * (actual - prediction))), 2) AS rmse,
       round(1 - sum((actual - prediction) * (actual - prediction)) / (var_pop(actual) * count(actual)), 6) AS r2
FROM scores_mid GROUP BY model""", "scores_mid"))
def regression_metrics_q(spark, sf_dir):
    m = met.regression_metrics(fx.scores_mid(spark, sf_dir), digits=None)
    return m.select("model", "test_rows", *[F.round(c, 2).alias(c) for c in ("mae", "mse", "rmse")],
                    F.round("r2", 6).alias("r2"))


_LABELLED_05 = """(SELECT model, row_id, actual, prediction, CAST(prediction >= 0.5 AS INTEGER) AS predicted_label FROM scores)"""

_CONF_COLS = """count(*) FILTER (WHERE CAST(actual AS INTEGER) = 0 AND predicted_label = 0) AS true_negative,
       count(*) FILTER (WHERE CAST(actual AS INTEGER) = 0 AND predicted_label = 1) AS false_positive,
       count(*) FILTER (WHERE CAST(actual AS INTEGER) = 1 AND predicted_label = 0) AS false_negative,
       count(*) FILTER (WHERE CAST(actual AS INTEGER) = 1 AND predicted_label = 1) AS true_positive"""


def _cls_sql(src: str) -> str:
    return f"""
SELECT *, {_cls_proj()} FROM (SELECT model, {_CONF_COLS} FROM {src} GROUP BY model) c"""


def _cls_proj() -> str:
    tn, fp, fn, tp = ("CAST(true_negative AS DOUBLE)", "CAST(false_positive AS DOUBLE)",
                      "CAST(false_negative AS DOUBLE)", "CAST(true_positive AS DOUBLE)")

    def ratio(a, b):
        return f"coalesce(({a}) / nullif({b}, 0), 0.0)"

    den = f"sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    return ", ".join([
        f"round({ratio(f'{tp} + {tn}', f'{tp} + {tn} + {fp} + {fn}')}, 6) AS accuracy",
        f"round({ratio(tp, f'{tp} + {fp}')}, 6) AS precision",
        f"round({ratio(tp, f'{tp} + {fn}')}, 6) AS recall",
        f"round({ratio(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')}, 6) AS f1",
        f"round({ratio(f'{tp} * {tn} - {fp} * {fn}', den)}, 6) AS mcc",
    ])


@query("fixed_threshold_labels", with_fixtures(f"SELECT model, row_id, predicted_label FROM {_LABELLED_05} l", "scores"))
def fixed_threshold_labels_q(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    return thr.apply_threshold(s, {m: 0.5 for m, _ in fx.SCORE_MODELS}).select("model", "row_id", "predicted_label")


@query("confusion_counts", with_fixtures(f"SELECT model, {_CONF_COLS} FROM {_LABELLED_05} l GROUP BY model", "scores"))
def confusion_counts_q(spark, sf_dir):
    s = thr.apply_threshold(fx.scores(spark, sf_dir), {m: 0.5 for m, _ in fx.SCORE_MODELS})
    return met.confusion_counts(s)


@query("classification_metrics", with_fixtures(_cls_sql(_LABELLED_05 + " l"), "scores"))
def classification_metrics_q(spark, sf_dir):
    s = thr.apply_threshold(fx.scores(spark, sf_dir), {m: 0.5 for m, _ in fx.SCORE_MODELS})
    return met.classification_metrics(s)


@query("median_threshold", with_fixtures(f"""
SELECT model, round(classification_threshold, 6) AS classification_threshold, {_CONF_COLS}
FROM (SELECT s.model, s.actual, m.med AS classification_threshold,
             CAST(s.prediction >= m.med AS INTEGER) AS predicted_label
      FROM scores s JOIN (SELECT model, median(prediction) AS med FROM scores GROUP BY model) m
      ON s.model = m.model) l
GROUP BY model, classification_threshold""", "scores"))
def median_threshold_q(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    th = thr.median_thresholds(s)
    labelled = thr.apply_threshold(s, th)
    return labelled.groupBy("model").agg(F.round(F.first("classification_threshold"), 6).alias("classification_threshold"),
                                         *met.confusion_aggs())


@query("all_metrics", with_fixtures(f"""
SELECT r.model, 'binary_label_regression_baseline' AS task_type, r.mae, r.mse, r.rmse, r.r2, r.test_rows,
       CAST(0.5 AS DOUBLE) AS classification_threshold, c.accuracy, c.precision, c.recall, c.f1, c.mcc,
       c.true_negative, c.false_positive, c.false_negative, c.true_positive
FROM (SELECT model, count(*) AS test_rows, round(avg(abs(actual - prediction)), 6) AS mae,
             round(avg((actual - prediction) * (actual - prediction)), 6) AS mse,
             round(sqrt(avg((actual - prediction) * (actual - prediction))), 6) AS rmse,
             round(1 - sum((actual - prediction) * (actual - prediction)) / (var_pop(actual) * count(actual)), 6) AS r2
      FROM scores GROUP BY model) r
JOIN ({_cls_sql(_LABELLED_05 + ' l')}) c ON r.model = c.model""", "scores"))
def all_metrics_q(spark, sf_dir):
    s = thr.apply_threshold(fx.scores(spark, sf_dir), {m: 0.5 for m, _ in fx.SCORE_MODELS})
    return met.all_metrics(s, binary_target=True)


def _sweep_sql(grp: str) -> str:
    return f"""
SELECT grp, s AS threshold, tp, fp, P - tp AS fn, N - fp AS tn FROM (
  SELECT grp, s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY grp) AS P, sum(neg) OVER (PARTITION BY grp) AS N
  FROM (SELECT {grp} AS grp, prediction AS s, count(*) FILTER (WHERE CAST(actual AS INTEGER) = 1) AS pos,
               count(*) FILTER (WHERE CAST(actual AS INTEGER) = 0) AS neg
        FROM scores GROUP BY 1, 2) a
  WINDOW w AS (PARTITION BY grp ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) b"""


def _sweep_metrics_sql(grp: str) -> str:
    tp, fp, fn, tn = ("CAST(tp AS DOUBLE)", "CAST(fp AS DOUBLE)", "CAST(fn AS DOUBLE)", "CAST(tn AS DOUBLE)")
    den = f"sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    return f"""
SELECT grp, threshold,
       coalesce({tp} / nullif({tp} + {fn}, 0), 0.0) AS recall,
       coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0) AS f1,
       coalesce(({tp} * {tn} - {fp} * {fn}) / nullif({den}, 0), 0.0) AS mcc
FROM ({_sweep_sql(grp)}) x"""


@query("sweep_mcc", with_fixtures(f"""
SELECT grp, threshold, round(mcc, 6) AS metric FROM ({_sweep_metrics_sql('model')}) m
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY mcc DESC, threshold DESC) = 1""", "scores"))
def sweep_mcc_q(spark, sf_dir):
    sw = thr.sweep(fx.scores(spark, sf_dir), "per_model")
    return thr.best_thresholds(sw, "validation_mcc", "limit_false_positives").select(
        "grp", "threshold", F.round("metric", 6).alias("metric"))


@query("sweep_f1_shared", with_fixtures(f"""
SELECT grp, threshold, round(f1, 6) AS metric FROM ({_sweep_metrics_sql("'shared'")}) m
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, mcc DESC, threshold DESC) = 1""", "scores"))
def sweep_f1_shared_q(spark, sf_dir):
    sw = thr.sweep(fx.scores(spark, sf_dir), "shared")
    return thr.best_thresholds(sw, "validation_f1", "balanced_screening").select(
        "grp", "threshold", F.round("metric", 6).alias("metric"))


@query("sweep_high_sensitivity", with_fixtures(f"""
SELECT grp, threshold, round(recall, 6) AS metric FROM ({_sweep_metrics_sql('model')}) m
WHERE recall >= 0.9
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY threshold DESC) = 1""", "scores"))
def sweep_high_sensitivity_q(spark, sf_dir):
    sw = thr.sweep(fx.scores(spark, sf_dir), "per_model")
    return thr.best_thresholds(sw, "high_sensitivity").select("grp", "threshold", F.round("metric", 6).alias("metric"))


@query("test_predictions", with_fixtures(f"""
SELECT p.model, p.row_id, p.actual, p.prediction, q.label
FROM scores p JOIN ({_split_sql('seqs', 42, 0.2)}) s ON p.row_id = s.row_id
JOIN seqs q ON q.row_id = p.row_id
WHERE s.split = 'test'""", "seqs", "scores"))
def test_predictions_q(spark, sf_dir):
    split = smp.holdout_split(fx.seqs(spark, sf_dir).select("row_id", "label"), 0.2, 42)
    test = split.filter(F.col("split") == "test").select("row_id", "label")
    return met.with_actuals(fx.scores(spark, sf_dir), test).select("model", "row_id", "actual", "prediction", "label")


@query("union_predictions", with_fixtures("""
SELECT model, row_id, prediction, CAST(prediction >= 0.5 AS INTEGER) AS predicted_label FROM scores WHERE model = 'linear_regression'
UNION ALL
SELECT model, row_id, prediction, NULL FROM scores WHERE model = 'random_forest'""", "scores"))
def union_predictions_q(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    a = thr.apply_threshold(s.filter(F.col("model") == "linear_regression"), {"linear_regression": 0.5})
    b = s.filter(F.col("model") == "random_forest")
    return met.union_predictions([a.select("model", "row_id", "prediction", "predicted_label"),
                                  b.select("model", "row_id", "prediction")])


@query("multi_seed_summary", with_fixtures(f"""
SELECT model, count(*) AS seeds,
       round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std, round(min(mae), 6) AS mae_min, round(max(mae), 6) AS mae_max,
       round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std,
       round(min(accuracy), 6) AS accuracy_min, round(max(accuracy), 6) AS accuracy_max
FROM (
  SELECT t.seed, p.model,
         avg(abs(p.actual - p.prediction)) AS mae,
         count(*) FILTER (WHERE CAST(p.actual AS INTEGER) = CAST(p.prediction >= 0.5 AS INTEGER)) / count(*) AS accuracy
  FROM scores p JOIN (
    SELECT seed, row_id, rn <= ceil(CAST(0.25 AS DOUBLE) * n) AS is_test
    FROM (SELECT s.seed, q.row_id,
                 row_number() OVER (PARTITION BY s.seed ORDER BY md5(CAST(s.seed AS VARCHAR) || ':' || CAST(q.row_id AS VARCHAR)), q.row_id) AS rn,
                 count(*) OVER (PARTITION BY s.seed) AS n
          FROM seqs q, (VALUES (1), (2), (3)) s(seed)) r) t
  ON p.row_id = t.row_id WHERE t.is_test GROUP BY t.seed, p.model) per_seed
GROUP BY model""", "seqs", "scores"))
def multi_seed_summary_q(spark, sf_dir):
    splits = smp.repeated_holdout(fx.seqs(spark, sf_dir).select("row_id"), 0.25, [1, 2, 3])
    test = splits.filter(F.col("split") == "test").select("seed", "row_id")
    s = thr.apply_threshold(fx.scores(spark, sf_dir), {m: 0.5 for m, _ in fx.SCORE_MODELS})
    j = s.join(test, "row_id")
    per_seed = j.groupBy("seed", "model").agg(
        F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae"),
        (F.count_if(F.col("actual").cast("int") == F.col("predicted_label")) / F.count(F.lit(1))).alias("accuracy"))
    return met.multi_seed_summary(per_seed, metrics=("mae", "accuracy"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from dnaframe.plans import file_queries, jobs, source_queries  # noqa: F401  (register their queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
