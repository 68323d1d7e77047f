"""Registered queries over files and registries that are written from the given tables, each with its SQL.

Every call writes to a fresh folder below the shared checkpoint folder, reads it back with the library's
readers and lookups, and returns what they give.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnaframe.operators import features as feat
from dnaframe.operators import profile as prof
from dnaframe.plans import catalog as cat
from dnaframe.plans import fixtures as fx
from dnaframe.plans import source_queries as src
from dnaframe.plans.catalog import query
from dnaframe.plans.fixtures import with_fixtures
from dnaframe.session import ensure_checkpoint_dir
from dnaframe.sources import digest, fasta, store, tabular


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{name}-{uuid.uuid4().hex}"


# ---- S1-S3 ------------------------------------------------------------------------------------

def _delimited(spark, sf_dir, suffix: str, sep: str) -> DataFrame:
    """Orders in key order as text files with a header, read back by name."""
    folder = _folder(spark, f"orders{suffix}")
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    o.orderBy("o_orderkey").write.option("header", True).option("sep", sep).csv(folder)
    rows = tabular.read_delimited(spark, folder, sep=sep)
    return rows.select("row_id", "o_orderkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))


_DELIMITED_SQL = """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_orderstatus, o_orderpriority, round(o_totalprice, 2) AS o_totalprice
FROM orders"""


@query("csv_rows", _DELIMITED_SQL)
def csv_rows_q(spark, sf_dir) -> DataFrame:
    """Header, inferred types, rows numbered over all files."""
    return _delimited(spark, sf_dir, ".csv", ",")


@query("tsv_rows", _DELIMITED_SQL)
def tsv_rows_q(spark, sf_dir) -> DataFrame:
    """The same with tabs."""
    return _delimited(spark, sf_dir, ".tsv", "\t")


def _customer_fasta(spark, sf_dir, blanks: bool) -> str:
    """A record per customer, a line of 64 bases per order of it; with ``blanks`` every third header is blank."""
    folder = _folder(spark, "fasta")
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    keys = fx.seqs_mid(spark, sf_dir).select(F.col("row_id").alias("o_orderkey"))
    # keys are joined and dealt, and get their bases where the file is written
    rows = o.join(keys, "o_orderkey").repartitionByRange("o_custkey").withColumn("sequence", fx.seq_of_order(F.col("o_orderkey")))
    first = F.col("o_custkey").isNotNull() & (F.col("o_orderkey") == F.min("o_orderkey").over(Window.partitionBy("o_custkey")))
    rows = rows.withColumn("first", first)
    head = F.when(F.lit(blanks) & (F.col("o_custkey") % 3 == 0), F.lit(">")).otherwise(F.concat(F.lit("> customer "), F.col("o_custkey").cast("string")))
    line = F.when(F.col("first"), F.concat(head, F.lit("\n"), F.lower("sequence"))).otherwise(F.col("sequence"))
    rows.sortWithinPartitions("o_custkey", "o_orderkey").select(line.alias("value")).write.text(folder)
    return folder


_CUSTOMERS = """customers AS (
SELECT o.o_custkey, row_number() OVER (ORDER BY o.o_custkey) AS nr, string_agg(s.sequence, '' ORDER BY o.o_orderkey) AS s
FROM orders o JOIN seqs_mid s ON s.row_id = o.o_orderkey GROUP BY o.o_custkey)"""


def _customers_sql(sql: str) -> str:
    return f"WITH seqs_mid AS (\n{fx.SEQS_MID_SQL}\n),\n{_CUSTOMERS}\n{sql}"


@query("fasta_split_records", _customers_sql("""
SELECT nr - 1 AS row_id, CASE WHEN o_custkey % 3 = 0 THEN 'blank' ELSE 'customer ' || o_custkey END AS id, s AS sequence FROM customers"""))
def fasta_split_records_q(spark, sf_dir) -> DataFrame:
    """S3, W1's reader: FASTA files in byte blocks; records numbered over all files. A blank header's number counts in
    its own file, which depends on how the files were written, so only its presence is shown."""
    rows = fasta.read_fasta_split(spark, _customer_fasta(spark, sf_dir, True))
    own = F.col("id") == F.concat(F.lit("sequence_"), F.col("record").cast("string"))
    return rows.select("row_id", F.when(own, F.lit("blank")).otherwise(F.col("id")).alias("id"), "sequence")


@query("fasta_piece_kmers", _customers_sql(f"""
SELECT o_custkey, kmer, CAST({cat.slot_sql('kmer', 4)} AS INTEGER) AS slot, count(*) AS n,
       round(count(*) / max(length(s) - 3), 6) AS freq
FROM (SELECT o_custkey, s, unnest([s[i:i + 3] FOR i IN range(1, length(s) - 2)]) AS kmer FROM customers) w
GROUP BY o_custkey, kmer"""))
def fasta_piece_kmers_q(spark, sf_dir) -> DataFrame:
    """S3, F4-F6 on records cut into pieces of 100 bases: 4-mers counted by pieces with a halo of 3."""
    pieces = fasta.read_fasta_pieces(spark, _customer_fasta(spark, sf_dir, False), 100, 3)
    parts = pieces.select(F.substring("id", 10, 20).cast("bigint").alias("o_custkey"), "piece", "length", "sequence")
    x = feat.segment_kmers(parts, 4, ("o_custkey",), size=100)
    return x.select("o_custkey", "kmer", "slot", "n", F.round("freq", 6).alias("freq"))


@query("kmer_counts_long", with_fixtures(cat._kmer_long_sql("seqs_dirty", 4), "seqs_dirty"))
def kmer_counts_long_q(spark, sf_dir) -> DataFrame:
    """F4-F6 with no limit of length: whole texts above 512 bases by segments, the others in their row."""
    x = feat.kmer_long_any(fx.seqs_dirty(spark, sf_dir), 4, size=512)
    return x.select("row_id", "kmer", "slot", "n", F.round("freq", 6).alias("freq"))


# ---- F11, W6 ----------------------------------------------------------------------------------

@query("file_digests", """
SELECT o_orderstatus, count(*) * 8 AS size_bytes, sha256(string_agg(lpad(o_orderkey::VARCHAR, 7, '0') || chr(10), '' ORDER BY o_orderkey)) AS sha256
FROM orders GROUP BY o_orderstatus""")
def file_digests_q(spark, sf_dir) -> DataFrame:
    """F11 by streaming: a file of keys per order status, read in lines, hashed in order."""
    folder = _folder(spark, "keys")
    line = F.coalesce(F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit(""))  # no key: an empty line
    o = fx.table(spark, sf_dir, "orders").select("o_orderstatus", line.alias("line"))
    # the one task that writes a file gets lines with equal first characters as one sorted row, not each by itself
    lines = F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("value")
    o = o.groupBy("o_orderstatus", F.substring("line", 1, 4).alias("part")).agg(lines)
    o = o.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "part")
    o.select("o_orderstatus", "value").write.partitionBy("o_orderstatus").text(folder)
    found = digest.file_digests(spark, [f"{folder}/*/*.txt"], whole=1)
    return found.select(F.regexp_extract("path", "o_orderstatus=([A-Z])", 1).alias("o_orderstatus"), "size_bytes", "sha256")


# ---- W1, K1, K4, S8, S9 -------------------------------------------------------------------------

@query("stored_datasets", """
SELECT 'orders-' || o_orderstatus AS dataset_id, count(*) AS row_count, 'o_orderkey,sequence,label' AS columns, 'sequence' AS suggested_sequence_col,
       'label' AS suggested_target_col, count(*) > 1000 AS large_dataset_warning, '.csv' AS source_format,
       sum(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS zeros, count(*) AS rows_read, sum(o_orderkey)::BIGINT AS key_sum
FROM orders GROUP BY o_orderstatus""")
def stored_datasets_q(spark, sf_dir) -> DataFrame:
    """A CSV per order status is ingested; manifests are listed, class counts and stored rows read back."""
    from dnaframe.plans import jobs

    folder, root = _folder(spark, "sources"), _folder(spark, "datasets")
    o = fx.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("sequence"),
                                                 (F.col("o_custkey") % 2).alias("label"))
    for status in ("F", "O", "P"):  # the statuses are a fixed set
        o.filter(F.col("o_orderstatus") == status).drop("o_orderstatus").write.option("header", True).csv(f"{folder}/{status}")
        jobs.ingest(spark, f"{folder}/{status}", root, f"orders-{status}")
    listed = store.list_datasets(spark, root)
    counts = store.read_table(spark, root, "datasets", "class_counts").filter("class = '0'").select("dataset_id", F.col("count").alias("zeros"))
    rows = None
    for status in ("F", "O", "P"):
        one = store.load_dataset(spark, root, f"orders-{status}").agg(F.count(F.lit(1)).alias("rows_read"), F.sum("o_orderkey").alias("key_sum"))
        one = one.withColumn("dataset_id", F.lit(f"orders-{status}"))
        rows = one if rows is None else rows.unionByName(one)
    return listed.join(counts, "dataset_id").join(rows, "dataset_id").select(
        "dataset_id", "row_count", F.array_join("columns", ",").alias("columns"), "suggested_sequence_col", "suggested_target_col",
        "large_dataset_warning", "source_format", "zeros", "rows_read", "key_sum")


# ---- W2, K2, K3, K5-K7, S10-S12, W7 -------------------------------------------------------------

def _gc_request(**options):
    from dnaframe.plans.jobs import BenchmarkRequest

    given = {"models": ["linear_regression"], "target_col": "label", "preprocessing": {"use_gc": True, "use_kmers": False},
             "test_size": 0.2, "random_seed": 42, "threshold_strategy": "median", "threshold_scope": "shared"}
    return BenchmarkRequest(**(given | options))


def _gc_dataset(spark, sf_dir) -> str:
    """The labelled sequences ingested from a CSV, as dataset ``gc``."""
    from dnaframe.plans import jobs

    folder, root = _folder(spark, "seqs"), _folder(spark, "runs")
    fx.seqs(spark, sf_dir).select(F.col("row_id").alias("doc_id"), "sequence", "label").orderBy("doc_id").write.option("header", True).csv(folder)
    jobs.ingest(spark, folder, root, "gc")
    return root


# the stored rows are numbered from 0 in key order, and the split goes by that number
_STORED = src._GC_RUN.replace("seqs AS (SELECT * FROM s)", "seqs AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, label, sequence FROM s)")


@query("stored_run", f"""{_STORED}
SELECT 'gc' AS dataset_id, c.test_rows, c.train_rows, c.rows_used, 'binary_numeric_label' AS target_kind, r.mae, r.mse, c.predictions, c.actual_sum, c.labels
FROM (SELECT round(avg(abs(actual - prediction)), 6) AS mae, round(avg((actual - prediction) * (actual - prediction)), 6) AS mse FROM l) r,
     (SELECT count(*) FILTER (split = 'test') AS test_rows, count(*) FILTER (split = 'train') AS train_rows, count(*) AS rows_used,
             (SELECT count(*) FROM l) AS predictions, (SELECT sum(actual) FROM l) AS actual_sum, (SELECT sum(predicted_label)::BIGINT FROM l) AS labels
      FROM p) c""")
def stored_run_q(spark, sf_dir) -> DataFrame:
    """W2 with its writes, K2, K3, K5, S10, S11: what the registry, metrics and predictions of a run hold."""
    from dnaframe.plans import jobs

    root = _gc_dataset(spark, sf_dir)
    run_id = jobs.run_benchmark(spark, root, _gc_request(dataset_id="gc"))["run"]["run_id"]
    found = store.get_run(spark, root, run_id, preview_rows=None)
    totals = found["predictions"].groupBy("run_id").agg(F.count(F.lit(1)).alias("predictions"), F.sum("actual").alias("actual_sum"),
                                                        F.sum("predicted_label").alias("labels"))
    runs = store.list_runs(spark, root).select("run_id", "dataset_id", "train_rows", "test_rows", "rows_used", "target_kind")
    metrics = found["metrics"].select("run_id", F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"))
    return runs.join(metrics, "run_id").join(totals, "run_id").drop("run_id")


@query("replayed_run", f"""{_STORED}
SELECT 'gc' AS dataset_id, 'fixed_train_validation_test' AS split_strategy, 42 AS random_seed, true AS verified, true AS same_metrics, true AS same_predictions,
       round(avg(abs(actual - prediction)), 6) AS mae, count(*) AS predictions FROM l""")
def replayed_run_q(spark, sf_dir) -> DataFrame:
    """A run's saved configuration is read, its checksum verified, the run replayed and compared."""
    from dnaframe.plans import config, jobs

    root, out = _gc_dataset(spark, sf_dir), _folder(spark, "replay")
    run = jobs.run_benchmark(spark, root, _gc_request(dataset_id="gc"))["run"]
    saved = store.get_run(spark, root, run["run_id"], preview_rows=None)
    summary = jobs.replay_run(spark, root, run["run_id"], out)
    again = spark.read.schema(saved["metrics"].schema).json(summary["metrics_path"])
    cfg = config.read_run_configs(spark, f"{root}/runs/configs/run_id={run['run_id']}")
    cfg = cfg.select(F.col("metadata.run_id").alias("run_id"), "dataset.dataset_id", "split.split_strategy", F.col("split.random_seed").cast("int").alias("random_seed"))
    names = ("mae", "mse", "rmse", "r2", "accuracy", "mcc")
    was = saved["metrics"].select("run_id", "model", F.struct(*[F.round(c, 9).alias(c) for c in names]).alias("was"))
    now = again.select("model", "mae", F.struct(*[F.round(c, 9).alias(c) for c in names]).alias("now"))
    same = was.join(now, "model").select("run_id", (F.col("was") == F.col("now")).alias("same_metrics"), F.round("mae", 6).alias("mae"))
    old = saved["predictions"].select("run_id", "model", F.col("row_id").cast("string").alias("row_id"), F.round("prediction", 9).alias("p"))
    new = spark.read.option("header", True).csv(summary["predictions_path"]).select("model", "row_id", F.round(F.col("prediction").cast("double"), 9).alias("q"))
    both = old.join(new, ["model", "row_id"], "full").groupBy("run_id").agg(
        F.bool_and(F.coalesce(F.col("p") == F.col("q"), F.lit(False))).alias("same_predictions"), F.count(F.lit(1)).alias("predictions"))
    verified = spark.read.parquet(f"{out}/replay_summary").select(F.lit(run["run_id"]).alias("run_id"), F.get_json_object(
        "summary_json", "$.dataset_checksum_verified").cast("boolean").alias("verified"))
    return cfg.join(verified, "run_id").join(same, "run_id").join(both, "run_id").drop("run_id")


@query("replayed_folds", f"""
WITH s AS ({fx.SEQS_SQL}), seqs AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, label, sequence FROM s),
f AS (SELECT row_id, CAST(label AS DOUBLE) AS y, {cat.gc_sql('sequence')} AS x FROM seqs),
p AS (SELECT f.*, fold FROM f JOIN ({cat._fold_sql('seqs', 42, 3)}) t USING (row_id)),
m AS (SELECT k.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM (SELECT DISTINCT fold FROM p) k JOIN p ON p.fold <> k.fold GROUP BY k.fold)
SELECT p.fold AS part, count(*) AS predictions, round(avg(abs(y - (a * x + b))), 6) AS mae, true AS same FROM p JOIN m ON p.fold = m.fold GROUP BY p.fold""")
def replayed_folds_q(spark, sf_dir) -> DataFrame:
    """W2 and W7 by split strategy (X4): a k-fold run is stored, replayed as k folds and compared fold by fold."""
    from dnaframe.plans import jobs

    root, out = _gc_dataset(spark, sf_dir), _folder(spark, "replay")
    run = jobs.run_benchmark(spark, root, _gc_request(dataset_id="gc", split_strategy="kfold_small_dataset", cv_folds=3))["run"]
    saved = store.get_run(spark, root, run["run_id"], preview_rows=None)
    summary = jobs.replay_run(spark, root, run["run_id"], out)
    again = spark.read.json(summary["metrics_path"]).select("model", F.col("part").cast("int").alias("part"), F.col("mae").alias("again"))
    counts = saved["predictions"].groupBy("model", "part").agg(F.count(F.lit(1)).alias("predictions"))
    both = saved["metrics"].select("model", "part", "mae").join(again, ["model", "part"]).join(counts, ["model", "part"])
    return both.select("part", "predictions", F.round("mae", 6).alias("mae"), (F.round("mae", 9) == F.round("again", 9)).alias("same"))


@query("dry_run_report", """
SELECT 'orders-' || st AS dataset_id, st <> 'P' AS dataset_available, CASE st WHEN 'P' THEN NULL ELSE st = 'F' END AS dataset_checksum_verified,
       'linear_regression' AS models, 7 AS random_seed
FROM (SELECT DISTINCT o_orderstatus AS st FROM orders)""")
def dry_run_report_q(spark, sf_dir) -> DataFrame:
    """Three saved configurations; one source is as it was, one has changed, one is gone."""
    from dnaframe.plans import jobs

    folder, root = _folder(spark, "sources"), _folder(spark, "plans")
    o = fx.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("sequence"),
                                                 (F.col("o_custkey") % 2).alias("label"))
    for status in ("F", "O", "P"):
        one = o.filter(F.col("o_orderstatus") == status).drop("o_orderstatus")
        one.write.option("header", True).csv(f"{folder}/{status}")
        jobs.ingest(spark, f"{folder}/{status}", root, f"orders-{status}")
        jobs.plan_only_run(spark, root, _gc_request(dataset_id=f"orders-{status}", random_seed=7))
    o.filter("o_orderstatus = 'O'").limit(1).write.mode("append").option("header", True).csv(f"{folder}/O")
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/P")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    found = jobs.dry_run_summary(spark, f"{root}/runs/configs")
    return found.select(F.concat(F.lit("orders-"), F.element_at(F.split("path", "/"), -1)).alias("dataset_id"), "dataset_available",
                        "dataset_checksum_verified", F.array_join("models", ",").alias("models"), F.col("random_seed").cast("int").alias("random_seed"))


# ---- L1, A11 on awkward values --------------------------------------------------------------------

@query("row_cap_words", """
SELECT o_orderpriority || '/' || o_orderkey AS row_id, o_totalprice FROM orders
WHERE o_orderkey % 10 <> 0 ORDER BY o_orderpriority || '/' || o_orderkey LIMIT 5000""")
def row_cap_words_q(spark, sf_dir) -> DataFrame:
    """L1 by a string key that a tenth of the rows lacks; of the rows under the cap, those with a key are shown (the others come last)."""
    key = F.when(F.col("o_orderkey") % 10 != 0, F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")))
    rows = fx.table(spark, sf_dir, "orders").select(key.alias("row_id"), "o_totalprice")
    return prof.cap_rows(rows, 5000)[0].filter("row_id IS NOT NULL")


@query("nan_quantiles", """
SELECT o_orderstatus AS status, count(*) AS n, round(quantile_cont(x, 0.25), 6) AS q25, round(median(x), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75,
       isnan(quantile_cont(x, 0.99)) AS top_is_nan
FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 20 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS x FROM orders) t
WHERE x IS NOT NULL GROUP BY o_orderstatus""")
def nan_quantiles_q(spark, sf_dir) -> DataFrame:
    """Exact quantiles per group of a column with nulls and NaN, which ranks above all numbers."""
    from dnaframe.operators.quantiles import exact_quantiles

    x = F.when(F.col("o_orderkey") % 20 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))
    t = fx.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), x.alias("x"))
    q = exact_quantiles(t, "x", [0.25, 0.5, 0.75, 0.99], "status", max_candidates=1000)
    counts = t.groupBy("status").agg(F.count("x").alias("n"))
    rows = [(g, q[g, 0.25], q[g, 0.5], q[g, 0.75], q[g, 0.99]) for g, p in q if p == 0.5]  # one per group
    found = spark.createDataFrame(rows, "status string, q25 double, q50 double, q75 double, top double")
    return counts.join(found, "status").select("status", "n", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], F.isnan("top").alias("top_is_nan"))


# ---- J1 -------------------------------------------------------------------------------------------

@query("joined_families", with_fixtures(f"""
SELECT a.row_id, a.target AS y, round({cat.gc_sql('a.sequence')}, 6) AS gc_content, coalesce(w.slots, 0) AS kmers, round(coalesce(w.total, 0), 6) AS kmer_total,
       coalesce(w.slot_sum, 0) AS slot_sum, 20 AS hot
FROM seqs_mid a LEFT JOIN (
  SELECT row_id, count(DISTINCT kmer) AS slots, count(*) / max(length(s) - 2) AS total, sum(DISTINCT {cat.slot_sql('kmer', 3)})::BIGINT AS slot_sum
  FROM {cat.kmer_windows_sql('seqs_mid', 3)} k GROUP BY row_id) w ON a.row_id = w.row_id""", "seqs_mid"))
def joined_families_q(spark, sf_dir) -> DataFrame:
    """J1 as stored tables: GC, 3-mers, one-hot and target are stored by themselves and joined by row id."""
    from dnaframe.sources import families

    root = _folder(spark, "families")
    cfg = feat.FeatureConfig(use_gc=True, use_kmers=True, kmer_size=3, use_one_hot=True, sequence_length=20)
    families.store_families(families.family_frames(fx.seqs_mid(spark, sf_dir), "sequence", cfg, "target"), root, 8)
    x = families.join_families(spark, root, ["target", "gc", "kmers", "one_hot"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return x.select("row_id", "y", F.round("gc_content", 6).alias("gc_content"), F.size("slots").cast("bigint").alias("kmers"),
                    F.round(total("values"), 6).alias("kmer_total"), F.aggregate("slots", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("slot_sum"),
                    total("one_hot").cast("int").alias("hot"))
