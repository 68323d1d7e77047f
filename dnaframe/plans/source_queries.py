"""Registered queries of the parsers, digests, registry statuses and whole runs, each with its SQL.

File texts are built from given tables in both engines' terms, so a parser's oracle is simply the
rows that went into its texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnaframe.operators import sampling as smp
from dnaframe.plans import catalog as cat
from dnaframe.plans import fixtures as fx
from dnaframe.plans.catalog import query
from dnaframe.plans.fixtures import with_fixtures
from dnaframe.sources import digest, fasta, sbol, store


@query("fasta_records", with_fixtures("""
SELECT 'cust' || o.o_custkey AS file, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS record,
       CASE WHEN o.o_orderstatus = 'P' THEN 'sequence_' || row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey)
            ELSE 'order ' || o.o_orderkey END AS id, s.sequence
FROM orders o JOIN seqs_mid s ON s.row_id = o.o_orderkey""", "seqs_mid"))
def fasta_records_q(spark, sf_dir) -> DataFrame:
    """S3: a FASTA text per customer, a record per order: folded lines, lower case, blank headers, mixed line ends."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows = o.join(fx.seqs_mid(spark, sf_dir).withColumnRenamed("row_id", "o_orderkey"), "o_orderkey")
    head = F.when(F.col("o_orderstatus") == "P", F.lit(">  ")).otherwise(F.concat(F.lit("> order "), F.col("o_orderkey").cast("string")))
    body = F.concat(F.lower(F.substring("sequence", 1, 20)), F.lit(" \r\n"), F.substring("sequence", 21, 64))
    record = F.concat(head, F.lit("\n"), body, F.lit("\r"))
    files = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", record.alias("r")))).alias("rs"))
    texts = files.select(F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("file"),
                         F.concat(F.lit("preamble\n"), F.array_join(F.transform("rs", lambda x: x["r"]), "")).alias("value"))
    return fasta.parse_fasta(texts).select("file", F.col("record").cast("bigint").alias("record"), "id", "sequence")


@query("sbol_rows", with_fixtures("""
SELECT 'o' || row_id AS id, sequence, target FROM seqs_mid""", "seqs_mid"))
def sbol_rows_q(spark, sf_dir) -> DataFrame:
    """An SBOL text per order; a numeric reference to a node comes first and must not count."""
    s = fx.seqs_mid(spark, sf_dir)
    xml = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:sbol="http://sbols.org/v2#" '
              'xmlns:ex="http://example.org/"><sbol:Sequence rdf:about="7"><ex:part rdf:resource="7"/><sbol:elements>'),
        F.lower("sequence"), F.lit("</sbol:elements><ex:kind>not a number</ex:kind><ex:price>"), F.col("target").cast("string"),
        F.lit("</ex:price><ex:price>-1</ex:price></sbol:Sequence></rdf:RDF>"))
    texts = s.select(F.concat(F.lit("o"), F.col("row_id").cast("string"), F.lit(".xml")).alias("name"), xml.alias("value"))
    return sbol.parse_sbol(texts)


@query("content_digests", """
SELECT doc_id AS path, strlen(text) AS size_bytes, sha256(text) AS sha256 FROM documents""")
def content_digests_q(spark, sf_dir) -> DataFrame:
    """size and SHA-256 of every document's bytes."""
    d = fx.table(spark, sf_dir, "documents")
    return digest.content_digests(d.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")))


@query("checksum_verdicts", """
SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN sha256('') ELSE sha256(text) END AS expected_sha256,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS sha256,
       CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN NULL ELSE doc_id % 5 <> 1 END AS checksum_verified
FROM documents WHERE strlen(text) > 0""")
def checksum_verdicts_q(spark, sf_dir) -> DataFrame:
    """Three-valued verdict of every document against a saved digest; some have none, some files are gone."""
    d = fx.table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", "text")
    there = d.filter(F.col("doc_id") % 7 != 0).select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    saved = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, F.sha2(F.lit(""), 256)).otherwise(F.sha2("text", 256))
    return digest.checksum_status(digest.content_digests(there), d.select(F.col("doc_id").alias("path"), saved.alias("expected_sha256")))


@query("run_status", """
SELECT o_orderkey AS run_id,
       CASE WHEN o_orderkey % 6 = 0 THEN 'missing_config' WHEN o_orderkey % 5 = 0 THEN 'partial'
            WHEN o_custkey % 3 <> 0 AND o_orderstatus <> 'P' THEN 'complete' ELSE 'partial' END AS reproducibility_status
FROM orders""")
def run_status_q(spark, sf_dir) -> DataFrame:
    """Orders as runs, customers as datasets; some datasets are gone, some digests differ."""
    o = fx.table(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string")
    runs = o.select(F.col("o_orderkey").alias("run_id"), key.alias("dataset_id"), (F.col("o_orderkey") % 6 != 0).alias("has_config"),
                    (F.col("o_orderkey") % 5 == 0).alias("source_dataset_removed_after_run"),
                    F.sha2(F.when(F.col("o_orderstatus") == "P", F.lit("changed")).otherwise(key), 256).alias("dataset_sha256"))
    c = fx.table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").cast("string").alias("dataset_id"))
    return store.reproducibility_status(runs, c.withColumn("sha256", F.sha2("dataset_id", 256))).select("run_id", "reproducibility_status")


@query("seeded_rank", with_fixtures(f"""
SELECT row_id, row_number() OVER (ORDER BY {cat.rank_sql(9)}, row_id) AS rank FROM seqs_mid""", "seqs_mid"))
def seeded_rank_q(spark, sf_dir) -> DataFrame:
    """Every row's place in seeded random order."""
    return smp.seeded_rank(fx.seqs_mid(spark, sf_dir).select("row_id"), 9)


_GC_RUN = f"""
WITH s AS ({fx.SEQS_SQL}), seqs AS (SELECT * FROM s),
f AS (SELECT row_id, CAST(label AS DOUBLE) AS y, {cat.gc_sql('sequence')} AS x FROM seqs),
p AS (SELECT f.*, split FROM f JOIN ({cat._split_sql('seqs', 42, 0.2)}) t USING (row_id)),
m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p WHERE split = 'train'),
t AS (SELECT 'linear_regression' AS model, y AS actual, a * x + b AS prediction FROM p, m WHERE split = 'test'),
l AS (SELECT t.*, round(med, 9) AS classification_threshold, CAST(round(prediction, 9) >= round(med, 9) AS INTEGER) AS predicted_label
      FROM t, (SELECT median(prediction) AS med FROM t))
"""


@query("benchmark_run_gc", f"""{_GC_RUN}
SELECT r.*, {cat._cls_proj()} FROM (
  SELECT model, count(*) AS test_rows, round(avg(abs(actual - prediction)), 6) AS mae,
         round(avg((actual - prediction) * (actual - prediction)), 6) AS mse,
         round(any_value(classification_threshold), 6) AS classification_threshold, {cat._CONF_COLS}
  FROM l GROUP BY model) r""")
def benchmark_run_gc_q(spark, sf_dir) -> DataFrame:
    """W2, D1, D4, T2 end to end: with GC as the only feature least squares has a closed form."""
    from dnaframe.plans.jobs import BenchmarkRequest, benchmark_frames

    req = BenchmarkRequest(models=["linear_regression"], target_col="label", preprocessing={"use_gc": True, "use_kmers": False},
                           test_size=0.2, random_seed=42, threshold_strategy="median", threshold_scope="shared")
    out = benchmark_frames(fx.seqs(spark, sf_dir), req)["metrics"]
    return out.select("model", "test_rows", F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"),
                      F.round("classification_threshold", 6).alias("classification_threshold"), "true_negative", "false_positive",
                      "false_negative", "true_positive", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "mcc")])


@query("cross_validate_gc", f"""
WITH s AS ({fx.SEQS_SQL}), seqs AS (SELECT * FROM s),
f AS (SELECT row_id, CAST(label AS DOUBLE) AS y, {cat.gc_sql('sequence')} AS x FROM seqs),
p AS (SELECT f.*, fold FROM f JOIN ({cat._fold_sql('seqs', 42, 5)}) t USING (row_id)),
k AS (SELECT DISTINCT fold FROM p),
m AS (SELECT k.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM k JOIN p ON p.fold <> k.fold GROUP BY k.fold)
SELECT 'linear_regression' AS model, p.fold, round(avg(abs(y - (a * x + b))), 6) AS mae, round(avg((y - (a * x + b)) ** 2), 6) AS mse
FROM p JOIN m ON p.fold = m.fold GROUP BY p.fold""")
def cross_validate_gc_q(spark, sf_dir) -> DataFrame:
    """X4 executed: five exact folds, a least-squares fit on the other four each time."""
    from dnaframe.plans.jobs import BenchmarkRequest, cross_validate

    req = BenchmarkRequest(models=["linear_regression"], target_col="label", preprocessing={"use_gc": True, "use_kmers": False},
                           random_seed=42)
    per = cross_validate(fx.seqs(spark, sf_dir), req, folds=5)["per_fold"]
    return per.select("model", "fold", F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"))
