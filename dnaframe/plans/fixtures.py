"""Fixture views over the driver tables (see FIXTURES.md), in Spark and in plain SQL.

The driver tables hold no DNA column; both engines derive the same one from md5 digests of
the row key. Each ``*_sql`` string is a SELECT runnable by DuckDB over the pre-registered
views; the oracle queries use them as CTEs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789abcdef"
BASES16 = "ACGTACGTACGTACGT"
# the two regression / binary "models" of the synthetic score table and their seeds
SCORE_MODELS = (("linear_regression", 1), ("random_forest", 2))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as its scan gives it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dna(a: Column, b: Column) -> Column:
    return F.translate(F.concat(F.md5(a), F.md5(b)), HEX, BASES16)


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, sequence): 64 bases per row of ``labels``, binary label."""
    l = table(spark, sf_dir, "labels")
    return l.select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").alias("label"),
        _dna(F.col("doc_id").cast("string"), (F.col("doc_id") + 1000000).cast("string")).alias("sequence"),
    )


SEQS_SQL = """SELECT doc_id AS row_id, quality AS label,
  translate(md5(CAST(doc_id AS VARCHAR)) || md5(CAST(doc_id + 1000000 AS VARCHAR)),
            '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence
FROM labels"""


def seqs_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, sequence, target): whole raw ``documents`` texts as sequences."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("sequence"),
                    F.col("n_chars").cast("double").alias("target"))


SEQS_DIRTY_SQL = """SELECT doc_id AS row_id, text AS sequence, CAST(n_chars AS DOUBLE) AS target
FROM documents"""


def seq_of_order(key: Column) -> Column:
    """The bases that ``seqs_mid`` gives an order."""
    return _dna(key.cast("string"), (key + 1000000).cast("string"))


def seqs_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, target, sequence) over ``orders``; target = o_totalprice."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("target"),
        seq_of_order(F.col("o_orderkey")).alias("sequence"),
    )


SEQS_MID_SQL = """SELECT o_orderkey AS row_id, o_totalprice AS target,
  translate(md5(CAST(o_orderkey AS VARCHAR)) || md5(CAST(o_orderkey + 1000000 AS VARCHAR)),
            '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence
FROM orders"""


def lineitem_key() -> Column:
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws(":", *[F.col(c).cast("string") for c in parts], price.cast("string"))


def seqs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id STRING, target, sequence) over ``lineitem``; target = l_quantity."""
    li = table(spark, sf_dir, "lineitem").select(lineitem_key().alias("row_id"), F.col("l_quantity").alias("target"))
    return li.select("row_id", "target", _dna(F.col("row_id"), F.concat(F.col("row_id"), F.lit("#"))).alias("sequence"))


SEQS_LONG_SQL = """SELECT row_id, target,
  translate(md5(row_id) || md5(row_id || '#'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence
FROM (SELECT concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                       CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                       CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS row_id,
             l_quantity AS target
      FROM lineitem) t"""


def _unit_hash(seed: Column, key: Column) -> Column:
    """First 4 hex digits of md5(seed:key) over 65536, a value in [0, 1)."""
    h = F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string"))), 1, 4)
    return F.conv(h, 16, 10).cast("double") / F.lit(65536.0)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, row_id, actual, prediction): synthetic binary scores from ``labels``, 2 models."""
    l = table(spark, sf_dir, "labels")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed")) for m, s in SCORE_MODELS])
    x = l.select("doc_id", "quality", F.inline(models))
    return x.select(
        "model",
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("double").alias("actual"),
        _unit_hash(F.col("seed"), F.col("doc_id")).alias("prediction"),
    )


SCORES_SQL = """SELECT m.model, l.doc_id AS row_id, CAST(l.quality AS DOUBLE) AS actual,
  CAST(('0x' || substr(md5(CAST(m.seed AS VARCHAR) || ':' || CAST(l.doc_id AS VARCHAR)), 1, 4))::INTEGER AS DOUBLE)
    / 65536.0 AS prediction
FROM labels l, (VALUES ('linear_regression', 1), ('random_forest', 2)) m(model, seed)"""


def scores_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, row_id, actual, prediction): synthetic regression scores over ``orders``."""
    o = table(spark, sf_dir, "orders")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed")) for m, s in SCORE_MODELS])
    x = o.select("o_orderkey", "o_totalprice", F.inline(models))
    return x.select(
        "model",
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("actual"),
        (F.col("o_totalprice") * (F.lit(0.5) + _unit_hash(F.col("seed"), F.col("o_orderkey")))).alias("prediction"),
    )


SCORES_MID_SQL = """SELECT m.model, o.o_orderkey AS row_id, o.o_totalprice AS actual,
  o.o_totalprice * (0.5 + CAST(('0x' || substr(md5(CAST(m.seed AS VARCHAR) || ':' || CAST(o.o_orderkey AS VARCHAR)), 1, 4))::INTEGER AS DOUBLE)
    / 65536.0) AS prediction
FROM orders o, (VALUES ('linear_regression', 1), ('random_forest', 2)) m(model, seed)"""


FIXTURE_SQL = {
    "seqs": SEQS_SQL,
    "seqs_dirty": SEQS_DIRTY_SQL,
    "seqs_mid": SEQS_MID_SQL,
    "seqs_long": SEQS_LONG_SQL,
    "scores": SCORES_SQL,
    "scores_mid": SCORES_MID_SQL,
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the named fixture views as CTEs."""
    ctes = ",\n".join(f"{n} AS (\n{FIXTURE_SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{sql}"
