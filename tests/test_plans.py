"""Physical-plan properties that matter at scale (checked on the executed plan text)."""

from pyspark.sql import functions as F

from dnaframe.operators import features as feat
from dnaframe.operators import metrics as met
from dnaframe.operators import sampling as smp
from dnaframe.plans import fixtures as fx

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def raw(spark, name):
    """The driver table without the local core-spreading step, as a large scan would be."""
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_split_tagging_is_narrow(spark):
    o = raw(spark, "orders").select(F.col("o_orderkey").alias("row_id"))
    p = plan(smp.holdout_split(o, 0.2, 42))
    assert "Exchange" not in p and "Sort" not in p


def test_kmer_long_has_no_exchange(spark):
    o = raw(spark, "orders").select(F.col("o_orderkey").alias("row_id"), F.md5(F.col("o_orderkey").cast("string")).alias("sequence"))
    assert "Exchange" not in plan(feat.kmer_long(o, 4))


def test_spectrum_one_exchange_after_partial_agg(spark):
    o = raw(spark, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("sequence"))
    p = plan(feat.kmer_spectrum(o, 4))
    assert p.count("Exchange") == 1 and "partial_sum" in p


def test_scan_is_pruned_and_filter_pushed(spark):
    li = raw(spark, "lineitem").filter(F.col("l_quantity") > 10).select("l_orderkey", "l_quantity")
    p = plan(li)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_all_metrics_single_aggregation(spark):
    s = fx.scores(spark, SF).withColumn("predicted_label", (F.col("prediction") >= 0.5).cast("int")) \
        .withColumn("classification_threshold", F.lit(0.5))
    p = plan(met.all_metrics(s, binary_target=True))
    assert p.count("HashAggregate") == 2  # partial + final, one exchange on model


def test_whole_fingerprint_sees_every_column(spark, monkeypatch):
    from dnaframe.plans import catalog

    li = fx.table(spark, SF, "lineitem").limit(50).cache()
    digest = lambda df: (monkeypatch.setattr(fx, "table", lambda *_: df), catalog.QUERIES["table_fingerprint_whole"](spark, SF).first())[1]
    base = digest(li)
    assert base == digest(li.repartition(3))
    for c, kind in li.dtypes:
        changed = F.date_add(c, 1) if kind == "date" else F.concat(c, F.lit("x")) if kind == "string" else F.col(c) + F.expr(
            "interval 1 day" if kind.startswith("timestamp") else "1")
        assert digest(li.withColumn(c, F.when(F.rand(1) >= 0, changed))) != base, c
