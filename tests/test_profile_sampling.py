"""Profiling (M8-M14) and exact seeded sampling properties."""

import math

import pytest
from pyspark.sql import functions as F

from dnaframe.operators import profile as prof
from dnaframe.operators import sampling as smp
from dnaframe.plans import fixtures as fx

SF = "/root/testdata/sf0.01"


def test_infer_column_priority_and_case():
    assert prof.column_for_role(["Label", "TARGET"], prof.TARGET_CANDIDATES) == "TARGET"
    assert prof.column_for_role(["seq", "Sequence"], prof.SEQUENCE_CANDIDATES) == "Sequence"
    assert prof.target_column(["a", "label"], "missing") == "label"
    with pytest.raises(ValueError):
        prof.target_column(["a"], "missing")


def test_summary_edges(spark):
    zero = spark.createDataFrame([(0,)] * 4, "t int")
    s = prof.target_summary(zero, "t").first()
    assert s.binary_numeric and s.class_count == 1 and s.minority_fraction is None and not s.imbalance_detected
    edge = spark.createDataFrame([(1,)] * 7 + [(0,)] * 13, "t int")
    s = prof.target_summary(edge, "t").first()
    assert s.minority_fraction == 0.35 and not s.imbalance_detected
    s = prof.target_summary(fx.seqs(spark, SF), "label").first()
    assert s.row_count_with_target == 399 and s.minority_fraction == round(58 / 399, 4) and s.imbalance_detected


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_split_exact_and_partition_independent(spark, parts):
    base = fx.seqs_mid(spark, SF).select("row_id").repartition(parts)
    s = smp.holdout_split(base, 0.07, 42)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["test"] == math.ceil(0.07 * 15000) and counts["train"] == 15000 - counts["test"]
    ref = smp.holdout_split(fx.seqs_mid(spark, SF).select("row_id"), 0.07, 42)
    assert s.filter("split = 'test'").select("row_id").subtract(ref.filter("split = 'test'").select("row_id")).count() == 0


def test_kfold_sizes_and_cover(spark):
    base = fx.seqs(spark, SF).select("row_id")
    f = smp.kfold(base, 5, 3)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == sorted(smp.kfold_sizes(399, 5)) and sum(sizes) == 399


def test_undersample_modes(spark):
    s = fx.seqs(spark, SF).select("row_id", "label")
    rows, applied = smp.undersample(s, "label", 42, "undersample")
    assert applied and {r.label: r["count"] for r in rows.groupBy("label").count().collect()} == {0: 58, 1: 58}
    same, applied = smp.undersample(s, "label", 42, "none")
    assert not applied and same.count() == 399
    mid = fx.seqs_mid(spark, SF).select("row_id", "target")
    _, applied = smp.undersample(mid, "target", 42, "undersample")
    assert not applied  # not binary
    balanced = spark.createDataFrame([(i, i % 2) for i in range(20)], "row_id int, label int")
    _, applied = smp.undersample(balanced, "label", 1, "auto_undersample")
    assert not applied


def test_cap_rows(spark):
    df = fx.seqs_mid(spark, SF).select("row_id")
    rows, flag = prof.cap_rows(df, 1000)
    ids = sorted(r.row_id for r in rows.collect())
    assert len(ids) == 1000 and flag.first()[0]
    assert ids == sorted(r.row_id for r in df.orderBy("row_id").limit(1000).collect())


def test_repeated_holdout_per_seed(spark):
    x = smp.repeated_holdout(fx.seqs(spark, SF).select("row_id"), 0.25, [1, 2])
    c = {(r.seed, r.split): r["count"] for r in x.groupBy("seed", "split").count().collect()}
    assert c[(1, "test")] == c[(2, "test")] == math.ceil(0.25 * 399)


def test_seeded_order_is_deterministic(spark):
    base = fx.seqs(spark, SF).select("row_id")
    a = [r.row_id for r in smp.seeded_order(base.repartition(3), 9).collect()]
    b = [r.row_id for r in smp.seeded_order(base.repartition(11), 9).collect()]
    assert a == b and sorted(a) == sorted(r.row_id for r in base.collect())


def test_provided_split(spark):
    t = spark.createDataFrame([(1,), (2,)], "row_id int")
    v = spark.createDataFrame([(3,)], "row_id int")
    s = spark.createDataFrame([(4,)], "row_id int")
    got = {r.row_id: r.split for r in smp.provided_split(t, v, s).collect()}
    assert got == {1: "train", 2: "train", 3: "validation", 4: "test"}


def test_split_manifest_columns(spark):
    m = smp.split_manifest(fx.seqs(spark, SF), 7, 0.2, 0.1, 5)
    assert m.columns == ["row_id", "seed", "split", "fold"] and m.count() == 399


def test_second_histogram_level_gives_same_rows(spark, monkeypatch):
    base = fx.seqs_mid(spark, SF).select("row_id")
    ref = {r.row_id: (r.split, r.fold) for r in smp.kfold(smp.holdout_split(base, 0.2, 42, validation_size=0.1), 5, 42).collect()}
    monkeypatch.setattr(smp, "RANK_DIRECTLY", 0)  # force the level-2 histogram path
    got = {r.row_id: (r.split, r.fold) for r in smp.kfold(smp.holdout_split(base, 0.2, 42, validation_size=0.1), 5, 42).collect()}
    assert got == ref


def test_split_sizes_property(spark):
    """Exact sizes for random n and fractions, including 0- and 1-row tables."""
    import random

    rnd = random.Random(17)
    cases = [(0, 0.2, 0.1), (1, 0.05, 0.0), (2, 0.5, 0.4)] + [
        (rnd.randint(3, 400), round(rnd.uniform(0.05, 0.5), 3), round(rnd.uniform(0.0, 0.4), 3)) for _ in range(6)]
    for n, t, v in cases:
        df = spark.range(n).withColumnRenamed("id", "row_id")
        got = {r.split: r["count"] for r in smp.holdout_split(df, t, n, validation_size=v).groupBy("split").count().collect()}
        train, val, test = smp.holdout_sizes(n, t, v)
        assert (got.get("train", 0), got.get("validation", 0), got.get("test", 0)) == (train, val, test), (n, t, v)
        assert test == (math.ceil(t * n) if n else 0)


def test_preview_fill_and_round(spark):
    df = spark.createDataFrame([(2, None, 0.1234567), (1, "x", 1.0)], "row_id int, s string, v double")
    rows = prof.preview(df, 1, round_cols=["v"], fill_blank=True).collect()
    assert len(rows) == 1 and rows[0].row_id == 1
    rows = prof.preview(df, 5, round_cols=["v"], fill_blank=True).collect()
    assert rows[1].s == "" and rows[1].v == "0.123457"


def test_describe_with_nulls(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4]] + [(None,)], "x double")
    r = prof.describe(df, ["x"]).first()
    assert (r["count"], r.mean, r["min"], r.q25, r.q50, r.q75, r["max"]) == (4, 2.5, 1.0, 1.75, 2.5, 3.25, 4.0)
    assert r.std == round(statistics_stdev([1, 2, 3, 4]), 6)


def statistics_stdev(v):
    import statistics

    return statistics.stdev(v)


def test_cap_rows_string_ids(spark):
    df = spark.createDataFrame([(f"id{i:03d}",) for i in range(30)], "row_id string")
    rows, flag = prof.cap_rows(df, 10)
    assert sorted(r.row_id for r in rows.collect()) == [f"id{i:03d}" for i in range(10)] and flag.first()[0]
