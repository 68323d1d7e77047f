import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from dnaframe.operators import quantiles as qt


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [(g, i % 7, x, int(x * 1000)) for g, n in (("a", 20_000), ("b", 9000), (None, 3000), ("c", 5)) for i in range(n)
            for x in [rng.gauss(0, 5)]]
    rows += [("a", 1, math.nan, None)] * 40 + [("a", 1, None, None)] * 30 + [("b", 1, 2.5, 2500)] * 4000 + [("n", 0, math.nan, 1)] * 3
    return rows, spark.createDataFrame(rows, "g string, part int, x double, w bigint").repartition(9)


@pytest.mark.parametrize("col,at", [("x", 2), ("w", 3)])
def test_ranks_of_every_group_are_exact_under_the_sketch(values, monkeypatch, col, at):
    rows, df = values
    by_group = {}
    for r in rows:
        if r[at] is not None:
            by_group.setdefault(r[0], []).append(r[at])
    by_group = {g: sorted(v, key=lambda x: (math.isnan(x), x)) for g, v in by_group.items()}
    ranks = {g: sorted({1, 2, len(v) // 4 + 1, len(v) // 2 + 1, max(1, len(v) - 1), len(v)}) for g, v in by_group.items()}
    brackets, real = [], qt._brackets
    monkeypatch.setattr(qt, "_brackets", lambda s, k, tasks, *rest: (real(s, k, tasks, *rest), brackets.extend(tasks)))
    got = qt.order_statistics(df, col, ranks, "g", max_candidates=400)
    for g, ks in ranks.items():
        for k in ks:
            want = by_group[g][k - 1]
            assert got[g, k] == want or (math.isnan(got[g, k]) and math.isnan(want)), (g, k)
    assert {t["g"] for t in brackets} == {"a", "b", None} and all(t["first"] for t in brackets)
    # a sketch that is far off is found out by the counts
    monkeypatch.setattr(qt, "SKETCH_ERROR", 0.0)
    monkeypatch.setattr(qt, "_brackets", lambda s, k, tasks, *rest: [t.update(first=(0.1, 0.2) if col == "x" else (100, 200)) for t in tasks])
    again = qt.order_statistics(df, col, ranks, "g", max_candidates=400)
    assert all(again[i] == v or (math.isnan(again[i]) and math.isnan(v)) for i, v in got.items())


def test_stored_sketches_combine(values, tmp_path):
    rows, df = values
    path = str(tmp_path / "sketches")
    qt.quantile_sketches(df, "x", ["g", "part"]).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    merged = qt.merge_sketches(stored, "double", ["g"])
    for r in merged.withColumn("quantiles", qt.sketched_quantiles("double", [0.25, 0.5, 0.99])).collect():
        every = [x for g, _, x, _ in rows if g == r.g and x is not None]
        numbers = sorted(x for x in every if not math.isnan(x))
        assert (r.n, r.numbers) == (len(every), len(numbers))
        if not numbers:
            assert r.quantiles is None
            continue
        for p, q in zip((0.25, 0.5, 0.99), r.quantiles):
            below, upto = sum(x < q for x in numbers), sum(x <= q for x in numbers)
            assert below - 2 - 3 * qt.SKETCH_ERROR * len(numbers) <= p * len(numbers) <= upto + 2 + 3 * qt.SKETCH_ERROR * len(numbers)
    whole = qt.merge_sketches(stored, "double").first()
    assert whole.numbers == sum(1 for r in rows if r[2] is not None and not math.isnan(r[2]))


def test_quantiles_of_a_null_group_and_of_no_rows(values):
    rows, df = values
    got = qt.exact_quantiles(df, "x", [0.5], "g", max_candidates=100)
    assert got[None, 0.5] == pytest.approx(statistics.median(r[2] for r in rows if r[0] is None))
    assert qt.exact_quantiles(df.filter("false"), "x", [0.5]) == {(None, 0.5): None}
    assert qt.exact_quantiles(df.filter("false"), "x", [0.5], "g") == {}
    days = df.select(F.date_add(F.lit("2020-01-01").cast("date"), "part").alias("d"))
    found = qt.order_statistics(days, "d", {None: [1, days.count()]}, max_candidates=50)
    assert [str(found[None, k]) for k in (1, days.count())] == ["2020-01-01", "2020-01-07"]
