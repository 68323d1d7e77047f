import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnaframe.llm import topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("id", T.StringType()),
                       T.StructField("norm", T.StringType())])


DOUBLES = T.StructType([SCHEMA[0], T.StructField("embedding", T.ArrayType(T.DoubleType())), *SCHEMA[2:]])


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], schema)


def brute(rows, k):
    """Every row is a query and a candidate for itself, also where ids repeat: sorted (query_id, rank, vec_id, score)."""
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for n, (q, a) in enumerate(usable):
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(usable) if m != n)
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def search(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in topk.topk_query(table(spark, rows, schema)).collect())


@pytest.mark.parametrize("block", [8192, 40])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "HEAD", 30)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * rng.uniform(0.1, 3)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(60)]  # ties
    rows += [(i, rows[i + 1][1]) for i in range(0, 200, 10)]  # repeated ids, queries among them
    assert search(spark, rows) == brute(rows, 20)


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0])]
    assert search(spark, rows) == [(0, 1, 1, 8192), (0, 2, 1, 2048)]


@pytest.mark.parametrize("big", [2.0**22, 1e12, 1e15])
def test_large_scores_are_ranked_exactly(spark, big):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * big).tolist()) for i in range(60)] + [(100 + i, [big, float(i), 0.0]) for i in range(8)]
    rows += [(200, [1.0, -1.0, 0.0, 0.5])]
    got = search(spark, rows, DOUBLES)
    assert got == brute(rows, 20)
    assert any(abs(r[3]) > 2**53 for r in got)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (20, [0.5, -1.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]),
            (100, [float("inf"), 1.0]), (1, [0.0, 0.0]), (2, []), (3, [1.0]), (None, [1.0, 1.0]), (4, [2.0, 2.0, 2.0]), (20, [9.0, 9.0])]
    got = search(spark, rows)
    assert got == brute(rows, 20) and {r[0] for r in got} == {0, 20} and sum(r[1] == 1 for r in got) == 4
    assert topk.topk_query(table(spark, [])).collect() == []
    assert topk.topk_query(table(spark, [(0, [1.0])])).collect() == []


def test_zero_vectors_and_negative_scores(spark):
    rows = [(i, [0.0, 0.0]) for i in range(50)] + [(i, [-1.0, -1.0]) for i in range(50, 80)] + [(100, [3.0, 1.0])]
    assert search(spark, rows) == brute(rows, 20)


def test_other_k_and_query_rule(spark):
    rows = [(i, [float(i), 1.0]) for i in range(10)]
    got = topk.top_k(table(spark, rows), F.col("vec_id") == 3, k=2).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 1, 9), (3, 2, 8)]
