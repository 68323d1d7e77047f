"""Centroid clustering against plain k-means in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from dnaframe.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, v string, id string, digit int"


def brute(rows, k=8, rounds=10, dim=64, scale=1024):
    """[(vec_id, cluster, distance)], centroids, from rows [(vec_id, vector)]."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = {i: hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "x" for i, _ in kept}
    cents = [v for _, v in sorted(kept, key=lambda r: (name[r[0]], r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        cents = [[sum(col) // len(g) for col in zip(*g)] if g else c for g, c in zip(groups, cents)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], cents


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x", 1) for i, v in rows], schema)


def check(spark, rows, schema=SCHEMA):
    got = sorted(map(tuple, clusters.clusters_query(frame(spark, rows, schema)).collect()), key=str)
    expect, cents = brute(rows)
    inertia = {}
    for _, c, d in expect:
        inertia[c] = inertia.get(c, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    cut = lambda n: min(n, 2**63 - 1)
    assert got == sorted(((i, c, cut(d), cut(inertia[c]), cut(sum(map(cut, inertia.values()))), names[c]) for i, c, d in expect), key=str)
    return got


def vectors(n, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    mids = rng.standard_normal((6, dim))
    return [(i, [float(np.float32(x)) for x in mids[i % 6] + 0.8 * rng.standard_normal(dim)]) for i in range(n)]


def test_matches_plain_k_means(spark):
    assert len(check(spark, vectors(150))) == 150


def test_awkward_vectors(spark):
    rows = vectors(30, seed=2)
    v = rows[0][1]
    rows += [(100, None), (101, []), (102, v[:63]), (103, [*v, 1.0]), (104, [None, *v[1:]]), (105, [math.nan, *v[1:]]),
             (106, [math.inf, *v[1:]]), (0, v), (0, rows[1][1]), (None, v), (None, rows[3][1]), (107, [0.0] * 64)]
    assert len(check(spark, rows)) == 35


def test_equal_vectors_and_empty_centroids(spark):
    rows = [(i, [1.0 + (i % 3 == 0)] * 64) for i in range(20)]  # centroids repeat: ties go to the smaller number
    check(spark, rows)
    check(spark, [(i, [0.5] * 64) for i in range(3)])  # fewer vectors than centroids


@pytest.mark.parametrize("big", [1e6, 1e15, 3e38])
def test_large_components_stay_exact(spark, big):
    rows = vectors(24, seed=4) + [(50 + i, [big * (1 + i)] * 32 + [-big] * 32) for i in range(3)]
    check(spark, rows, SCHEMA.replace("array<float>", "array<double>"))


def test_empty_table(spark):
    out = clusters.clusters_query(frame(spark, []))
    assert out.collect() == []
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_search_passes_over_most_centroids():
    rng = np.random.default_rng(8)
    cents = [[int(x) for x in c] for c in rng.integers(-500, 500, (64, 1)) + rng.integers(-40, 40, (64, 16))]
    x = np.array(cents)[rng.integers(0, 64, 300)] + rng.integers(-10, 10, (300, 16))
    search = clusters.Search(cents)
    cluster, dist = search.nearest(x)
    every = ((x[:, None, :] - np.array(cents)[None]) ** 2).sum(axis=2)
    assert (dist == every.min(axis=1)).all() and (cluster == every.argmin(axis=1)).all()
    assert search.compared < 0.2 * every.size
