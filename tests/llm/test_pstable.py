"""p-stable near-dedup of vectors against every pair's exact cosine."""

import math

import numpy as np
import pytest

from dnaframe.llm import pstable

SCHEMA = "vec_id long, embedding array<float>, label int, node string, size string, raw string, keys string, t string, root string"
DOUBLES = SCHEMA.replace("array<float>", "array<double>")


def brute(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) in the order of ``rows`` [(vec_id, vector)]."""
    unit = []
    for _, v in rows:
        ok = v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    dim = max([len(u) for u in unit if u is not None], default=1)
    unit = [None if u is None else np.pad(u, (0, dim - len(u))) for u in unit]
    links = [[j for j, w in enumerate(unit) if j != i and u is not None and w is not None and u @ w >= cosine] for i, u in enumerate(unit)]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((vec_id, len(links[i]), least, vec_id is not None and vec_id == least))
    return out


def found(spark, rows, schema=SCHEMA, **options):
    frame = spark.createDataFrame([(i, v, 1, *["x"] * 6) for i, v in rows], schema)
    got = pstable.near_duplicate_vectors(frame, "vec_id", **options)
    assert got.columns == ["id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


def crowd(n=240, dim=16, seed=3):
    """Groups of close vectors, chains whose ends are far apart, and unrelated ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n // 12):
        mid = rng.standard_normal(dim)
        step = rng.standard_normal(dim)
        for k in range(12):
            near = mid + 0.25 * rng.standard_normal(dim) if g % 2 else mid + 0.3 * k * step
            rows.append(near * rng.uniform(0.1, 40))
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(5 * n)[: len(rows)], rows)]


def test_links_and_components_match_brute_force(spark):
    rows = crowd()
    rows += [(10_000 + i, rows[i][1]) for i in range(40)]  # copies
    expect = brute(rows)
    assert sum(n for _, n, _, _ in expect) > 500
    assert found(spark, rows) == sorted(expect, key=str)


@pytest.mark.parametrize("block", [4, 33])
def test_blocks_of_a_crowded_bucket_lose_no_pair(spark, block):
    rng = np.random.default_rng(5)
    mid = rng.standard_normal(8)
    rows = [(i, (mid + 0.2 * rng.standard_normal(8)).tolist()) for i in range(150)]
    assert found(spark, rows, DOUBLES, block=block) == sorted(brute(rows), key=str)


def test_awkward_vectors(spark):
    a, b = [1.0, 0.0, 0.5], [1.0, 0.0, 0.25]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [1.0, math.nan, 0.0]), (6, [math.inf, 0.0, 0.0]),
            (7, a), (8, a), (8, a), (8, [-1.0, 0.0, 0.0]), (9, b), (None, b), (None, [0.0, 0.0, -3.0]), (10, [2.0, 0.0]), (11, [0.0, -1.0]),
            (12, [x * 1e30 for x in a]), (13, [-0.0, 0.0, -3.0])]
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_doubles_of_any_size(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1.01e-300]), (3, [1e300, -1e300])]
    assert found(spark, rows, DOUBLES) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_plan_misses_few_pairs_at_the_threshold():
    near = math.sqrt(0.2)
    for n in (0, 1, 1000, 10**6, 10**9):
        width, per, tables = pstable.plan(n, 0.9)
        assert (1 - pstable.collision(width, near) ** per) ** tables <= 1e-3 * 1.001
        assert n * pstable.collision(width, math.sqrt(2)) ** per <= 513


def test_recall_against_brute_force_on_the_table(spark):
    """Pairs around the threshold: at least 0.9 of the true links, none that is not one."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((150, 64))
    rows = []
    for i, v in enumerate(base):
        for k, angle in enumerate((0, 0.42, 0.44, 0.46)):  # cosine 0.9 is an angle of 0.451
            other = rng.standard_normal(64)
            other -= other @ v / (v @ v) * v
            u = math.cos(angle) * v / np.linalg.norm(v) + math.sin(angle) * other / np.linalg.norm(other)
            rows.append((4 * i + k, [float(np.float32(c)) for c in u]))
    expect = {r[0]: r[1] for r in brute(rows)}
    got = {r[0]: r[1] for r in found(spark, rows, crowd=16)}
    assert all(got[i] <= expect[i] for i in expect)
    assert sum(got.values()) >= 0.98 * sum(expect.values()) > 0
