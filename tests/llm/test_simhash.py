import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dnaframe.llm import simhash
from tests.llm.conftest import prose


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for f in fps:
        out.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("text", ["", " \n", "A b", "a b c d", "İ Ü a b c d E f g", prose(500), "x " * 1000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(), 4) == brute_fingerprint(text)


def test_every_pair_within_the_radius_shares_a_bucket():
    masks = simhash.covering(4, 64, 7)
    assert len(masks) == 31
    rng = np.random.default_rng(0)
    for _ in range(5000):
        diff = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("split", [2048, 32])
def test_links_join_all_near_fingerprints(spark, split):
    rng = np.random.default_rng(1)
    fps = set()
    for centre in [0, 2**64 - 1, *map(int, rng.integers(0, 2**63, 3))]:
        for _ in range(120):
            fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)))
    signed = {f: f - 2**64 if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.near_links(df, 4, split)).collect()}
    groups = {}
    for f, s in signed.items():
        groups.setdefault(found.get(s, s), set()).add(f)
    assert sorted(map(sorted, groups.values())) == brute_components(fps)


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert {found[i] for i in range(1, 201)} == {0} and found[1001] == 1000


def test_query_against_brute_force(make):
    base = prose(400, 9)
    rows = [(i, base.replace("the", "thee", i % 3)) for i in range(5, 12)] + [(i, prose(50, i)) for i in range(20, 30)] + [(40, prose(50, 20).upper())]
    found = {r.doc_id: r for r in simhash.simhash_query(make(rows)).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == {i: brute_fingerprint(t) for i, t in rows}
    groups = {frozenset(f) for f in map(tuple, brute_components({brute_fingerprint(t) for _, t in rows}))}
    least = {}
    for g in groups:
        ids = [i for i, t in rows if brute_fingerprint(t) in g]
        least |= {i: min(ids) for i in ids}
    assert {i: r.component_id for i, r in found.items()} == least


def test_awkward_rows(awkward, empty):
    rows = simhash.simhash_query(awkward).collect()
    assert len(rows) == awkward.count()
    none = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {(r.fingerprint, r.component_id) for r in none} == {("0" * 16, 1)}
    stay = simhash.deduplicated(awkward)
    assert stay.columns == awkward.columns and stay.schema == awkward.schema
    ids = [r.doc_id for r in stay.collect()]
    assert 1 in ids and 2 not in ids and 6 not in ids and 12 not in ids and ids.count(5) == 1 and 8 in ids
    assert simhash.simhash_query(empty).collect() == [] and simhash.deduplicated(empty).collect() == []


def test_one_of_each_component_stays(make):
    docs = make([(3, prose(60)), (2, prose(60)), (2, prose(60)), (9, prose(60, 4))])
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [2, 9]
    assert simhash.deduplicated(docs).filter(F.col("doc_id") == 2).first().row == "x"


def test_groups_grow_in_number_with_the_rows(spark, monkeypatch):
    fps = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % 2**62 ^ (1 << i % 3),) for i in range(60)] + [(7,), (15,)], "fp long")
    want = {tuple(r) for r in simhash.near_links(fps).collect()}
    monkeypatch.setattr(simhash, "GROUP", 4)
    assert (15, 7) in want and {tuple(r) for r in simhash.near_links(fps).collect()} == want
