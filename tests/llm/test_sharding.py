import zlib
from collections import Counter

import pytest

from dnaframe.llm import sharding
from tests.llm.conftest import prose


def checked(docs, rows, shards):
    texts = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None)
    size = {i: len((t or "").encode()) + 16 for i, t in texts}
    for r in rows:
        if r.doc_id is not None:
            assert r.size == size[r.doc_id]
    for s in range(shards):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    return load


def test_groups_stay_together_and_sizes_are_even(make):
    rows = [(i, prose(20 + i % 90, i)) for i in range(600)] + [(1000 + i, prose(50, 5000 + i // 6)) for i in range(240)]
    docs = make(rows)
    got = sharding.shard(docs, shards=8).collect()
    load = checked(docs, got, 8)
    mean = sum(load.values()) / 8
    assert len(got) == 840 and max(load.values()) - min(load.values()) < 0.02 * mean
    place = {r.doc_id: r.shard for r in got}
    groups = [{place[1000 + i] for i in range(a, a + 6)} for a in range(0, 240, 6)]
    assert all(len(g) == 1 for g in groups)


def test_a_group_too_large_for_one_shard_takes_few(make):
    docs = make([(i, "the same text " * 10) for i in range(300)] + [(1000 + i, prose(25, i)) for i in range(600)])
    got = sharding.shard(docs, shards=10).collect()
    load = checked(docs, got, 10)
    mean = sum(load.values()) / 10
    assert max(load.values()) - min(load.values()) < 0.05 * mean
    need = 300 * 156 / mean
    assert len({r.shard for r in got if r.doc_id < 1000}) <= need + 3


def test_query_columns(make):
    docs = make([(1, "abc"), (2, "é"), (3, None), (4, "")])
    rows = {r.doc_id: r for r in sharding.sharding_query(docs).collect()}
    assert [rows[i].size for i in (1, 2, 3, 4)] == [19, 18, 16, 16]
    assert rows[2].text_crc32 == zlib.crc32("é".encode()) and rows[3].text_crc32 == 0
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40 for r in rows.values())


def test_awkward_rows(awkward, empty):
    rows = sharding.sharding_query(awkward).collect()
    assert len(rows) == awkward.count()
    assert sharding.sharding_query(empty).collect() == []


@pytest.mark.parametrize("shards", [1, 3])
def test_few_shards(make, shards):
    docs = make([(i, "t" * (i % 7)) for i in range(50)])
    got = sharding.shard(docs, shards=shards).collect()
    assert len(got) == 50 and {r.shard for r in got} <= set(range(shards))
    checked(docs, got, shards)
