from collections import Counter

import pytest

from dnaframe.llm import mixing
from tests.llm.conftest import prose


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.fixture(scope="module")
def docs(make):
    rows = [(i, prose(40 + 13 * i % 500, i), "en", ["hot", "a", "b", "ü", None, "hot", "hot"][i % 7]) for i in range(150)]
    return make(rows + [(500, prose(9000, 3), "en", "long"), (501, None, "en", "hot"), (502, "", "en", "void")])


def test_targets_and_taken_words(docs):
    rows = mixing.mixing_query(docs).toPandas()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    want = brute_targets(sizes)
    taken = Counter()
    for r in rows.itertuples():
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(source)
    assert all(abs(taken[s] - want[s]) <= 3 * 128 for s in want)


def test_reruns_agree_under_any_partitioning(spark, docs):
    a = {(r.doc_id, r.taken) for r in mixing.mixing_query(docs).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert a == {(r.doc_id, r.taken) for r in mixing.mixing_query(docs.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_slots_are_permutations_and_quotas_are_met(docs):
    m = mixing.mix(docs.select("doc_id", "source", "text"))
    slots = m.slots.toPandas()
    quota = {r.sid: r.quota for r in m.targets.collect()}
    blocks = {r.sid: r.blocks for r in m.targets.collect()}
    for sid, s in slots.groupby("sid"):
        assert sorted(s["rank"]) == list(range(quota[sid]))
        for _, use in s.groupby("use"):
            assert use.block.is_unique and use.block.between(0, blocks[sid] - 1).all()
        assert set(s[s.use == 0].block) == set(range(blocks[sid])) or quota[sid] < blocks[sid]
    parts = m.parts.toPandas().groupby(["sid", "block"]).words.sum()
    assert parts.max() <= 128 and (parts < 128).sum() <= len(quota)


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), 42).alias("p")).toPandas().p
        assert sorted(got) == list(range(n))
    assert list(got) != list(range(n))


def test_mixed_documents_hold_the_taken_words(docs):
    out = mixing.mixed_documents(docs)
    assert out.schema.fieldNames() == docs.columns
    rows = out.collect()
    taken = Counter({r.doc_id: r.taken for r in mixing.mixing_query(docs.select("doc_id", "source", "text")).collect()})
    assert sum(len(r.text.split()) for r in rows) == pytest.approx(sum(taken.values()), rel=0.01)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or not Counter(r.text.split()) - Counter(texts[r.doc_id].split())


def test_awkward_rows(awkward, empty):
    rows = mixing.mixing_query(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.taken == 0 for r in rows if r.size == 0) and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mixing_query(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    assert mixing.mixed_documents(awkward).schema.fieldNames() == awkward.columns


def test_tables_with_maps(spark):
    """Maps name a row like any other column: the order of a map's entries does not matter."""
    from dnaframe.llm import packing, simhash
    from dnaframe.llm.common import row_hash

    schema = "doc_id long, text string, source string, lang string, tags map<string,int>, deep struct<m:map<string,int>>"
    rows = [(i % 9, prose(40, i % 9), "a", "en", t, ({"k": i % 9},)) for i, t in enumerate([{"x": 1, "y": None}, {"y": None, "x": 1}] * 9)]
    docs = spark.createDataFrame(rows + [(20, prose(50, 3), None, None, None, None), (21, None, "b", None, {}, (None,))], schema)
    assert docs.select(row_hash(docs).alias("h")).distinct().count() == 11
    assert simhash.deduplicated(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert packing.packed_documents(docs).filter("doc_id = 20").count() == 1
