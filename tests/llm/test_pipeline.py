"""The pipeline on a small table: each stage on what its predecessor kept, against plain Python."""

import random

import pytest

import corpus_pipeline as cp
from tests.llm.conftest import prose
from tests.llm.test_langid import LANGS
from tests.llm.test_secrets import brute_base
from tests.llm.test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def docs(make):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(LANGS[k].split()) + rng.choice(["", "", "n", "s"]) for _ in range(60 + i)), k, "abc"[i % 3])
            for i in range(60) for k in [list(LANGS)[i % 3]]]
    rows += [(100 + i, rows[i][1].replace("a", "a", 1), rows[i][2], "hot") for i in range(20)]  # copies
    rows += [(200, "12 34 %%", "en", "a"), (201, None, "en", "a"), (207, "漢字" * 60, "en", "a")]  # 207 is held out of training
    rows += [(300 + i, prose(70, i) + f" password = 'hunter{i}xyz' AKIA" + "ABCDEFGHIJKLMNOP" + " the end", "en", "b") for i in range(6)]
    return make(rows)


def test_the_stages_are_the_dealt_ones():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "secret_scan", "source_mixing", "bin_packing"]


def test_every_stage_on_its_own_input(spark, docs, tmpdir_path):
    kept = {}
    table = docs
    for name, stage in cp.STAGES:
        out = stage(spark, table, tmpdir_path)
        if name != "bin_packing":
            assert out.schema.fieldNames() == docs.columns
        out.write.parquet(f"{tmpdir_path}/{name}")
        kept[name] = (table, spark.read.parquet(f"{tmpdir_path}/{name}"))
        table = kept[name][1]
    rows = {name: (before.collect(), after.collect()) for name, (before, after) in kept.items()}

    before, after = rows["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {200, 201, 207}

    before, after = rows["near_dedup"]
    fps = {r.doc_id: brute_fingerprint(r.text) for r in before}
    groups = brute_components(set(fps.values()))
    assert sorted(r.doc_id for r in after) == sorted(min(i for i, f in fps.items() if f in g) for g in groups)

    before, after = rows["secret_scan"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert not any(brute_base(r.text) for r in after)
    clean = {r.doc_id: r.text for r in before if not brute_base(r.text)}
    assert all(r.text == clean[r.doc_id] for r in after if r.doc_id in clean) and len(clean) >= 40

    before, after = rows["source_mixing"]
    words = {r.doc_id: len(r.text.split()) for r in before}
    taken = {}
    for r in after:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 2 * words[i] for i, n in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(words.values()), rel=0.1)

    before, after = rows["bin_packing"]
    assert sorted(r.text for r in after) == sorted(r.text for r in before)
    bins = {}
    for r in after:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for b in bins.values():
        assert sum(r.words for r in b) <= 2048 and len({r.source for r in b}) == len(b)


def test_run_over_a_folder(spark, docs, empty, tmpdir_path):
    docs.write.parquet(f"{tmpdir_path}/x/documents.parquet")
    assert cp.run(spark, f"{tmpdir_path}/x").count() > 40
    empty.write.parquet(f"{tmpdir_path}/y/documents.parquet")
    assert cp.run(spark, f"{tmpdir_path}/y").collect() == []
