"""Feature families stored by themselves and joined without an exchange."""

import pytest

from dnaframe.operators import features as feat
from dnaframe.sources import families, store
from tests.test_plans import plan


def test_joined_families_equal_features_made_at_once(spark, tmpdir_path):
    rows = [(i, "ACGTNACGT"[: i % 10] * (i % 4), str(i) if i % 5 else "none") for i in range(200)] + [(500, None, "1")]
    df = spark.createDataFrame(rows, "row_id long, sequence string, target string")
    cfg = feat.FeatureConfig(use_gc=True, use_kmers=True, kmer_size=2, use_one_hot=True, sequence_length=20)
    families.store_families(families.family_frames(df, "sequence", cfg, "target"), tmpdir_path, 4)
    x = families.join_families(spark, tmpdir_path, ["target", "gc", "kmers", "one_hot"])
    p = plan(x)
    assert "Exchange" not in p and p.count("SortMergeJoin") == 3, p
    got = {r.row_id: r for r in x.collect()}
    assert set(got) == {i for i, _, t in rows if t != "none"}
    for r in feat.build_features(df, "sequence", cfg, keep=("row_id",)).collect():
        if r.row_id in got:
            g = got[r.row_id]
            v = [g.gc_content] + [0.0] * 16 + list(g.one_hot)
            for s, n in zip(g.slots, g["values"]):
                v[1 + s] = n
            assert v == pytest.approx(list(r.features.toArray()))


def test_a_family_is_replaced_and_unknown_ones_are_refused(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "GC")], "row_id long, sequence string")
    cfg = feat.FeatureConfig(use_gc=True, use_kmers=False)
    for n in (1, 2):
        families.store_families(families.family_frames(df.unionByName(df.limit(n - 1)), "sequence", cfg), tmpdir_path, 2)
    assert families.load_family(spark, tmpdir_path, "gc").count() == 2
    with pytest.raises(ValueError, match="unknown family"):
        families.store_families({"shape": df}, tmpdir_path)


def test_buckets_grow_with_the_rows(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(families, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(i, "GCA", "1" if i % 2 else "none") for i in range(95)], "row_id long, sequence string, target string")
    cfg = feat.FeatureConfig(use_gc=True, use_kmers=False)
    frames = families.family_frames(df, "sequence", cfg, "target")
    for name in ("gc", "target"):  # stored one after the other, the smaller family last
        families.store_families({name: frames[name]}, tmpdir_path, 2)
    x = families.join_families(spark, tmpdir_path, ["target", "gc"])
    assert "Exchange" not in plan(x) and x.count() == 47
    assert [store.read_json(spark, tmpdir_path, "families", f"{n}.description")["buckets"] for n in ("gc", "target")] == [10, 10]
