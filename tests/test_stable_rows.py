"""Row ids, registry reads, and split strategies hold whatever the scan settings or the stored columns."""

import os

import pytest
from pyspark.sql import functions as F

from dnaframe.functions.hashing import table_fingerprint
from dnaframe.functions.sequence import to_numeric
from dnaframe.operators import sampling as smp
from dnaframe.operators import thresholds as thr
from dnaframe.plans import jobs
from dnaframe.sources import sbol, store, tabular


def write(path, text):
    with open(path, "w", newline="") as fh:
        fh.write(text)
    return path


def sequences(n, seed=1):
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(n)]


@pytest.fixture()
def folder(tmpdir_path):
    """Three files whose sizes are not in the order of their names."""
    at = 0
    d = os.path.join(tmpdir_path, "in")
    os.makedirs(d)
    for name, n in (("a.csv", 7), ("b.csv", 700), ("c.csv", 60)):
        write(os.path.join(d, name), "sequence,label,nr\n" + "".join(f"{s},{i % 2},{at + i}\n" for i, s in enumerate(sequences(n))))
        at += n
    return d


def test_row_ids_do_not_depend_on_the_split_size(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    tests = []
    try:
        for size in ("128m", "3000", "701"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = tabular.read_delimited(spark, folder)
            rows = df.collect()
            assert len(rows) == 767 and all(r.row_id == r.nr for r in rows)  # files by name, rows as they stand
            tests.append({r.row_id for r in smp.holdout_split(df, 0.2, 42).filter("split = 'test'").collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tests[0] == tests[1] == tests[2] and len(tests[0]) == 154


def test_a_folder_is_ingested(spark, folder, tmpdir_path):
    m = jobs.ingest(spark, folder, os.path.join(tmpdir_path, "store"))
    assert m["row_count"] == 767 and m["source_format"] == ".csv"
    write(os.path.join(folder, "d.fasta"), ">a\nACGT\n")
    with pytest.raises(ValueError, match="2 formats"):
        jobs.read_any(spark, folder)


def test_datasets_with_other_columns_read_back_as_stored(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "store")
    a = write(os.path.join(tmpdir_path, "a.csv"), "sequence,label\nACGT,1\nGGCC,0\n")
    b = write(os.path.join(tmpdir_path, "b.csv"), "id,seq,target,extra\nx,AC,1.5,q\ny,GT,2.5,\n")
    for path, name in ((a, "one"), (b, "two")):
        jobs.ingest(spark, path, root, name)
    for path, name in ((a, "one"), (b, "two")):
        want = tabular.read_delimited(spark, path)
        got = store.load_dataset(spark, root, name)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(got.collect()) == sorted(want.collect())


def test_runs_of_two_kinds_keep_their_columns(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "store")
    rows = [(i, s, i % 2, float(i)) for i, s in enumerate(sequences(40))]
    df = spark.createDataFrame(rows, "row_id long, sequence string, label int, price double")
    pre = {"use_gc": True, "use_kmers": False}
    binary = jobs.run_benchmark(spark, root, jobs.BenchmarkRequest(target_col="label", preprocessing=pre), df)["run"]["run_id"]
    real = jobs.run_benchmark(spark, root, jobs.BenchmarkRequest(target_col="price", preprocessing=pre), df)["run"]["run_id"]
    b, r = store.get_run(spark, root, binary), store.get_run(spark, root, real)
    assert "mcc" in b["metrics"].columns and b["metrics"].first().mcc is not None
    assert r["metrics"].first().mae > 0 and b["run"].first().target_kind != r["run"].first().target_kind
    assert "predicted_label" in b["predictions"].columns
    assert {x.run_id for x in store.list_runs(spark, root).collect()} == {binary, real}


def test_each_models_own_median_whatever_the_scope(spark):
    p = spark.createDataFrame([("a", i, 0.1 * i) for i in range(5)] + [("b", i, 0.5 + 0.1 * i) for i in range(5)],
                              "model string, row_id int, prediction double")
    for scope in ("shared", "per_model"):
        got = thr.resolve_thresholds(p, "median", scope=scope)
        assert got["a"] == pytest.approx(0.2) and got["b"] == pytest.approx(0.7)


def test_boolean_targets_are_numbers(spark):
    df = spark.createDataFrame([(True, "true"), (False, "1"), (None, None)], "b boolean, t string")
    rows = df.select(to_numeric("b").alias("b"), to_numeric("t").alias("t")).collect()
    assert [tuple(r) for r in rows] == [(1.0, None), (0.0, 1.0), (None, None)]


def test_a_reference_to_a_node_is_no_number(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "x.xml"), '<r:RDF xmlns:r="urn:r" xmlns:e="urn:e"><e:s><e:p r:resource="7"/><e:v>2.5</e:v></e:s></r:RDF>')
    assert sbol.read_sbol(spark, p).first().target == 2.5


def test_fingerprint_tells_places_and_nulls_apart(spark):
    make = lambda rows: table_fingerprint(spark.createDataFrame(rows, "a string, b string")).first()
    tables = [[("1", None)], [(None, "1")], [("1", "")], [("1,1:2", None)], [("1", "2")], [("12", "")]]
    assert len({make(t).content_hash for t in tables}) == len(tables)
    assert make([("1", "2"), ("3", None)]) == make([("3", None), ("1", "2")])


def test_split_strategies(spark, tmpdir_path):
    df = spark.createDataFrame([(i, s, i % 2) for i, s in enumerate(sequences(40))], "row_id long, sequence string, label int")
    pre = {"use_gc": True, "use_kmers": False}

    def parts(**more):
        rows = jobs.evaluate(df, jobs.BenchmarkRequest(target_col="label", preprocessing=pre, **more)).collect()
        return sorted((r.part, r.test_rows) for r in rows)

    assert parts() == [(None, 8)]
    assert parts(split_strategy="kfold_small_dataset", cv_folds=4) == [(i, 10) for i in range(4)]
    assert parts(split_strategy="repeated_seed_holdout", reruns=3, random_seed=7) == [(7, 8), (8, 8), (9, 8)]
    path = os.path.join(tmpdir_path, "split")
    smp.save_split_manifest(smp.split_manifest(df, 42, 0.25), path)
    assert parts(split_strategy="provided_train_validation_test", split_manifest_path=path) == [(None, 10)]
    with pytest.raises(ValueError):
        parts(split_strategy="provided_train_validation_test")
    with pytest.raises(ValueError):
        parts(split_strategy="no_such")


def test_no_frame_stays_in_memory(spark, tmpdir_path):
    spark.catalog.clearCache()
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    df = spark.createDataFrame([(i, s, i % 2) for i, s in enumerate(sequences(40))], "row_id long, sequence string, label int")
    pre = {"use_gc": True, "use_kmers": False}
    req = jobs.BenchmarkRequest(target_col="label", preprocessing=pre, threshold_strategy="validation_mcc", validation_size=0.2)
    jobs.run_benchmark(spark, os.path.join(tmpdir_path, "store"), req, df)
    for strategy in ("fixed_train_validation_test", "kfold_small_dataset", "repeated_seed_holdout"):
        jobs.evaluate(df, jobs.BenchmarkRequest(target_col="label", preprocessing=pre, split_strategy=strategy, reruns=2, cv_folds=2)).collect()
    assert held() == before


def test_dry_run_over_two_configs(spark, tmpdir_path):
    import hashlib
    import json

    d = os.path.join(tmpdir_path, "configs")
    os.makedirs(d)
    for i, good in enumerate((True, False)):
        p = write(os.path.join(tmpdir_path, f"d{i}.csv"), f"sequence,label\nACGT,{i}\n")
        sha = hashlib.sha256(open(p, "rb").read()).hexdigest() if good else "0" * 64
        write(os.path.join(d, f"c{i}.json"), json.dumps({"dataset": {"path": p, "sha256": sha}, "split": {"random_seed": i}, "models": []}))
    got = {r.random_seed: (r.dataset_available, r.dataset_checksum_verified) for r in jobs.dry_run_summary(spark, d).collect()}
    assert got == {0: (True, True), 1: (True, False)}


def _dataset(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "store")
    path = write(os.path.join(tmpdir_path, "d.csv"), "sequence,label\n" + "".join(f"{s},{i % 2}\n" for i, s in enumerate(sequences(50))))
    jobs.ingest(spark, path, root, "ds")
    return root, path


def test_a_saved_run_is_replayed_as_it_ran(spark, tmpdir_path):
    root, path = _dataset(spark, tmpdir_path)
    req = jobs.BenchmarkRequest(dataset_id="ds", target_col="label", preprocessing={"use_gc": True, "use_kmers": True, "kmer_size": 2},
                                threshold_strategy="median", biological_goal="high_sensitivity", balance_strategy="undersample")
    run = jobs.run_benchmark(spark, root, req)
    out = os.path.join(tmpdir_path, "again")
    summary = jobs.replay_run(spark, root, run["run"]["run_id"], out)
    assert summary["dataset_checksum_verified"] is True and os.path.exists(summary["model_paths"]["linear_regression"])
    first, again = run["metrics"].first(), spark.read.json(os.path.join(out, "metrics")).first()
    assert (first.mae, first.mcc, first.test_rows) == (again.mae, again.mcc, again.test_rows)
    ids = {int(r.row_id) for r in spark.read.option("header", True).csv(os.path.join(out, "predictions")).collect()}
    assert ids == {r.row_id for r in run["predictions"].collect()}
    cfg = store.read_json(spark, root, "runs", "configs", f"run_id={run['run']['run_id']}")
    assert cfg["threshold"]["biological_goal"] == "high_sensitivity" and cfg["balance"]["balance_strategy"] == "undersample"
    write(path, "sequence,label\nACGT,1\n")
    with pytest.raises(ValueError, match="checksum"):
        jobs.replay_run(spark, root, run["run"]["run_id"], out)


def test_a_plan_only_run_leaves_a_complete_row(spark, tmpdir_path):
    root, _ = _dataset(spark, tmpdir_path)
    run = jobs.plan_only_run(spark, root, jobs.BenchmarkRequest(dataset_id="ds", target_col="label", max_rows=20))
    assert (run["rows_used"], run["row_cap_applied"], run["run_mode"]) == (20, True, "plan_only")
    status = store.reproducibility_status(store.list_runs(spark, root), store.list_datasets(spark, root)).first()
    assert status.run_id == run["run_id"] and status.reproducibility_status == "complete"
