"""Sources (S1-S6, S12, F11), registry (S8-S11, J4) and jobs (W1-W3, W6-W8) on our own small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from dnaframe.plans import jobs
from dnaframe.plans.config import read_run_configs, validate_config
from dnaframe.sources import digest, fasta, sbol, store, tabular


def write(path, text, mode="w"):
    with open(path, mode, encoding="utf-8", newline="") as fh:
        fh.write(text)
    return path


def test_csv_and_tsv(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "a.csv"), "sequence,label\nACGT,1\nGGCC,0\n")
    df = tabular.read_delimited(spark, p)
    assert df.count() == 2 and set(df.columns) == {"sequence", "label", "row_id"}
    t = write(os.path.join(tmpdir_path, "b.txt"), "sequence\tlabel\nAC\t1\n")
    assert tabular.read_delimited(spark, t).first().label == 1


def test_fasta_rules(spark, tmpdir_path):
    text = "junk before\n>seq1 desc > more\nac gt\n  GG  \n\n>\nTTTT\n>  \n>last\nA\n"
    p = write(os.path.join(tmpdir_path, "x.fasta"), text)
    rows = [(r.record, r.id, r.sequence) for r in fasta.read_fasta(spark, p).orderBy("record").collect()]
    assert rows == [(1, "seq1 desc > more", "ACNGTGG"), (2, "sequence_2", "TTTT"), (3, "sequence_3", ""), (4, "last", "A")]
    split_rows = [(r.record, r.id, r.sequence) for r in fasta.read_fasta_split(spark, p).orderBy("record").collect()]
    assert split_rows == rows
    indented = write(os.path.join(tmpdir_path, "ind.fasta"), ">a\nAC\n  >b\nGT\n>c\nTT\n")
    whole = [(r.record, r.id, r.sequence) for r in fasta.read_fasta(spark, indented).orderBy("record").collect()]
    assert whole == [(1, "a", "AC"), (2, "b", "GT"), (3, "c", "TT")]
    assert [(r.record, r.id, r.sequence) for r in fasta.read_fasta_split(spark, indented).orderBy("record").collect()] == whole
    none = write(os.path.join(tmpdir_path, "none.fa"), "ACGT\n")
    assert fasta.read_fasta(spark, none).count() == 0


def test_sbol(spark, tmpdir_path):
    xml = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:sbol="http://sbols.org/v2#"
         xmlns:ex="http://example.org/#">
  <sbol:Sequence rdf:about="7">
    <sbol:elements>acgtnn</sbol:elements>
    <ex:value>2.5</ex:value>
    <ex:name>promoter</ex:name>
  </sbol:Sequence>
</rdf:RDF>"""
    p = write(os.path.join(tmpdir_path, "part1.xml"), xml)
    r = sbol.read_sbol(spark, p).first()
    assert (r.id, r.sequence, r.target) == ("part1", "ACGTNN", 2.5)


def test_sbol_is_parsed_once_and_reads_what_single_paths_read(spark):
    wrap = lambda body, more="": f'<r xmlns:s="http://sbols.org/v2#" {more}>{body}</r>'
    texts = [wrap("<s:elements>acgt</s:elements><v>2.5</v>"), wrap("<v>3</v><s:elements>ac</s:elements><s:elements>gg</s:elements>", 'n="7"'),
             wrap("<s:elements x='4'>ac</s:elements><s:elements>gg</s:elements>"), wrap("<s:elements><b>5</b>ac<c>6</c>gt</s:elements>"),
             wrap("<s:elements/><s:elements>gg</s:elements>"), wrap("<s:elements><b>5</b></s:elements><p s:elements='tt'>1</p>"), wrap("<v>x</v>"),
             wrap("<p elements='tt'/><s:elements>ac<!-- c -->gt</s:elements>"), wrap("<s:elements><![CDATA[ac]]>gt</s:elements>"), "<elements>acg</elements>", wrap("<v rid='4' lang='5'/><v about='6' langs='7'/>"),
             "<elements k='9'>acg</elements>", "<elements>12</elements>", wrap("<s:elements>a</s:elements><q><s:elements>c<d/></s:elements></q>", "m='8'"),
             wrap("<s:elements> </s:elements><v> </v><v>1e3</v>"), "<r/>", "", None]
    df = spark.createDataFrame([(f"{i}.xml", t) for i, t in enumerate(texts)], "name string, value string")
    no_value = " or ".join(f"local-name()='{n}'" for n in ("about", "ID", "nodeID", "resource", "datatype", "lang", "parseType"))
    literals = f"//*[not(*)]/text() | //@*[not({no_value} or starts-with(name(), 'xmlns'))]"
    paths = df.select("name", *[F.xpath("value", F.lit(p)).alias(c) for c, p in (("e", sbol._ELEMENT), ("a", sbol._ATTRIBUTE), ("l", literals))])
    numbers = F.filter(F.transform(F.array_distinct("l"), lambda t: sbol.to_numeric(t)), lambda v: v.isNotNull())
    expect = paths.select(F.regexp_extract("name", "[0-9]+", 0), sbol.normalize(F.coalesce(F.get("e", 0), F.get("a", 0))), F.get(numbers, 0))
    found = sbol.parse_sbol(df)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expect.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    always = [part for part in plan.split("Project")[1:] if "CASE WHEN" not in part]
    assert sum(part.lower().count("xpath") for part in always) == 1 and plan.count("[not(*)]/text()") == 1, plan


def test_digest_and_gate(spark, tmpdir_path):
    import hashlib

    p = write(os.path.join(tmpdir_path, "d.csv"), "sequence,label\nACGT,1\n")
    expected = hashlib.sha256(open(p, "rb").read()).hexdigest()
    assert digest.file_digests(spark, p).first().sha256 == expected
    cfg = {"dataset": {"path": p, "sha256": expected}}
    assert jobs.checksum_gate(spark, cfg) is True
    assert jobs.checksum_gate(spark, {"dataset": {"path": p, "sha256": "0" * 64}}) is False
    assert jobs.checksum_gate(spark, {"dataset": {"path": None}}) is None
    assert jobs.checksum_gate(spark, {"dataset": {"path": p + ".gone", "sha256": expected}}) is None


def _dataset_csv(tmpdir_path, n=40):
    lines = ["sequence,label"]
    for i in range(n):
        seq = "ACGT"[i % 4] * 3 + "GC" * (i % 5) + "ATTA" * (1 + i % 3)
        lines.append(f"{seq},{1 if i % 3 else 0}")
    return write(os.path.join(tmpdir_path, "ds.csv"), "\n".join(lines) + "\n")


def test_ingest_benchmark_registry(spark, tmpdir_path):
    p = _dataset_csv(tmpdir_path)
    root = os.path.join(tmpdir_path, "store")
    man = jobs.ingest(spark, p, root)
    assert man["row_count"] == 40 and man["suggested_target_col"] == "label" and man["target_summary"]["binary_numeric"]
    req = jobs.BenchmarkRequest(dataset_id=man["dataset_id"], target_col="label", models=["linear_regression"],
                                preprocessing={"use_gc": True, "use_kmers": True, "kmer_size": 2}, test_size=0.25)
    res = jobs.run_benchmark(spark, root, req)
    run = res["run"]
    assert run["train_rows"] + run["test_rows"] == 40 and run["test_rows"] == 10
    got = store.get_run(spark, root, run["run_id"])
    m = got["metrics"].first()
    assert m.task_type == "binary_label_regression_baseline"
    assert m.true_negative + m.false_positive + m.false_negative + m.true_positive == 10
    assert got["predictions"].count() == 10
    status = store.reproducibility_status(store.list_runs(spark, root), store.list_datasets(spark, root)).first()
    assert status.reproducibility_status == "complete"


def test_profile_export_and_replay(spark, tmpdir_path):
    import hashlib

    p = _dataset_csv(tmpdir_path)
    df = tabular.read_delimited(spark, p)
    r = jobs.profile_export(df, "label", 25).first()
    assert (r.source_rows, r.rows_used, r.row_cap_applied, r.binary_target) == (40, 25, True, True)
    cfg = {
        "schema_version": "1.0.0",
        "dataset": {"path": p, "sha256": hashlib.sha256(open(p, "rb").read()).hexdigest(),
                    "sequence_column": "sequence", "target_column": "label"},
        "split": {"split_strategy": "fixed_train_validation_test", "test_size": 0.25, "validation_size": 0.1,
                  "random_seed": 7},
        "preprocessing": {"use_gc": True, "use_kmers": True, "kmer_size": 2},
        "models": [{"model_name": "linear_regression"}, {"model_name": "cnn"}],
        "training": {"threshold_strategy": "median", "threshold_scope": "per_model"},
        "dependencies": {"python_version": "3.13"}, "hardware": {"device": "cpu"},
        "metadata": {"created_at": "2026-01-01T00:00:00+00:00"},
    }
    assert validate_config(cfg) == []
    out = os.path.join(tmpdir_path, "replay")
    s = jobs.replay(spark, cfg, out, dry_run=True)
    assert s["dataset_checksum_verified"] is True and s["skipped_models"] == ["cnn"]
    s = jobs.replay(spark, cfg, out, dry_run=False)
    assert os.path.isdir(s["metrics_path"])
    cdir = os.path.join(tmpdir_path, "configs")
    os.makedirs(cdir)
    write(os.path.join(cdir, "run_config.json"), json.dumps(cfg, indent=2))
    d = jobs.dry_run_summary(spark, cdir).first()
    assert d.dataset_available and d.dataset_checksum_verified and d.models == ["linear_regression", "cnn"]
    assert read_run_configs(spark, cdir).first().split.random_seed == 7


def test_ingest_rejects_empty(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "empty.fasta"), "no header here\n")
    with pytest.raises(ValueError):
        jobs.ingest(spark, p, os.path.join(tmpdir_path, "store_empty"))


def test_table_fingerprint_is_order_free(spark):
    from dnaframe.functions.hashing import table_fingerprint

    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    a = table_fingerprint(li).first()
    b = table_fingerprint(li.repartition(7).orderBy(F.rand(3))).first()
    assert a == b
    assert a.rows == li.count()
    c = table_fingerprint(li.limit(100)).first()
    assert c != a


def test_benchmark_validation_threshold(spark, tmpdir_path):
    df = tabular.read_delimited(spark, _dataset_csv(tmpdir_path, n=60))
    req = jobs.BenchmarkRequest(target_col="label", models=["linear_regression"], validation_size=0.2,
                                preprocessing={"use_gc": True, "use_kmers": True, "kmer_size": 2},
                                threshold_strategy="validation_mcc", threshold_scope="per_model")
    out = jobs.benchmark_frames(df, req)
    assert out["validation_rows"] == 12 and out["test_rows"] == 12 and out["train_rows"] == 36
    th = out["thresholds"]["linear_regression"]
    val_scores = {r.prediction for r in out["fitted"]["linear_regression"].transform(
        out["split"].filter("split = 'validation'")).collect()}
    assert th in val_scores  # a validation score, not a test score
    m = out["metrics"].first()
    assert m.test_rows == 12 and m.classification_threshold == th
    out["split"].unpersist()


def test_reproducibility_status_cases(spark):
    runs = spark.createDataFrame(
        [("r1", "d1", "abc", True, False), ("r2", "d1", "abc", False, False), ("r3", "d1", "abc", True, True),
         ("r4", "d2", "xyz", True, False)],
        "run_id string, dataset_id string, dataset_sha256 string, has_config boolean, source_dataset_removed_after_run boolean")
    ds = spark.createDataFrame([("d1", "abc")], "dataset_id string, sha256 string")
    got = {r.run_id: r.reproducibility_status for r in store.reproducibility_status(runs, ds).collect()}
    assert got == {"r1": "complete", "r2": "missing_config", "r3": "partial", "r4": "partial"}


def test_benchmark_from_saved_manifest(spark, tmpdir_path):
    from dnaframe.operators import sampling as smp

    df = tabular.read_delimited(spark, _dataset_csv(tmpdir_path, n=50))
    path = os.path.join(tmpdir_path, "manifest")
    smp.save_split_manifest(smp.split_manifest(df, 5, 0.3, 0.0, 5), path)
    smp.save_split_manifest(smp.split_manifest(df, 5, 0.3, 0.0, 5), path)  # rewrite: no duplicates
    m = smp.load_split_manifest(spark, path, 5)
    assert m.count() == 50 and m.filter("split = 'test'").count() == 15
    req = jobs.BenchmarkRequest(target_col="label", models=["linear_regression"], random_seed=5,
                                preprocessing={"use_gc": True, "use_kmers": False}, split_manifest_path=path)
    out = jobs.benchmark_frames(df, req)
    assert (out["train_rows"], out["test_rows"]) == (35, 15)
    test_ids = {r.row_id for r in m.filter("split = 'test'").collect()}
    assert {r.row_id for r in out["predictions"].collect()} == test_ids
    out["split"].unpersist()


def test_cross_validate_and_repeated(spark, tmpdir_path):
    df = tabular.read_delimited(spark, _dataset_csv(tmpdir_path, n=50))
    req = jobs.BenchmarkRequest(target_col="label", models=["linear_regression"], random_seed=3,
                                preprocessing={"use_gc": True, "use_kmers": True, "kmer_size": 2})
    cv = jobs.cross_validate(df, req, folds=5)
    rows = cv["per_fold"].collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2, 3, 4] and all(r.test_rows == 10 for r in rows)
    s = cv["summary"].first()
    assert s.folds == 5 and s.mcc_min <= s.mcc_mean <= s.mcc_max
    rep = jobs.repeated_benchmark(df, req, [1, 2, 3])
    ps = rep["per_seed"].collect()
    assert sorted(r.seed for r in ps) == [1, 2, 3] and all(r.test_rows == 10 for r in ps)
    assert rep["summary"].first().seeds == 3


def test_m15_needs_five_valid_rows(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "few.csv"), "sequence,target\nACGT,1\nGGCC,x\nAAAA,2\nCCCC,\nGGGG,3\nTTTT,4\n")
    req = jobs.BenchmarkRequest(target_col="target", preprocessing={"use_gc": True, "use_kmers": False})
    with pytest.raises(ValueError, match="5 are needed"):
        jobs.benchmark_frames(tabular.read_delimited(spark, p), req)


def test_m13_cap_then_balance(spark, tmpdir_path):
    df = tabular.read_delimited(spark, _dataset_csv(tmpdir_path, n=40))
    first20 = df.orderBy("row_id").limit(20).collect()
    ones = sum(1 for r in first20 if r.label == 1)
    req = jobs.BenchmarkRequest(target_col="label", max_rows=20, balance_strategy="undersample", test_size=0.2,
                                preprocessing={"use_gc": True, "use_kmers": False})
    out = jobs.benchmark_frames(df, req)
    assert out["row_cap_applied"] and out["class_balance_applied"]
    assert out["rows_used"] == 2 * min(ones, 20 - ones)
    out["split"].unpersist()
