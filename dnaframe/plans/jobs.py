"""Whole-run jobs (W1-W3, W6-W8) and their registered queries.

* ``ingest``            W1: scan a file or folder, reject empty, store, profile, digest, manifest.
* ``benchmark_frames``  W2 without side effects: cap -> balance -> valid target -> features ->
                        split -> fit -> predict -> thresholds -> all metrics.
* ``run_benchmark``     W2 with the registry writes (K2, K3, K5, K6).
* ``profile_export``    W3: rows, rows used under the cap, binary flag; no training.
* ``checksum_gate``     W6; ``replay`` W7; ``dry_run_summary`` W8.

Lazy until a metric or a write is asked for; the feature frame is persisted once and read by
every model fit.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnaframe.functions.sequence import to_numeric
from dnaframe.operators import features as feat
from dnaframe.operators import metrics as met
from dnaframe.operators import models as mdl
from dnaframe.operators import profile as prof
from dnaframe.operators import sampling as smp
from dnaframe.operators import thresholds as thr
from dnaframe.plans import fixtures as fx
from dnaframe.plans.catalog import query
from dnaframe.plans.config import SCHEMA_VERSION
from dnaframe.sources import digest, fasta, sbol, store, tabular

MIN_VALID_ROWS = 5
# The names of the split strategies.
SPLIT_STRATEGIES = ("fixed_train_validation_test", "provided_train_validation_test", "kfold_small_dataset", "repeated_seed_holdout")
TOOL_VERSION = "0.1.0"
RUN_ROW = ("run_id string, created_at string, completed_at string, dataset_id string, dataset_sha256 string, "
           "tool_version string, run_mode string, rows_used bigint, row_cap_applied boolean, class_balance_applied boolean, "
           "train_rows bigint, test_rows bigint, target_kind string, source_dataset_removed_after_run boolean, "
           "has_config boolean, target_col string, request_json string, classification_threshold double, "
           "model_paths_json string")


def _now() -> str:
    return _dt.datetime.now(_dt.timezone.utc).isoformat()


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Suffix dispatch of a file or folder: csv/tsv/txt, fa/fasta, xml/rdf/sbol. Every result has a ``row_id``."""
    kinds = store.suffixes(spark, path)
    if len(kinds) != 1:
        raise ValueError(f"{path} holds files of {len(kinds)} formats {sorted(kinds)}, not of one")
    low = kinds.pop()
    if low in (".csv", ".tsv", ".txt"):
        return tabular.read_delimited(spark, path, sep=tabular.separator_for(low))
    if low in (".fa", ".fasta"):
        return fasta.read_fasta_split(spark, path)
    if low in (".xml", ".rdf", ".sbol"):
        return tabular.numbered(sbol.read_sbol(spark, path), "id")
    raise ValueError(f"no reader for {low or 'files without a suffix'}: {path}")


# ---- W1 -------------------------------------------------------------------------------------

def ingest(spark: SparkSession, path: str, root: str, dataset_id: str | None = None) -> dict:
    """Returns the manifest dict; writes rows (K1), manifest and class counts (K4)."""
    dataset_id = dataset_id or str(uuid.uuid4())
    # parse the source once: write it, then count and profile the stored columnar copy
    src = read_any(spark, path)
    if src.isEmpty():  # stops at the first row found
        raise ValueError(f"nothing to ingest: {path} has no row")
    store.write_dataset(src, root, dataset_id)
    df = store.load_dataset(spark, root, dataset_id)
    rows = df.count()
    cols = [c for c in df.columns if c != "row_id"]
    target = prof.column_for_role(cols, prof.TARGET_CANDIDATES)
    seqcol = prof.column_for_role(cols, prof.SEQUENCE_CANDIDATES)
    sha, size = digest.path_digest(spark, path)
    manifest = {
        "dataset_id": dataset_id, "original_name": os.path.basename(path.rstrip("/")), "created_at": _now(),
        "row_count": rows, "columns": cols, "suggested_sequence_col": seqcol, "suggested_target_col": target,
        "large_dataset_warning": rows > prof.LOCAL_ROW_LIMIT, "local_small_run_limit": prof.LOCAL_ROW_LIMIT,
        "sha256": sha, "source_format": min(store.suffixes(spark, path)), "upload_bytes": size,
        "source_path": path,
    }
    if target:
        summary = prof.target_summary(df, target).first().asDict()
        manifest["target_summary"] = {k: v for k, v in summary.items()}
        cc = prof.class_counts(df, target).withColumn("dataset_id", F.lit(dataset_id))
        store.write_partitions(cc, root, "datasets", "class_counts")
    schema = ("dataset_id string, original_name string, created_at string, row_count bigint, columns array<string>, "
              "suggested_sequence_col string, suggested_target_col string, large_dataset_warning boolean, "
              "local_small_run_limit bigint, sha256 string, source_format string, upload_bytes bigint, source_path string")
    row = {k: manifest[k] for k in [f.split()[0] for f in schema.split(", ")]}
    store.write_partitions(spark.createDataFrame([row], schema), root, "datasets", "manifest")
    return manifest


# ---- W2 -------------------------------------------------------------------------------------

@dataclass
class BenchmarkRequest:
    dataset_id: str | None = None
    sequence_col: str = "sequence"
    target_col: str = "target"
    models: list = field(default_factory=lambda: ["linear_regression"])
    preprocessing: dict = field(default_factory=lambda: {"use_gc": True, "use_kmers": True, "kmer_size": 6})
    test_size: float = 0.2
    validation_size: float = 0.1
    random_seed: int = 42
    split_strategy: str = "fixed_train_validation_test"
    threshold_strategy: str = "user_or_literature"
    threshold_value: float | None = None
    threshold_scope: str = "shared"
    biological_goal: str = "limit_false_positives"
    balance_strategy: str = "none"
    max_rows: int = 0  # 0 = no cap: Spark runs the whole table
    model_overrides: dict = field(default_factory=dict)
    cv_folds: int = 5  # kfold_small_dataset
    reruns: int = 5  # repeated_seed_holdout: seeds random_seed, random_seed + 1, ...
    split_manifest_path: str | None = None  # X6: take the split from a saved manifest (joined on row_id)

    def __post_init__(self):
        if not (0.05 <= self.test_size <= 0.5):
            raise ValueError("test_size must be between 0.05 and 0.5")
        if not (0.0 <= self.validation_size <= 0.4):
            raise ValueError("validation_size must be between 0 and 0.4")
        if self.split_strategy not in SPLIT_STRATEGIES:
            raise ValueError(f"unknown split strategy {self.split_strategy!r}; known are {list(SPLIT_STRATEGIES)}")
        if self.threshold_strategy not in thr.STRATEGIES:
            raise ValueError(f"unknown threshold strategy {self.threshold_strategy!r}; known are {list(thr.STRATEGIES)}")
        if self.cv_folds < 2 or self.reruns < 1:
            raise ValueError("cv_folds is 2 at least, reruns 1")
        unknown = [m for m in self.models if m not in mdl.MODEL_NAMES]
        if unknown:
            raise ValueError(f"unknown models {unknown}; known are {list(mdl.MODEL_NAMES)}")


def benchmark_frames(df: DataFrame, req: BenchmarkRequest, row_id: str = "row_id") -> dict:
    """W2 core: returns DataFrames and counts; writes nothing."""
    if req.sequence_col not in df.columns:
        raise ValueError(f"the table has no sequence column {req.sequence_col!r}")
    target = prof.target_column(df.columns, req.target_col)
    cfg = feat.FeatureConfig.from_dict(req.preprocessing)
    source = df
    row_cap_applied = False
    if req.max_rows and req.max_rows > 0:
        source, flag = prof.cap_rows(source, req.max_rows, row_id)
        row_cap_applied = bool(flag.first()[0])
    source, balanced = smp.undersample(source, target, req.random_seed, req.balance_strategy, row_id)
    valid = source.select(row_id, req.sequence_col, to_numeric(target).alias("y")).filter(F.col("y").isNotNull())
    frame = feat.build_features(valid, req.sequence_col, cfg, keep=(row_id, "y"))
    use_validation = req.threshold_strategy in ("validation_mcc", "validation_f1", "high_sensitivity") and req.validation_size > 0
    if req.split_manifest_path:
        manifest = smp.load_split_manifest(frame.sparkSession, req.split_manifest_path, req.random_seed)
        split = frame.join(manifest.select(row_id, "split"), row_id, "inner")
    else:
        split = smp.holdout_split(frame, req.test_size, req.random_seed, row_id,
                                  validation_size=req.validation_size if use_validation else 0.0)
    split = split.persist(StorageLevel.MEMORY_AND_DISK)
    # split sizes and the binary-target check (M10) in one pass over the persisted frame
    stats = split.groupBy("split").agg(F.count(F.lit(1)).alias("count"), F.count("y").alias("ny"),
                                       F.bool_and(F.col("y").isin(0.0, 1.0)).alias("b01")).collect()
    counts = {r["split"]: r["count"] for r in stats}
    binary = sum(r["ny"] for r in stats) > 0 and all(r["b01"] for r in stats)
    rows_used = sum(counts.values())
    if rows_used < MIN_VALID_ROWS:
        split.unpersist()
        raise ValueError(f"{rows_used} rows have a numeric target; {MIN_VALID_ROWS} are needed")
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    fitted, preds = mdl.fit_and_predict(train, test, list(req.models), req.random_seed, row_id,
                                        overrides=req.model_overrides)
    # test rows x models: read by the threshold passes, the metrics and the sinks
    preds = preds.persist(StorageLevel.MEMORY_AND_DISK)
    cached = [split, preds]
    thresholds = None
    if binary:
        validation = None
        if use_validation:
            vrows = split.filter(F.col("split") == "validation")
            validation = met.union_predictions([
                m.transform(vrows).select(F.lit(n).alias("model"), row_id, F.col("y").alias("actual"), "prediction")
                for n, m in fitted.items()]).persist(StorageLevel.MEMORY_AND_DISK)  # read by the count, the bounds and the sweep
            cached.append(validation)
        thresholds = thr.resolve_thresholds(preds, req.threshold_strategy, req.threshold_value, req.threshold_scope,
                                            req.biological_goal, validation=validation)
        preds = thr.apply_threshold(preds, thresholds)
    metrics = met.all_metrics(preds, binary, train_rows=counts.get("train", 0))
    return {
        "target_col": target, "fitted": fitted, "predictions": preds, "metrics": metrics, "split": split,
        "rows_used": rows_used, "train_rows": counts.get("train", 0), "test_rows": counts.get("test", 0),
        "validation_rows": counts.get("validation", 0), "binary_target": binary, "row_cap_applied": row_cap_applied,
        "class_balance_applied": balanced, "thresholds": thresholds, "cached": cached,
    }


def release(out: dict) -> None:
    """Frees what ``benchmark_frames`` keeps in memory; its frames stay usable and are computed again if read."""
    for frame in out["cached"]:
        frame.unpersist()


def _feature_frame(df: DataFrame, req: BenchmarkRequest, row_id: str = "row_id") -> DataFrame:
    """Cap, balance, valid target, features: the frame every fold or seed reuses."""
    target = prof.target_column(df.columns, req.target_col)
    source = df
    if req.max_rows and req.max_rows > 0:
        source, _ = prof.cap_rows(source, req.max_rows, row_id)
    source, _ = smp.undersample(source, target, req.random_seed, req.balance_strategy, row_id)
    valid = source.select(row_id, req.sequence_col, to_numeric(target).alias("y")).filter(F.col("y").isNotNull())
    return feat.build_features(valid, req.sequence_col, feat.FeatureConfig.from_dict(req.preprocessing), keep=(row_id, "y"))


def _fold_metrics(train: DataFrame, test: DataFrame, req: BenchmarkRequest, seed: int, binary: bool,
                  row_id: str = "row_id", keep: bool = False) -> tuple[DataFrame, DataFrame | None, float | None, DataFrame | None]:
    """Metrics per model, and with ``keep`` the labelled predictions, the last model's threshold and the frame to release."""
    _, preds = mdl.fit_and_predict(train, test, list(req.models), seed, row_id, overrides=req.model_overrides)
    preds = preds.persist(StorageLevel.MEMORY_AND_DISK)
    last = None
    if binary:
        th = thr.resolve_thresholds(preds, req.threshold_strategy, req.threshold_value, req.threshold_scope,
                                    req.biological_goal)
        labelled, last = thr.apply_threshold(preds, th), th.get(list(req.models)[-1])
    else:
        labelled = preds
    found = met.all_metrics(labelled, binary, train_rows=None)
    rows = found.collect()  # one row per model
    metrics = preds.sparkSession.createDataFrame(rows, found.schema)
    if keep:
        return metrics, labelled, last, preds
    preds.unpersist()
    return metrics, None, None, None


def _side_by_side(work, parts: list[int], parallelism: int) -> list:
    """``work(part)`` for every part, ``parallelism`` at a time: Spark runs their jobs together, results keep their order.

    Small folds leave most executors idle when they run one after the other.
    """
    with ThreadPool(max(1, min(parallelism, len(parts)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), parts)


def _over_parts(frame: DataFrame, req: BenchmarkRequest, name: str, parts: list[int], split, parallelism: int, row_id: str, keep: bool) -> dict:
    """Fits and metrics of every fold or seed over the persisted ``frame``; ``split(part)`` gives its train and test rows."""
    binary = bool(prof.is_binary(frame, "y").first()[0])
    seed = (lambda p: p) if name == "seed" else (lambda p: req.random_seed)

    def one(part: int):
        train, test = split(part)
        return _fold_metrics(train, test, req, seed(part), binary, row_id, keep)

    found = _side_by_side(one, parts, parallelism)
    tagged = lambda i: reduce(DataFrame.unionByName, [f[i].withColumn(name, F.lit(p)) for f, p in zip(found, parts)])
    return {"metrics": tagged(0), "predictions": tagged(1) if keep else None, "last_threshold": found[-1][2], "binary_target": binary,
            "cached": [f[3] for f in found if f[3] is not None]}


def cross_validate(df: DataFrame, req: BenchmarkRequest, folds: int = 5, row_id: str = "row_id", parallelism: int = 4,
                   keep: bool = False) -> dict:
    """X4 executed: exact seeded k folds; each fold is the test set once, ``parallelism`` folds are fitted at a time.

    Returns per-fold metrics and their mean / std / min / max per model (W10 form); with ``keep`` also the
    ``predictions`` of every fold, persisted until ``release``.
    """
    frame = smp.kfold(_feature_frame(df, req, row_id), folds, req.random_seed, row_id)
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    rows = frame.count()
    out = _over_parts(frame, req, "fold", list(range(folds)), lambda f: (frame.filter(F.col("fold") != f), frame.filter(F.col("fold") == f)),
                      parallelism, row_id, keep)
    if not keep:
        frame.unpersist()
    summary = met.multi_seed_summary(out["metrics"]).withColumnRenamed("seeds", "folds")
    return out | {"per_fold": out["metrics"], "summary": summary, "frame": frame, "rows_used": rows, "cached": [frame, *out["cached"]]}


def repeated_benchmark(df: DataFrame, req: BenchmarkRequest, seeds: list[int], row_id: str = "row_id", parallelism: int = 4,
                       keep: bool = False) -> dict:
    """X5 + W10 executed: one exact holdout and fit per seed, ``parallelism`` seeds at a time, then mean / std / min /
    max of every metric per model across seeds."""
    # one persisted feature frame; each seed tags it with a narrow projection (no copy per seed)
    frame = _feature_frame(df, req, row_id).persist(StorageLevel.MEMORY_AND_DISK)
    rows = frame.count()

    def split(seed: int):
        one = smp.holdout_split(frame, req.test_size, seed, row_id)
        return one.filter(F.col("split") == "train"), one.filter(F.col("split") == "test")

    out = _over_parts(frame, req, "seed", [int(s) for s in seeds], split, parallelism, row_id, keep)
    if not keep:
        frame.unpersist()
    return out | {"per_seed": out["metrics"], "summary": met.multi_seed_summary(out["metrics"]), "frame": frame, "rows_used": rows,
                  "cached": [frame, *out["cached"]]}


def strategy_frames(df: DataFrame, req: BenchmarkRequest, row_id: str = "row_id") -> dict:
    """W2 by the request's split strategy; as ``benchmark_frames``, with a column ``part`` in metrics and predictions.

    * fixed_train_validation_test: one exact holdout (X1, X2); ``part`` is null.
    * provided_train_validation_test: the split saved at ``split_manifest_path`` (X3, X6).
    * kfold_small_dataset: ``cv_folds`` folds (X4); ``part`` is the fold.
    * repeated_seed_holdout: ``reruns`` holdouts (X5); ``part`` is the seed.

    Where there are several parts, there are several fits of each model and none is returned. The caller
    releases the frames.
    """
    if req.split_strategy in ("kfold_small_dataset", "repeated_seed_holdout"):
        if req.split_strategy == "kfold_small_dataset":
            out, name = cross_validate(df, req, req.cv_folds, row_id, keep=True), "fold"
        else:
            out, name = repeated_benchmark(df, req, [req.random_seed + i for i in range(req.reruns)], row_id, keep=True), "seed"
        if out["rows_used"] < MIN_VALID_ROWS:
            release(out)
            raise ValueError(f"{out['rows_used']} rows have a numeric target; {MIN_VALID_ROWS} are needed")
        counts = df.count() if req.max_rows and req.max_rows > 0 else 0
        return out | {
            "target_col": prof.target_column(df.columns, req.target_col), "fitted": {}, "train_rows": None, "validation_rows": 0,
            "test_rows": out["predictions"].filter(F.col("model") == req.models[0]).count(), "row_cap_applied": counts > req.max_rows > 0,
            "class_balance_applied": _balances(df, req, row_id), "thresholds": None,
            "metrics": out["metrics"].withColumnRenamed(name, "part"), "predictions": out["predictions"].withColumnRenamed(name, "part")}
    if req.split_strategy == "provided_train_validation_test" and not req.split_manifest_path:
        raise ValueError("a provided split needs split_manifest_path")
    out = benchmark_frames(df, req, row_id)
    none = F.lit(None).cast("int")
    return out | {"metrics": out["metrics"].withColumn("part", none), "predictions": out["predictions"].withColumn("part", none),
                  "last_threshold": (out["thresholds"] or {}).get(list(req.models)[-1])}


def _balances(df: DataFrame, req: BenchmarkRequest, row_id: str) -> bool:
    return smp.undersample(df, prof.target_column(df.columns, req.target_col), req.random_seed, req.balance_strategy, row_id)[1]


def evaluate(df: DataFrame, req: BenchmarkRequest, row_id: str = "row_id") -> DataFrame:
    """W2 by the request's split strategy: metrics per model, and per fold or seed where there are several (``strategy_frames``)."""
    out = strategy_frames(df, req, row_id)
    rows = out["metrics"].collect()  # one row per model and part
    release(out)
    return df.sparkSession.createDataFrame(rows, out["metrics"].schema)


def run_benchmark(spark: SparkSession, root: str, req: BenchmarkRequest, df: DataFrame | None = None, run_id: str | None = None) -> dict:
    """W2 with writes: predictions (K2), metrics (K3), models (K6), configuration and registry row (K5).

    A run retried under its ``run_id`` replaces what an attempt before it has left.
    """
    started = _now()
    data = df if df is not None else store.load_dataset(spark, root, req.dataset_id)
    out = strategy_frames(data, req)
    run_id = run_id or str(uuid.uuid4())
    preds = out["predictions"].withColumn("run_id", F.lit(run_id))
    store.write_partitions(preds, root, "runs", "predictions", keys=("run_id", "model"))
    store.write_partitions(out["metrics"].withColumn("run_id", F.lit(run_id)), root, "runs", "metrics", keys=("run_id",))
    model_paths = {n: store.save_model(m, root, run_id, n) for n, m in out["fitted"].items()}
    manifest = None
    if req.dataset_id:
        found = store.read_partition(spark, root, "datasets", "manifest", key="dataset_id", value=req.dataset_id)
        manifest = found.first().asDict() if found is not None else None
    reg = {
        "run_id": run_id, "created_at": started, "completed_at": _now(), "dataset_id": req.dataset_id,
        "dataset_sha256": manifest["sha256"] if manifest else None, "tool_version": TOOL_VERSION,
        "run_mode": "spark_benchmark", "rows_used": out["rows_used"], "row_cap_applied": out["row_cap_applied"],
        "class_balance_applied": out["class_balance_applied"], "train_rows": out["train_rows"],
        "test_rows": out["test_rows"],
        "target_kind": "binary_numeric_label" if out["binary_target"] else "numeric_regression",
        "source_dataset_removed_after_run": False, "has_config": True, "target_col": out["target_col"],
        "request_json": _json(asdict(req)), "classification_threshold": out["last_threshold"],
        "model_paths_json": _json(model_paths),
    }
    store.write_json(spark, run_config(reg, req, manifest), root, "runs", "configs", f"run_id={run_id}")
    # the registry row comes last and is read first: a run that died before it is in no listing and no lookup
    store.write_partitions(spark.createDataFrame([reg], RUN_ROW), root, "runs", "registry", keys=("run_id",))
    release(out)
    return {"run": reg, "metrics": out["metrics"], "predictions": out["predictions"]}


def run_config(run: dict, req: BenchmarkRequest, manifest: dict | None) -> dict:
    """K5: the nested run configuration of a run, complete enough to replay it."""
    import platform

    ds = manifest or {}
    threshold = {"threshold_strategy": req.threshold_strategy, "threshold_value": req.threshold_value,
                 "threshold_scope": req.threshold_scope, "biological_goal": req.biological_goal}
    rounds = {"cv_folds": req.cv_folds, "reruns": req.reruns}
    limits = {"row_cap_applied": run["row_cap_applied"], "local_row_limit": req.max_rows}
    return {
        "schema_version": SCHEMA_VERSION,
        "dataset": {"path": ds.get("source_path"), "sha256": ds.get("sha256"), "size_bytes": ds.get("upload_bytes"),
                    "sequence_column": req.sequence_col, "target_column": run["target_col"], "dataset_id": req.dataset_id,
                    "original_name": ds.get("original_name"), "row_count": ds.get("row_count"), "source_format": ds.get("source_format"),
                    "columns": ds.get("columns"), "source_dataset_removed_after_run": run["source_dataset_removed_after_run"],
                    "run_mode": run["run_mode"], "plan_only": run["run_mode"] == "plan_only"},
        "split": {"split_strategy": req.split_strategy, "test_size": req.test_size, "validation_size": req.validation_size,
                  "random_seed": req.random_seed, "train_rows": run["train_rows"], "test_rows": run["test_rows"], **rounds,
                  "split_manifest_path": req.split_manifest_path},
        "preprocessing": feat.FeatureConfig.from_dict(req.preprocessing).to_dict(),
        "models": [{"model_name": m, "runner": "spark", "overrides": req.model_overrides.get(m) or {}} for m in req.models],
        "threshold": {**threshold, "resolved_classification_threshold": run["classification_threshold"]},
        "balance": {"balance_strategy": req.balance_strategy, "class_balance_applied": run["class_balance_applied"],
                    "rows_used": run["rows_used"], **limits},
        "training": {**threshold, "balance_strategy": req.balance_strategy, **limits, **rounds},
        "dependencies": {"python_version": platform.python_version()},
        "hardware": {"device": "spark", "machine": platform.machine()},
        "metadata": {"created_at": run["created_at"], "completed_at": run["completed_at"], "tool_version": TOOL_VERSION,
                     "run_id": run["run_id"]},
    }


def replay_run(spark: SparkSession, root: str, run_id: str, out_root: str, **options) -> dict:
    """W7 from a registry row: the run's saved configuration over the rows it was run on."""
    cfg = store.read_json(spark, root, "runs", "configs", f"run_id={run_id}")
    dataset_id = cfg["dataset"].get("dataset_id")
    data = store.load_dataset(spark, root, dataset_id) if dataset_id else None
    return replay(spark, cfg, out_root, data=data, **options)


def plan_only_run(spark: SparkSession, root: str, req: BenchmarkRequest) -> dict:
    """W3 with its registry row: the rows a run would use, its configuration, no training."""
    found = store.read_partition(spark, root, "datasets", "manifest", key="dataset_id", value=req.dataset_id)
    manifest = found.first().asDict() if found is not None else None
    data = store.load_dataset(spark, root, req.dataset_id)
    target = prof.target_column(data.columns, req.target_col)
    p = profile_export(data, target, req.max_rows or 2**62).first()
    now = _now()
    run = {
        "run_id": str(uuid.uuid4()), "created_at": now, "completed_at": now, "dataset_id": req.dataset_id,
        "dataset_sha256": manifest["sha256"] if manifest else None, "tool_version": TOOL_VERSION, "run_mode": "plan_only",
        "rows_used": p["rows_used"], "row_cap_applied": p["row_cap_applied"], "class_balance_applied": False, "train_rows": 0,
        "test_rows": 0, "target_kind": "binary_numeric_label" if p["binary_target"] else "numeric_regression",
        "source_dataset_removed_after_run": False, "has_config": True, "target_col": target, "request_json": _json(asdict(req)),
        "classification_threshold": None, "model_paths_json": "{}",
    }
    store.write_json(spark, run_config(run, req, manifest), root, "runs", "configs", f"run_id={run['run_id']}")
    store.write_partitions(spark.createDataFrame([run], RUN_ROW), root, "runs", "registry", keys=("run_id",))
    return run


def _json(x) -> str:
    import json

    return json.dumps(x, sort_keys=True, default=str)


# ---- W3 -------------------------------------------------------------------------------------

def profile_export(df: DataFrame, target_col: str, max_rows: int) -> DataFrame:
    """One row: source rows, rows used under the cap, cap flag, binary flag (one pass)."""
    agg = df.withColumn("_y", to_numeric(target_col)).agg(
        F.count(F.lit(1)).alias("source_rows"), prof.is_binary_expr("_y").alias("binary_target"))
    return agg.select(
        "source_rows",
        F.least(F.col("source_rows"), F.lit(max_rows).cast("bigint")).alias("rows_used"),
        (F.col("source_rows") > F.lit(max_rows)).alias("row_cap_applied"),
        "binary_target",
    )


# ---- W6-W8 ----------------------------------------------------------------------------------

def checksum_gate(spark: SparkSession, cfg: dict) -> bool | None:
    """W6 (M22): True / False, or None when no path or no file; only False stops a replay."""
    ds = cfg.get("dataset") or {}
    path = ds.get("path")
    if not path or not store._exists(spark, path):
        return None
    return digest.path_digest(spark, path)[0] == ds.get("sha256")


def replay(spark: SparkSession, cfg: dict, out_root: str, dry_run: bool = False, models: list | None = None,
           data: DataFrame | None = None) -> dict:
    """Gate, then re-run the saved settings: split strategy, folds or seeds, provided split, model options,
    row cap and balancing (M21).

    Model names that are not runnable here are skipped and reported. ``data``: the stored rows, where
    there are any; else the source file is read again, which gives its rows the same ids.
    """
    from dnaframe.plans.config import validate_config

    missing = validate_config(cfg)
    if missing:
        raise ValueError(f"Invalid run config, missing: {', '.join(missing)}")
    ok = checksum_gate(spark, cfg)
    if ok is False:
        raise ValueError("Dataset checksum mismatch.")
    requested = models or [m["model_name"] for m in cfg.get("models", [])]
    runnable = [m for m in requested if m in mdl.MODEL_NAMES]
    skipped = [m for m in requested if m not in mdl.MODEL_NAMES]
    summary = {"dry_run": dry_run, "output_dir": out_root, "schema_version": cfg.get("schema_version"),
               "dataset_checksum_verified": ok, "models": requested, "runnable_models": runnable,
               "skipped_models": skipped, "random_seed": cfg["split"]["random_seed"],
               "preprocessing": cfg.get("preprocessing")}
    if not dry_run:
        if not runnable:
            raise ValueError(f"none of the models {requested} can run here; known are {list(mdl.MODEL_NAMES)}")
        ds, sp, tr = cfg["dataset"], cfg["split"], cfg["training"]
        data = data if data is not None else read_any(spark, ds["path"])
        if ds["target_column"] not in data.columns:
            raise ValueError(f"Target column not found: {ds['target_column']}")
        bal = (cfg.get("balance") or {})
        req = BenchmarkRequest(
            sequence_col=ds["sequence_column"], target_col=ds["target_column"], models=runnable,
            preprocessing={k: v for k, v in (cfg.get("preprocessing") or {}).items() if k != "additional_options"},
            test_size=float(sp["test_size"]), validation_size=float(sp.get("validation_size") or 0.0),
            split_strategy=sp["split_strategy"], cv_folds=int(sp.get("cv_folds") or 5), reruns=int(sp.get("reruns") or 5),
            biological_goal=tr.get("biological_goal") or (cfg.get("threshold") or {}).get("biological_goal") or "limit_false_positives",
            random_seed=int(sp["random_seed"]), threshold_strategy=tr.get("threshold_strategy") or "user_or_literature",
            threshold_value=tr.get("threshold_value"), threshold_scope=tr.get("threshold_scope") or "shared",
            balance_strategy=bal.get("balance_strategy") or tr.get("balance_strategy") or "none",
            max_rows=int(bal.get("local_row_limit") or 0) if bal.get("row_cap_applied") else 0,
            split_manifest_path=sp.get("split_manifest_path"),
            model_overrides={m["model_name"]: m["overrides"] for m in cfg.get("models", []) if m.get("overrides")},
        )
        res = strategy_frames(data, req)
        res["metrics"].write.mode("overwrite").json(os.path.join(out_root, "metrics"))
        res["predictions"].write.mode("overwrite").option("header", True).csv(os.path.join(out_root, "predictions"))
        summary["model_paths"] = {n: store.save_model(m, out_root, "replay", n) for n, m in res["fitted"].items()}
        release(res)
        summary.update(metrics_path=os.path.join(out_root, "metrics"), predictions_path=os.path.join(out_root, "predictions"))
    row = spark.createDataFrame([{"summary_json": _json(summary), "created_at": _now()}],
                                "summary_json string, created_at string")
    row.write.mode("append").parquet(os.path.join(out_root, "replay_summary"))
    return summary


def dry_run_summary(spark: SparkSession, configs_path: str) -> DataFrame:
    """W8 over many configs: dataset present?, checksum verdict, models, seed; no training.

    Configs are one table; each referenced file is digested once and left-joined back.
    """
    from dnaframe.plans.config import read_run_configs

    cfgs = read_run_configs(spark, configs_path)
    base = cfgs.select("config_path", F.col("dataset.path").alias("path"), F.col("dataset.sha256").alias("expected_sha256"),
                       F.transform("models", lambda m: m["model_name"]).alias("models"),
                       F.col("split.random_seed").alias("random_seed"), F.col("preprocessing").alias("preprocessing"))
    # one row per dataset, not per config; a path is known by the name its own file system gives it
    paths = [r[0] for r in base.select("path").distinct().collect() if r[0] and store._exists(spark, r[0])]
    files = {p: store.qualified(spark, p) for p in paths if not store.is_folder(spark, p)}
    d = spark.createDataFrame([(p, digest.path_digest(spark, p)[0]) for p in paths if p not in files], "path string, sha256 string")
    if files:
        names = spark.createDataFrame(list(files.items()), "path string, name string")
        found = digest.file_digests(spark, list(files)).withColumnRenamed("path", "name")
        d = d.unionByName(names.join(found, "name").select("path", "sha256"))
    j = base.join(d, "path", "left")
    verdict = F.when(F.col("sha256").isNull() | F.col("expected_sha256").isNull(), F.lit(None).cast("boolean")) \
               .otherwise(F.col("sha256") == F.col("expected_sha256"))
    return j.select("config_path", "path", F.col("sha256").isNotNull().alias("dataset_available"),
                    verdict.alias("dataset_checksum_verified"), "models", "random_seed", "preprocessing")


# ---- registered job queries -----------------------------------------------------------------

@query("run_profile", """
SELECT count(*) AS source_rows, least(count(*), 1000) AS rows_used, count(*) > 1000 AS row_cap_applied,
       count(o_totalprice) > 0 AND bool_and(o_totalprice IN (0, 1)) AS binary_target
FROM orders""")
def run_profile_q(spark, sf_dir):
    return profile_export(fx.seqs_mid(spark, sf_dir), "target", 1000)


@query("benchmark_run")
def benchmark_run_q(spark, sf_dir):
    """W2 end to end on the labelled sequences: GC + 3-mers, three baseline models, all metrics."""
    req = BenchmarkRequest(models=["linear_regression", "random_forest", "gradient_boosting"], target_col="label",
                           preprocessing={"use_gc": True, "use_kmers": True, "kmer_size": 3}, test_size=0.2,
                           random_seed=42, threshold_strategy="median")
    return benchmark_frames(fx.seqs(spark, sf_dir), req)["metrics"]


@query("cross_validate_run")
def cross_validate_run_q(spark, sf_dir):
    """X4 executed: 5 exact seeded folds over the labelled sequences, one fit per fold, summary per model."""
    req = BenchmarkRequest(models=["linear_regression"], target_col="label",
                           preprocessing={"use_gc": True, "use_kmers": True, "kmer_size": 3}, random_seed=42)
    return cross_validate(fx.seqs(spark, sf_dir), req, folds=5)["summary"]
