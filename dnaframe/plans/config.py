"""Run configuration: the saved settings of one run as a nested Spark struct.

Field names are fixed values of the saved-config format (version 1.0.0), so configs written by
the original tool load here too. Configs are read as a table, many at once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0.0"

# Section and field names of the saved run configuration. Our own beside them: split_manifest_path, overrides.
RUN_CONFIG_DDL = """
schema_version STRING,
dataset STRUCT<path: STRING, uri: STRING, sha256: STRING, size_bytes: BIGINT, sequence_column: STRING,
  target_column: STRING, dataset_id: STRING, original_name: STRING, row_count: BIGINT, source_format: STRING,
  columns: ARRAY<STRING>, source_dataset_removed_after_run: BOOLEAN, run_mode: STRING, plan_only: BOOLEAN, note: STRING>,
split STRUCT<split_strategy: STRING, test_size: DOUBLE, validation_size: DOUBLE, train_csv: STRING,
  validation_csv: STRING, test_csv: STRING, random_seed: BIGINT, train_rows: BIGINT, validation_rows: BIGINT,
  test_rows: BIGINT, cv_folds: INT, reruns: INT, split_manifest_path: STRING>,
preprocessing STRUCT<use_gc: BOOLEAN, use_kmers: BOOLEAN, normalize_kmers: BOOLEAN, use_one_hot: BOOLEAN,
  kmer_size: INT, sequence_length: INT, additional_options: MAP<STRING, STRING>>,
models ARRAY<STRUCT<model_name: STRING, model_variant: STRING, checkpoint: STRING, tokenizer: STRING, runner: STRING,
  overrides: MAP<STRING, STRING>>>,
model_selection STRUCT<local_models: ARRAY<STRING>, comparison_models: ARRAY<STRING>,
  runnable_local_models: ARRAY<STRING>, planned_hpc_models: ARRAY<STRING>, model_requirements: MAP<STRING, STRING>>,
threshold STRUCT<threshold_strategy: STRING, threshold_value: DOUBLE, threshold_scope: STRING,
  biological_goal: STRING, resolved_classification_threshold: DOUBLE>,
balance STRUCT<balance_strategy: STRING, class_balance_applied: BOOLEAN, row_cap_applied: BOOLEAN,
  local_row_limit: BIGINT, rows_used: BIGINT>,
training STRUCT<batch_size: INT, epochs: INT, cycles: INT, learning_rate: DOUBLE, weight_decay: DOUBLE,
  dropout: DOUBLE, early_stopping_patience: INT, class_weighting: STRING, balance_strategy: STRING,
  threshold_strategy: STRING, threshold_value: DOUBLE, threshold_scope: STRING, primary_metrics: ARRAY<STRING>,
  biological_goal: STRING, local_row_limit: BIGINT, row_cap_applied: BOOLEAN, reruns: INT, cv_folds: INT>,
dependencies STRUCT<python_version: STRING, python_implementation: STRING, docker_base_image: STRING,
  pip_packages: ARRAY<STRING>, system_packages: ARRAY<STRING>, conda_dependencies: ARRAY<STRING>,
  cuda_version: STRING, cudnn_version: STRING, requirements_file: STRING, requirements_lock_file: STRING,
  package_manager: STRING, notes: STRING>,
hardware STRUCT<device: STRING, platform: STRING, machine: STRING, processor: STRING, cpu_count: INT,
  gpu_available: BOOLEAN, cuda_available: BOOLEAN, cuda_version: STRING, gpu_name: STRING, gpu_count: INT,
  gpu_names: ARRAY<STRING>>,
environment STRUCT<safe_env_vars: MAP<STRING, STRING>, excluded_secret_patterns: ARRAY<STRING>>,
env_vars MAP<STRING, STRING>,
metadata STRUCT<created_at: STRING, commit: STRING, git_commit: STRING, repo_url: STRING, branch: STRING,
  tool_version: STRING, run_id: STRING, completed_at: STRING, elapsed_seconds: DOUBLE, repo: STRING,
  artifact_paths: MAP<STRING, STRING>>,
replay STRUCT<dry_run_command: STRING, local_replay_command: STRING, docker_build_command: STRING,
  limitations: ARRAY<STRING>>
"""
RUN_CONFIG_SCHEMA = " ".join(RUN_CONFIG_DDL.split())
REQUIRED_SECTIONS = ("dataset", "split", "preprocessing", "models", "training", "dependencies", "hardware", "metadata")


def read_run_configs(spark: SparkSession, path: str) -> DataFrame:
    """A folder (or glob) of saved configs as one table, with the source file beside each."""
    df = spark.read.schema(RUN_CONFIG_SCHEMA).option("multiLine", True).json(path)
    return df.withColumn("config_path", F.col("_metadata.file_path"))


def validate_config(cfg: dict) -> list[str]:
    """Names of missing required sections / fields (empty when the config is usable)."""
    missing = [s for s in REQUIRED_SECTIONS if cfg.get(s) in (None, [], {})]
    ds = cfg.get("dataset") or {}
    for f in ("sha256", "sequence_column", "target_column"):
        if not ds.get(f):
            missing.append(f"dataset.{f}")
    tr = cfg.get("training") or {}
    for f in ("threshold_strategy", "threshold_scope"):
        if not tr.get(f):
            missing.append(f"training.{f}")
    sp = cfg.get("split") or {}
    for f in ("split_strategy", "test_size", "validation_size", "random_seed"):
        if sp.get(f) is None:
            missing.append(f"split.{f}")
    return missing


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as fh:
        return json.load(fh)
