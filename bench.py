"""Benchmark of the headline operators; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The fixture views (DNA derived from md5 of row keys, see FIXTURES.md) are first written once
as multi-file parquet to a fresh scratch folder, like a stored sequence table; the timed queries
read those files, so they measure the operators and their scans, not the md5 fabrication of
test sequences. Each query is forced to full evaluation with the ``noop`` sink (every row
computed, nothing collected). Timings are wall seconds per query after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from dnaframe.functions.sequence import gc_content, normalize  # noqa: E402
from dnaframe.operators import features as feat  # noqa: E402
from dnaframe.operators import metrics as met  # noqa: E402
from dnaframe.operators import sampling as smp  # noqa: E402
from dnaframe.operators import thresholds as thr  # noqa: E402
from dnaframe.plans import fixtures as fx  # noqa: E402
from dnaframe.plans.jobs import BenchmarkRequest, benchmark_frames  # noqa: E402
from dnaframe.session import local_session  # noqa: E402


def long_scores(spark, sf, views=fx):
    """Synthetic binary scores over every lineitem row, two models."""
    li = views.seqs_long(spark, sf).select("row_id", "target")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed")) for m, s in fx.SCORE_MODELS])
    x = li.select("row_id", "target", F.inline(models))
    u = F.conv(F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("row_id"))), 1, 4), 16, 10)
    return x.select("model", "row_id", (F.col("target") >= 45).cast("double").alias("actual"),
                    (u.cast("double") / 65536.0).alias("prediction"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="dnaframe-bench")

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    # stage the fixture views once as parquet tables with one file per core
    stage = tempfile.mkdtemp(prefix="dnaframe-bench-", dir=os.environ.get("BENCH_STAGE_DIR", "/tmp"))
    parts = spark.sparkContext.defaultParallelism
    t0 = time.time()
    for name, make in (("seqs_long", fx.seqs_long), ("seqs_mid", fx.seqs_mid), ("seqs_dirty", fx.seqs_dirty),
                       ("seqs", fx.seqs)):
        make(spark, sf).repartition(parts).write.mode("overwrite").parquet(f"{stage}/{name}")
    setup = round(time.time() - t0, 3)

    class Staged:
        """Fixture views read back from the staged parquet tables."""

        @staticmethod
        def seqs_long(spark_, _sf):
            return spark_.read.parquet(f"{stage}/seqs_long")

        @staticmethod
        def seqs_mid(spark_, _sf):
            return spark_.read.parquet(f"{stage}/seqs_mid")

        @staticmethod
        def seqs_dirty(spark_, _sf):
            return spark_.read.parquet(f"{stage}/seqs_dirty")

        @staticmethod
        def seqs(spark_, _sf):
            return spark_.read.parquet(f"{stage}/seqs")

        SCORE_MODELS = fx.SCORE_MODELS

    fxs = Staged

    def q_normalize_gc():
        s = fxs.seqs_long(spark, sf)
        run(s.select("row_id", gc_content(normalize("sequence")).alias("gc")))

    def q_dirty_normalize_gc():
        d = fxs.seqs_dirty(spark, sf)
        run(d.select("row_id", normalize("sequence").alias("s")).select("row_id", gc_content("s").alias("gc")))

    def q_kmer6_spectrum():
        run(feat.kmer_spectrum(fxs.seqs_long(spark, sf), 6))

    def q_kmer6_counts():
        run(feat.kmer_spectrum(fxs.seqs_long(spark, sf), 6, with_rows=False))

    def q_kmer6_long():
        run(feat.kmer_long(fxs.seqs_long(spark, sf), 6))

    def q_kmer6_vectors():
        run(feat.kmer_vector(fxs.seqs_long(spark, sf), 6, normalized=False))

    def q_undersample():
        s = fxs.seqs_long(spark, sf).withColumn("label", (F.col("target") >= 45).cast("int"))
        rows, _ = smp.undersample(s, "label", 42, "undersample")
        run(rows)

    def q_exact_split():
        run(smp.holdout_split(fxs.seqs_long(spark, sf).select("row_id", "target"), 0.2, 42, validation_size=0.1))

    def q_kfold():
        run(smp.kfold(fxs.seqs_long(spark, sf).select("row_id"), 5, 42))

    def q_all_metrics():
        s = long_scores(spark, sf, fxs)
        th = thr.median_thresholds(s)
        run(met.all_metrics(thr.apply_threshold(s, th), binary_target=True))

    def q_threshold_sweep():
        sw = thr.sweep(long_scores(spark, sf, fxs), "per_model")
        run(thr.best_thresholds(sw, "validation_mcc"))

    def q_fit_linear_k4():
        req = BenchmarkRequest(models=["linear_regression"], target_col="target",
                               preprocessing={"use_gc": True, "use_kmers": True, "kmer_size": 4})
        out = benchmark_frames(fxs.seqs_mid(spark, sf), req)
        run(out["metrics"])
        out["split"].unpersist()

    queries = {
        "normalize_gc": q_normalize_gc,
        "dirty_normalize_gc": q_dirty_normalize_gc,
        "kmer6_spectrum": q_kmer6_spectrum,
        "kmer6_counts": q_kmer6_counts,
        "kmer6_long": q_kmer6_long,
        "kmer6_vectors": q_kmer6_vectors,
        "undersample": q_undersample,
        "exact_split": q_exact_split,
        "kfold": q_kfold,
        "all_metrics": q_all_metrics,
        "threshold_sweep": q_threshold_sweep,
        "fit_linear_k4": q_fit_linear_k4,
    }
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    run(fxs.seqs(spark, sf).select(gc_content(normalize("sequence"))))  # warm-up
    times = {}
    for name, fn in queries.items():
        if only and name not in only:
            continue
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    sf_name = os.path.basename(os.path.normpath(sf)).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_name, "cpus": cpus, "setup_sec": setup}))
    spark.stop()


if __name__ == "__main__":
    main()
