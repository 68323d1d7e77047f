"""dnaframe: Spark-native benchmark tables for labelled DNA sequences.

Sub-packages
------------
functions   Column -> Column helpers (normalise, pad, GC, k-mers, one-hot, coercion, hashing)
operators   DataFrame -> DataFrame operators (features, profiling, sampling, metrics,
            thresholds, quantiles, models)
sources     readers and writers (CSV/TSV, FASTA, SBOL/XML, digests, dataset/run registry)
plans       whole-run jobs, run configs and the fixture views used by tests and the bench
streaming   incremental ingest of landing folders with Structured Streaming
"""

__version__ = "0.1.0"
