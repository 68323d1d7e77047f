from dnaframe.functions.hashing import rank_hash, table_fingerprint
from dnaframe.functions.sequence import (
    DNA_BASES,
    ONE_HOT_CATEGORIES,
    gc_content,
    kmer_denominator,
    kmer_runs,
    kmer_slot,
    kmer_vocabulary,
    kmer_windows,
    normalize,
    one_hot,
    pad,
    to_numeric,
)

__all__ = [
    "DNA_BASES", "ONE_HOT_CATEGORIES", "gc_content", "kmer_denominator", "kmer_runs", "kmer_slot",
    "kmer_vocabulary", "kmer_windows", "normalize", "one_hot", "pad", "to_numeric", "rank_hash",
    "table_fingerprint",
]
