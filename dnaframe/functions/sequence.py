"""Sequence scalar functions: Column -> Column, all built-in JVM expressions (no Python UDF).

Normalisation rule (M1): upper case, strip white space at both ends, then every character
outside ``A C G T N`` becomes ``N``. A null sequence is treated as the empty sequence
(documented divergence M2): length 0, GC 0, no k-mers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnaframe.functions._col import as_col

# Fixed values that must equal the reference's for right results.
# Base alphabet of k-mers, in lexical order (slot of a k-mer = its base-4 value in this order).
DNA_BASES = "ACGT"
# One-hot categories per position, in this order (index = 5 * position + category).
ONE_HOT_CATEGORIES = ("A", "C", "G", "T", "N")
# Characters stripped at both ends: the set Python's str.strip() removes (str.isspace()).
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Feature defaults of the preprocessing options, and the shortest one-hot length.
DEFAULT_KMER_SIZE = 6
DEFAULT_SEQUENCE_LENGTH = 150
MIN_SEQUENCE_LENGTH = 20
# A slot is a base-4 number that must fit a long.
MAX_KMER_SIZE = 31


def normalize(seq) -> Column:
    """normalised sequence; null becomes ''."""
    s = F.coalesce(as_col(seq).cast("string"), F.lit(""))
    return F.regexp_replace(F.btrim(F.upper(s), F.lit(STRIP_CHARS)), "[^ACGTN]", "N")


def pad(seq, length: int, normalized: bool = True) -> Column:
    """centre-trim (extra base dropped on the right) or centre-pad with ``N`` to ``length``.

    Pad split follows ``str.center``: left = p div 2 + (p & L & 1), p = L - len (M7).
    Trim drops ``diff div 2`` on the left (M6).
    """
    if length < 1:
        raise ValueError("length must be >= 1")
    s = as_col(seq) if normalized else normalize(seq)
    n = F.length(s)
    diff = n - F.lit(length)
    trimmed = F.substring(s, (F.floor(diff / 2) + 1).cast("int"), length)
    p = F.lit(length) - n
    left = (F.floor(p / 2) + F.when((p % 2 == 1) & F.lit(length % 2 == 1), 1).otherwise(0)).cast("int")
    right = (p - left).cast("int")
    padded = F.concat(F.repeat(F.lit("N"), left), s, F.repeat(F.lit("N"), right))
    return F.when(n > length, trimmed).otherwise(padded)


def gc_content(seq, normalized: bool = True) -> Column:
    """(G + C) / length, 0 for the empty sequence (M3; N counts in the length)."""
    s = as_col(seq) if normalized else normalize(seq)
    n = F.length(s)
    gc = n - F.length(F.translate(s, "GC", ""))
    return F.coalesce(gc / F.nullif(n, F.lit(0)), F.lit(0.0)).cast("double")


def kmer_windows(seq, k: int, normalized: bool = True) -> Column:
    """Overlapping k-length windows (stride 1) without ``N``, in position order (M4, M5).

    One JVM regex pass with a zero-width lookahead, ``(?=([ACGT]{k}))``, returns every
    N-free window; len < k gives []. No lambda is involved, so the optimizer can never copy an
    expensive input expression into a per-window function.
    """
    _check_k(k)
    s = as_col(seq) if normalized else normalize(seq)
    return F.regexp_extract_all(s, F.lit(f"(?=([ACGT]{{{int(k)}}}))"), 1)


def kmer_denominator(seq, k: int, normalized: bool = True) -> Column:
    """F5 denominator: max(len - k + 1, 1); windows with N still count here (M4)."""
    s = as_col(seq) if normalized else normalize(seq)
    return F.greatest(F.length(s) - k + 1, F.lit(1))


def sorted_windows(seq, k: int, normalized: bool = True) -> Column:
    """N-free k-mer windows of a row, sorted (the input of ``runs_of_sorted``)."""
    return F.sort_array(kmer_windows(seq, k, normalized))


def runs_of_sorted(w) -> Column:
    """Runs of equal words in a sorted array: ``array<struct<kmer string, n bigint>>``.

    Every lambda reads only its own parameters. Give ``w`` as a column of its own projection
    (see ``kmer_long``) so the sort runs once per row.
    """
    w = as_col(w)
    n = F.size(w)
    following = F.slice(F.concat(F.slice(w, 2, F.greatest(n, F.lit(1))), F.array(F.lit(None).cast("string"))), 1, n)
    is_end = F.zip_with(w, following, lambda a, b: b.isNull() | (a != b))
    ends = F.filter(F.transform(is_end, lambda e, i: F.when(e, i + 1)), lambda x: x.isNotNull())
    words = F.filter(F.zip_with(w, is_end, lambda a, e: F.when(e, a)), lambda x: x.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    counts = F.zip_with(ends, starts, lambda e, p: (e - p).cast("bigint"))
    return F.arrays_zip(words.alias("kmer"), counts.alias("n"))


def kmer_runs(seq, k: int, normalized: bool = True) -> Column:
    """F4 per row as one expression: ``runs_of_sorted(sorted_windows(seq, k))``."""
    return runs_of_sorted(sorted_windows(seq, k, normalized))


def kmer_slot(kmer) -> Column:
    """slot of a k-mer in the lexical vocabulary = its base-4 value (A=0, C=1, G=2, T=3)."""
    return F.conv(F.translate(as_col(kmer), DNA_BASES, "0123"), 4, 10).cast("bigint")


def kmer_vocabulary(k: int) -> list[str]:
    """all 4^k words in lexical order, on the driver (the width of a dense k-mer vector)."""
    _check_k(k)
    words = [""]
    for _ in range(k):
        words = [w + b for w in words for b in DNA_BASES]
    return words


def one_hot(seq, length: int, normalized: bool = True) -> Column:
    """F8: pad/trim to ``length`` then 5 float indicators per position (A, C, G, T, N)."""
    chars = F.split(pad(seq, length, normalized), "")
    cats = F.array(*[F.lit(c) for c in ONE_HOT_CATEGORIES])
    return F.flatten(F.transform(chars, lambda ch: F.transform(cats, lambda c: (ch == c).cast("float"))))


# Accepted numeric text (P3): optional blanks, sign, decimal with optional exponent, inf, nan.
NUMERIC_TEXT = r"^[ \t\r\n]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])[ \t\r\n]*$"


def to_numeric(value) -> Column:
    """Coerce to DOUBLE; unparsable text, NaN and null become null.

    Spark's own cast also takes ``1d`` / ``1f``; the pattern guard rejects them like pandas. A column
    of type BOOLEAN counts as 1 and 0; the words ``true`` and ``false`` in a text column are no numbers.
    """
    s = as_col(value).cast("string")
    num = F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))
    num = F.when(F.typeof(as_col(value)) == "boolean", (s == "true").cast("double")).otherwise(num)
    return F.when(F.isnan(num), F.lit(None).cast("double")).otherwise(num)


def _check_k(k: int) -> None:
    if not (1 <= int(k) <= MAX_KMER_SIZE):
        raise ValueError(f"k must be between 1 and {MAX_KMER_SIZE}")
