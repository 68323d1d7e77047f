"""Feature operators: k-mer tables and vectors, one-hot, and the assembled feature frame.

Every family is computed from the same row in one projection (no join back on row_id), the
sequence is normalised once, and k-mers are counted inside each row, so none of these
operators shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnaframe.functions.sequence import (
    DEFAULT_KMER_SIZE,
    DEFAULT_SEQUENCE_LENGTH,
    MAX_KMER_SIZE,
    MIN_SEQUENCE_LENGTH,
    ONE_HOT_CATEGORIES,
    gc_content,
    kmer_denominator,
    kmer_slot,
    runs_of_sorted,
    sorted_windows,
    kmer_vocabulary,
    kmer_windows,
    normalize,
    one_hot,
)


#: Bases of the segments that ``segment_kmers`` counts in one row.
BLOCK = 1 << 14
#: Text that switches a yes/no option on; any other text switches it off.
TRUE_WORDS = ("1", "true", "yes", "on")
#: option: (kind, default, least, most)
OPTIONS = {
    "use_gc": (bool, True, None, None),
    "use_kmers": (bool, True, None, None),
    "normalize_kmers": (bool, True, None, None),
    "use_one_hot": (bool, False, None, None),
    "kmer_size": (int, DEFAULT_KMER_SIZE, 1, MAX_KMER_SIZE),
    "sequence_length": (int, DEFAULT_SEQUENCE_LENGTH, MIN_SEQUENCE_LENGTH, None),
}


@dataclass(frozen=True)
class FeatureConfig:
    """Preprocessing options, checked against ``OPTIONS``; lengths have no ceiling."""

    use_gc: bool = True
    use_kmers: bool = True
    normalize_kmers: bool = True
    use_one_hot: bool = False
    kmer_size: int = DEFAULT_KMER_SIZE
    sequence_length: int = DEFAULT_SEQUENCE_LENGTH
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, (_, _, least, most) in OPTIONS.items():
            value = getattr(self, name)
            if (least is not None and value < least) or (most is not None and value > most):
                raise ValueError(f"option {name}={value} is out of range [{least}, {'any' if most is None else most}]")
        if not any(getattr(self, name) for name in OPTIONS if name.startswith("use_")):
            raise ValueError("all feature families are switched off")

    @classmethod
    def from_dict(cls, d: dict | None) -> "FeatureConfig":
        given = {name: v for name, v in (d or {}).items() if name in OPTIONS and v is not None}
        words = {name: v.strip().lower() in TRUE_WORDS for name, v in given.items()
                 if OPTIONS[name][0] is bool and isinstance(v, str)}
        return cls(**{name: OPTIONS[name][0](v) for name, v in (given | words).items()})

    def to_dict(self) -> dict:
        return {
            "use_gc": self.use_gc,
            "use_kmers": self.use_kmers,
            "normalize_kmers": self.normalize_kmers,
            "use_one_hot": self.use_one_hot,
            "kmer_size": self.kmer_size,
            "sequence_length": self.sequence_length,
        }


def with_normalized(df: DataFrame, seq_col: str = "sequence", out: str = "sequence") -> DataFrame:
    """F1 as a projection; later features read the normalised column (normalise once)."""
    return df.withColumn(out, normalize(seq_col))


def kmer_long(df: DataFrame, k: int, seq_col: str = "sequence", id_cols=("row_id",), normalized: bool = False) -> DataFrame:
    """F4 + F5 + F6 long table ``(id..., kmer, slot, n, freq)``.

    Counted per row with ``kmer_runs`` and expanded with ``inline``: no exchange. Rows with
    no k-mer (len < k, or all windows hold N) produce no line; ``kmer_totals`` keeps them.
    """
    s = F.col(seq_col) if normalized else normalize(seq_col)
    base = df.select(*id_cols, s.alias("_s"))
    base = base.select(*id_cols, kmer_denominator("_s", k).alias("_den"), sorted_windows("_s", k).alias("_w"))
    x = base.select(*id_cols, "_den", F.inline_outer(runs_of_sorted("_w"))).filter(F.col("kmer").isNotNull())
    return x.select(*id_cols, "kmer", kmer_slot("kmer").alias("slot"), "n",
                    (F.col("n") / F.col("_den")).alias("freq"))


def segments(df: DataFrame, size: int, halo: int, seq_col: str = "sequence", id_cols=("row_id",), normalized: bool = False) -> DataFrame:
    """``(id..., segment, length, sequence)``: long sequences cut every ``size`` bases, with the next ``halo`` bases behind.

    ``length`` counts a segment's own bases, the halo left out. With ``halo = k - 1`` every k-mer window lies
    whole in exactly one segment, so counts of segments add up to those of the sequence. An empty sequence has
    one empty segment. The pieces of ``sources.fasta.read_fasta_pieces`` have the same form.
    """
    if not 0 <= halo <= size:
        raise ValueError("halo is 0 at least and size at most")
    s = F.col(seq_col) if normalized else normalize(seq_col)
    base = df.select(*id_cols, s.alias("_s")).withColumn("_n", F.length("_s"))
    x = base.withColumn("segment", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / size).cast("int")))))
    at = F.col("segment") * size
    return x.select(*id_cols, "segment", F.least(F.lit(size), F.col("_n") - at).alias("length"),
                    F.substring("_s", at + 1, F.lit(size + halo)).alias("sequence"))


def segment_kmers(parts: DataFrame, k: int, id_cols=("row_id",), size: int | None = None) -> DataFrame:
    """F4 + F5 + F6 long table of sequences given as segments with a halo of ``k - 1`` bases.

    One exchange adds the counts of a sequence up (partial counts first: at most 4^k rows per sequence and
    task), another its length, one number per sequence. Segments far shorter than 4^k bases have about a count
    per base; where ``size``, the length of a segment, is given, they are counted by blocks (``_block_kmers``).
    """
    ids = list(id_cols)
    if size and k > 1 and size <= BLOCK // 2:
        return _block_kmers(parts, k, ids, BLOCK // size)
    w = parts.select(*ids, kmer_windows("sequence", k).alias("_w"))
    counts = w.select(*ids, F.explode_outer("_w").alias("kmer")).filter(F.col("kmer").isNotNull())
    counts = counts.groupBy(*ids, "kmer").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy(*ids).agg(F.greatest(F.sum("length").cast("bigint") - k + 1, F.lit(1).cast("bigint")).alias("_den"))
    x = counts.join(sizes, ids)
    return x.select(*ids, "kmer", kmer_slot("kmer").alias("slot"), "n", (F.col("n") / F.col("_den")).alias("freq"))


def _block_kmers(parts: DataFrame, k: int, ids: list[str], segments: int) -> DataFrame:
    """``segment_kmers`` of short segments: ``segments`` neighbours make a block, the bases of a block are exchanged and
    counted in its row, in place of a row per k-mer.

    Sequences that end in their first block are then done; only longer ones exchange the counts of their blocks.
    """
    at = "piece" if "piece" in parts.columns else "segment"
    x = parts.select(*ids, F.col(at).alias("_at"), F.floor(F.col(at) / segments).alias("_block"), "length", "sequence")
    # every step below reads this one exchange
    x = x.filter(reduce(and_, [F.col(c).isNotNull() for c in ids])).repartition(*ids, "_block")
    last = F.length("sequence") <= F.col("length")  # no bases of a next segment behind its own
    x = x.groupBy(*ids, "_block").agg(
        F.array_join(F.collect_list("sequence"), "N").alias("_s"),  # no window goes over an N, so their order is free
        F.sum("length").cast("bigint").alias("_n"), F.max("_block").alias("_last"),
        F.count_if(F.col("_at") == 0).alias("_starts"), F.count_if(last).alias("_ends"))
    # as many ends as starts: every sequence of the id ends in this block
    done = (F.col("_last") == 0) & (F.col("_starts") == F.col("_ends"))
    den = lambda n: F.greatest(n - k + 1, F.lit(1).cast("bigint")).alias("_den")
    whole = _row_kmers(x.filter(done).select(*ids, den(F.col("_n")), "_s"), k, [*ids, "_den"])
    rest = x.filter(~done)
    counts = _row_kmers(rest, k, ids).groupBy(*ids, "kmer").agg(F.sum("n").alias("n"))
    sizes = rest.groupBy(*ids).agg(den(F.sum("_n")))
    x = whole.unionByName(counts.join(sizes, ids))
    return x.select(*ids, "kmer", kmer_slot("kmer").alias("slot"), "n", (F.col("n") / F.col("_den")).alias("freq"))


def _row_kmers(df: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """``(keep..., kmer, n)`` of the normalised text ``_s`` of each row, without an exchange."""
    if 4**k > 4096:
        w = df.select(*keep, sorted_windows("_s", k).alias("_w"))
        return w.select(*keep, F.inline_outer(runs_of_sorted("_w"))).filter(F.col("kmer").isNotNull())
    from pyspark.ml.feature import CountVectorizerModel

    words = kmer_vocabulary(k)
    x = df.select(*keep, kmer_windows("_s", k).alias("_w"))
    x = CountVectorizerModel.from_vocabulary(words, inputCol="_w", outputCol="_c").transform(x)
    x = x.select(*keep, F.unwrap_udt("_c").alias("_c"))
    x = x.select(*keep, F.inline_outer(F.arrays_zip(F.col("_c.indices").alias("_slot"), F.col("_c.values").alias("n")))).filter(F.col("_slot").isNotNull())
    kmer = F.element_at(F.split(F.lit(",".join(words)), ","), F.col("_slot") + 1)
    return x.select(*keep, kmer.alias("kmer"), F.col("n").cast("bigint").alias("n"))


def kmer_long_any(df: DataFrame, k: int, seq_col: str = "sequence", id_cols=("row_id",), normalized: bool = False,
                  size: int = 1 << 20) -> DataFrame:
    """``kmer_long`` with no limit of length: sequences above ``size`` bases are counted by segments.

    The others stay in their row, without an exchange. ``id_cols`` name a row.
    """
    s = F.col(seq_col) if normalized else normalize(seq_col)
    base = df.select(*id_cols, s.alias("_s"))
    short = kmer_long(base.filter(F.length("_s") <= size), k, "_s", id_cols, normalized=True)
    long = segments(base.filter(F.length("_s") > size), size, k - 1, "_s", id_cols, normalized=True)
    return short.unionByName(segment_kmers(long, k, id_cols))


def segment_profile(parts: DataFrame, id_cols=("row_id",)) -> DataFrame:
    """F3 of sequences given as segments: ``(id..., length, gc_content)``; halos are left out."""
    own = F.substring(F.col("sequence"), F.lit(1), F.col("length").cast("int"))
    gc = F.col("length") - F.length(F.translate(own, "GC", ""))
    x = parts.groupBy(*id_cols).agg(F.sum("length").cast("bigint").alias("length"), F.sum(gc).alias("_gc"))
    return x.select(*id_cols, "length", F.coalesce(F.col("_gc") / F.nullif(F.col("length"), F.lit(0)), F.lit(0.0)).alias("gc_content"))


def segment_vectors(parts: DataFrame, k: int, id_cols=("row_id",), normalize_counts: bool = True, out: str = "kmer_vec") -> DataFrame:
    """F7 of sequences given as segments with a halo of ``k - 1`` bases: the segments' sparse vectors added up.

    A vector of 4^k slots per sequence and task is all that is exchanged. A sequence without a k-mer gets a
    zero vector.
    """
    from pyspark.ml.feature import Interaction
    from pyspark.ml.stat import Summarizer

    ids = list(id_cols)
    x = kmer_vector(parts.select(*ids, "length", "sequence"), k, "sequence", normalize_counts=False, out="_counts")
    slots = x.schema["_counts"].metadata  # sums carry none of their own
    x = x.groupBy(*ids).agg(Summarizer.sum(F.col("_counts")).alias(out),
                            F.greatest(F.sum("length") - k + 1, F.lit(1)).cast("double").alias("_den"))
    if not normalize_counts:
        return x.drop("_den")
    x = x.select(*ids, (F.lit(1.0) / F.col("_den")).alias("_scale"), F.col(out).alias("_sum", metadata=slots))
    return Interaction(inputCols=["_scale", "_sum"], outputCol=out).transform(x).drop("_scale", "_sum")


def kmer_row_totals(df: DataFrame, k: int, seq_col: str = "sequence", id_cols=("row_id",), normalized: bool = False) -> DataFrame:
    """Per-row window accounting: (id..., length, windows, acgt_windows, distinct_kmers). Every row kept (M5)."""
    s = F.col(seq_col) if normalized else normalize(seq_col)
    base = df.select(*id_cols, s.alias("_s"))
    x = base.select(*id_cols, "_s", kmer_windows("_s", k).alias("_w"))
    return x.select(
        *id_cols,
        F.length("_s").alias("length"),
        kmer_denominator("_s", k).alias("windows"),
        F.size("_w").cast("bigint").alias("acgt_windows"),
        F.size(F.array_distinct("_w")).cast("bigint").alias("distinct_kmers"),
    )


def kmer_spectrum(df: DataFrame, k: int, seq_col: str = "sequence", by=(), normalized: bool = False,
                  with_rows: bool = True) -> DataFrame:
    """Corpus k-mer spectrum ``(by..., kmer, slot, n[, rows])``: occurrences, and rows holding it.

    Each row's windows are sorted inside the row and every window is flagged when it differs
    from its predecessor (its first occurrence in the row); one generator emits (kmer, flag) and a
    single ``groupBy(kmer)`` with map-side partial aggregation counts occurrences and sums the
    flags, so the exchange carries at most 4^k keys per partition and group, whatever the number
    of sequences. Without ``with_rows`` the sort and flag are skipped.
    """
    s = F.col(seq_col) if normalized else normalize(seq_col)
    if not with_rows:
        w = df.select(*by, kmer_windows(s, k).alias("_w"))
        x = w.select(*by, F.explode_outer("_w").alias("kmer")).filter(F.col("kmer").isNotNull())
        return x.groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n")) \
                .select(*by, "kmer", kmer_slot("kmer").alias("slot"), "n")
    w = df.select(*by, sorted_windows(s, k).alias("_w"))
    size = F.size("_w")
    previous = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.col("_w")), 1, size)
    first = F.zip_with("_w", previous, lambda a, b: (b.isNull() | (a != b)).cast("int"))
    x = w.select(*by, F.inline_outer(F.arrays_zip(F.col("_w").alias("kmer"), first.alias("f")))) \
         .filter(F.col("kmer").isNotNull())
    return x.groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"), F.sum("f").cast("bigint").alias("rows")) \
            .select(*by, "kmer", kmer_slot("kmer").alias("slot"), "n", "rows")


def one_hot_long(df: DataFrame, length: int, seq_col: str = "sequence", id_cols=("row_id",), normalized: bool = False) -> DataFrame:
    """F8 long form: the hot index of every position ``(id..., pos, base, idx)`` (idx = 5*pos + cat)."""
    s = F.col(seq_col) if normalized else normalize(seq_col)
    x = df.select(*id_cols, F.posexplode_outer(one_hot(s, length)).alias("idx", "v")).filter(F.col("v") == 1.0)
    cats = F.array(*[F.lit(c) for c in ONE_HOT_CATEGORIES])
    return x.select(*id_cols, (F.col("idx") / 5).cast("int").alias("pos"),
                    F.element_at(cats, (F.col("idx") % 5 + 1).cast("int")).alias("base"), "idx")


def kmer_vector(df: DataFrame, k: int, seq_col: str = "sequence", normalize_counts: bool = True,
                out: str = "kmer_vec", normalized: bool = True) -> DataFrame:
    """sparse k-mer vector of size 4^k, slots in lexical order, per row (no shuffle).

    ``CountVectorizerModel.from_vocabulary`` counts the window tokens JVM-side; frequencies are
    counts scaled by ``1 / max(len-k+1, 1)`` with ``Interaction``. len < k gives a zero vector.
    """
    from pyspark.ml.feature import CountVectorizerModel, Interaction

    s = F.col(seq_col) if normalized else normalize(seq_col)
    tmp_tokens, tmp_counts, tmp_scale = f"_{out}_tok", f"_{out}_cnt", f"_{out}_scale"
    x = df.withColumn(tmp_tokens, kmer_windows(s, k))
    cv = CountVectorizerModel.from_vocabulary(kmer_vocabulary(k), inputCol=tmp_tokens, outputCol=tmp_counts)
    x = cv.transform(x)
    if normalize_counts:
        x = x.withColumn(tmp_scale, (F.lit(1.0) / kmer_denominator(s, k)).cast("double"))
        x = Interaction(inputCols=[tmp_scale, tmp_counts], outputCol=out).transform(x)
        return x.drop(tmp_tokens, tmp_counts, tmp_scale)
    return x.withColumnRenamed(tmp_counts, out).drop(tmp_tokens)


def feature_names(config: FeatureConfig) -> list[str]:
    """Names of the assembled columns in order: gc_content, k-mer words, ohe_0..."""
    names = []
    if config.use_gc:
        names.append("gc_content")
    if config.use_kmers:
        names.extend(kmer_vocabulary(config.kmer_size))
    if config.use_one_hot:
        names.extend(f"ohe_{i}" for i in range(5 * config.sequence_length))
    return names


def build_features(df: DataFrame, seq_col: str, config: FeatureConfig | dict | None = None,
                   out: str = "features", keep=("row_id",)) -> DataFrame:
    """F9 + J1: normalise once, then GC | k-mer vector | one-hot assembled into one ML vector.

    Families are same-row projections; the assembled frame keeps ``keep`` columns beside it.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    cfg = config if isinstance(config, FeatureConfig) else FeatureConfig.from_dict(config)
    keep = [c for c in keep if c in df.columns and c != seq_col]
    x = df.select(*keep, normalize(seq_col).alias("_seq"))
    parts = []
    if cfg.use_gc:
        x = x.withColumn("_gc", gc_content("_seq"))
        parts.append("_gc")
    if cfg.use_kmers:
        x = kmer_vector(x, cfg.kmer_size, "_seq", cfg.normalize_kmers, out="_kmers")
        parts.append("_kmers")
    if cfg.use_one_hot:
        x = x.withColumn("_ohe", array_to_vector(one_hot("_seq", cfg.sequence_length)))
        parts.append("_ohe")
    assembled = VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="error").transform(x)
    return assembled.select(*keep, out)
