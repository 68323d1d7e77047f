"""Edge rows for the sequence functions (M1-M7, FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from dnaframe.functions.sequence import (gc_content, kmer_denominator, kmer_slot, kmer_vocabulary, kmer_windows,
                                         normalize, one_hot, pad, to_numeric)
from dnaframe.operators import features as feat


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"s {typ}").select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [
    (" acgu\t", "ACGN"), ("AC GT", "ACNGT"), ("a\nb", "ANN"), ("ß", "NN"), (None, ""), ("", ""),
    ("　acgt ", "ACGT"), ("x ", "N"),
])
def test_normalize(spark, raw, expected):
    assert one(spark, normalize("s"), raw) == expected


@pytest.mark.parametrize("seq,gc", [("GCGC", 1.0), ("ACGT", 0.5), ("NNNN", 0.0), ("", 0.0), ("AAGN", 0.25)])
def test_gc(spark, seq, gc):
    assert one(spark, gc_content("s"), seq) == pytest.approx(gc)


@pytest.mark.parametrize("seq,L,expected", [
    ("ABCDE", 3, "BCD"), ("ABCDE", 2, "BC"), ("AA", 3, "NAA"), ("A", 4, "NANN"), ("ACGT", 4, "ACGT"), ("", 3, "NNN"),
])
def test_pad(spark, seq, L, expected):
    assert one(spark, pad("s", L), seq) == expected


def test_pad_matches_str_center_and_trim_rule(spark):
    rows = []
    for n in range(0, 9):
        for L in range(1, 9):
            s = "ACGTACGTA"[:n]
            if n > L:
                d = n - L
                exp = s[d // 2: n - (d // 2 + d % 2)]
            else:
                exp = s.center(L, "N")
            rows.append((s, L, exp))
    df = spark.createDataFrame(rows, "s string, L int, exp string")
    got = [r for r in df.collect()]
    for s, L, exp in got:
        assert one(spark, pad("s", L), s) == exp


def test_kmer_windows_and_runs(spark):
    df = spark.createDataFrame([(1, "ACGTACG"), (2, "ACNGTA"), (3, "AC"), (4, None)], "row_id int, sequence string")
    long = {(r.row_id, r.kmer): (r.n, r.freq, r.slot) for r in feat.kmer_long(df, 3).collect()}
    assert long[(1, "ACG")] == (2, pytest.approx(2 / 5), 6)
    assert long[(1, "CGT")][0] == 1 and long[(1, "GTA")][0] == 1 and long[(1, "TAC")][0] == 1
    assert long[(2, "GTA")] == (1, pytest.approx(1 / 4), 44)
    assert not any(k[0] in (3, 4) for k in long)
    totals = {r.row_id: r for r in feat.kmer_row_totals(df, 3).collect()}
    assert totals[3].acgt_windows == 0 and totals[3].windows == 1
    assert totals[1].distinct_kmers == 4 and totals[1].acgt_windows == 5


def test_kmer_windows_never_exceed_positions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(normalize("text").alias("s"))
    bad = df.select((F.size(kmer_windows("s", 4)) > kmer_denominator("s", 4)).alias("b")).filter("b").count()
    assert bad == 0


def test_vocabulary_and_slot(spark):
    v = kmer_vocabulary(2)
    assert v[:5] == ["AA", "AC", "AG", "AT", "CA"] and len(v) == 16
    df = spark.createDataFrame([(w,) for w in kmer_vocabulary(3)], "k string")
    slots = [r[0] for r in df.select(kmer_slot("k")).collect()]
    assert slots == list(range(64))


def test_kmer_vector_matches_long_table(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([(1, "ACGTACG"), (2, "AC")], "row_id int, sequence string")
    v = feat.kmer_vector(df, 3, normalized=False).select("row_id", vector_to_array("kmer_vec").alias("a"))
    got = {r.row_id: r.a for r in v.collect()}
    assert len(got[1]) == 64 and got[1][6] == pytest.approx(0.4) and sum(got[2]) == 0


def test_one_hot(spark):
    arr = one(spark, one_hot("s", 3), "AC")  # padded to NAC
    assert arr == [0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0]


def test_build_features_width(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([(1, "ACGT" * 10)], "row_id int, sequence string")
    cfg = feat.FeatureConfig(use_gc=True, use_kmers=True, kmer_size=2, use_one_hot=True, sequence_length=20)
    f = feat.build_features(df, "sequence", cfg).select(vector_to_array("features").alias("a")).first().a
    assert len(f) == 1 + 16 + 100 and f[0] == pytest.approx(0.5)
    assert len(feat.feature_names(cfg)) == 117
    with pytest.raises(ValueError):
        feat.FeatureConfig(use_gc=False, use_kmers=False, use_one_hot=False)


@pytest.mark.parametrize("raw,expected", [
    ("1.5", 1.5), (" 1 ", 1.0), ("abc", None), ("1d", None), ("1f", None), ("0x10", None), ("inf", float("inf")),
    ("True", None), ("nan", None), ("-2e3", -2000.0), (".5", 0.5), ("", None),
])
def test_to_numeric(spark, raw, expected):
    assert one(spark, to_numeric("s"), raw) == expected


def test_normalize_property_against_rule(spark):
    """M1 on random text (letters, blanks, unicode): upper, strip ends, non-ACGTN -> N."""
    from hypothesis import given, settings, strategies as st

    samples = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("acgtnuxACGTN \t\n 　ßé")), max_size=30))
    def collect(s):
        samples.append(s)

    collect()
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(normalize("s")).collect()]
    want = ["".join(b if b in "ACGTN" else "N" for b in s.upper().strip()) for s in samples]
    assert got == want


def test_spectrum_without_rows_matches(spark):
    df = spark.createDataFrame([(1, "ACGTACG"), (2, "ACNGTA"), (3, "ACGACG")], "row_id int, sequence string")
    full = {r.kmer: (r.n, r.rows) for r in feat.kmer_spectrum(df, 3).collect()}
    fast = {r.kmer: r.n for r in feat.kmer_spectrum(df, 3, with_rows=False).collect()}
    assert {k: v[0] for k, v in full.items()} == fast
    assert full["ACG"] == (4, 2) and full["GTA"] == (2, 2)


def test_kmer_vector_raw_counts(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([(1, "ACGTACG")], "row_id int, sequence string")
    v = feat.kmer_vector(df, 3, normalize_counts=False, normalized=False).select(vector_to_array("kmer_vec").alias("a")).first().a
    assert v[6] == 2.0 and sum(v) == 5.0  # ACG twice; 5 windows, none with N


def test_feature_config_parsing():
    cfg = feat.FeatureConfig.from_dict({"use_gc": "yes", "use_kmers": "0", "use_one_hot": "true", "kmer_size": "3",
                                        "sequence_length": 40})
    assert (cfg.use_gc, cfg.use_kmers, cfg.use_one_hot, cfg.kmer_size, cfg.sequence_length) == (True, False, True, 3, 40)
    assert feat.FeatureConfig.from_dict(None).to_dict()["kmer_size"] == 6
    with pytest.raises(ValueError):
        feat.FeatureConfig.from_dict({"kmer_size": 32})
    assert feat.FeatureConfig.from_dict({"sequence_length": 5000, "kmer_size": 8}).sequence_length == 5000
    with pytest.raises(ValueError):
        feat.FeatureConfig.from_dict({"sequence_length": 10})
