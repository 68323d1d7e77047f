"""Files and sequences above a block or a row: every cut gives what one piece gives."""

import hashlib
import os
import random
import tempfile

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dnaframe.operators import features as feat
from dnaframe.sources import digest, fasta


@pytest.fixture(params=[64, 333, 1 << 27])
def split(request, spark):
    """Scan blocks of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def folder(texts):
    d = tempfile.mkdtemp(prefix="dnaframe-test-", dir="/tmp")
    for name, data in texts.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())
    return d


def fasta_texts():
    rng = random.Random(1)

    def record(i):
        head = rng.choice([">", ">", ">", "  >", "\t> "]) + rng.choice(["", "  ", f"r{i} x", f">r{i}"]) + rng.choice(["\n", "\r\n", "\r"])
        return head + "".join(rng.choice([" ", ""]) + "".join(rng.choice("acgtnuACGT") for _ in range(rng.randint(0, 50)))
                              + rng.choice(["\n", "\r\n", "\r", " \n", "\x0b", "\n\n", " "]) for _ in range(rng.randint(0, 6)))

    plain = "".join(f">{i}\n{'ACGTTGCA' * rng.randint(0, 20)}\n" for i in range(120))
    return {"a.fa": "pre\nAC\n" + "".join(record(i) for i in range(120)), "b.fa": plain, "c.fa": "no header\n", "d.fa": ">x\nAC\n>", "f.fa": "",
            "e.fa": "﻿>x\nAC\n>\nGT", "g.fa": ">", "h.fa": "\n\n  >only\nACGTACGTAC" + "\nAC>GT\n" * 60,
            "i.fa": "".join(f">{i}\r{'ACGT' * 10}\r" for i in range(40))}


def test_fasta_is_the_same_under_every_cut(spark, split):
    d = folder(fasta_texts())
    key = lambda r: (os.path.basename(r.file), r.record)
    whole = sorted((*key(r), r.id, r.sequence) for r in fasta.read_fasta(spark, d).collect())
    rows = sorted(fasta.read_fasta_split(spark, d).collect(), key=key)
    assert [(*key(r), r.id, r.sequence) for r in rows] == whole
    assert [r.row_id for r in rows] == list(range(len(whole)))  # files by name, records as they stand
    full = {x[:2]: x[3] for x in whole}
    for size, halo in ((7, 3), (1000, 0)):
        pieces = sorted(fasta.read_fasta_pieces(spark, d, size, halo).collect(), key=lambda r: (*key(r), r.piece))
        joined = {}
        for r in pieces:
            assert r.sequence == full[key(r)][r.start: r.start + size + halo]
            joined[(*key(r), r.id)] = joined.get((*key(r), r.id), "") + r.sequence[: r.length]
        assert [(*k, v) for k, v in joined.items()] == whole


def test_split_reader_joins_places_and_has_no_chain_of_cases(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        d = folder({"a.fa": "".join(f">{i}\nACGTACGT\n" for i in range(2000))})
        df = fasta.read_fasta_split(spark, d)
        assert df.rdd.getNumPartitions() >= 1 and df.count() == 2000
        assert df._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 20
        assert len(spark.read.text(d).inputFiles()) == 1 and spark.read.option("lineSep", "\n>").text(d).rdd.getNumPartitions() > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_digests_are_the_same_under_every_cut(spark, split):
    rng = random.Random(2)
    texts = {"a": "x\n" * 200, "b": "line\r\nwith no end", "d": "\n", "e": "﻿mark\nand\n", "f": "﻿", "j": b"\xff\xfe\x00\n\x80" * 100,
             "g": bytes(rng.randrange(256) for _ in range(3000)), "h": "one", "i": "\n\n\nend\r"}
    d = folder(texts)
    data = {n: (t if isinstance(t, bytes) else t.encode()) for n, t in texts.items()}
    expect = {n: (len(t), hashlib.sha256(t).hexdigest()) for n, t in data.items()}
    for whole in (1, 1 << 30):  # every file by lines; every file in one row
        got = {os.path.basename(r.path): (r.size_bytes, r.sha256) for r in digest.file_digests(spark, d, whole).collect()}
        assert got == expect

    def tree(t, block):
        level = [hashlib.sha256(t[i: i + block]).digest() for i in range(0, max(1, len(t)), block)]
        return hashlib.sha256(b"".join(level)).hexdigest() if len(level) > 1 else level[0].hex()

    got = {os.path.basename(r.path): (r.size_bytes, r.blocks, r.tree_sha256) for r in digest.tree_digests(spark, d, 100).collect()}
    assert {n: x[0] for n, x in got.items()} == {n: len(t) for n, t in data.items()}
    assert {n: x[1] for n, x in got.items()} == {n: max(1, -(-len(t) // 100)) for n, t in data.items()}
    assert {n: x[2] for n, x in got.items()} == {n: tree(t, 100) for n, t in data.items()}


def test_no_task_takes_the_lines_of_a_whole_block(spark, monkeypatch):
    d = folder({"a": "".join(f"{i:07}\n" for i in range(20_000)), "b": "x\n"})
    rows = digest._byte_lines(spark, d, 4)
    assert rows.count() < 20_000 * 8 / digest.RUN * 2 and rows.agg(F.max(F.octet_length("bytes"))).first()[0] <= digest.RUN + 8
    d = folder({"a.fa": "".join(f">{i}\n{'ACGT' * (i % 9)}\n" for i in range(500))})
    whole = sorted(map(tuple, fasta.read_fasta_pieces(spark, d, 10, 3).drop("file").collect()))
    monkeypatch.setattr(fasta, "RUN", 16)
    assert sorted(map(tuple, fasta.read_fasta_pieces(spark, d, 10, 3).drop("file").collect())) == whole
    plan = fasta.read_fasta_pieces(spark, d, 10, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in plan and "windowspecdefinition(file" in plan


def test_folder_digest_sees_names_folders_and_bytes(spark):
    d = folder({"a": "1", "b": "2"})
    first = digest.path_digest(spark, d)
    assert first == digest.path_digest(spark, folder({"a": "1", "b": "2"})) and first[1] == 2
    assert first[0] != digest.path_digest(spark, folder({"a": "2", "b": "1"}))[0]
    assert digest.path_digest(spark, os.path.join(d, "a")) == (hashlib.sha256(b"1").hexdigest(), 1)


def sequences(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ACGTACGTN") for _ in range(n))) for i, n in enumerate([0, 1, 3, 4, 5, 9, 10, 11, 20, 21, 99, 100, 1000])]
    return spark.createDataFrame([*rows, (98, None), (99, "acgu ")], "row_id long, sequence string")


@pytest.mark.parametrize("size", [4, 10, 64])
def test_segments_count_like_whole_sequences(spark, size):
    df = sequences(spark)
    cut = lambda x: sorted((r.row_id, r.kmer, r.slot, r.n, round(r.freq, 12)) for r in x.collect())
    expect = cut(feat.kmer_long(df, 4))
    parts = feat.segments(df, size, 3)
    assert parts.agg(F.max(F.length("sequence"))).first()[0] <= size + 3
    assert cut(feat.segment_kmers(parts, 4)) == expect
    assert cut(feat.kmer_long_any(df, 4, size=size)) == expect
    want = df.select("row_id", F.round(feat.gc_content(feat.normalize("sequence")), 12).alias("gc")).collect()
    got = feat.segment_profile(parts).select("row_id", F.round("gc_content", 12).alias("gc")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    for scaled in (True, False):
        whole = feat.kmer_vector(df, 4, "sequence", scaled, normalized=False).select("row_id", vector_to_array("kmer_vec").alias("v"))
        added = feat.segment_vectors(parts, 4, normalize_counts=scaled).select("row_id", vector_to_array("kmer_vec").alias("v"))
        rounded = lambda x: sorted((r.row_id, [round(c, 12) for c in r.v]) for r in x.collect())
        assert rounded(added) == rounded(whole)


def test_a_sequence_of_fifty_million_bases(spark):
    n, unit = 50_000_000, "ACGTTGCAAC"
    df = spark.range(1).select(F.col("id").alias("row_id"), F.repeat(F.lit(unit), n // 10).alias("sequence"))
    parts = feat.segments(df, 1 << 20, 2, normalized=True).repartition(48).cache()
    got = {r.kmer: r.n for r in feat.segment_kmers(parts, 3).collect()}
    expect = {}
    for i in range(10):
        w = (unit * 2)[i: i + 3]
        expect[w] = expect.get(w, 0) + n // 10 - (i > 7)
    assert got == expect
    assert feat.segment_profile(parts).first().length == n
