"""Records read and counted in pieces: their lines are exchanged once, and blocks of pieces count like whole sequences."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from dnaframe.operators import features as feat
from dnaframe.sources import fasta


@pytest.fixture()
def no_broadcast(spark):
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [line for line in plan if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]


def pieces_of(spark, size, halo):
    rng = random.Random(4)
    d = tempfile.mkdtemp(prefix="dnaframe-test-", dir="/tmp")
    texts = {}
    for name in "ab":
        records = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(60)]
        texts[name] = records
        with open(os.path.join(d, f"{name}.fa"), "w") as f:
            for i, s in enumerate(records):
                f.write(f">r{i}\n" + "".join(s[j: j + 17] + "\n" for j in range(0, len(s), 17)))
    return fasta.read_fasta_pieces(spark, d, size, halo), texts


@pytest.mark.parametrize("run", [16, 1 << 16])
def test_pieces_whatever_the_run(spark, monkeypatch, run):
    monkeypatch.setattr(fasta, "RUN", run)
    pieces, texts = pieces_of(spark, 25, 3)
    got = {}
    for r in pieces.collect():
        text = texts[os.path.basename(r.file)[0]][r.record - 1]
        assert (r.id, r.start, r.sequence) == (f"r{r.record - 1}", r.piece * 25, text[r.start: r.start + 28])
        assert r.length == len(text[r.start: r.start + 25])
        got[r.file, r.record] = got.get((r.file, r.record), 0) + r.length
    assert sorted(got.values()) == sorted(len(s) for t in texts.values() for s in t)


def test_lines_are_exchanged_once(spark, no_broadcast):
    pieces, _ = pieces_of(spark, 25, 3)
    # the lines, their runs (two small tables), and the pieces of records over the end of a run
    assert len(exchanges(pieces)) == 5
    counted = feat.segment_kmers(pieces.select("id", "piece", "length", "sequence"), 4, ("id",), size=25)
    by_kmer = [line for line in exchanges(counted) if "kmer" in line]
    assert len(exchanges(counted)) <= 12 and len(by_kmer) == 1  # the counts of sequences above a block


@pytest.mark.parametrize("block, k", [(20, 4), (60, 2), (60, 7), (1 << 14, 4)])
def test_blocks_of_segments_count_like_whole_sequences(spark, monkeypatch, block, k):
    monkeypatch.setattr(feat, "BLOCK", block)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ACGTACGTN") for _ in range(n))) for i, n in enumerate([0, 1, 3, 4, 10, 11, 20, 59, 60, 61, 500])]
    rows += [(90, "ACGT" * 3), (90, "GATTACA" * 40), (90, ""), (91, "ACGTACGTAA"), (91, "ACGTACGTAA"), (92, None), (None, "ACGTACGT" * 9)]
    parts = feat.segments(spark.createDataFrame(rows, "row_id long, sequence string"), 10, k - 1)
    cut = lambda x: sorted((r.row_id, r.kmer, r.slot, r.n, round(r.freq, 12)) for r in x.collect())
    expect, found = feat.segment_kmers(parts, k), feat.segment_kmers(parts, k, size=10)
    assert found.schema.simpleString() == expect.schema.simpleString()
    assert cut(found) == cut(expect) and {90, 91} <= {r.row_id for r in found.select("row_id").collect()}
    by_hand = {}
    for i, s in rows:
        for j in range(len(s or "") - k + 1) if i == 90 else ():
            by_hand[s[j: j + k]] = by_hand.get(s[j: j + k], 0) + 1
    assert {r.kmer: r.n for r in found.filter("row_id = 90").collect()} == by_hand
