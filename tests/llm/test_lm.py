import math
from collections import Counter

import pytest

from dnaframe.llm import lm
from tests.llm.conftest import prose


def brute(docs, good, order=5, prior=1.0, trust=8.0):
    n, t = Counter(), Counter()
    grams = {}
    for i, text in docs:
        b = b"\n" * (order - 1) + (text or "").encode()
        grams.setdefault(i, []).append([b[p:p + order] for p in range(len(b) - order + 1)])
        for g in grams[i][-1]:
            n[g] += 1
            t[g] += i in good
    cn, ct = Counter(), Counter()
    for g in n:
        cn[g[:-1]] += n[g]
        ct[g[:-1]] += t[g]
    out = []
    for i, each in grams.items():
        for gs in each:
            pb = [(n[g] + prior / 256) / (cn[g[:-1]] + prior) for g in gs]
            pt = [(t[g] + trust * p) / (ct[g[:-1]] + trust) for g, p in zip(gs, pb)]
            m = max(1, len(gs))
            out.append((i, len(gs), -sum(map(math.log2, pt)) / m, -sum(map(math.log2, pb)) / m))
    return out


@pytest.mark.parametrize("chunk", [1 << 23, 2000])
def test_losses_match_brute_force(spark, make, chunk):
    docs = [(i, prose(60, i) if i % 2 else prose(60, i).upper() + " ü漢") for i in range(40)] + [(98, None), (99, ""), (97, "a")]
    good = {i for i in range(40) if i % 2}
    marks = spark.createDataFrame([(i,) for i in good] + [(None,), (12345,), (1,)], "doc_id long")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(make(docs), marks, chunk=chunk).collect()}
    assert len(got) == len(docs)
    for i, n, target, background in brute(docs, good):
        assert got[i].n_tokens == n
        if n:
            assert got[i].loss_target == pytest.approx(target) and got[i].loss_background == pytest.approx(background)
            assert got[i].score == pytest.approx(target - background)
        else:
            assert got[i].score is None and got[i].loss_target is None
    assert max(got[i].score for i in good) < min(got[i].score for i in range(0, 40, 2))


def test_awkward_rows(spark, awkward, empty):
    marks = spark.createDataFrame([(5,), (8,)], "doc_id long")
    assert lm.cross_entropy_difference(awkward, marks).count() == awkward.count()
    none = marks.filter("doc_id < 0")
    scores = [r.score for r in lm.cross_entropy_difference(awkward, none).collect() if r.score is not None]
    assert scores and scores == pytest.approx([0] * len(scores), abs=1e-9)
    assert lm.cross_entropy_difference(empty, marks).collect() == []


def test_query_prefers_labelled_quality(spark, make):
    docs = make([(i, prose(60, i) if i % 2 else " ".join(w + "###" for w in prose(60, i).split())) for i in range(30)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in lm.lm_query(docs, labels).collect()}
    assert max(scores[i] for i in range(21, 30, 2)) < min(scores[i] for i in range(20, 30, 2))


def test_rows_without_id_or_of_one_id_spread_over_chunks(spark, make, monkeypatch):
    stored, keep = {}, lm.kept
    monkeypatch.setattr(lm, "kept", lambda df, name: stored.setdefault(name, keep(df, name)))
    docs = make([(None if i % 2 else 7, prose(50, i % 40)) for i in range(200)])
    out = lm.cross_entropy_difference(docs, spark.createDataFrame([(7,)], "doc_id long"), chunk=4000).collect()
    sums = [r["sum(n)"] for r in stored["lm-counts"].groupBy("chunk").sum("n").collect()]
    assert len(out) == 200 and len(sums) > 5 and max(sums) < sum(sums) / 4
    assert stored["lm-counts"].agg({"t": "sum"}).first()[0] == sum(r.n_tokens for r in out if r.doc_id == 7)
