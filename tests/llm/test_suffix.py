import hashlib

import numpy as np
import pytest

from dnaframe.llm import suffix
from tests.llm.conftest import prose


def brute(docs, length=200, keep="none"):
    seen = {}
    texts = [(t or "").encode() for _, t in docs]
    for i, b in enumerate(texts):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p:p + length], []).append((i, p))
    gone = [bytearray(len(b)) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places[1 if keep == "first" else 0:]:
                gone[i][p:p + length] = b"\1" * length
    out = []
    for (doc_id, _), b, g in zip(docs, texts, gone):
        rest = bytes(c for c, x in zip(b, g) if not x)
        spans = sum(1 for j, x in enumerate(g) if x and (j == 0 or not g[j - 1]))
        out.append((doc_id, len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


PASSAGE, OTHER = prose(70, 77), prose(200, 78)
DOCS = ([(i, prose(30 + i, i) + " " + PASSAGE + " " + prose(20, 100 + i)) for i in range(12)]
        + [(20, OTHER), (21, OTHER), (22, OTHER[:500] + "é" + OTHER[500:]), (23, "ab" * 400), (24, "x" * 199), (25, "x" * 200), (26, "x" * 401),
           (27, None), (28, ""), (29, "漢字" * 100 + prose(50, 4)), (30, "y" + "漢字" * 100), (31, prose(10, 3) * 30)])


@pytest.mark.parametrize("crowd", [4096, 2])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_matches_brute_force(make, monkeypatch, keep, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "BUCKET", 20_000)
    got = suffix.without_repeats(make(DOCS), keep=keep).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute(DOCS, keep=keep)
    assert all(hashlib.sha256(r.rest).hexdigest() == r.kept_sha256 for r in got)


def shared(a, b, length):
    return next((i for i in range(length) if a[i] != b[i]), length)


@pytest.mark.parametrize("letters", [2, 26])
def test_factors_match_brute_force(letters):
    rng = np.random.default_rng(letters)
    data = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
    data[1000:1300] = data[200:500]
    starts = np.sort(rng.choice(2700, 500, replace=False))
    for length in (8, 11, 16, 50, 200):
        texts = [data[s:s + length].tobytes() for s in starts]
        previous, following = suffix.factors(data, starts, length)
        assert [*previous] == [max((shared(t, u, length) for u in texts[:i]), default=0) for i, t in enumerate(texts)]
        assert [*following] == [max((shared(t, u, length) for u in texts[i + 1:]), default=0) for i, t in enumerate(texts)]
        assert [*suffix.factors(data, starts, length, later=False)[0]] == [*previous]
    assert len(suffix.factors(data, starts[:0], 50)[0]) == 0


def test_nearest_smaller_before():
    rng = np.random.default_rng(1)
    for x in (rng.permutation(400), np.arange(50), np.arange(50)[::-1], np.concatenate((np.arange(1, 60), [0])), np.zeros(0, int)):
        want = [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), -1) for i in range(len(x))]
        assert [*suffix.before_smaller(x)] == want


def test_halves_keep_every_window_and_bring_equal_ones_together():
    hashes = suffix.ByteHash(1), suffix.ByteHash(2)
    texts = [(prose(40, i) + PASSAGE + prose(40, 50 + i)).encode() for i in range(6)]
    owner, first, n, key, _ = suffix.runs(texts, 200, *hashes)
    lo = hi = None
    for _ in range(9):
        pieces = [texts[o][f:f + c + 199] for o, f, c in zip(owner, first, n)]
        key, content, of, first, n, lo, hi = suffix.halves(pieces, first, key, lo, hi, 200, *hashes)
        owner = owner[of]
        windows = sorted((o, s) for o, f, c in zip(owner, first, n) for s in range(f, f + c))
        assert windows == [(o, s) for o, t in enumerate(texts) for s in range(len(t) - 199)]
        at = {}
        for o, f, c, k, a, b in zip(owner, first, n, key, lo, hi):
            for s in range(f, f + c):
                assert s <= a and b <= s + 200
                at.setdefault(texts[o][s:s + 200], set()).add(k)
        assert all(len(keys) == 1 for keys in at.values())
    assert set(n) == {1} and set(hi - lo) == {200} and len(set(key)) == len(at)


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 50, 500)
    for width in (1, 3, 169):
        assert [*suffix.sliding_min(x, width)] == [x[i:i + width].min() for i in range(501 - width)]


def test_awkward_rows(awkward, empty):
    rows = suffix.suffix_query(awkward).collect()
    assert len(rows) == awkward.count()
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted([tuple(r) for r in rows], key=str) == want
    assert suffix.suffix_query(empty).collect() == []
