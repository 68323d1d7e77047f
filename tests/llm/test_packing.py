import random

from dnaframe.llm import packing
from tests.llm.conftest import prose


def naive(items, capacity):
    bins, out = [], []
    for words, source, cluster in items:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= words and (source is None or source not in b[1])
                and (cluster is None or cluster not in b[2])]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        bins[i][0] -= words
        bins[i][1].add(source)
        bins[i][2].add(cluster)
        out.append(i)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(60):
        items = [(rng.randint(1, 100), rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 3])) for _ in range(120)]
        assert packing.best_fit(items, 100) == naive(items, 100)


def test_bins_hold_no_conflict_and_every_word(make):
    rows = [(i, prose(5 + 37 * i % 900, i % 40), "en", "abcdefgh"[i % 8] if i % 3 else "hot") for i in range(200)] + [(999, prose(5000, 7))]
    docs = make(rows)
    out = packing.packed_documents(docs, capacity=1000, bins=4).toPandas()
    for _, b in out.groupby(["shard", "bin"]):
        assert b.words.sum() <= 1000 and b.source.is_unique
        assert [*b.sort_values("start").start] == [*(b.sort_values("start").words.cumsum() - b.sort_values("start").words)]
        texts = [packing_key(t) for t in b.text]
        assert len(set(texts)) == len(texts)
    assert (out.text.str.split().str.len() == out.words).all()
    again = {i: " ".join(g.sort_values("piece").text) for i, g in out.groupby("doc_id")}
    assert {i: t.split() for i, t in again.items()} == {i: t.split() for i, t, *_ in rows}


def packing_key(text):
    return " ".join(text.lower().split())


def test_awkward_rows(awkward, empty):
    out = packing.packing_query(awkward).toPandas()
    pieces = packing.packed_documents(awkward).toPandas()
    assert len(out) == len(pieces)
    assert out.words.sum() == pieces.words.sum() == sum(len((r.text or "").split()) for r in awkward.collect())
    assert out[out.doc_id.isin([1, 2, 3])].bin.isna().all() and out[out.words > 0].bin.notna().all()
    assert (out.doc_id == 5).sum() == 2
    assert packing.packing_query(empty).collect() == [] and packing.packed_documents(empty).collect() == []


def near(text, n, seed):
    """``text`` with its last ``n`` words replaced."""
    return " ".join(text.split()[:-n] + prose(n, seed).split())


def test_near_copies_are_one_cluster(make):
    base = [prose(300, 100 + i) for i in range(20)]
    rows = [(i, t, "en", None) for i, t in enumerate(base)] + [(100 + i, near(t, 15, 900 + i), "en", f"s{i}") for i, t in enumerate(base)]
    rows += [(200 + i, near(t, 250, 700 + i), "en", f"t{i}") for i, t in enumerate(base)] + [(300, "four words are here", "en", None)]
    out = packing.packing_query(make(rows)).toPandas().set_index("doc_id")
    place = {i: (r.shard, r.bin) for i, r in out.iterrows()}
    assert all(place[i] != place[100 + i] for i in range(20))
    docs = packing.by_content(make(rows))
    sizes = packing.measured(docs, packing.F.col("doc.source"), packing.text_cluster(packing.F.col("doc.text")), packing.F.col("doc.text"))
    found = {r.id: r.cluster for r in packing.clustered(sizes, docs, packing.F.col("doc.text"), False).collect()}
    assert all(found[i] == found[100 + i] != found[200 + i] for i in range(20)) and len(set(found.values())) == 41


def test_uses_of_one_id_share_no_bin(make):
    rows = [(i % 10, prose(40, i), "en", None) for i in range(60)]
    out = packing.packed_documents(make(rows)).toPandas()
    assert len(out) == 60 and not out.duplicated(["shard", "bin", "doc_id"]).any()


def test_minima_estimate_the_similarity():
    a, b = prose(400, 1), near(prose(400, 1), 40, 2)
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in (a, b)]
    sig = packing.minima([b"", a.encode(), b"one", b.encode(), a.encode(), b" "])
    assert abs((sig[1] == sig[3]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.2
    assert (sig[1] == sig[4]).all() and (sig[1] != sig[2]).any() and not sig[0].any() and not sig[5].any()


def rare(n, seed, kinds=5000):
    """Words that unrelated texts hardly share."""
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def grouped(make, texts, block):
    """The groups that links between ``texts`` form, as sets of places."""
    docs = packing.by_content(make([(i, t) for i, t in enumerate(texts)]))
    named = docs.select("id", packing.text_cluster(packing.F.col("doc.text")).alias("cluster"), packing.F.lower("doc.text").alias("text"))
    at = {r.cluster: r.id for r in named.collect()}
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in packing.near_copies(named, block).collect():
        root[top(at[r.a])] = top(at[r.b])
    out = {}
    for i in range(len(texts)):
        out.setdefault(top(i), set()).add(i)
    return sorted(sorted(g) for g in out.values())


def jaccard(a, b):
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_a_shared_boilerplate_makes_no_cluster(make):
    common = rare(150, 1)
    texts = [f"{common} {rare(150, 10 + i)}" for i in range(400)]  # similarity about a third
    assert grouped(make, texts, packing.BLOCK) == [[i] for i in range(400)]


def test_links_in_a_crowded_bucket_need_no_third_text(make):
    """Chains whose middle is near both ends, near copies among boilerplate, in blocks of every size."""
    common = rare(60, 2)
    texts = []
    for g in range(25):
        words = f"{common} {rare(240, 500 + g)}".split()
        left, right = list(words), list(words)
        left[70:84] = rare(14, 3000 + g).split()
        right[200:214] = rare(14, 4000 + g).split()
        texts += [" ".join(left), " ".join(words), " ".join(right)]
    near = [(i, j) for i in range(75) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert len(near) == 50  # both ends of each chain are near its middle, not near each other
    for block in (packing.BLOCK, 7):
        assert grouped(make, texts, block) == [[3 * g, 3 * g + 1, 3 * g + 2] for g in range(25)]


def test_every_near_pair_of_a_large_group_meets(make):
    base = rare(300, 7).split()
    rng = random.Random(8)
    texts = []
    for _ in range(120):
        words = list(base)
        for p in rng.sample(range(300), 5):
            words[p] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    assert [len(g) for g in grouped(make, texts, 16)] == [120]


def test_minima_hold_a_part_of_a_batch_in_words():
    import tracemalloc

    import pyarrow as pa

    texts = [None, "", " \n", *(prose(1000, i) for i in range(1200)), prose(9)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    names = 0
    tracemalloc.start()
    for out in packing._minima(iter([batch])):
        names += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == 1201 and peak < 64 << 20, (names, peak)
