import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from dnaframe.llm import quality
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(1 for i, x in enumerate(lines) if x in lines[:i]), len(covered))


@pytest.mark.parametrize("text", ["", "a b c d e", "a b c d e a b c d e", "x y z \x1c é漢 😀 # $$", "a\n a\na\n\n \t\na", "a a a a a a a",
                                  prose(300) + "\n" + prose(300), "1 2 3 4 5 6 1 2 3 4 5 9 1 2 3 4 5"])
def test_base_counts_match_brute_force(text):
    assert quality.base_counts(text.encode()) == brute(text)


def test_distance_is_jensen_shannon():
    p, q = np.array([1.0, 0, 3]), np.array([2.0, 2, 0])
    a, b = p / p.sum(), q / q.sum()
    m = (a + b) / 2
    kl = lambda x: sum(v * math.log2(v / w) for v, w in zip(x, m) if v)
    assert quality.js_distance(p, q) == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2))
    assert quality.js_distance(p, p) == pytest.approx(0, abs=1e-7)
    assert quality.js_distance(p, np.zeros(3)) == 1


def test_references_count_the_whole_table(make):
    docs = make([(i, prose(100, i)) for i in range(20)] + [(99, None), (98, "x y", "fr")])
    classes, vocabulary, counts = quality.references(docs, common=5, least_reference=10)["en"]
    text = "".join(prose(100, i) for i in range(20))
    assert classes[quality.CLASSES.index("lower")] == sum(c.islower() for c in text)
    assert classes[quality.CLASSES.index("space")] == text.count(" ")
    words = Counter(w for i in range(20) for w in prose(100, i).split())
    assert sorted(counts[:-1]) == sorted(n for _, n in words.most_common(5)) and counts.sum() == 2000
    assert "fr" not in quality.references(docs, least_reference=10)
    with pytest.raises(ValueError):
        quality.references(docs, least_reference=1, most_langs=1)


def test_odd_documents_go_and_clean_ones_stay(make):
    clean = [(i, prose(150, i)) for i in range(30)]
    odd = [(100, " ".join(w + "$$$" for w in prose(150, 50).split())), (101, prose(150, 51).upper().replace(" ", "!! ")),
           (102, " ".join(f"q{i}zx" for i in range(150)))]
    kept = {r.doc_id: r.kept for r in quality.quality_query(make(clean + odd)).collect()}
    assert all(kept[i] for i, _ in clean) and not any(kept[i] for i, _ in odd)


def test_awkward_rows(awkward, empty):
    rows = quality.quality_query(awkward).collect()
    assert len(rows) == awkward.count()
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id not in (None, 9)}
    for r in rows:
        if r.doc_id in texts:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality.quality_query(empty).collect() == []


def test_texts_without_common_words_go(spark):
    """Judged by the references of a real table: wrong languages and random letters go, clean texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    found = quality.quality_query(docs).filter("kept and n_words >= 200").select("doc_id")
    clean = docs.join(found, "doc_id").orderBy("doc_id").collect()
    english, french = ([r.text for r in clean if r.lang == x][:10] for x in ("en", "fr"))
    # random letters of the same class: every word is strange, the class histogram is that of the text
    rng = random.Random(1)
    strange = [re.sub("[a-z]", lambda _: rng.choice("abcdefghijklmnopqrstuvwxyz"), t) for t in english]
    rows = [(10**6 + i, "en", t) for i, t in enumerate(strange + french)] + [(2 * 10**6 + i, "en", t) for i, t in enumerate(english)]
    rows += [(3 * 10**6 + i, None, t) for i, t in enumerate(french)] + [(4 * 10**6 + i, None, t) for i, t in enumerate(strange)]
    out = quality.quality_query(docs.unionByName(spark.createDataFrame(rows, docs.schema))).filter("doc_id >= 1000000").collect()
    wrong = [(r.doc_id, r.class_distance, r.word_distance, r.kept) for r in out if r.kept != (r.doc_id // 10**6 in (2, 3))]
    assert len(out) == 50 and not wrong
