import numpy as np

from dnaframe.llm import langid
from tests.llm.conftest import prose


def brute_phrases(text, data):
    n = 0
    for a in range(0, len(text), langid.SEGMENT):
        part, i = text[a:a + langid.SEGMENT], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i:j + 1] in data:
                j += 1
            n, i = n + 1, j
    return n


def test_automaton_accepts_exactly_the_substrings():
    data = b"abracadabra_abrab"
    step, _, _ = langid.suffix_automaton(data)
    seen = set()

    def walk(state, path):
        seen.add(path)
        for c, to in step[state].items():
            walk(to, path + bytes([c]))

    walk(0, b"")
    assert seen == {data[i:j] for i in range(len(data)) for j in range(i, len(data) + 1)}


def test_phrases_match_brute_force():
    samples = {"x": langid.plain(prose(300, 1)), "y": b"zz top", "z": "ünï çödé".encode()}
    parser = langid.Parser(samples)
    texts = [langid.plain(prose(n, n)) for n in (1, 5, 700, 2000)] + [b"", b"a", bytes([200, 201]) + b"abc" + bytes([202])]
    want = np.array([[brute_phrases(t, samples[n]) for n in parser.langs] for t in texts])
    assert (parser.phrases(texts) == want).all()


def test_plain_text():
    assert langid.plain("Ab1c--D\n¿É“x”_y ") == "ab c d é x y".encode()
    assert langid.plain("12 $%") == b"" and langid.plain(None) == b"" and langid.plain("") == b""


LANGS = {"en": "the house is in the middle of our street and ", "de": "das haus steht mitten in unserer strasse und ",
         "fr": "la maison est au milieu de notre rue et "}


def corpus(n=60):
    import random

    rng = random.Random(2)
    return [(i, " ".join(rng.sample(LANGS[k].split() * 4, 24)), k) for i in range(n) for k in [list(LANGS)[i % 3]]]


def test_held_out_documents_are_recognised(make):
    import zlib

    rows = langid.langid_query(make(corpus(90))).collect()
    truth = {i: k for i, _, k in corpus(90)}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if r.held_out]
    assert len(test) > 15 and all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in test)


def test_labels_of_predicted_rows_are_no_input(make):
    a = {r.doc_id: r.lang_pred for r in langid.langid_query(make(corpus())).collect() if r.held_out}
    shuffled = [(i, t, k if i not in a else "fr") for i, t, k in corpus()]
    assert a == {r.doc_id: r.lang_pred for r in langid.langid_query(make(shuffled)).collect() if r.held_out}


def test_awkward_rows(awkward, empty, make):
    rows = langid.langid_query(awkward).collect()
    assert len(rows) == awkward.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3, 11))
    stay = langid.identified_documents(awkward)
    assert stay.schema.fieldNames() == awkward.columns
    assert {1, 2, 3, 11}.isdisjoint(r.doc_id for r in stay.collect()) and 8 in [r.doc_id for r in stay.collect()]
    assert langid.langid_query(empty).collect() == [] and langid.identified_documents(empty).collect() == []
    unlabelled = langid.langid_query(make([(1, "some text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_no_language_is_lost_by_size_or_repeats(make):
    long = {i: (LANGS["de"] * 1000)[:40_000] for i in range(1, 13)}
    repeated = LANGS["fr"] * 2
    rows = [(i, t, "de") for i, t in long.items()] + [(50, repeated, "fr")] * 30_000 + [(i, LANGS["en"] * 2, "en") for i in range(100, 130)]
    samples = langid.learn(make(rows))
    assert set(samples) == {"de", "en", "fr"} and all(0 < len(v) < 2 * 32_768 for v in samples.values())
    assert samples["fr"] == langid.plain(repeated)
    parser = langid.Parser(samples)
    assert [p[0] for p in parser.predict([langid.plain(LANGS[k]) for k in ("de", "fr", "en")])] == ["de", "fr", "en"]
