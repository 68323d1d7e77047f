import random
import re
import string

import pytest

from dnaframe.llm import secrets
from tests.oracle_compare import rows_of

BASE = {"assign": (re.compile(secrets.ASSIGN), lambda m: len(m[2]) >= 6), "access": (re.compile(secrets.ACCESS), lambda m: len(m[0]) >= 20),
        "hex": (re.compile(secrets.HEX), lambda m: len(m[0]) >= 24)}


def brute_base(text):
    return sorted((m.start(), list(BASE).index(k), m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text or "") if ok(m))


def entropy(s):
    from math import log2

    return -sum(s.count(c) / len(s) * log2(s.count(c) / len(s)) for c in set(s))


def rnd(rng, n, alphabet=string.ascii_letters + string.digits + "+/"):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", "  ", "password=token: abcdef", "tokén token = 'abcdefg' AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 11,
           "x " + rnd(rng, 40) + " é " + rnd(rng, 24) + " y" + rnd(rng, 19), "550e8400-e29b-41d4-a716-446655440000 abcdefghijklmnopqrstuvwxyz0123456789",
           "Secret:" + rnd(rng, 300) + "zz", "  ".join(rnd(rng, 22) for _ in range(600)), "aa" * 30 + rnd(rng, 40) + "b" * 50,
           "API_KEY : \"" + rnd(rng, 33) + "\" apikey=12345 passwd'= \"x.y-z_1", "token=" * 50, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa 😀" + "0f" * 20]
    return out + [" ".join(rnd(rng, rng.randint(1, 30), "ab01") for _ in range(40)) for _ in range(10)]


def test_base_spans_match_brute_force(make, texts):
    found = secrets.find_secrets(make(list(enumerate(texts))), out="found").collect()
    for r in found:
        base = [(s.start, s.rank, s.end) for s in r.found if s.rank < 3]
        assert base == brute_base(r.text), r.doc_id


def test_entropy_spans_match_brute_force(make, texts):
    for r in secrets.find_secrets(make(list(enumerate(texts))), out="found").collect():
        base = [(s.start, s.end) for s in r.found if s.rank < 3]
        want = []
        for m in re.finditer(secrets.CANDIDATE, r.text or ""):
            if any(a <= m.start() and m.end() <= b for a, b in base) or any(re.search(p, m[0]) for p in secrets.ALLOW):
                continue
            limit = next(bits for _, p, bits in secrets.CLASSES if re.search(p, m[0]))
            hot = [i for i in range(len(m[0]) - 19) if entropy(m[0][i:i + 20]) >= limit]
            if hot:
                want.append((m.start() + hot[0], m.start() + hot[-1] + 20))
        assert [(s.start, s.end) for s in r.found if s.rank == 3] == want, r.doc_id


def judged_closely(run, base, start):
    """(first, end) of the hot windows of a run, each judged by its own characters as well; None if there are none."""
    if any(a <= start and start + len(run) <= b for a, b in base):
        return None
    limit = lambda w: next(bits for _, p, bits in secrets.CLASSES if re.search(p, w))
    plain = ""
    for part in re.findall(r"[-_/+]|[^-_/+]+", re.sub(secrets.UUID, "-" * 36, run)):
        plain += ("." if part in "-_/+" or any(re.search(p, part) for p in secrets.PLAIN) else "x") * len(part)
    whole = None if any(re.search(p, run) for p in secrets.ALLOW) else limit(run)
    hot = []
    for i in range(len(run) - 19):
        w = run[i: i + 20]
        bits = entropy(w)
        if whole is not None and bits >= whole or bits >= limit(w) and not re.search(secrets.PLACEHOLDER, w) and "x" in plain[i: i + 20]:
            hot.append(i)
    return (start + hot[0], start + hot[-1] + 20) if hot else None


def hidden(rng):
    """Texts with secrets beside names, paths and placeholders, and texts without a secret."""
    hexes = [rnd(rng, n, "0123456789ABCDEF") for n in (24, 32, 40)] * 8
    mixed = [rnd(rng, n, string.ascii_letters + string.digits) for n in (20, 24, 40)] * 8
    return ([f"a key_{x} b" for x in hexes] + [f"io/example/{x}" for x in mixed] + [f"{x}-sample-{y}" for x, y in zip(mixed, hexes)],
            ["see docs/getting-started/installation_guide now", "id/550e8400-e29b-41d4-a716-446655440000/550e8400-e29b-41d4-a716-446655440001/x",
             "abcdefghijklmnopqrstuvwxyz0123456789", "readTheWholeFileFromTheDisk", "your-placeholder-token-here-please"])


def test_query_spans_match_brute_force(make, texts):
    secret, calm = hidden(random.Random(9))
    rows = list(enumerate([*texts, *secret, *calm]))
    found = {r.doc_id: r.spans for r in secrets.secrets_query(make(rows)).collect()}
    for i, text in rows:
        base = [(a, b) for a, _, b in brute_base(text)]
        want = [s for m in re.finditer(secrets.CANDIDATE, text or "") if (s := judged_closely(m[0], base, m.start()))]
        assert [tuple(map(int, s.split(":")[1:])) for s in found[i].split(",") if s.startswith("entropy")] == want, text
    n = len(texts)
    assert all("entropy" in found[n + i] for i in range(len(secret)))
    assert not any(found[n + len(secret) + i] for i in range(len(calm)))


def test_query_matches_duckdb(spark, make, texts, tmpdir_path):
    import duckdb

    path = f"{tmpdir_path}/documents.parquet"
    make(list(enumerate([*texts, *sum(hidden(random.Random(9)), [])]))).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(secrets.ORACLE_SQL)
    rows = secrets.secrets_query(spark.read.parquet(path))
    assert rows_of(rows.columns, [tuple(r) for r in rows.collect()]) == rows_of([c[0] for c in want.description], want.fetchall())


def test_redaction_takes_the_spans_and_nothing_else(make):
    text = "keep this. password = 'abcdef123456' and AKIA" + "Z" * 16 + ", end é"
    out = secrets.redacted(make([(1, text), (2, "clean"), (3, None)])).collect()
    assert [r.text for r in out] == ["keep this. <secret>' and <secret>, end é", "clean", None]
    assert out[0].n_chars == len(out[0].text) and out[1].n_chars == 5


def test_awkward_rows(awkward, empty):
    out = secrets.redacted(awkward)
    assert out.schema.fieldNames() == awkward.columns and out.count() == awkward.count()
    assert len(secrets.secrets_query(awkward).collect()) == awkward.count()
    assert secrets.secrets_query(empty).collect() == [] and secrets.redacted(empty).collect() == []


def test_redaction_looks_at_each_window(make):
    rng = random.Random(8)
    both = string.ascii_letters
    secret = [rnd(rng, n, "0123456789ABCDEF") for n in (24, 32, 40)] + [rnd(rng, n, both + string.digits) for n in (24, 30, 40)] + [rnd(rng, 40, both)]
    texts = [f"a key_{x} b" for x in secret] + [f"a io/example/{x} b" for x in secret] + [f"a {x} b" for x in secret[3:]]
    # no secrets: words, a UUID, an alphabet, a name of words
    calm = ["see docs/getting-started/installation_guide now", "id/550e8400-e29b-41d4-a716-446655440000/x", "abcdefghijklmnopqrstuvwxyz0123456789",
            "readTheWholeFileFromTheDisk", "MAX_BUFFER_SIZE_IN_BYTES_FOR_ALL", "12345678901234567890123"]
    out = {r.doc_id: r.text for r in secrets.redacted(make(list(enumerate(texts + calm)))).collect()}
    hidden = secret * 2 + secret[3:]
    assert not [t for i, t in enumerate(texts) if hidden[i][:12] in out[i] or hidden[i][-12:] in out[i]]
    assert [out[len(texts) + i] for i in range(len(calm))] == calm
