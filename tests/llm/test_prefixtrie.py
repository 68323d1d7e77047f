"""Conversation trie against a brute-force walk over all beginnings."""

import hashlib
import random
import zlib

import pytest

from dnaframe.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, c string, d string, name string, pos string, least string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tok = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            talks.setdefault(c, []).append((turn is not None, turn or 0, tok, role, text))
    return {c: [(r, x) for *_, r, x in sorted(t)] for c, t in talks.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = talks.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(talks):
    members, ends = {}, {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), sum(not kids[q] for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, query=prefixtrie.trie_query):
    got = query(spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


def talk(n, seed=1, words=3, most=9):
    """Conversations that share beginnings: few different turns."""
    rng = random.Random(seed)
    return [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "ho ünï", "x" * 40][:words]))
            for c in rng.sample(range(3 * n), n) for t in range(rng.randint(1, most))]


def test_rebuilt_conversations_match_brute_force(spark):
    rows = talk(230)
    random.Random(2).shuffle(rows)
    assert run(spark, rows) == brute(rebuilt(ordered(rows)))


@pytest.mark.parametrize("deepest", [1, 2, 3, 8, 33])
def test_every_depth(spark, deepest):
    rows = talk(25, deepest, 2, deepest) + [(1000 + c, t, "u", "hi") for c in range(3) for t in range(deepest)]
    assert run(spark, rows, prefixtrie.conversation_trie) == brute(ordered(rows))


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "lost"), (200, None, "user", "first"), (200, 0, None, None), (200, 0, None, None), (200, 5, "", "ü漢"),
            (200, 5, "ü", "漢"), (205, 1, "user", "first"), (206, 2, "user", "first"), (301, 0, "user", "x" * 50_000),
            (302, 0, "user", "x" * 50_000), (303, -7, "a", "b"), (303, 3, "a", None), (307, 10**15, "a", "b"), (-3, 0, "a", "b")]
    rows += [(c, 0, "user", "first") for c in range(207, 240)]  # short ones: some are left without a turn
    talks = ordered(rows)
    expect = brute({c: t for c, t in rebuilt(talks).items()} | {-3: (talks.get(0, [])[:zlib.crc32(b"-3") % 6] + talks[-3][zlib.crc32(b"-3") % 6:])})
    assert run(spark, rows) == expect
    assert any(r[1] == 0 and r[3] == len(talks) for r in expect)


def test_a_long_conversation_and_a_crowded_beginning(spark):
    rows = [(700, t, "u", str(t % 7)) for t in range(700)] + [(701, t, "u", str(t % 7)) for t in range(650)]
    rows += [(c, 0, "u", "0") for c in range(2000, 3500)]
    got = run(spark, rows, prefixtrie.conversation_trie)
    n = {(r[0], r[1]): r for r in got}
    assert len(got) == 701
    ids = ",".join(map(str, range(2000, 3500)))
    assert n[700, 1] == (700, 1, 700, 1502, 1, 1, 1501 + 649, hashlib.sha256(ids.encode()).hexdigest())
    assert n[700, 0][3:7] == (1502, 1, 1, 1501 + 649)
    assert n[700, 650][3:7] == (2, 1, 1, 1) and n[700, 650][7] == hashlib.sha256(b"701").hexdigest()


def test_empty_table(spark):
    assert run(spark, []) == []
