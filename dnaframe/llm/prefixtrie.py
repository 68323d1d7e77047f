"""(12) Prefix trie of conversations by van Emde Boas recursion.

Every conversation is a sequence of turns; a node of the trie is a distinct beginning of such sequences.
The trie of height 2**m is cut at half its depth: beginnings of half the length are named, the upper half is
a trie of the halves, and every name is the root of a lower trie of the rests. Both are cut again in the same
step, so after m steps each trie is one turn high, and its edges are the nodes. In Spark:

* ``blocks`` (upward) names the aligned runs of 1, 2, 4, ... turns, each from its two halves;
* ``beginnings`` (downward) takes the tries of all blocks of one size apart at once: the first half stays in
  its trie, the second goes to the trie named by the cut beginning. Every step is one join of the blocks,
  half as many rows as the step after it;
* ``subtree_sums`` grafts totals upward: the totals of lower tries, one row per root, are added to the nodes
  of the upper half that lead to their root, and to the total of the trie that holds both.

So a trie of depth D takes some 4 * log2(D) small jobs instead of D rounds, no conversation is ever one row or one
task's group, and no list of a node's members is made. Names are SHA-256 of the turns' contents, so equal
beginnings get equal names wherever they are computed. Digests of a node's members are made from
sorted pieces of ids that stream through a task.

Turns are ordered by ``turn`` (null first), equal ones by a hash of role and text; a null role or text is
empty. A repeated row is a turn of its own. Rows without a conversation id take no part. A conversation
without a turn is a member of the root alone. No conversations give no rows, not even the root. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnaframe.llm.common import kept, offsets

ROOT = hashlib.sha256(b"").digest()


def _name(level: int, *parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(bytearray([level])), *parts), 256))


def turns_in_order(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, pos (from 1), tok (name of role and text), cp (code points of the text) of every turn."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    tok = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = talks.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), tok.alias("tok"), F.length(text).cast("long").alias("cp"),
        F.lit(1).cast("long").alias("one"))
    # places are counted within stretches of turn numbers, then added up: a long conversation is no single group
    piece = F.coalesce(F.shiftright(F.floor("turn").cast("long"), 12), F.lit(-(2**63)).cast("long"))
    placed = offsets(kept(rows.withColumn("piece", piece), "trie-turns"), ["c"], "piece", ["turn", "tok"], "one", "before")
    return placed.select("c", (F.col("before") + 1).alias("pos"), "tok", "cp")


def blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """By level j: (c, i, name) of every whole run of 2**j turns, from i * 2**j on."""
    found = [turns.select("c", (F.col("d") - 1).alias("i"), F.col("tok").alias("name"))]
    for j in range(1, levels):
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = found[-1].groupBy("c", F.shiftright("i", 1).alias("k")).agg(half(0).alias("l"), half(1).alias("r"))
        whole = pairs.filter("l is not null and r is not null").select("c", F.col("k").alias("i"), _name(j, F.col("l"), F.col("r")).alias("name"))
        found.append(kept(whole, f"trie-blocks-{j}"))
    return found


def beginnings(convs: DataFrame, runs: list[DataFrame]) -> list[DataFrame]:
    """By level j: (c, i, name) with the name of the first i * 2**j turns, for every block that begins within ``c`` or at its end."""
    levels = len(runs)
    down = [convs.select("c", F.lit(0).cast("long").alias("i"), F.lit(bytearray(ROOT)).alias("name"))]
    for j in reversed(range(levels)):
        first = runs[j].filter("i % 2 = 0").select("c", F.shiftright("i", 1).alias("i"), F.col("name").alias("half"))
        cut = down[-1].join(first, ["c", "i"], "left")
        lower = F.when(F.col("half").isNotNull(), F.struct((2 * F.col("i") + 1).alias("i"), _name(j, F.col("name"), F.col("half")).alias("name")))
        both = F.array(F.struct((2 * F.col("i")).alias("i"), "name"), lower)
        down.append(kept(cut.select("c", F.explode(both).alias("x")).filter("x is not null").select("c", "x.i", "x.name"), f"trie-cut-{j}"))
    return down[::-1]


def subtree_sums(nodes: DataFrame, paths: DataFrame, starts: list[DataFrame], values: list[str]) -> DataFrame:
    """name and, for each of ``values``, its sum over the node's subtree.

    ``nodes``: name, parent, least, d and the values; ``paths``: (c, d, name) of every beginning of every
    sequence; ``starts``: as ``beginnings`` gives them. The path of a node is that of its smallest member.
    """
    add = [F.sum(v).alias(v) for v in values]
    # totals of the tries one turn high: the children of their root
    totals = kept(nodes.filter("d > 0").groupBy(F.col("parent").alias("name"), (F.col("d") - 1).alias("d")).agg(*add), "trie-totals-0")
    parts = [nodes.select("name", *values)]
    for j in range(1, len(starts)):
        high, half = 1 << j, 1 << (j - 1)
        cut = totals.filter(F.col("d") % high == half).join(nodes.select("name", "least"), "name").select(
            F.col("least").alias("c"), F.shiftright("d", j).alias("i"), *values)
        cut = kept(cut, f"trie-grafts-{j}")
        upper = paths.filter((F.col("d") > 0) & ((F.col("d") - 1) % high < half)).select("c", F.shiftright(F.col("d") - 1, j).alias("i"), "name")
        parts.append(upper.join(cut, ["c", "i"]).groupBy("name").agg(*add))
        roots = starts[j].join(cut, ["c", "i"]).select("name", (F.col("i") * high).alias("d"), *values)
        totals = kept(totals.filter(F.col("d") % high == 0).unionByName(roots).groupBy("name", "d").agg(*add), f"trie-totals-{j}")
    parts.append(totals.filter("d = 0").select("name", *values))
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(*add)


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, sha of the comma-joined pieces of every name; rows come sorted, a name's state goes on over batches."""
    at = state = None
    for b in rows:
        out = []
        for name, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if name != at:
                if state:
                    out.append((at, state.hexdigest()))
                at, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist([{"name": n, "sha": s} for n, s in out], pa.schema([("name", pa.binary()), ("sha", pa.string())]))
    if state:
        yield pa.RecordBatch.from_pylist([{"name": at, "sha": state.hexdigest()}], pa.schema([("name", pa.binary()), ("sha", pa.string())]))


def member_digests(ends: DataFrame) -> DataFrame:
    """name, sha: SHA-256 of the ascending ids ``c`` of every name, comma-joined.

    Ids are sorted and joined within stretches of 256 numbers; a name's pieces stream in order through one
    task, which holds nothing but the state of the digest (SHA-256 can't be taken apart further).
    """
    pieces = ends.groupBy("name", F.shiftright("c", 8).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    return (pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids")
            .mapInArrow(_digests, "name binary, sha string"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``turns``: (c, d, tok, cp), d from 1 without gaps; ``convs``: (c, len), one row per conversation.
    """
    deepest, count, least = convs.agg(F.max("len"), F.count("*"), F.min("c")).first()
    runs = blocks(turns, (deepest or 0).bit_length())
    starts = beginnings(convs, runs[: (deepest or 0).bit_length()])
    names = starts[0].withColumnRenamed("i", "d")
    above = names.select("c", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    paths = kept(turns.select("c", "d", "cp").join(names, ["c", "d"]).join(above, ["c", "d"]), "trie-paths")
    none = F.lit(None)
    top = convs.sparkSession.range(1 if count else 0).select(
        F.lit(bytearray(ROOT)).alias("name"), none.cast("binary").alias("parent"), F.lit(0).cast("long").alias("d"),
        F.lit(0).cast("long").alias("cp"), F.lit(least).cast("long").alias("least"), F.lit(count).cast("long").alias("n"))
    nodes = kept(paths.groupBy("name", "parent", "d", "cp").agg(F.min("c").alias("least"), F.count("*").alias("n")).unionByName(top), "trie-nodes")
    kids = nodes.filter("d > 0").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("kids"))
    nodes = nodes.join(kids, "name", "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long")))
    nodes = kept(nodes.withColumn("saved", (F.col("n") - 1) * F.col("cp")).withColumn("leaves", (F.col("kids") == 0).cast("long")), "trie-kids")
    sums = subtree_sums(nodes, paths, starts, ["saved", "leaves"])
    ends = names.join(convs.select("c", F.col("len").alias("d")), ["c", "d"]).select("name", "c")
    digests = member_digests(ends)
    upper = nodes.select(F.col("name").alias("parent"), F.col("least").alias("parent_conv_id"))
    found = (nodes.drop("saved", "leaves").join(sums, "name").join(digests, "name", "left").join(upper, "parent", "left"))
    return found.select(F.col("least").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
                        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(talks: DataFrame, **columns) -> DataFrame:
    """The trie of conversations as they are."""
    turns = kept(turns_in_order(talks, **columns).withColumnRenamed("pos", "d"), "trie-order")
    return trie(turns, turns.groupBy("c").agg(F.max("d").alias("len")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) for ``trie``: the first h turns of conversation c - c % 100, then c's own after its first h; h = crc32(c) % 6.

    The remainder has the sign of c.
    """
    most = 5
    sizes = turns.groupBy("c").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)
    first = sizes.filter("c % 100 = 0").select(F.col("c").alias("base"), F.least("n", F.lit(most)).alias("there"))
    plan = sizes.withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % 100).join(first, "base", "left")
    plan = plan.withColumn("head", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    plan = kept(plan.withColumn("len", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("c", "base", "h", "head", "len"), "trie-plan")
    own = turns.join(plan, "c").filter("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("head")).alias("d"), "tok", "cp")
    lead = turns.filter(f"c % 100 = 0 and pos <= {most}").withColumnRenamed("c", "of")
    lead = plan.filter("head > 0").join(lead, (F.col("base") == F.col("of")) & (F.col("pos") <= F.col("head"))).select(
        "c", F.col("pos").alias("d"), "tok", "cp")
    return kept(own.unionByName(lead), "trie-rebuilt"), plan.select("c", "len")


def trie_query(talks: DataFrame) -> DataFrame:
    """The contract's columns for every node over the rebuilt conversations."""
    return trie(*rebuilt(kept(turns_in_order(talks), "trie-order")))


#: Nodes by their turns' hashes in a row; sums by the path of every node's smallest member.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok,
         length(coalesce(text, '')) AS cp, turn FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT c, tok, cp, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tok) AS pos FROM t
), convs AS (
  SELECT c, xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')],
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))),
         4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM placed)
), rows AS (
  SELECT convs.c, 0 AS part, pos, tok, cp FROM convs JOIN placed ON placed.c = convs.c - convs.c % 100 AND pos <= h
  UNION ALL SELECT c, 1, pos, tok, cp FROM convs JOIN placed USING (c) WHERE pos > h
), seqs AS (
  SELECT convs.c, coalesce(r.toks, []) AS toks, coalesce(r.cps, []) AS cps FROM convs LEFT JOIN (
    SELECT c, list(tok ORDER BY part, pos) AS toks, list(cp ORDER BY part, pos) AS cps FROM rows GROUP BY c) r USING (c)
), paths AS (
  SELECT c, d, array_to_string(toks[1:d], '') AS name, array_to_string(toks[1:d - 1], '') AS parent,
         CASE WHEN d = 0 THEN 0 ELSE cps[d] END AS cp, d = len(toks) AS last
  FROM (SELECT c, toks, cps, unnest(range(0, len(toks) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT name, d, any_value(CASE WHEN d = 0 THEN NULL ELSE parent END) AS parent, min(c) AS least, count(*) AS n,
         any_value(cp) AS cp, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends
  FROM paths GROUP BY name, d
), kids AS (
  SELECT parent AS name, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY parent
), valued AS (
  SELECT nodes.*, coalesce(kids, 0) AS kids, (n - 1) * cp AS saved, (kids IS NULL)::INTEGER AS leaf FROM nodes LEFT JOIN kids USING (name)
), sums AS (
  SELECT p.name, sum(v.saved) AS saved, sum(v.leaf) AS leaves FROM valued v JOIN paths p ON p.c = v.least AND p.d <= v.d GROUP BY p.name
)
SELECT v.least AS conv_id, v.d::BIGINT AS depth, u.least AS parent_conv_id, v.n AS n_convs, v.kids::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM valued v JOIN sums s USING (name) LEFT JOIN nodes u ON u.name = v.parent
"""
