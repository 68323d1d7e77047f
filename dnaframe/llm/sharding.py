"""(10) Sharding by balanced label propagation, law ``bytes``.

Documents of equal text are linked. Every linked document starts on a pseudorandom shard; in each
round Spark joins tell it how many bytes of its neighbours lie on each shard, and it asks to move to
the shard that holds most of them and still has room. A shard's quota is its room: askers are
admitted in a fixed order until their running total would go beyond it, so no shard ever exceeds
its share of bytes, and a group too large for one shard fills the next one. Rounds end when nobody
moves. Documents that lost their place to a share already exceeded, and all unlinked ones, then fill
what is missing to equal shares: those above 1/``fine`` of a share (at most ``fine`` per shard, a bound
that no table changes) one by one to the emptiest shard, all smaller ones in a fixed order, cut where
a share is full. Shards so differ by about the largest small document.

Size: UTF-8 bytes of the text plus 16. A null text has no bytes and checksum 0; null texts are not
linked, empty ones are linked to each other. Repeated rows are documents of their own, linked by
their text. Slots number a shard's documents without gaps from 0. An empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnaframe.llm.common import kept, offsets

#: Rows of a piece whose running totals are taken in one task.
PIECE = 20_000


def _table(values: dict[int, int], key: Column, default: int = 0) -> Column:
    """A small literal table (an entry per shard) looked up by ``key``."""
    if not values:
        return F.lit(default).cast("long")
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.lit(v).cast("long") for v in values.values()]))
    return F.coalesce(F.element_at(entries, key), F.lit(default).cast("long"))


def _pieces(n: int, groups: int) -> int:
    return max(1, -(-n // (PIECE * groups)))


def propagate(linked: DataFrame, shards: int, share: int, rounds: int = 64) -> DataFrame:
    """row, size, shard of the linked documents (row, size, link), shard null for those without a place."""
    state = kept(linked.withColumn("shard", F.pmod(F.xxhash64(F.lit("start"), "row"), F.lit(shards)).cast("int")), "label-start")
    n = state.count()
    pieces = _pieces(n, shards)
    piece = F.pmod(F.xxhash64(F.lit("piece"), "row"), F.lit(pieces))
    # whoever starts beyond a share has no place
    state = offsets(state.withColumn("piece", piece), ["shard"], "piece", ["row"], "size", "at")
    state = state.select("row", "size", "link", F.when(F.col("at") + F.col("size") <= share, F.col("shard")).alias("shard"))
    state = kept(state, "label-0")
    for i in range(rounds):
        load = {r[0]: r[1] for r in state.filter("shard is not null").groupBy("shard").agg(F.sum("size")).collect()}
        room = {s: share - load.get(s, 0) for s in range(shards)}
        votes = state.groupBy("link", "shard").agg(F.sum("size").alias("n"), F.min("size").alias("one")).filter("shard is not null")
        votes = votes.groupBy("link").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("votes"),
                                          F.max(F.when(_table(room, F.col("shard")) >= F.col("one"), F.struct("n", (-F.col("shard")).alias("s"))))
                                          .alias("best"))
        # stored, so that the join below has no aggregate in its stage and a large group can be split
        near = state.join(kept(votes, f"label-votes-{i}").hint("merge"), "link", "left")
        own = F.when(F.col("shard").isNotNull(), F.element_at("votes", F.col("shard"))).otherwise(F.lit(0))
        target = -F.col("best.s")
        wants = F.coalesce((F.col("best.n") > own) | ((F.col("best.n") == own) & (target < F.col("shard"))), F.lit(False)) & (
            F.col("shard").isNull() | (target != F.col("shard")))
        asked = kept(near.select("row", "size", "link", "shard", F.when(wants, target).alias("target")), f"label-ask-{i}")
        moves = asked.filter("target is not null").withColumn("piece", piece)
        moves = offsets(moves, ["target"], "piece", ["row"], "size", "at")
        moves = moves.select("row", "size", "link", F.when(F.col("at") + F.col("size") <= _table(room, F.col("target")), F.col("target"))
                             .otherwise(F.col("shard")).alias("shard"), (F.col("at") + F.col("size") <= _table(room, F.col("target"))).alias("moved"))
        stay = asked.filter("target is null").select("row", "size", "link", "shard", F.lit(False).alias("moved"))
        state = kept(stay.unionByName(moves), f"label-{i + 1}")
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("row", "size", "shard")


def fill(free: DataFrame, load: dict[int, int], shards: int, share: float, fine: int) -> DataFrame:
    """row, size, shard: every free document (row, size) on a shard, so that all come to ``share`` bytes."""
    spark = free.sparkSession
    least = share / fine
    left = [(-(share - load.get(s, 0)), s) for s in range(shards)]
    heapq.heapify(left)
    # more than share / fine bytes each and shards * share bytes in all: at most shards * fine rows
    placed = []
    for r in free.filter(F.col("size") > least).orderBy(F.desc("size"), "row").collect():
        room, s = heapq.heappop(left)
        placed.append((r["row"], r["size"], s))
        heapq.heappush(left, (room + r["size"], s))
    big = spark.createDataFrame(placed, "row long, size long, shard int")
    small = kept(free.filter(F.col("size") <= least), "label-small")
    n, total = small.agg(F.count("*"), F.sum("size")).first()
    room = {s: max(0.0, -r) for r, s in left}
    scale = (total or 0) / max(1e-9, sum(room.values()))
    ends, at = [], 0.0
    for s in range(shards):
        at += room[s] * scale
        ends.append(at)
    small = offsets(small.withColumn("piece", F.pmod(F.xxhash64(F.lit("fill"), "row"), F.lit(_pieces(n, 1)))), [], "piece", ["row"],
                    "size", "at")
    # the middle of a document decides: the shard in whose stretch it lies
    where = F.size(F.filter(F.array(*[F.lit(e) for e in ends[:-1]]).cast("array<double>"),
                            lambda e: e <= F.col("at") + F.col("size") / 2))
    return big.unionByName(small.select("row", "size", where.cast("int").alias("shard")))


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = 40, rounds: int = 64,
          fine: int = 1024) -> DataFrame:
    """id, size, text_crc32, shard, slot of every row."""
    body = F.col(text)
    rows = docs.select(F.col(id_col), (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
                       F.coalesce(F.crc32(body), F.lit(0).cast("long")).alias("text_crc32"), F.md5(body).alias("link"))
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    share = (total or 0) / shards
    groups = rows.filter("link is not null").groupBy("link").agg(F.count("*").alias("n")).filter("n > 1").select("link")
    linked = rows.join(kept(groups, "shard-groups").hint("merge"), "link", "left_semi").select("row", "size", "link")
    held = kept(propagate(linked, shards, int(share), rounds), "shard-linked")
    load = {r[0]: r[1] for r in held.filter("shard is not null").groupBy("shard").agg(F.sum("size")).collect()}
    alone = rows.select("row", "size").join(held.filter("shard is not null").select("row"), "row", "left_anti")
    placed = held.filter("shard is not null").unionByName(fill(alone, load, shards, share, fine))
    out = rows.drop("link").join(placed.drop("size"), "row").withColumn("one", F.lit(1))
    out = out.withColumn("piece", F.pmod(F.xxhash64(F.lit("slot"), "row"), F.lit(_pieces(n, shards))))
    out = offsets(out, ["shard"], "piece", ["row"], "one", "slot")
    return out.select(id_col, "size", "text_crc32", "shard", "slot")


def sharding_query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))
