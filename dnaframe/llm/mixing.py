"""(6) Mixing sources to target weights, with DataFrame functions only.

Every source's words, documents in a fixed pseudorandom order, form one stream that is cut into
blocks of ``block`` words (a source's last block may be short). The mix is a run of slots in
output shards. Each shard draws multinomial source counts; a source's slots are numbered through
all shards, the number modulo its blocks goes through the source's own pseudorandom permutation of
block indices, and slots join blocks by index. Totals of the draws that exceed a source's quota
are passed to sources that fell short, so every source ends at its quota to the block.

Targets: sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
words; none gets more than ``most`` times its own words, and the excess is shared again by weight,
which ends at target = min(most * words, level * weight) with one level for all.

Null and empty texts have size 0, are kept and take no part. Repeated rows,
and several rows of one doc_id, are documents of their own; equal ones are numbered.
Of ``docs`` only the id, source and text columns are read. The per-source tables have one row per
source and are made after aggregation; a hot source is spread over pieces of ``PIECE`` documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnaframe.llm.common import RUN, WORD, by_content, kept, let, n_words, offsets, one_of_each, row_hash, unrolled

#: Documents in a piece of a source's stream, slots in an output shard.
PIECE, SHARD = 2048, 1024
ROUNDS = 24


@dataclass
class Mix:
    sizes: DataFrame    # row, doc_id, h, copy, source, size: one row per document
    targets: DataFrame  # source, sid, source_size, target, blocks, quota
    parts: DataFrame    # row, sid, block, first, words: a document's words in a block
    slots: DataFrame    # shard, sid, rank, block, use


def _draw(*parts: Column) -> Column:
    """A non-negative pseudorandom long that depends on ``parts`` alone."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**63 - 1))


def targets(sizes: DataFrame, weights: list[int], share: float, most: float, block: int) -> DataFrame:
    """One row per source with its target words, blocks and quota of slots."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    t = per.withColumn("sid", F.row_number().over(order) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            (F.col("sid") % len(weights) + 1).cast("int")))
    t = t.withColumn("goal", F.lit(share) * F.sum("source_size").over(whole))
    # sources reach their cap in the order of cap / weight; the level lies where the caps of those
    # before and the weights of the rest add up to the goal
    t = t.withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "sid").rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("goal") - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before),
                                                          F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level")))
                     .over(whole)["level"])
    cap = F.lit(most) * F.col("source_size")
    t = t.withColumn("target", F.when(F.col("level").isNull(), cap).otherwise(
        F.least(cap, F.col("level") * F.col("weight"))))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    quota = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
    t = t.withColumn("quota", F.when(F.col("source_size") > 0, quota).otherwise(F.lit(0).cast("long")))
    return t.select("source", "sid", "source_size", "target", "blocks", "quota")


def _permuted(index: Column, n: Column, key: Column, seed: int) -> Column:
    """A permutation of 0 .. n-1 fixed by ``key``: rounds that swap an index with its mirror or not.

    In each round a key decides the mirror of every index, and the pair's larger index decides
    whether both change places; each round is its own inverse, so no two indices meet.
    """
    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(_draw(F.lit(seed), key, r) % n - x, n)
        swap = F.xxhash64(F.lit(seed + 1), key, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def _slots(t: DataFrame, seed: int) -> DataFrame:
    """shard, sid, rank: the slots of every output shard; a source's ranks run from 0 to quota - 1."""
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    t = t.filter("quota > 0").withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)).cast("long"))
    t = t.withColumn("total", F.sum("quota").over(Window.partitionBy()))
    # a uniform draw below the total falls on one quota slot, whose source it takes: multinomial counts
    slots = unrolled(t, "quota", "n").select((F.col("first") + F.col("n")).alias("slot"), "sid", "total")
    drawn = slots.select((F.col("slot") / F.lit(SHARD)).cast("long").alias("shard"),
                         (_draw(F.lit(seed), F.col("slot")) % F.col("total")).alias("at"))
    # rows made from the small table of targets look small to the planner: sort-merge, then stored
    counts = (drawn.join(slots.select(F.col("slot").alias("at"), "sid").hint("merge"), "at").groupBy("shard", "sid")
              .agg(F.count("*").alias("n")))
    counts = kept(counts, "mix-counts").withColumn("run", (F.col("shard") / F.lit(RUN)).cast("long"))
    counts = offsets(counts, ["sid"], "run", ["shard"], "n", "base")
    ranked = counts.select("shard", "sid", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("rank"))
    # draws beyond a quota, counted through all sources, fill the places that other sources lack
    totals = counts.groupBy("sid").agg(F.sum("n").alias("drawn"))
    gap = t.join(totals, "sid", "left").select("sid", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    gap = gap.withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)))
    gap = gap.withColumn("under", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    gap = gap.withColumn("over_at", F.coalesce(F.sum("over").over(before), F.lit(0)))
    gap = gap.withColumn("under_at", F.coalesce(F.sum("under").over(before), F.lit(0)))
    lacking = unrolled(gap.filter("under > 0"), "under", "n").select(
        (F.col("under_at") + F.col("n")).alias("spare"), F.col("sid").alias("to"), (F.col("drawn") + F.col("n")).alias("to_rank"))
    ranked = ranked.join(gap.select("sid", "quota", "over_at"), "sid")
    fits = ranked.filter("rank < quota").select("shard", "sid", "rank")
    moved = (ranked.filter("rank >= quota").withColumn("spare", F.col("over_at") + F.col("rank") - F.col("quota"))
             .join(lacking.hint("merge"), "spare").select("shard", F.col("to").alias("sid"), F.col("to_rank").alias("rank")))
    return fits.unionByName(moved)


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
        weights: list[int] | None = None, share: float = 1.5, most: float = 2.0, block: int = 128,
        seed: int = 42, name: str | None = None) -> Mix:
    """The mix of ``docs``: its sizes, targets, blocks and slots as tables.

    Rows are known by their id and ``name``, a hash of the row (default: of all columns of ``docs``).

    ``weights`` repeat over the sources (default 3, 1, 2). Reruns with one seed agree.
    """
    each = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"),
                       (row_hash(docs) if name is None else F.col(name)).alias("h"))
    each = each.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies"))
    sizes = kept(unrolled(each, "copies", "copy").drop("copies").withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    t = kept(targets(sizes, weights or [3, 1, 2], share, most, block), "mix-targets")
    pieces = max(1, -(-sizes.count() // PIECE))
    placed = (sizes.filter("size > 0").join(t.select(F.col("source").alias("s"), "sid"), F.col("source").eqNullSafe(F.col("s")))
              .select("row", "doc_id", "h", "copy", "sid", "size",
                      F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h", "copy"), F.lit(pieces)).alias("piece")))
    placed = offsets(placed, ["sid"], "piece", ["doc_id", "h", "copy"], "size", "at")
    cut = placed.withColumn("block", F.explode(F.sequence((F.col("at") / F.lit(block)).cast("long"),
                                                          ((F.col("at") + F.col("size") - 1) / F.lit(block)).cast("long"))))
    start = F.greatest(F.col("at"), F.col("block") * block)
    parts = cut.select("row", "sid", "block", (start - F.col("at")).alias("first"),
                       (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - start).alias("words"))
    slots = _slots(t, seed).join(t.select("sid", "blocks"), "sid")
    slots = slots.select("shard", "sid", "rank", _permuted(F.col("rank") % F.col("blocks"), F.col("blocks"), F.col("sid"), seed)
                         .alias("block"), (F.col("rank") / F.col("blocks")).cast("long").alias("use"))
    return Mix(sizes, t, parts, kept(slots, "mix-slots"))


def taken_words(m: Mix) -> DataFrame:
    """row, taken: the words the mix takes from a document, repeats counted (documents taken from only)."""
    times = m.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    return (m.parts.join(times, ["sid", "block"]).groupBy("row")
            .agg(F.sum(F.col("words") * F.col("times")).alias("taken")))


def mixing_query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    m = mix(docs.select("doc_id", "source", "text"))
    rows = m.sizes.join(taken_words(m), "row", "left")
    return (rows.join(m.targets.select(F.col("source").alias("s"), "source_size", "target"),
                      F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, in the columns of ``docs``: a row per use of a document.

    A use that takes every block of a document keeps its text as it is; one that takes a part has
    the taken words, in order, joined by spaces. Documents the mix takes nothing from, and those
    without a word, give no row. ``n_chars``, if there, is counted anew.
    """
    rows = by_content(docs)
    m = mix(rows.select("id", "h", "doc.source", "doc.text"), id_col="id", name="h", **options)
    uses = m.parts.join(m.slots.select("sid", "block", "use"), ["sid", "block"])
    uses = uses.groupBy("row", "use").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("runs"),
                                          F.sum("words").alias("taken"))
    uses = uses.join(m.sizes.select("row", F.col("doc_id").alias("use_id"), F.col("h").alias("use_h"), "size"), "row").drop("row")
    part = F.col("taken") < F.col("size")
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0))
    some = let(words, lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(
        w, (r["first"] + 1).cast("int"), r["words"].cast("int")))), " "))
    out = one_of_each(rows).join(uses, F.col("id").eqNullSafe(F.col("use_id")) & (F.col("h") == F.col("use_h"))).withColumn(
        "cut", F.when(part, some).otherwise(F.col("doc.text")))
    doc = F.col("doc").withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("cut").cast(docs.schema["n_chars"].dataType))
    return out.select(doc.alias("doc")).select("doc.*")
