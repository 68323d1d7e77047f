"""(8) LM scoring by cross-entropy difference.

Two n-gram models over bytes, so with one vocabulary of 256 tokens: the background model counts all
documents, the target model those marked as target. The background's probability of a byte after
the ``order`` - 1 bytes before it is smoothed with the uniform one, the target's with the
background's, so both know the same n-grams. A document's losses are the mean bits per byte under
each; ``score`` is target loss less background loss, lower for documents that look like the target.

Rows are numbered in a stored copy and dealt to chunks of about ``CHUNK`` bytes by a hash of the number, so
rows without an id, or of one id, spread over all chunks. Targets are found by a join of ids and numbers, without the texts. A chunk's distinct n-grams
with their counts are all that leaves it: summed over the chunks they are the model, which grows with
the corpus and is never gathered in one place; joined back, every chunk receives the losses of
its own n-grams and scores its documents. An n-gram of ``order`` <= 7 bytes is its own key, so no hash
can confuse two of them.

Every text is read whole, after ``order`` - 1 line ends that begin each document. Null and empty texts
have 0 tokens and null losses and score. A document is a target if any of its marks is; marks of
unknown ids count for nothing. Repeated rows count, and are scored, each. Without a target document
the target model is the background model, so scores are 0. Empty tables give empty results; only the
named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnaframe.llm.common import batches, kept

CHUNK, SLICE = 8 << 20, 2 << 20


def grams(texts: list[bytes], order: int) -> np.ndarray:
    """The n-gram that ends at each byte of the texts, one after the other, as whole numbers."""
    data = np.frombuffer(b"".join(b"\n" * (order - 1) + t for t in texts), np.uint8)
    out = np.zeros(max(0, len(data) - order + 1), np.int64)
    for j in range(order):
        out = (out << 8) | data[j: j + len(out)]
    size = np.array([len(t) for t in texts], np.int64)
    # between two texts lie order - 1 windows that end in the next one's line ends
    ends = np.cumsum(size + order - 1) - (order - 1)
    inside = np.ones(len(out), bool)
    for j in range(order - 1):
        cross = ends + j
        inside[cross[cross < len(out)]] = False
    return out[inside]


def _texts(column: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in column]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    gram, at = np.unique(keys, return_inverse=True)
    return gram, np.bincount(at, weights=n, minlength=len(gram)).astype(np.int64)


def _count(order: int):
    def run(key, docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        target = docs["row"].isin(set(marks["aim"])).to_numpy()
        texts = _texts(docs["text"])
        every = _summed([np.unique(grams(texts[a:b], order), return_counts=True) for a, b in batches(texts, SLICE)])
        chosen = [t for t, x in zip(texts, target) if x]
        aim = _summed([np.unique(grams(chosen[a:b], order), return_counts=True) for a, b in batches(chosen, SLICE)])
        wanted = np.zeros(len(every[0]), np.int64)
        wanted[np.searchsorted(every[0], aim[0])] = aim[1]
        return pd.DataFrame({"chunk": key[0], "gram": every[0], "n": every[1], "t": wanted})

    return run


def _score(order: int):
    def run(key, docs: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        model = model.sort_values("gram")
        known, target, background = (model[c].to_numpy() for c in ("gram", "target", "background"))
        texts = _texts(docs["text"])
        size = np.array([len(t) for t in texts], np.int64)
        sums = np.zeros((2, len(texts)))
        for a, b in batches(texts, SLICE):
            g = grams(texts[a:b], order)
            if not len(g):
                continue
            at = np.searchsorted(known, g)
            if at.max() >= len(known) or (known[at] != g).any():
                raise RuntimeError("a chunk lacks n-grams: its documents changed between two reads")
            owner = np.repeat(np.arange(a, b), size[a:b])
            for row, loss in zip(sums, (target, background)):
                row += np.bincount(owner, weights=loss[at], minlength=len(texts))
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(size > 0, sums / size, np.nan)
        out = pd.DataFrame({"id": docs["id"], "n_tokens": size, "loss_target": mean[0], "loss_background": mean[1],
                            "score": mean[0] - mean[1]})
        return out.astype(object).where(out.notna(), None)

    return run


def model(counts: DataFrame, prior: float = 1.0, trust: float = 8.0) -> DataFrame:
    """gram, target, background: both losses in bits of every n-gram of ``counts`` (gram, n, t)."""
    total = counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    total = total.withColumn("context", F.shiftrightunsigned("gram", 8))
    context = total.groupBy("context").agg(F.sum("n").alias("cn"), F.sum("t").alias("ct"))
    both = total.join(context, "context")
    background = (F.col("n") + F.lit(prior / 256)) / (F.col("cn") + F.lit(prior))
    both = both.withColumn("p", background)
    target = (F.col("t") + F.lit(trust) * F.col("p")) / (F.col("ct") + F.lit(trust))
    return both.select("gram", (-F.log2(target)).alias("target"), (-F.log2("p")).alias("background"))


def cross_entropy_difference(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = 5,
                             chunk: int = CHUNK, prior: float = 1.0, trust: float = 8.0) -> DataFrame:
    """id, n_tokens, loss_target, loss_background, score of every row; ``marks`` holds the target's ids."""
    if not 2 <= order <= 7:
        raise ValueError("order is 2 to 7")
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    chunks = max(1, -(-size // chunk))
    rows = kept(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"),
                            F.monotonically_increasing_id().alias("row")), "lm-rows")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "row"), F.lit(chunks)))
    wanted = marks.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    aims = rows.select("id", "row", "chunk").filter("id is not null").join(wanted, "id", "left_semi").select(
        F.col("row").alias("aim"), F.col("chunk").alias("part"))
    counted = kept(rows.groupBy("chunk").cogroup(aims.groupBy("part")).applyInPandas(
        _count(order), "chunk long, gram long, n long, t long"), "lm-counts")
    losses = counted.select("chunk", "gram").join(model(counted, prior, trust), "gram")
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.groupBy("chunk").cogroup(losses.groupBy("chunk")).applyInPandas(
        _score(order), f"id {kind}, n_tokens long, loss_target double, loss_background double, score double")
    return out.withColumnRenamed("id", id_col)


def lm_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's losses; the target are the documents labelled of good quality."""
    return cross_entropy_difference(docs.select("doc_id", "text"), labels.filter("quality = 1").select("doc_id"))
