"""(5) Language ID by cross-parsing entropy.

Per language, a suffix automaton of labelled text answers how long the next stretch of a document
is that occurs in that text. Cutting a document greedily into such longest matches gives its
phrases; a language's cost is phrases * log2(labelled bytes) / bytes of the document, an estimate
of the cross entropy in bits per byte, and the cheapest language wins (ties: the smaller name).

Labelled text is a bounded sample: distinct documents in the order of a hash of their id and text,
until ``sample`` bytes per language are reached; a document longer than that gives its first ``sample`` bytes. Documents are always parsed whole, in segments of
``SEGMENT`` bytes that run side by side; a phrase ends with its segment.

The alphabet is the bytes of lower-cased text in which every run of other characters than letters
is one space. Null texts and texts without a letter get ``und`` and score 0. ``score`` is the gap
between the best and the second-best cost relative to the latter, 1 if only one language was
learned. Rows are predicted one by one: repeated rows give repeated results, an empty table an
empty one, and without any labelled text every row is ``und``. Rows without an id are predicted, but
never learned from. Only the named columns are read.
More than ``most_langs`` languages are an error, so the broadcast automata have at most
most_langs * 4 * sample states with a column per byte that occurs (256 at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 2048
#: Documents of a language that its sample may take; their text ends it far earlier.
CANDIDATES = 256
#: ASCII letters stay, other ASCII becomes a space, later bytes are judged by character.
_ASCII = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower-case letters with single spaces between the words; empty if there is no letter."""
    if not text:
        return b""
    low = text.lower()
    if not low.isascii():
        for c in set(low):
            if not c.isascii() and not c.isalpha():
                low = low.replace(c, " ")
    return b" ".join(low.encode("utf-8", "replace").translate(_ASCII).split())


def suffix_automaton(data: bytes) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Transitions, suffix links and longest lengths of the automaton of all substrings of ``data``."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in data:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step, link, length


class Parser:
    """The automata of all languages as one table: row = state, column = byte that occurs in training.

    A cell holds 4 * (place of the next state's row) + the phrases that end in this step. Where the
    automaton has no transition, the phrase ends before the byte and the next one begins with it;
    a byte that the language lacks is a phrase of its own.
    """

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.langs = sorted(samples)
        seen = sorted(set().union(*map(set, samples.values()))) if samples else []
        self.code = np.full(256, len(seen), np.int32)  # the last column: bytes that no language has
        self.code[seen] = np.arange(len(seen))
        width = len(seen) + 1
        automata = [suffix_automaton(samples[name])[0] for name in self.langs]
        states = sum(map(len, automata))
        kind = np.int32 if 4 * states * width < 2**31 else np.int64
        table, roots, at = np.empty((states, width), kind), [], 0
        for step in automata:
            part = table[at: at + len(step)]
            first = np.full(width, -1, np.int64)
            first[self.code[list(step[0])]] = np.fromiter(step[0].values(), np.int64, len(step[0]))
            lost = first < 0
            again = 4 * width * (at + np.where(lost, 0, first)) + lost
            part[0], part[1:] = again, again + 1
            for s, out in enumerate(step):
                if out:
                    part[s, self.code[list(out)]] = 4 * width * (np.fromiter(out.values(), np.int64, len(out)) + at)
            roots.append(at * width)
            at += len(step)
        self.table, self.roots = table.ravel(), np.array(roots, kind)[:, None]
        self.bits = np.array([np.log2(max(2, len(samples[n]))) for n in self.langs])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases, texts x languages, all segments of all texts stepping together."""
        lengths = np.array([len(t) for t in texts], np.int64)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not len(owner) or not self.langs:
            return out
        data = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(lengths) - lengths, pieces) + nth * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(lengths, pieces) - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # segments that reach a step
        state = np.repeat(self.roots, len(owner), 1)
        cuts = np.zeros(state.shape, np.int32)
        for i in range(size[0]):
            n = live[i]
            cell = self.table.take(state[:, :n] + data[start[:n] + i], mode="clip")
            cuts[:, :n] += cell & 3
            np.right_shift(cell, 2, out=state[:, :n])
        cuts += state != self.roots
        np.add.at(out, owner, cuts.T)
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, float, float]]:
        """Language, score, cost (bits per byte) and phrases per byte of each text."""
        phrases = self.phrases(texts)
        found = phrases * self.bits
        out = []
        for text, row, n in zip(texts, found, phrases):
            if not text or not self.langs:
                out.append(("und", 0.0, None, None))
                continue
            cost = row / len(text)
            best = int(np.argmin(cost))
            rest = np.delete(cost, best)
            score = 1.0 if not len(rest) else float((rest.min() - cost[best]) / rest.min()) if rest.min() else 0.0
            out.append((self.langs[best], min(1.0, max(0.0, score)), float(cost[best]), float(n[best]) / len(text)))
        return out


def learn(labelled: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", sample: int = 32_768,
          most_langs: int = 64) -> dict[str, bytes]:
    """Per language, the plain text of the sampled documents.

    The first documents by hash are taken until ``sample`` bytes are reached, so a language has less
    than twice that. Longer documents give their first ``sample`` bytes and repeats count once, so no language
    is lost by the size of its documents or by repeats.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.octet_length(F.col(text)).alias("n"),
        F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text)), 1).alias("h"))
    rows = rows.filter(F.col("n") > 0)
    # about four times the candidates that are used pass a hash limit per language, so that what meets
    # in the sort below does not grow with the table; repeats share a hash, so the limit counts hashes,
    # and the smallest one always passes
    docs = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("docs"), F.min("h").alias("least"))
    docs = docs.limit(most_langs + 1).collect()
    if len(docs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not docs:
        return {}
    limit = F.map_from_arrays(F.array(*[F.lit(r.lang) for r in docs]),
                              F.array(*[F.lit(max(r.least, min(2**63 - 1, 2**63 * 4 * CANDIDATES // max(1, r.docs)))) for r in docs]))
    rows = rows.filter(F.col("h") <= F.element_at(limit, F.col("lang"))).select(
        "lang", "h", F.substring("text", 1, sample).alias("text"))
    # repeats meet before the sort
    rows = rows.groupBy("lang", "h").agg(F.first("text").alias("text")).withColumn("n", F.octet_length("text"))
    first = Window.partitionBy("lang").orderBy("h", "n")
    picked = (rows.select("lang", "h", "n", "text").withColumn("place", F.row_number().over(first))
              .filter(F.col("place") <= CANDIDATES))
    before = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    picked = picked.withColumn("had", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("had") < sample)
    out: dict[str, list[bytes]] = {}
    for r in sorted(picked.select("lang", "place", "text").collect(), key=lambda r: (r.lang, r.place)):
        out.setdefault(r.lang, []).append(plain(r.text)[:sample].decode("utf-8", "ignore").encode())
    return {k: v for k, v in ((k, b" ".join(x for x in v if x)) for k, v in out.items()) if v}


def _predict(shared):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        for batch in rows:
            texts = [plain(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            found = []
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (size < 4 << 20):
                    size += len(texts[upto])
                    upto += 1
                found += parser.predict(texts[at:upto])
                at = upto
            lang, score, cost, rate = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns - 1)]
                + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64()),
                   pa.array(rate, pa.float64())], names=batch.schema.names[:-1] + ["lang_pred", "score", "cost", "phrases_per_byte"])

    return run


def identify(docs: DataFrame, samples: dict[str, bytes], key: str | Column = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, cost, phrases_per_byte of every row; ``key`` may be a struct column that carries the row."""
    key = F.col(key) if isinstance(key, str) else key
    rows = docs.select(key, F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Parser(samples))
    kind = rows.schema[0]
    return rows.mapInArrow(_predict(shared), f"`{kind.name}` {kind.dataType.simpleString()}, lang_pred string, score double, cost double, phrases_per_byte double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def langid_query(docs: DataFrame) -> DataFrame:
    """The contract's columns and the cost for every document."""
    samples = learn(docs.filter(~held_out()))
    found = identify(docs, samples)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "cost")


def identified_documents(docs: DataFrame, most_phrases: float = 0.6) -> DataFrame:
    """``docs`` without those in no learned language: no letter, or more than ``most_phrases`` phrases per
    byte, so that even the best language's text shares next to nothing with them."""
    samples = learn(docs.filter(~held_out()))
    found = identify(docs, samples, F.struct("*").alias("doc"))
    return found.filter((F.col("lang_pred") != "und") & (F.col("phrases_per_byte") <= most_phrases)).select("doc.*")
