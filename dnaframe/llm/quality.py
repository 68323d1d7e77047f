"""(1) Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with
its language's references by Jensen-Shannon distance (base 2, so 0 to 1). References are counted
over all documents with a language; a language's common words are its ``common`` most frequent
ones. Words that are not common match nothing: the document's have a slot of their own and the
reference's another, so a text without a common word has distance 1. The limit of the word distance
comes from the reference: the distance of a text that has the reference's own proportions among its
common words, but only ``least_common`` times their share. A document without a known language is compared
with every reference and judged by the nearest. Guards: a text of fewer than ``least_chars`` characters is
not judged by classes, one of fewer than ``least_words`` words not by words, as short texts have
ragged histograms. Words, lines and windows are told apart by 64-bit hashes of their bytes.

Defined results: null and empty texts have no words, fail the base rule and are not kept. Rows are
judged one by one, so repeated rows give repeated results; an empty table gives an empty one. Only
the named columns are read. A language with fewer than ``least_reference`` words has no reference;
its documents are compared with the nearest one. More than ``most_langs`` languages are an error:
the references, at most ``most_langs * (common + classes)`` numbers, go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnaframe.llm.common import ByteHash, batches, kept, mix64, word_bounds

# Fixed values of the contract's base rule.
SYMBOLS = b"#*$%&|<>"
#: The bytes of a character after its first.
LATER = bytes(range(128, 192))
#: Byte classes. A character beyond ASCII counts once, by its first byte.
CLASSES = ["lower", "upper", "digit", "space", "stop", "symbol", "other"]
STOPS = b".,;:!?'\"()-"


def class_table() -> np.ndarray:
    """The class of each byte; later bytes of a character have class len(CLASSES), which is not counted."""
    table = np.full(256, CLASSES.index("symbol"), np.uint8)
    table[128:] = CLASSES.index("other")
    table[128:192] = len(CLASSES)
    for name, chars in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                        ("digit", b"0123456789"), ("space", b" \t\n\v\f\r"), ("stop", STOPS)):
        table[list(chars)] = CLASSES.index(name)
    return table


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two histograms; 1 if one is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a = np.sum(p * np.log2(np.where(p > 0, p, 1) / np.where(p > 0, m, 1)))
    b = np.sum(q * np.log2(np.where(q > 0, q, 1) / np.where(q > 0, m, 1)))
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def hashes(hasher: ByteHash, data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 4 << 20) -> np.ndarray:
    """Hashes of the slices of a byte string, in order and apart, over about ``piece`` bytes at a time."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + piece, "right")))
        part = data[start[at]: end[to - 1]]
        out[at:to] = hasher.slices(hasher.sums(part), start[at:to] - start[at], end[at:to] - start[at])
        at = to
    return out


def repeated_words(words: np.ndarray, width: int = 5) -> int:
    """How many words (given by hash) lie in windows of ``width`` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    grams = np.zeros(n, np.uint64)
    for j in range(width):
        grams = mix64(grams + words[j: n + j] * np.uint64(2 * j + 1))
    _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(len(words), bool)
    for j in range(width):
        covered[j: n + j] |= again
    return int(covered.sum())


def base_counts(text: bytes, hasher: ByteHash | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    hasher = hasher or ByteHash(7)
    data = np.frombuffer(text, np.uint8)
    start, end = word_bounds(data)
    chars = len(text.translate(None, b" \t\n\v\f\r" + LATER))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    cut = np.flatnonzero(data == 10)
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(data)]))
    wordy = np.searchsorted(start, first) < np.searchsorted(start, last)  # a word starts in the line
    lines = hashes(hasher, data, first[wordy], last[wordy])
    return (len(start), chars, symbols, len(lines) - len(np.unique(lines)),
            repeated_words(hashes(hasher, data, start, end)))


def word_histograms(words: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both histograms (all other words last) with a slot each for the words that are not common."""
    return np.append(words, 0.0).astype(float), np.concatenate((reference[:-1], [0.0], reference[-1:])).astype(float)


def word_limit(reference: np.ndarray, least_common: float) -> float:
    """The distance of a text whose common words have the reference's proportions and ``least_common`` times their share."""
    thin = reference * least_common
    thin[-1] = reference.sum() - thin[:-1].sum()
    return js_distance(*word_histograms(thin, reference))


def _runs(batch: pa.RecordBatch, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _tally(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, key, n: the characters of each class (key: the class) and the words by hash of a batch."""
    hasher, table = ByteHash(7), class_table()
    for run in (r for batch in rows for r in _runs(batch)):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(run.column("lang").to_pylist(), run.column("text").cast(pa.binary()).to_pylist()):
            by_lang.setdefault(lang, []).append(text or b"")
        for lang, texts in by_lang.items():
            for a, b in batches(texts):
                data = np.frombuffer(b" ".join(texts[a:b]), np.uint8)
                start, end = word_bounds(data)
                key, n = np.unique(hashes(hasher, lowered(data), start, end), return_counts=True)
                classes = np.bincount(table[data], minlength=len(CLASSES) + 1)[: len(CLASSES)]
                classes[CLASSES.index("space")] -= b - a - 1
                for kind, ks, ns in (("class", np.arange(len(CLASSES)), classes), ("word", key.view(np.int64), n)):
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(ks), pa.string()), "kind": pa.array([kind] * len(ks), pa.string()),
                        "key": pa.array(ks.astype(np.int64)), "n": pa.array(ns.astype(np.int64))})


def references(docs: DataFrame, lang: str = "lang", text: str = "text", common: int = 200, most_langs: int = 256,
               least_reference: int = 500) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """lang: (class counts, hashes of its common words, their counts with that of all other words at the end).

    Words are told apart by a 64-bit hash of their ASCII-lower-cased bytes.
    """
    known = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    tally = (known.mapInArrow(_tally, "lang string, kind string, key long, n long")
             .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    # most frequent first, ties by hash; the limit is applied before the exchange as well
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    tally = kept(tally, "quality-tally")
    top = tally.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= common)
    total = tally.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    langs = total.filter("kind = 'word'").filter(F.col("total") >= least_reference)
    found = langs.select("lang", "total").limit(most_langs + 1).collect()
    if len(found) > most_langs:
        raise ValueError(f"more than {most_langs} languages have a reference")
    rows: dict[str, dict[str, list]] = {r.lang: {"class": [], "word": []} for r in found}
    for r in top.join(F.broadcast(langs.select("lang")), "lang").collect():
        rows[r.lang][r.kind].append((r.key, r.n))
    out = {}
    for r in found:
        classes = np.zeros(len(CLASSES))
        for k, n in rows[r.lang]["class"]:
            classes[k] = n
        words = sorted((np.int64(k).view(np.uint64), n) for k, n in rows[r.lang]["word"])
        counts = np.array([n for _, n in words], float)
        out[r.lang] = (classes, np.array([k for k, _ in words], np.uint64), np.append(counts, r.total - counts.sum()))
    return out


def _judge(refs: dict, class_limit: float, least_common: float, least_chars: int, least_words: int):
    limits = {name: word_limit(words, least_common) for name, (_, _, words) in refs.items()}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = ByteHash(7), class_table()
        for batch in rows:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())
            out = []
            for i, lang in enumerate(langs):
                text = texts[i].as_py() or b""
                base = base_counts(text, hasher)
                data = np.frombuffer(text, np.uint8)
                classes = np.bincount(table[data], minlength=len(CLASSES) + 1)[: len(CLASSES)]
                words = hashes(hasher, lowered(data), *word_bounds(data)) if refs else None
                found = []  # class distance, word distance, its limit
                for name in [lang] if lang in refs else refs:
                    ref_classes, vocabulary, ref_words = refs[name]
                    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                    at = np.where(vocabulary[at] == words, at, len(vocabulary))
                    counts = np.bincount(at, minlength=len(vocabulary) + 1)
                    found.append((js_distance(classes.astype(float), ref_classes),
                                  js_distance(*word_histograms(counts, ref_words)), limits[name]))
                best = min(found, key=lambda x: x[0] + x[1] / x[2], default=(0.0, 0.0, 1.0))
                failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
                far = (classes.sum() >= least_chars and best[0] > class_limit) or (
                    base[0] >= least_words and best[1] > best[2])
                out.append((*base, failed, *best[:2], not failed and not far))
            cols = list(zip(*out)) if out else [[] for _ in range(9)]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance",
                     "word_distance", "kept"]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            rest = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(rest + [pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=batch.schema.names[:-2] + names)

    return run


def judge(docs: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", class_limit: float = 0.2,
          least_common: float = 0.15, least_chars: int = 200, least_words: int = 100,
          **options) -> DataFrame:
    """id, the base counts, both distances, base_failed and kept, a row for each row of ``docs``."""
    refs = references(docs, lang, text, **options)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(
        _judge(refs, class_limit, least_common, least_chars, least_words),
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, class_distance double, word_distance double, kept boolean")


def quality_query(docs: DataFrame) -> DataFrame:
    """The contract's columns and both distances for every document."""
    return judge(docs)
