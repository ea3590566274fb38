"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are runs of words of a benchmark item. How rare one is follows from the corpus
frequencies of its words (their product), so a passage that stands in many documents
doesn't make its own seeds common. Each item keeps all seeds that are rare and, where
these are few, its rarest ones. The seeds of a bounded block of items are broadcast;
documents are scanned where they lie, each hit opens a window around its diagonal, and
the alignment of window and item decides. A larger benchmark takes more blocks.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import as_bytes, chunks, doc_and_text
from .kernels import as_long, window_hashes, word_hashes

#: Words of a seed; the chance of a rare one at a place; seeds that an item keeps at least.
SEED, RARE, LEAST = 4, 1e-7, 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best possible alignment score from which a document counts as holding the item.
SCORE = 0.5
#: Words of benchmark items that are broadcast at once (about 40 bytes each).
BLOCK_WORDS = 1_000_000
_PUNCT = string.punctuation.encode()


def normal_words(texts: list[bytes | None]) -> list[np.ndarray]:
    """Word hashes of lower-cased texts without ASCII punctuation."""
    return word_hashes([t.decode("utf-8", "replace").lower().encode().translate(None, _PUNCT) if t else None for t in texts])


def align(item: np.ndarray, window: np.ndarray) -> float:
    """Best local alignment as a share of the item's perfect score."""
    at = np.arange(len(window) + 1) * -GAP
    above, best = np.zeros(len(window) + 1), 0.0
    for w in item:
        here = np.zeros(len(window) + 1)
        np.maximum(above[1:] + GAP, above[:-1] + np.where(window == w, MATCH, MISMATCH), out=here[1:])
        np.maximum(here, 0, out=here)
        above = np.maximum.accumulate(here + at) - at
        best = max(best, float(above.max()))
    return best / (MATCH * len(item))


class Seeds:
    """Seeds of a block of items, and the items' words."""

    def __init__(self, ids: list, words: list[np.ndarray], freq: dict[int, float]):
        self.ids, self.words = ids, words
        least = min(freq.values(), default=1e-9)
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(words):
            if not len(w):
                continue
            k = min(SEED, len(w))
            grams = window_hashes(w, k)
            p = np.log([freq.get(int(x), least) for x in as_long(w)])
            chance = np.array([p[o : o + k].sum() for o in range(len(grams))])
            keep = set(np.flatnonzero(chance <= np.log(RARE))) | set(np.argsort(chance, kind="stable")[:LEAST])
            rows.setdefault(k, []).extend((int(grams[o]), i, o) for o in sorted(keep))
        for k, r in rows.items():
            r.sort()
            h = np.array([x[0] for x in r], np.uint64)
            self.by[k] = (h, np.array([x[1] for x in r]), np.array([x[2] for x in r]))
        self.filters = {k: np.zeros(1 << 20, bool) for k in self.by}
        for k, (h, _, _) in self.by.items():
            self.filters[k][h & np.uint64((1 << 20) - 1)] = True

    def hits(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item, word at which the item would start) of every seed hit."""
        out = []
        for k, (h, item, offset) in self.by.items():
            grams = window_hashes(words, k)
            at = np.flatnonzero(self.filters[k][grams & np.uint64((1 << 20) - 1)])
            lo, hi = np.searchsorted(h, grams[at]), np.searchsorted(h, grams[at], "right")
            for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                out += [(int(item[x]), int(p) - int(offset[x])) for x in range(a, b)]
        return out

    def found(self, words: np.ndarray, score: float) -> dict[int, float]:
        """Best score per item, of those that reach score."""
        got: dict[int, float] = {}
        starts: dict[int, set[int]] = {}
        for i, s in self.hits(words):
            starts.setdefault(i, set()).add(s)
        for i, at in starts.items():
            item = self.words[i]
            n, margin = len(item), len(item) // 3 + 2
            order = sorted(at)
            group = [order[0], order[0]]
            groups = [group]
            for s in order[1:]:
                if s - group[1] <= margin:
                    group[1] = s
                else:
                    groups.append(group := [s, s])
            for a, b in groups:
                if got.get(i, 0) >= 1:
                    break
                exact = a >= 0 and a == b and np.array_equal(words[a : a + n], item)
                x = 1.0 if exact else align(item, words[max(0, a - margin) : b + n + margin])
                if x >= score and x > got.get(i, 0):
                    got[i] = x
        return got


def _frequencies(docs: DataFrame, words: np.ndarray) -> dict[int, float]:
    """Share of all corpus words that each of the given word hashes has."""
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total, n = 0, np.zeros(len(known), np.int64)
        for b in chunks(batches):
            for w in normal_words(as_bytes(b)):
                total += len(w)
                if len(w) and len(known):
                    at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                    n += np.bincount(at[known[at] == w], minlength=len(known))
        if total:
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([*as_long(known[some]).tolist(), None], pa.int64()), pa.array([*n[some].tolist(), total], pa.int64())], names=["w", "n"])

    counts = dict(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n")).collect())
    total = counts.pop(None, 1)
    return {w: n / total for w, n in counts.items()}


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in blocks by hash, each of about BLOCK_WORDS words."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(chars // (4 * BLOCK_WORDS)) + 1
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _seeds(docs: DataFrame, block: DataFrame) -> Seeds | None:
    items = block.orderBy("item_id", "text").collect()
    words = normal_words([r["text"].encode() for r in items])
    if not sum(map(len, words)):
        return None
    return Seeds([r["item_id"] for r in items], words, _frequencies(docs, np.concatenate(words)))


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """(doc_id, item_id, score) for each document that holds a benchmark item, whole or edited.

    score is that of the best alignment, 1.0 for a verbatim copy (case and ASCII punctuation
    aside). Null texts hold nothing and items without words are in nothing; items shorter
    than a seed must stand there whole; null ids are kept as null; repeated rows give
    repeated results. Empty tables give no rows. Nothing of docs is shuffled.
    """
    out = []
    for block in _blocks(benchmark):
        if (seeds := _seeds(docs, block)) is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def emit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            for b in chunks(batches):
                rows = [(d, s.ids[i], x) for d, w in zip(b.column(0).to_pylist(), normal_words(as_bytes(b)), strict=True) for i, x in s.found(w, score).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score"])

        out.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(emit, "doc_id long, item_id long, score double"))
    if not out:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return reduce(DataFrame.unionByName, out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; nulls as in contaminated."""
    cols = docs.columns
    for block in _blocks(benchmark):
        if (seeds := _seeds(docs, block)) is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(seeds)
        sent, columns = doc_and_text(docs, cols)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, columns=columns) -> Iterator[pa.RecordBatch]:
            s = shared.value
            for b in chunks(batches):
                clean = pa.array([not s.found(w, score) for w in normal_words(as_bytes(b))], pa.bool_())
                yield pa.RecordBatch.from_arrays(columns(b.filter(clean)), names=cols)

        docs = docs.select(*sent).mapInArrow(keep, docs.schema)
    return docs


