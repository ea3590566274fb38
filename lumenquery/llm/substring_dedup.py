"""Repeated passages by prefix-partitioned suffix trees.

A window is 35 consecutive words; a word goes when a window over it occurs elsewhere too.

1. Every window has one anchor, the least fingerprint of its 8-word runs. Windows that are
   equal have equal anchors, so consecutive windows with one anchor travel as one row
   (anchor, fingerprint of the words they span, place): about one row per 14 words.
2. An anchor seen once holds no repeat. Where all spans of an anchor are equal, all their
   windows repeat. Only the other anchors need trees.
3. The suffixes that start at the windows of one span for each distinct content are cut
   at 35 words and given fingerprints of their prefixes of 8, 20 and 35 words. Range
   partitioning over the three splits the suffixes into groups of even size: a boundary
   falls after 8 words where these are rare and after 20 or 35 where they are common, so a
   group is a set of variable-length prefixes. Each task sorts its group and builds its
   subtrees from the depths that neighbours share; internal nodes that are 35 deep are the
   repeats. Equal suffixes of a batch travel as one leaf with a count, so a passage that
   many documents share doesn't pile up in one task.
4. Repeated windows go back to the documents by joins on content and on row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import as_bytes, chunks, cut, doc_and_text, row_key
from .kernels import as_long, span_hash, window_hashes, word_hashes

WINDOW, ANCHOR = 35, 8
DEPTHS = (8, 20, 35)
#: Row keys that may be broadcast (8 bytes each) to keep unaffected texts out of a shuffle.
BROADCAST_ROWS = 1_000_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def spans_of(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """start, number of windows, anchor, content and whether the anchor occurs twice, per span of windows."""
    grams = window_hashes(words, ANCHOR)
    least = _sliding_min(grams, window - ANCHOR + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(start[1:], len(least))
    anchor = least[start]
    ordered = np.sort(grams)
    twice = np.searchsorted(ordered, anchor, "right") - np.searchsorted(ordered, anchor) > 1
    return start, end - start, anchor, span_hash(words, start, end + window - 1), twice


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), row_key()["a"].alias("__row"))


def _spans(docs: DataFrame, window: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rows = b.column(1).to_pylist()
            got = [[], [], [], [], [], []]
            for row, w in zip(rows, word_hashes(as_bytes(b)), strict=True):
                if len(w) >= window:
                    parts = spans_of(w, window)
                    got[0].append(np.full(len(parts[0]), row, np.int64))
                    for g, p in zip(got[1:], parts, strict=True):
                        g.append(p)
            if got[0]:
                row, start, n, anchor, content, twice = (np.concatenate(g) for g in got)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(as_long(anchor)), pa.array(as_long(content)), pa.array(twice)], names=["row", "start", "n", "anchor", "content", "twice"])

    return _keyed(docs).mapInArrow(emit, "row long, start int, n int, anchor long, content long, twice boolean")


def _only(docs: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of docs(..., __row) joined with lists(__row, __list), and the rows without a list.

    While the row keys are few they are broadcast, so that only the texts concerned are
    shuffled; beyond that one left join does it all and the second result is None.
    """
    keys = lists.select("__row")
    if keys.count() <= BROADCAST_ROWS:
        small = F.broadcast(keys)
        return docs.join(small, "__row", "left_semi").join(lists, "__row"), docs.join(small, "__row", "left_anti")
    return docs.join(lists, "__row", "left"), None


def _suffixes(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """content, idx, weight and prefix fingerprints of the suffixes at the windows of the chosen spans."""
    window = DEPTHS[-1]
    lists = cut(chosen.groupBy(F.col("at.row").alias("__row")).agg(F.collect_list(F.struct("at.start", "at.n", "content", "weight")).alias("__list")))
    rows, _ = _only(_keyed(docs), lists)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, bytes_at_once=2 << 20, rows_at_once=256):
            out = [[] for _ in range(6)]
            for w, spans in zip(word_hashes(as_bytes(b)), b.column(1).to_pylist(), strict=True):
                for s in spans or ():
                    at, n = s["start"], s["n"]
                    part = w[at : at + n + window - 1]
                    for o, v in zip(out, [np.full(n, s["content"], np.int64), np.arange(n, dtype=np.int32), np.full(n, min(s["weight"], 2), np.int64), *(as_long(window_hashes(part[: n + d - 1], d)) for d in DEPTHS)], strict=True):
                        o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["content", "idx", "weight", "p1", "p2", "p3"])

    return rows.where("__list is not null").select("text", "__list").mapInArrow(emit, "content long, idx int, weight long, p1 long, p2 long, p3 long")


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal suffixes of a batch as one leaf with their number."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]).group_by(["p1", "p2", "p3"]).aggregate([("weight", "sum")])
            yield from t.rename_columns(["p1", "p2", "p3", "weight"]).combine_chunks().to_batches()


def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deep internal nodes of the subtrees over sorted leaves (p1, p2, p3, weight).

    The depth that a leaf shares with the one before it is 0, 8, 20 or 35 words; leaves
    that share all 35 hang below one node, which is a repeat if two suffixes end there.
    """
    held: tuple | None = None  # the last node's path and weight, which the next batch may go on with
    for b in batches:
        if not b.num_rows:
            continue
        path = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
        weight = b.column(3).to_numpy()
        if held is not None:
            path, weight = np.vstack([held[0], path]), np.append(held[1], weight)
        same = path[1:] == path[:-1]
        shared = same[:, 0].astype(int) + (same[:, 0] & same[:, 1]) + same.all(axis=1)  # index into (0, *DEPTHS)
        first = np.flatnonzero(np.append(True, shared < len(DEPTHS)))
        total = np.add.reduceat(weight, first)
        held = (path[first[-1]], total[-1])
        deep = total[:-1] >= 2
        yield pa.RecordBatch.from_arrays([pa.array(path[first[:-1]][deep, 2])], names=["p3"])
    if held is not None and held[1] >= 2:
        yield pa.RecordBatch.from_arrays([pa.array([int(held[0][2])], pa.int64())], names=["p3"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """__row and __list, the word spans (start, stop) under repeated windows, for each row that has some."""
    spans = cut(_spans(docs, WINDOW))
    kinds = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("twice").alias("tw"))
    kinds = kinds.where("k > 1 or tw").select("anchor", F.expr("k > 1 and lo = hi and not tw").alias("alike"))
    seen = cut(spans.select("row", "start", "n", "anchor", "content").join(kinds, "anchor").drop("anchor"))
    whole = seen.where("alike").select(F.col("row").alias("__row"), F.struct("start", (F.col("start") + F.col("n") + (WINDOW - 1)).alias("stop")).alias("span"))
    mixed = seen.where("not alike")
    chosen = mixed.groupBy("content").agg(F.min(F.struct("row", "start", "n")).alias("at"), F.count(F.lit(1)).alias("weight"))
    suffixes = cut(_suffixes(docs, chosen))
    leaves = suffixes.select("p1", "p2", "p3", "weight").mapInArrow(_leaves, "p1 long, p2 long, p3 long, weight long")
    deep = cut(leaves.repartitionByRange("p1", "p2", "p3").sortWithinPartitions("p1", "p2", "p3").mapInArrow(subtrees, "p3 long"))
    hit = suffixes.select("content", "idx", "p3").join(deep, "p3").groupBy("content").agg(F.sort_array(F.collect_list("idx")).alias("at"))
    # Consecutive windows of a span make one stretch.
    runs = F.expr("""aggregate(at, cast(array() as array<struct<a:int,b:int>>), (acc, i) ->
        if(size(acc) > 0 and acc[size(acc) - 1].b = i, concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', acc[size(acc) - 1].a, 'b', i + 1))),
           concat(acc, array(named_struct('a', i, 'b', i + 1)))))""")
    part = mixed.join(hit.select("content", runs.alias("runs")), "content").select(F.col("row").alias("__row"), "start", F.explode("runs").alias("r"))
    part = part.select("__row", F.struct((F.col("start") + F.col("r.a")).alias("start"), (F.col("start") + F.col("r.b") + (WINDOW - 1)).alias("stop")).alias("span"))
    return cut(whole.unionByName(part).groupBy("__row").agg(F.collect_list("span").alias("__list")))


def _keep(n: int, spans: list[dict] | None) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["stop"]] -= 1
    return np.cumsum(edge[:-1]) == 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of docs(doc_id, text, ...) with n_words, n_removed and kept_text.

    A word goes when a 35-word window over it also starts anywhere else, in this or
    another document; windows are judged on the input. kept_text is the words left, joined
    by one space. Null texts have no words; texts of fewer than 35 words lose none; of
    repeated rows both lose all their windows; null ids are allowed; columns of docs named
    like a result are replaced. An empty table gives no rows.
    """
    made = ["n_words", "n_removed", "kept_text"]
    kept = [c for c in docs.columns if c.lower() not in made]
    schema = docs.select(*kept).schema
    sent, columns = doc_and_text(docs, kept)
    keyed = docs.select(*sent, row_key()["a"].alias("__row"))
    hit, miss = _only(keyed, repeated_spans(docs))
    both = hit.select("doc", "text", "__list")
    if miss is not None:
        both = both.unionByName(miss.select("doc", "text", F.lit(None).cast(both.schema["__list"].dataType).alias("__list")))
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, bytes_at_once=2 << 20):
            n, gone, left = [], [], []
            for t, spans in zip(as_bytes(b), b.column(2).to_pylist(), strict=True):
                words = (t or b"").split()
                if spans:
                    words, total = [words[i] for i in np.flatnonzero(_keep(len(words), spans))], len(words)
                else:
                    total = len(words)
                n.append(total)
                gone.append(total - len(words))
                left.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*columns(b), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], names=[*kept, *made])

    return both.mapInArrow(emit, schema)
