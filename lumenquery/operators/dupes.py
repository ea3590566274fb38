"""Near-duplicate photos and videos, and their groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import BLOCK, TILE, count_blocks, exact_dot, matrix, self_blocks, slack, tiles

#: Similarity of photos, and of videos at that photo threshold.
PHOTO, VIDEO = 0.985, 0.97
#: What a frame scores against videos without a frame of its width; elements of a product of videos held at once.
LOWEST, HELD = -3.4028234663852886e38, 8_000_000


def _sides(t: pa.Table, p: int, q: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors of blocks p and q."""
    ids, blk, x = t.column("asset_id").to_numpy(), t.column("blk").to_numpy(), matrix(t.column("vector"), width)
    left, right = np.flatnonzero(blk == p), np.flatnonzero(blk == q)
    return ids[left], x[left], ids[right], x[right]


def _close(t: pa.Table, p: int, q: int, width: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, score) of the pairs over the threshold, a tile at a time."""
    ia, x, ib, y = _sides(t, p, q, width)
    eps = slack(x, y)
    for r, c, s in tiles(x, y, p == q):
        i, j = np.nonzero(s >= threshold - eps)
        i, j = i + r, j + c
        keep = ia[i] != ib[j]
        if p == q:
            keep &= i < j
        i, j = i[keep], j[keep]
        for at in range(0, len(i), TILE * 64):
            ii, jj = i[at : at + TILE * 64], j[at : at + TILE * 64]
            sc = exact_dot(x, ii, y, jj)
            ok = sc >= threshold
            a, b = ia[ii[ok]], ib[jj[ok]]
            yield np.minimum(a, b), np.maximum(a, b), sc[ok]


def _blocked(vectors: DataFrame, block: int) -> DataFrame:
    v = vectors.where("vector is not null").select("asset_id", "vector", F.size("vector").alias("w"))
    return self_blocks(v, "asset_id", count_blocks(vectors.count(), block))


def similar_pairs(vectors: DataFrame, threshold: float = PHOTO, block: int = BLOCK) -> DataFrame:
    """(a, b, score) of asset pairs a < b of equal width with inner product >= threshold.

    Vectors fall into blocks by hash; each pair of blocks meets once in a task that
    multiplies them a tile at a time. Only pairs over the threshold leave it.
    """

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, s in _close(pa.Table.from_batches(batches), key[1].as_py(), key[2].as_py(), key[0].as_py(), threshold):
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "score": s})

    return _blocked(vectors, block).groupBy("w", "p", "q").applyInArrow(compare, "a long, b long, score double")


def similar_links(vectors: DataFrame, threshold: float = PHOTO, block: int = BLOCK) -> DataFrame:
    """(a, b) that join what similar_pairs joins: of each two blocks one star per group, so rows grow with the vectors, not the pairs."""

    def link(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids = np.unique(t.column("asset_id").to_numpy())
        label = np.arange(len(ids))
        for a, b, _ in _close(t, key[1].as_py(), key[2].as_py(), key[0].as_py(), threshold):
            label = unite(label, np.searchsorted(ids, a), np.searchsorted(ids, b))
        at = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_pydict({"a": ids[label[at]], "b": ids[at]})

    return _blocked(vectors, block).groupBy("w", "p", "q").applyInArrow(link, "a long, b long")


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (each node's smallest member so far) after joining nodes i with nodes j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]


def video_threshold(photo: float) -> float:
    """The video threshold that goes with a photo threshold (ALG2)."""
    return min(max(VIDEO + photo - PHOTO, 0.5), 1.0)


class _Clips:
    """The frames of a block's videos in the order of videos and times: runs are frames of one time."""

    def __init__(self, t: pa.Table, missing: int):
        vector, ts = t.column("vector").combine_chunks(), t.column("ts").to_numpy()
        ids, of = np.unique(t.column("asset_id").to_numpy(), return_inverse=True)
        order = np.lexsort((ts, of))
        width = pc.list_value_length(vector)
        size = pc.fill_null(width, 0).to_numpy(zero_copy_only=False)
        x = np.zeros((len(order), size.max(initial=0)))
        x[np.arange(x.shape[1]) < size[:, None]] = vector.flatten().to_numpy(zero_copy_only=False)
        self.ids, self.of, self.x = ids, of[order], x[order]
        self.width = pc.fill_null(width, missing).to_numpy(zero_copy_only=False)[order]
        self.odd = not np.isfinite(x).all()
        self.frames = np.bincount(of, minlength=len(ids))
        self.run = np.flatnonzero(np.r_[True, (np.diff(self.of) != 0) | (ts[order][1:] != ts[order][:-1])]) if len(order) else np.zeros(0, int)

    def products(self, r: slice, other: _Clips, c: slice) -> np.ndarray:
        n = min(self.x.shape[1], other.x.shape[1])
        s = self.x[r, :n] @ other.x[c, :n].T
        apart = self.width[r, None] != other.width[None, c]
        if apart.any():
            s[apart] = LOWEST
        if self.odd or other.odd:
            s[np.isnan(s)] = -np.inf
        return s


def _first(of: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, np.diff(of) != 0])


def _ask(x: _Clips, y: _Clips) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(videos of x, their scores against all of y): means over the times in x of the best match in y."""
    if not len(x.run) or not len(y.run):
        return
    step = max(1, min(TILE, HELD // len(y.ids)))
    kept, total, count = None, 0.0, 0.0
    for at in range(0, len(x.run), step):
        run = x.run[at : at + step]
        end = x.run[at + step] if at + step < len(x.run) else len(x.of)
        best = np.full((len(run), len(y.ids)), -np.inf)
        for r in range(run[0], end, TILE):  # one tile, save where many frames have one time
            rows = slice(r, min(end, r + TILE))
            into = np.searchsorted(run, np.arange(rows.start, rows.stop), "right") - 1
            for c in range(0, len(y.of), TILE):
                s = x.products(rows, y, slice(c, c + TILE))
                first = _first(y.of[c : c + TILE])
                s = np.maximum.reduceat(s, first, axis=1)
                head = _first(into)
                to = np.ix_(into[head], y.of[c : c + TILE][first])
                best[to] = np.maximum(best[to], np.maximum.reduceat(s, head, axis=0) if len(head) < len(s) else s)
        there = best > -np.inf
        head = _first(x.of[run])
        videos = x.of[run][head]
        n = np.add.reduceat(there, head, axis=0, dtype=float)
        best[~there] = 0.0
        best = np.add.reduceat(best, head, axis=0)
        if kept == videos[0]:
            best[0] += total
            n[0] += count
        elif kept is not None:
            yield np.array([kept]), (total / np.where(count > 0, count, np.nan))[None]
        kept, total, count = videos[-1], best[-1].copy(), n[-1].copy()
        yield videos[:-1], best[:-1] / np.where(n[:-1] > 0, n[:-1], np.nan)
    yield np.array([kept]), (total / np.where(count > 0, count, np.nan))[None]


def video_similarity(frames: DataFrame, threshold: float = VIDEO, asks: str = "shorter", block: int = BLOCK) -> DataFrame:
    """(a, b, score) of videos: mean over one's frames of the best match in the other (J16, AG9, G8).

    The side of fewer frames asks, the first on ties; with asks="first" the smaller id does,
    whatever their lengths. Frames without a partner of their width make the mean hugely
    negative, as a missing match counts as the least float. Blocks of whole videos meet in
    tasks that reduce their products to means; only pairs over the threshold leave them.
    """
    if asks not in ("shorter", "first"):
        raise ValueError(f"asks: {asks}")
    kind = frames.schema["asset_id"].dataType.simpleString()
    f = frames.where("asset_id is not null").select("asset_id", F.coalesce(F.col("ts_secs").cast("double"), F.lit(float("-inf"))).alias("ts"), "vector")
    f = self_blocks(f, "asset_id", count_blocks(frames.count(), block))

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, p, q = pa.Table.from_batches(batches), key[0].as_py(), key[1].as_py()
        left = t.filter(pc.equal(t.column("blk"), p))
        right = left if p == q else t.filter(pc.equal(t.column("blk"), q))
        x, y = _Clips(left, -1), _Clips(right, -2)
        for u, v in [(x, y)] if p == q else [(x, y), (y, x)]:
            for videos, score in _ask(u, v):
                i, j = np.nonzero(score >= threshold)
                a, b, na, nb = u.ids[videos[i]], v.ids[j], u.frames[videos[i]], v.frames[j]
                ok = a < b if asks == "first" else (na < nb) | ((na == nb) & (a < b))
                a, b, sc = a[ok], b[ok], score[i[ok], j[ok]]
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": sc})

    return f.groupBy("p", "q").applyInArrow(compare, f"a {kind}, b {kind}, score double")


def groups(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(asset_id, group_id): connected components of pairs(a, b), named by their smallest member (AG11, X46).

    Labels travel along edges and jump to their label's label, so rounds grow with the
    logarithm of a chain; each round is checkpointed in the session's checkpoint folder.
    """
    e = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = cut(e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    for _ in range(rounds):
        near = e.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(near, "id").select("id", F.least("label", "m").alias("label"))
        jump = step.join(step.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.least("label", "up").alias("new"))
        new = cut(jump.join(labels, "id"))
        if new.where("new <> label").limit(1).count() == 0:
            return labels.select(F.col("id").alias("asset_id"), F.col("label").alias("group_id"))
        labels = new.select("id", F.col("new").alias("label"))
    raise RuntimeError(f"groups did not settle in {rounds} rounds")
