"""Vector, transcript and hybrid search, and structured filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_like, query_terms, tokens
from ..functions.vectors import dot, dot_literal
from .blocks import exact_dot, matrix, meet, slack, tiles

#: Ranking constants of transcript search and the score of a spoken hit.
K1, B, IDF_FLOOR, SPOKEN_SCORE, OVERFETCH = 1.2, 0.75, 1e-6, 0.35, 5


@dataclass(frozen=True)
class Filters:
    """Optional conjunctive filters; None means unrestricted."""

    person: str | None = None
    after: str | None = None
    before: str | None = None
    place: str | None = None
    kind: str | None = None


def asset_predicate(f: Filters) -> Column | None:
    """The filters over assets(taken, imported, place, admin1, country, mime); person apart."""
    when = F.coalesce("date_taken", "imported_at")
    parts = []
    if f.after:
        parts.append(when >= F.to_timestamp(F.lit(f.after)))
    if f.before:
        parts.append(when < F.to_timestamp(F.lit(f.before)))
    if f.place:
        parts.append(reduce(lambda a, b: a | b, [F.coalesce(contains_like(F.col(c), f.place), F.lit(False)) for c in ("place", "admin1", "country_name")]))
    if f.kind in ("image", "photo", "video"):
        parts.append(F.col("mime_type").startswith("video/" if f.kind == "video" else "image/"))
    return reduce(lambda a, b: a & b, parts) if parts else None


def allowed_assets(assets: DataFrame, f: Filters, people: DataFrame | None = None) -> DataFrame | None:
    """asset_id of the assets that pass, or None without any filter (J8: a person filter is a semi-join)."""
    pred = asset_predicate(f)
    if pred is None and not f.person:
        return None
    out = assets if pred is None else assets.where(pred)
    if f.person:
        named = people.where(contains_like(F.col("name"), f.person)).select("asset_id").distinct()
        out = out.join(named, "asset_id", "left_semi")
    return out.select("asset_id")


def vector_topk(pool: DataFrame, query: list[float], limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """asset_id, ts_secs and score of the best assets by inner product with the query (K1, K2, AG7).

    Vectors of another width are skipped; an asset of several rows counts by its best,
    ties to the smaller ts; equal scores rank by asset_id. One pass over the pool: the
    score is an expression, the best row per asset a grouped maximum combined before the
    shuffle, the ranking a bounded top-k.
    """
    rows = pool.where(F.size("vector") == len(query))
    if allowed is not None:
        rows = rows.join(allowed, "asset_id", "left_semi")
    scored = rows.select("asset_id", F.col("ts_secs"), dot_literal(F.col("vector"), query).alias("score"))
    best = scored.groupBy("asset_id").agg(F.max(F.struct("score", (-F.coalesce("ts_secs", F.lit(-1.0))).alias("neg"), "ts_secs")).alias("b"))
    return best.select("asset_id", "b.ts_secs", "b.score").orderBy(F.desc("score"), "asset_id").limit(limit)


def bm25(segments: DataFrame, query: str) -> DataFrame:
    """segments(asset_id, ts_secs, text) with their rank value, smaller is better (K3).

    Term counts are array expressions on each segment: one pass gives the statistics, one
    the scores, and nothing is exploded or shuffled but one row of sums.
    """
    terms = query_terms(query)
    if not terms:
        return segments.limit(0).withColumn("bm25", F.lit(0.0))
    counted = segments.withColumn("__tok", tokens(F.col("text"))).withColumn("__len", F.size("__tok"))
    count = lambda term: F.size(F.filter("__tok", lambda x: x == term))
    tf = [count(t).alias(f"__tf{i}") for i, t in enumerate(terms)]
    counted = counted.select(*segments.columns, "__len", *tf)
    stats = counted.agg(F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
    scored = counted.join(F.broadcast(stats))

    def part(i: int) -> Column:
        idf = F.greatest(F.log((F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5)), F.lit(IDF_FLOOR))
        return idf * F.col(f"__tf{i}") * (K1 + 1) / (F.col(f"__tf{i}") + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))

    hit = reduce(lambda a, b: a | b, [F.col(f"__tf{i}") > 0 for i in range(len(terms))])
    return scored.where(hit).select(*segments.columns, (-reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))])).alias("bm25"))


def spoken_hits(segments: DataFrame, query: str, limit: int, allowed: DataFrame | None = None, exact_filter: bool = False) -> DataFrame:
    """Best segment per asset, ranked (AG8): the best 5 * limit rows first, the filter after them.

    exact_filter applies the filter first, so that a selective one can't under-return.
    """
    if allowed is not None and exact_filter:
        segments = segments.join(allowed, "asset_id", "left_semi")
    top = bm25(segments, query).orderBy("bm25", "asset_id", "ts_secs").limit(OVERFETCH * limit)
    if allowed is not None and not exact_filter:
        top = top.join(allowed, "asset_id", "left_semi")
    first = Window.partitionBy("asset_id").orderBy("bm25", "ts_secs")
    return top.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r").orderBy("bm25", "asset_id").limit(limit)


def hybrid(semantic: DataFrame, spoken: DataFrame, limit: int) -> DataFrame:
    """Spoken hits first in their order with score 0.35, then the other semantic hits by score.

    Both inputs hold at most limit rows, so the final ranking is over a bounded set.
    """
    s = spoken.select("asset_id", F.col("ts_secs").alias("frame_ts"), F.lit(SPOKEN_SCORE).alias("score"), F.col("text").alias("speech"), F.lit(0).alias("src"), F.col("bm25").alias("key"))
    rest = semantic.join(spoken.select("asset_id"), "asset_id", "left_anti")
    m = rest.select("asset_id", F.col("ts_secs").alias("frame_ts"), "score", F.lit(None).cast("string").alias("speech"), F.lit(1).alias("src"), (-F.col("score")).alias("key"))
    rank = F.row_number().over(Window.orderBy("src", "key", "asset_id"))
    return s.unionByName(m).orderBy("src", "key", "asset_id").limit(limit).withColumn("rank", rank).drop("src", "key")


def retrieval_eval(queries: DataFrame, images: DataFrame) -> DataFrame:
    """Recall at 1, 5, 10 and mean reciprocal rank of (query_id, target, vector) over images (AG14, AG15).

    The rank of the target is one more than the images that score strictly higher (G18).
    Blocks of queries meet blocks of images. Images clearly above the target are counted in
    the task; those within rounding of it leave it as one row per score with their number.
    """
    own = queries.join(images.select(F.col("asset_id").alias("target"), F.col("vector").alias("tv")), "target").select("query_id", "target", "vector", dot(F.col("vector"), F.col("tv")).alias("own"))
    right = own.where("own is not null").withColumn("own", F.col("own").cast("double"))
    whole = images.where("asset_id is not null and not exists(vector, x -> x is null)").select("asset_id", "vector")

    def above(it: pa.Table, qt: pa.Table, width: int) -> pa.Table:
        x, y = matrix(qt.column("vector"), width), matrix(it.column("vector"), width)
        target, own, ids = qt.column("target").to_numpy(), qt.column("own").to_numpy(), it.column("asset_id").to_numpy()
        eps = 1e-11 + slack(x, y)
        sure, close = np.zeros(len(x), np.int64), [(np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))]
        for r, c, s in tiles(x, y):
            o = own[r : r + len(s), None]
            other = target[r : r + len(s), None] != ids[None, c : c + s.shape[1]]
            with np.errstate(invalid="ignore"):
                near = ~(np.abs(s - o) > eps)
            sure[r : r + len(s)] += ((s > o) & ~near & other).sum(axis=1)
            i, j = np.nonzero(near & other)
            key, n = np.unique(np.stack([i + r, exact_dot(x, i + r, y, j + c)], axis=1), axis=0, return_counts=True)
            close.append((key[:, 0].astype(int), key[:, 1], n))
        i, score, n = (np.concatenate(z) for z in zip(*close, strict=True))
        qid, at = qt.column("query_id").to_numpy(), np.flatnonzero(sure)
        return pa.table({"query_id": np.r_[qid[at], qid[i]], "own": np.r_[own[at], own[i]], "score": pa.array(np.r_[np.zeros(len(at)), score], mask=np.arange(len(at) + len(i)) < len(at)), "n": np.r_[sure[at], n]})

    got = meet(whole, "asset_id", right, "query_id", above, "query_id long, own double, score double, n long")
    more = got.groupBy("query_id").agg(F.sum(F.when(F.col("score").isNull() | (F.round("score", 12) > F.round("own", 12)), F.col("n")).otherwise(0)).alias("more"))
    others = images.where("asset_id is not null").select("asset_id").distinct().limit(2).count() > 1
    rank = own.where(F.lit(others)).select("query_id").distinct().join(more, "query_id", "left").select((1 + F.coalesce("more", F.lit(0))).alias("rank"))
    return rank.agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_{k}") for k in (1, 5, 10)], F.avg(1 / F.col("rank")).alias("mrr"))
