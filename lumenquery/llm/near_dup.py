"""Near-duplicate groups by one-permutation hashing with optimal densification.

A document's set is its distinct 5-word shingles. Documents with equal sets form one
class, and all later steps see classes only, so copies cost nothing. A class gets one
hash per bin from a single pass over its set; an empty bin takes the value of a filled
bin that a hash shared by all documents picks for it. Bands of bins give bucket keys.

Every bucket links its members to its smallest one (a star), so pairs grow with members
and not with their square; a link counts once the full sets confirm it. What a star may
miss is a link between two members of which one isn't linked to the centre. Buckets
whose members lie in several components after the stars get a few more centres, of their
largest component and of the others, and test the members outside that component only.
What is left is settled by an exact prefix filter: with shingles ordered from rare to common, a
pair at the threshold shares one of the first few of each set, at places that leave
enough shingles to come. Ids meet on those shingles, and sets are fetched only for the
pairs that pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .io import ROW_KEY, as_bytes, chunks, cut, row_key
from .kernels import as_long, mix, shingle_set, word_hashes

#: Words of a shingle, bins of a signature, and bins of a band. At similarity 0.75 a pair
#: misses all 52 bands with a chance of 1e-6.
WORDS, BANDS, ROWS = 5, 52, 5
BINS = BANDS * ROWS
#: New centres of a bucket in several components, in its largest component and outside of it, before the prefix filter settles the rest.
CENTRES = (2, 1)
#: Row keys that may be broadcast (16 bytes each, 24 with a class) to spare the texts a shuffle.
BROADCAST_ROWS = 1_000_000

_rng = np.random.Generator(np.random.PCG64(77))
#: For each bin the order in which an empty one asks the others.
_ORDER = np.argsort(_rng.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.uint16)
_SALT = mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def signature(values: np.ndarray) -> np.ndarray:
    """One hash per bin for a sorted set of hashes."""
    h = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    bins = ((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    order = np.argsort(h)
    h, bins = h[order], bins[order].astype(np.intp)
    filled, first = np.unique(bins, return_index=True)
    sig = np.zeros(BINS, np.uint64)
    sig[filled] = h[first]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        sig[empty] = sig[filled[_ORDER[np.ix_(empty, filled)].argmin(axis=1)]]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    mixed = mix(sig + _SALT).reshape(BANDS, ROWS)
    return mix(np.add.reduce(mixed, axis=1) ^ _BAND)


def _digest(values: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set, the same for equal sets."""
    n = np.uint64(len(values))
    both = np.array([np.add.reduce(mix(values)) + n, np.add.reduce(mix(values ^ np.uint64(0xA0761D6478BD642F))) ^ n], np.uint64)
    return tuple(mix(both).view(np.int64).tolist())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (key of id and text), n_shingles, cls and alt (hashes of the set, null when empty) and band keys of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            n, cls, alt, keys = [], [], [], []
            for w in word_hashes(as_bytes(b), lower=True):
                s = shingle_set(w, WORDS)
                c, a = _digest(s) if len(s) else (None, None)
                n.append(len(s))
                cls.append(c)
                alt.append(a)
                keys.append(as_long(bands(signature(s))) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(alt, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "n_shingles", "cls", "alt", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row")).mapInArrow(sketch, f"doc_id long, row {ROW_KEY}, n_shingles long, cls long, alt long, keys array<long>")


def _told_apart(s: DataFrame) -> DataFrame:
    """Sketches in which rows of one cls agree in alt too: where two sets share a cls, each gets another."""
    while True:
        clash = cut(s.where("cls is not null").groupBy("cls").agg(F.min("alt").alias("lo"), F.max("alt").alias("hi")).where("lo <> hi").select(F.col("cls").alias("bad")))
        if not clash.limit(1).count():
            return s
        both = s.join(clash, s["cls"] == clash["bad"], "left")
        s = cut(both.withColumn("cls", F.when(F.col("bad").isNotNull(), F.xxhash64("cls", "alt")).otherwise(F.col("cls"))).drop("bad"))


def _few(rows: DataFrame) -> DataFrame:
    """rows, for a broadcast while they are at most BROADCAST_ROWS, so that no text is shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and its whole set for the classes of wanted(cls, row), row being the key of one member."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, bytes_at_once=2 << 20, rows_at_once=512):
            sets = [as_long(shingle_set(w, WORDS)) for w in word_hashes(as_bytes(b), lower=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "vals"])

    keyed = docs.select(F.col("text").cast("string").alias("text"), row_key().alias("row"))
    some = keyed.join(_few(wanted.select("cls", "row")), "row").select("text", "cls")
    return some.mapInArrow(make, "cls long, vals array<long>").groupBy("cls").agg(F.any_value("vals").alias("vals"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) with 100 * intersection >= percent * union of their full sets."""
    a = sets.select(F.col("cls").alias("a"), F.col("vals").alias("x"))
    b = sets.select(F.col("cls").alias("b"), F.col("vals").alias("y"))
    n, m, i = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    both = pairs.join(b, "b").join(a, "a").where(100 * F.least(n, m) >= percent * F.greatest(n, m))
    return both.where(100 * i >= percent * (n + m - i)).select("a", "b")


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, cls, comp, stray) of the buckets in several components; strays lie outside a bucket's largest one.

    members(key, cls) are the buckets without their first centres. Of two members in
    different components one at least is a stray.
    """
    m = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
    parts = m.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    tops = parts.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "top")
    return m.join(tops, "key").select("key", "cls", "comp", (F.col("comp") != F.col("top")).alias("stray"))


def _new_centres(opened: DataFrame, within: int, outside: int) -> DataFrame:
    """Pairs (a, b) of each stray with members of its bucket that hashes pick: some of the largest component, some strays."""
    pick = lambda i: F.struct(F.xxhash64("cls", F.lit(i)).alias("h"), "cls", "comp")
    centres = opened.groupBy("key").agg(*[F.min(F.when(~F.col("stray") if i < within else F.col("stray"), pick(i))).alias(f"c{i}") for i in range(within + outside)])
    centres = centres.select("key", F.array(*[f"c{i}" for i in range(within + outside)]).alias("cs"))
    pairs = opened.where("stray").join(centres, "key").select("cls", "comp", F.explode(F.array_distinct("cs")).alias("c")).where("c.comp <> comp")
    return pairs.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct()


def _by_prefix(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) in different components, one a stray, that can reach percent.

    Shingles are ordered by the number of open sets that hold them. Of a set of n the
    first n - ceil(percent n) + 1 count; a pair's first common one at places p and q
    leaves min(n - p, m - q) more, which has to suffice. Sets of like size meet only.
    """
    who = opened.groupBy("cls").agg(F.any_value("comp").alias("comp"), F.max("stray").alias("stray"))
    full = cut(who.join(sets, "cls").select("cls", "comp", "stray", F.size("vals").alias("n"), "vals"))
    each = full.select("cls", "comp", "stray", "n", F.explode("vals").alias("v"))
    often = each.groupBy("v").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("df > 1").select("v", "df", (F.col("lo") != F.col("hi")).alias("across"))
    # Shingles of one set alone come first in the order: their number shifts the places of the others.
    shared = each.join(often, "v").groupBy("cls", "comp", "stray", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v", "across"))).alias("vs"))
    head = (F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 - (F.col("n") - F.size("vs"))).cast("int")
    ratio = 100.5 / percent  # a little more than the most that two sizes may differ by
    near = shared.where(head > 0).select("cls", "comp", "stray", "n", F.floor(F.log("n") / F.log(F.lit(ratio))).cast("int").alias("band"), (F.col("n") - F.size("vs")).alias("alone"), F.posexplode(F.slice("vs", F.lit(1), head)).alias("i", "x"))
    near = cut(near.where("x.across").select("cls", "comp", "stray", "n", "band", (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), F.col("x.v").alias("v")))
    s = near.where("stray").select(F.col("cls").alias("a"), F.col("comp").alias("ac"), F.col("n").alias("an"), F.col("rest").alias("ar"), "v", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    u = near.select(F.col("cls").alias("b"), F.col("comp").alias("bc"), F.col("n").alias("bn"), F.col("rest").alias("br"), F.col("stray").alias("bs"), "v", "band")
    enough = (100 + percent) * F.least("ar", "br") >= percent * (F.col("an") + F.col("bn"))
    both = s.join(u, (s["v"] == u["v"]) & (s["band"] == u["band"]) & (F.col("ac") != F.col("bc")) & (~F.col("bs") | (F.col("a") < F.col("b"))) & enough)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps after links(a, b) between components: the components stand for their members."""
    at = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"{name}c"))
    bridges = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    upper = cut(components(bridges))
    nodes = comps.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
    return cut(nodes.join(upper.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text).

    Documents with 100 * intersection >= percent * union of their shingle sets are linked;
    component_id is the smallest doc_id reachable. A-Z are folded; texts of fewer than five
    words have one shingle, null texts and texts without words none and are linked with
    nothing. Repeated rows are linked like any copies. A null doc_id is linked but never the
    smallest; where a component has no other, component_id is null and its rows are kept.
    Further columns are dropped. An empty table gives no rows.
    """
    return _decided(docs, percent).drop("row", "comp")


def _decided(docs: DataFrame, percent: int) -> DataFrame:
    """near_duplicates with the hash of each row's id and text, and comp, which names the components of two rows or more."""
    s = _told_apart(cut(sketches(docs)))
    classes = s.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.any_value("keys").alias("keys"), F.min("row").alias("row"))
    buckets = cut(classes.select("cls", F.explode("keys").alias("key")))
    hubs = buckets.groupBy("key").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    members = cut(buckets.join(hubs, "key"))
    stars = cut(members.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct())
    reps = cut(classes.select("cls", "row").join(stars.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi"))
    sets = cut(_sets(docs, reps))
    comps = cut(components(cut(_confirm(stars, sets, percent))))
    rest = members.where("cls <> hub").select("key", "cls")
    opened = cut(_open(rest, comps))
    if sum(CENTRES):
        comps = _joined(comps, cut(_confirm(_new_centres(opened, *CENTRES), sets, percent)))
        opened = cut(_open(opened.select("key", "cls"), comps))
    found = cut(_confirm(_by_prefix(opened, sets, percent), sets, percent))
    if found.limit(1).count():
        comps = _joined(comps, found)
    of = classes.select("cls", "doc_id").join(comps.withColumnRenamed("node", "cls"), "cls")
    least = of.groupBy("comp").agg(F.min("doc_id").alias("least"))
    of = of.join(least, "comp").select("cls", "comp", "least")
    # Classes of copies that are in no link: only those with two rows or more need their smallest id.
    copies = s.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cls", "low")
    names = of.join(copies, "cls", "full").select("cls", F.coalesce("least", "low").alias("component_id"), F.coalesce("comp", "cls").alias("comp"))
    out = s.select("doc_id", "row", "n_shingles", "cls").join(names, "cls", "left")
    out = out.select("doc_id", "row", "n_shingles", F.when(F.col("comp").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "comp")
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def keep_one_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of docs per component of near_duplicates, with all its columns.

    Of the rows that near_duplicates keeps in a component (several where an id repeats or
    all ids are null) the one with the least hash of id and text stays, and of rows equal in
    both any one. Texts without words are linked with nothing, so their rows all stay.
    """
    rows = _decided(docs.select("doc_id", "text"), percent).where("comp is not null")
    rows = cut(rows.groupBy("comp", "row", "kept").agg(F.count(F.lit(1)).alias("n")))
    kept = rows.where("kept")
    first = kept.groupBy("comp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("k"))
    rest = kept.join(first.where("k > 1"), "comp").where("row <> first")
    gone = cut(rows.where("not kept").select("row").unionByName(rest.select("row")).distinct())
    twice = cut(kept.where("n > 1").select("row").join(gone, "row", "left_anti"))
    n = twice.count()
    gone, twice = _few(gone), _few(twice)
    left = docs.select(F.struct("*").alias("doc"), row_key().alias("row")).join(gone, "row", "left_anti")
    if not n:
        return left.select("doc.*")
    once = left.join(twice, "row", "left_anti").select("doc")
    # Rows are equal in id and text here; the maps combine them before the shuffle.
    one = left.join(twice, "row", "left_semi").groupBy("row").agg(F.any_value("doc").alias("doc")).select("doc")
    return once.unionByName(one).select("doc.*")
