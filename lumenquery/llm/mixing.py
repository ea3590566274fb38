"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything here is DataFrame or SQL expressions. A source's documents fall into
``BLOCKS`` blocks by a hash, so block order is a permutation of the source. A target
is met by whole blocks in that order, pass after pass, and by part of one last block
(documents in hash order, the last one cut to the exact word). The quotas of blocks
are dealt to output shards by a binary tree: each node splits its quotas between two
children by drawing, source after source, from the hypergeometric distribution that
conditions on what is left, so that a shard's composition is distributed as in a
full shuffle and all quotas come out exact. Shards then take disjoint ranges of
each source's permuted blocks and order rows locally by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .io import cut

#: Hash blocks of a source: three hexadecimal digits of the permuting hash.
BLOCKS = 4096
#: Fixed weights of sources in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Total share of all words that the mix takes, and the most of one source, in passes.
SHARE, MOST = 1.5, 2


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size in words and the permuting hash of every row; no text is kept."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), ident)).alias("perm"),
    )


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: weights shared out, capped at most x size, the excess reshared.

    Water filling: the sources that end at their cap are those with the least cap per
    weight. The window runs over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", w.alias("w")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rising = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest)
    # A source is capped when the level at its turn would lift it above its cap; levels are the same for all after the last.
    lifted = per.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    final = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("w")).alias("k"), F.col("source").isNull().alias("z"), F.col("source").alias("source_key"), F.col("level").alias("level")))).over(everything)["level"]
    return lifted.withColumn("final", final).select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def _blocks(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """One row per (source, block): its words, and the words of the source's earlier blocks."""
    per = sized.groupBy("source", F.substring("perm", 1, 3).alias("block")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return per.join(goal.withColumnRenamed("source", "source_g"), F.col("source").eqNullSafe(F.col("source_g"))).drop("source_g")


def taken(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Every row with source_size, target and taken: the words that the mix takes of it.

    Of a source's floor(target) words, whole passes take every document; the rest is
    drawn in permuted order. Only the one block in which the rest runs out is sorted by
    document. Null sources form one source; null ids share one place in the order;
    repeated rows are rows of their own; no rows give no rows.
    """
    goal = targets(sized, weights, share, most)
    quota = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = quota - F.col("passes") * F.col("source_size")
    b = _blocks(sized, goal).withColumn("passes", passes).withColumn("rest", rest)
    b = b.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "source_size", "target", "passes", (F.col("rest") - F.col("before")).alias("left"), "words")
    # Rows meet their block: a hot source is spread over its blocks' keys.
    rows = sized.withColumn("block", F.substring("perm", 1, 3))
    rows = rows.join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))).drop("b_source", "b_block")
    whole = rows.where((F.col("left") >= F.col("words")) | (F.col("left") <= 0)).withColumn("part", F.when(F.col("left") > 0, F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("source", "block").orderBy("perm", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where((F.col("left") > 0) & (F.col("left") < F.col("words")))
    last = last.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    return whole.unionByName(last).withColumn("taken", (F.col("passes") * F.col("size") + F.col("part")).cast("long"))


def _let(value: Column, f) -> Column:  # noqa: ANN001
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _log_factorial(k: Column) -> Column:
    """ln k!, from a table below 20 and by Stirling's series (1e-13) above."""
    x = k.cast("double") + 1.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k < 20, F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(20)]), (k + 1).cast("int"))).otherwise(series)


def _draw(n: Column, good: Column, total: Column, u: Column) -> Column:
    """Inverse of the hypergeometric distribution at u: good ones among n drawn of total.

    Only values within 10 standard deviations of the mean are weighed: u has 52 bits, so
    no other can be drawn.
    """
    mean = n.cast("double") * good / F.greatest(total, F.lit(1))
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (total - good) * (total - n) / F.greatest(total, F.lit(1)) / F.greatest(total - 1, F.lit(1))))
    low = F.greatest(F.lit(0).cast("long"), n + good - total, F.floor(mean - 10 * sd - 2).cast("long"))
    high = F.least(n, good, F.ceil(mean + 10 * sd + 2).cast("long"))
    log_weight = lambda k: -(_log_factorial(k) + _log_factorial(good - k) + _log_factorial(n - k) + _log_factorial(total - good - n + k))
    scaled = lambda logs: _let(F.array_max(logs), lambda top: F.transform(logs, lambda x: F.exp(x - top)))
    pick = lambda ws: F.aggregate(
        ws,
        F.struct(F.lit(0.0).alias("cum"), F.lit(0).cast("long").alias("at"), (u * F.aggregate(ws, F.lit(0.0), lambda a, x: a + x)).alias("goal")),
        lambda acc, x: F.struct((acc["cum"] + x).alias("cum"), F.when(acc["cum"] + x < acc["goal"], acc["at"] + 1).otherwise(acc["at"]).alias("at"), acc["goal"].alias("goal")),
    )["at"]
    return _let(F.struct(low.alias("lo"), high.alias("hi")), lambda r: F.when(r["hi"] <= r["lo"], r["lo"]).otherwise(_let(scaled(F.transform(F.sequence(r["lo"], r["hi"]), log_weight)), lambda ws: F.least(r["hi"], r["lo"] + pick(ws)))))


def split_quotas(quotas: DataFrame, depth: int, seed: int = 7) -> DataFrame:
    """Deal (source, quota) to 2**depth shards: rows (shard, source, quota) whose sums are the quotas.

    A tree node is one row with the quotas of all sources, so a row grows with the number
    of sources (24 bytes each) and not with the data; its left child gets half of its
    blocks (rounded up), drawn source after source. No quotas give no rows.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("z"), "source", "quota"))).alias("q")).select(F.lit(0).alias("node"), "q")
    kind = "struct<left:array<bigint>,n:bigint,total:bigint>"
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["quota"])

        here = F.xxhash64(F.lit(seed), F.lit(level), F.col("node"))

        def step(acc: Column, x: Column) -> Column:
            u = (F.pmod(F.xxhash64(here, x["source"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)  # noqa: B023
            got = _draw(acc["n"], x["quota"], acc["total"], u)
            return F.element_at(F.transform(F.array(got), lambda g: F.struct(F.concat(acc["left"], F.array(g)).alias("left"), (acc["n"] - g).alias("n"), (acc["total"] - x["quota"]).alias("total"))), 1)

        start = F.struct(F.array().cast("array<bigint>").alias("left"), F.floor((total + 1) / 2).cast("long").alias("n"), total.alias("total")).cast(kind)
        nodes = nodes.withColumn("left", F.aggregate("q", start, step)["left"])
        child = lambda take: F.zip_with("q", "left", lambda x, g: F.struct(x["z"].alias("z"), x["source"].alias("source"), (g if take else x["quota"] - g).alias("quota")))
        nodes = nodes.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), child(True).alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), child(False).alias("q")))).alias("c")).select("c.node", "c.q")
    return nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source", "x.quota")


def mix(docs: DataFrame, depth: int = 4, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the shards of the row's draws.

    shards lists, for each time that the mix takes words of the row, (shard, spot, words):
    the output shard and the row's local place in it. Block draws, pass after pass, are
    dealt to shards by split_quotas, and taken is what the dealt draws of the row's block
    give. The mix is a function of the rows and the seed only. Null texts have no words;
    null sources are one source; rows that repeat are rows of their own; whole texts
    count; other columns are dropped; an empty table gives no rows.
    """
    sized = cut(sizes(docs, seed))
    rows = taken(sized, weights, share, most).drop("taken")
    goal = targets(sized, weights, share, most)
    block = Window.partitionBy("source").orderBy("block")
    quota = F.floor("target").cast("long")
    ranks = _blocks(sized, goal).withColumn("place", F.row_number().over(block) - 1)
    ranks = ranks.withColumn("n_blocks", F.count(F.lit(1)).over(Window.partitionBy("source"))).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    last = ((quota - F.col("passes") * F.col("source_size") - F.col("before") > 0) & (F.col("words") > 0)).cast("long")
    ranks = ranks.withColumn("last", last).withColumn("last_place", F.sum("last").over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    ranks = cut(ranks.select("source", "block", "place", "n_blocks", "passes", "last_place", (F.col("passes") + F.col("last")).alias("used")))
    shares = split_quotas(ranks.groupBy("source").agg(F.sum("used").cast("long").alias("quota")), depth)
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = shares.withColumn("end", F.sum("quota").over(upto)).groupBy(F.col("source").alias("s_source")).agg(F.array_sort(F.collect_list("end")).alias("ends"))
    # Draws are numbered through a source's passes over its blocks, the last over those that still give words.
    number = lambda t: t * F.col("n_blocks") + F.when(t < F.col("passes"), F.col("place")).otherwise(F.col("last_place"))
    draws = F.transform(F.when(F.col("used") > 0, F.sequence(F.lit(0).cast("long"), F.col("used") - 1)).otherwise(F.array().cast("array<bigint>")), lambda t: F.size(F.filter("ends", lambda e: e <= number(t))))
    dealt = ranks.join(ends, F.col("source").eqNullSafe(F.col("s_source"))).select(F.col("source").alias("s_source"), F.col("block").alias("s_block"), draws.alias("draws"))
    out = rows.join(dealt, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")))
    spot = F.xxhash64(F.lit(seed), "perm", "size")
    got = F.transform("draws", lambda s, t: F.struct(s.alias("shard"), F.xxhash64(spot, t).alias("spot"), F.when(t < F.col("passes"), F.col("size")).otherwise(F.col("part")).cast("long").alias("words")))
    out = out.select("doc_id", "source", "size", "source_size", "target", F.filter(got, lambda x: (x["words"] > 0) & (x["shard"] < 1 << depth)).alias("shards"))
    taken_words = F.aggregate("shards", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken_words.alias("taken"), "shards")
