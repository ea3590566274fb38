"""Blocks of vectors that meet in tasks, and the arithmetic of one such meeting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is cut into at most SIDES blocks of BLOCK vectors or more, so each vector is sent SIDES times whatever the table's
#: size; only tables of more than SIDES * MOST vectors are cut further, so that a task stays bounded.
SIDES, BLOCK, MOST = 16, 256, 65_536
#: Rows and columns of a product held at once.
TILE = 2048


def count_blocks(n: int, block: int = BLOCK, sides: int = SIDES) -> int:
    return max(1, min(sides, -(-n // block)), -(-n // MOST))


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a list column as doubles; a null element is NaN."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(flat), width)


def exact_dot(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of x and j of y, added up in the order of the elements as functions.vectors.dot does.

    A matrix product adds in another order, so that equal vectors could differ in the last digits.
    """
    out = np.zeros(len(i))
    for k in range(x.shape[1]):
        out += x[i, k] * y[j, k]
    return out


def slack(x: np.ndarray, y: np.ndarray) -> float:
    """More than a matrix product of x and y can differ from exact_dot."""
    if not len(x) or not len(y):
        return 0.0
    return 1e-12 + 1e-14 * float(np.sqrt(np.nanmax((x * x).sum(axis=1)) * np.nanmax((y * y).sum(axis=1))))


def tiles(x: np.ndarray, y: np.ndarray, same: bool = False, tile: int = TILE) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, product) of the tiles of x times y; of one set with itself only those on and above the diagonal."""
    for r in range(0, len(x), tile):
        for c in range(r if same else 0, len(y), tile):
            yield r, c, x[r : r + tile] @ y[c : c + tile].T


def self_blocks(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """rows once per pair of blocks p <= q that holds theirs (blk)."""
    v = rows.withColumn("blk", block_of(key, blocks))
    at = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("blk", o).alias("p"), F.greatest("blk", o).alias("q")))
    return v.select("*", F.explode(at).alias("at")).select(*v.columns, "at.p", "at.q")


def meet(left: DataFrame, left_key: str, right: DataFrame, right_key: str, task: Callable, schema: str, right_sides: int = 4) -> DataFrame:
    """task(left table, right table, width) wherever a block of left meets one of right; both hold an array column vector.

    Each left row is sent right_sides times, each right row SIDES times. Rows meet those of their width only.
    """
    a, b = count_blocks(left.count()), count_blocks(right.count(), sides=right_sides)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wide = lambda t: t.where("vector is not null").withColumn("w", F.size("vector"))
    x = wide(left).withColumn("p", block_of(left_key, a)).withColumn("q", every(b))
    y = wide(right).withColumn("q", block_of(right_key, b)).withColumn("p", every(a))

    def one(key, lt, rt):
        return task(lt, rt, key[0].as_py())

    x, y = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (x, y))  # both may come from one table
    return x.groupBy("w", "p", "q").cogroup(y.groupBy("w", "p", "q")).applyInArrow(one, schema)
