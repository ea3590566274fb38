"""Column functions over vectors held as arrays; all arithmetic is in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_literal(v: Column, values: list[float], unroll: int = 256) -> Column:
    """Inner product with a constant vector: unrolled, so that it stays inside generated code."""
    if len(values) > unroll or not values:
        return dot(v, literal_vector(values))
    parts = [F.get(v, F.lit(i)).cast("double") * F.lit(float(x)) for i, x in enumerate(values)]
    while len(parts) > 1:  # a balanced tree keeps the expression shallow
        parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot for unit vectors; infinite when the widths differ."""
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(1 - dot(a, b))


def l2_normalise(v: Column) -> Column:
    """v over its norm; v itself when the norm is at most 1e-8."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm <= 1e-8, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


@F.pandas_udf(BinaryType())
def encode_f32(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decode_f32(v: pd.Series) -> pd.Series:
    """Inverse of encode_f32; a length that four doesn't divide is an error."""

    def one(b):
        if b is None:
            return None
        if len(b) % 4:
            raise ValueError(f"corrupt vector: {len(b)} bytes")
        return np.frombuffer(b, "<f4")

    return v.map(one)
