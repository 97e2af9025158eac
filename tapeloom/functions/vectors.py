"""Vector expressions over array columns (V1, V2) and the byte codec of older archives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """V1: unit vector in double; a zero vector stays as it is.

    The norm is bound as a one-element array so it is worked out once per row, not per element.
    """
    scaled = F.transform(
        F.array(norm(v)),
        lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))),
    )
    return F.get(scaled, 0)


def cosine_distance(a: Column, b: Column) -> Column:
    """V2: 1 - cosine; 1.0 when either side is a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when(scale == 0, 1.0).otherwise(1.0 - F.try_divide(dot(a, b), scale))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_f32(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def pack_f32(values: pd.Series) -> pd.Series:
    """Array to little-endian float32 bytes."""
    return values.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
