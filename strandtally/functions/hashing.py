"""A 64-bit mix (SplitMix64: golden increment and finaliser), on columns and on arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
GAMMA = 0x9E3779B97F4A7C15
FIRST = 0xBF58476D1CE4E5B9
SECOND = 0x94D049BB133111EB


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(GAMMA)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _add(x: Column, constant: int) -> Column:
    """Wrapping sum by halves: ANSI addition would throw."""
    low = _low32(x) + F.lit(constant & 0xFFFFFFFF)
    high = F.shiftrightunsigned(x, 32) + F.lit(constant >> 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(_low32(high), 32).bitwiseOR(_low32(low))


def _times(x: Column, constant: int) -> Column:
    """Wrapping product by 16-bit parts of the constant."""
    out = None
    low, high = _low32(x), F.shiftrightunsigned(x, 32)
    for i in range(4):
        part = constant >> (16 * i) & 0xFFFF
        if not part:
            continue
        a = low * F.lit(part)  # below 2**48
        b = _low32(high * F.lit(part))
        total = F.shiftrightunsigned(a, 32) + b
        term = F.shiftleft(F.shiftleft(_low32(total), 32).bitwiseOR(_low32(a)), 16 * i)
        out = term if out is None else _plus(out, term)
    return out


def _plus(a: Column, b: Column) -> Column:
    low = _low32(a) + _low32(b)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(_low32(high), 32).bitwiseOR(_low32(low))


def with_mix64(df: DataFrame, source: str, target: str) -> DataFrame:
    """df with target = mix64(source) as a signed BIGINT; staged, as one nested expression would explode."""
    df = df.withColumn("_x", _add(F.col(source).cast("bigint"), GAMMA))
    for shift, constant in ((30, FIRST), (27, SECOND)):
        df = df.withColumn("_x", F.col("_x").bitwiseXOR(F.shiftrightunsigned("_x", shift)))
        df = df.withColumn("_x", _times(F.col("_x"), constant))
    return df.withColumn(target, F.col("_x").bitwiseXOR(F.shiftrightunsigned("_x", 31))).drop("_x")
