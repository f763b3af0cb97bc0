"""Space-filling curve codes as column expressions.

Coordinates are arrays of non-negative BIGINT. A code is a BIGINT where dimension * bits fits into 63 bits,
else a fixed-width string of binary digits, which sorts like the number. Z and Gray codes stay in the JVM;
the Hilbert transform is a vectorised Arrow function that feeds the same interleaving.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def is_narrow(dimension: int, bits: int) -> bool:
    return dimension * bits <= 63


def z_encode(coords: Column, dimension: int, bits: int) -> Column:
    """Bits interleaved, highest first, dimension 0 first."""
    if is_narrow(dimension, bits):
        terms = [F.shiftleft(F.shiftright(coords[k], p).bitwiseAND(F.lit(1).cast("bigint")), p * dimension + dimension - 1 - k) for p in range(bits) for k in range(dimension)]
        return reduce(lambda a, b: a.bitwiseOR(b), terms)
    digits = F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), lambda p: F.concat(*(F.getbit(coords[k], p).cast("string") for k in range(dimension))))
    return F.array_join(digits, "")


def z_decode(code: Column, dimension: int, bits: int) -> Column:
    if is_narrow(dimension, bits):
        one = F.lit(1).cast("bigint")

        def axes(z: Column) -> Column:
            return F.array(*(reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(z, p * dimension + dimension - 1 - k).bitwiseAND(one), p) for p in range(bits)]) for k in range(dimension)))

        return _let(code, axes)
    return _let(
        code,
        lambda z: F.transform(
            F.sequence(F.lit(1), F.lit(dimension)),
            lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("bigint"), lambda acc, p: acc * 2 + F.substr(z, p * dimension + k, F.lit(1)).cast("bigint")),
        ),
    )


def gray_encode(coords: Column, dimension: int, bits: int) -> Column:
    """The Z code z with z >> 1 exclusive-ored into it."""
    z = z_encode(coords, dimension, bits)
    if is_narrow(dimension, bits):
        return z.bitwiseXOR(F.shiftright(z, 1))
    width = dimension * bits
    return _let(z, lambda z: F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.when((i > 1) & (F.substr(z, i, F.lit(1)) != F.substr(z, F.greatest(i - 1, F.lit(1)), F.lit(1))), "1").when(i > 1, "0").otherwise(F.substr(z, F.lit(1), F.lit(1)))), ""
    ))


def _xor_down(step: int):
    return lambda c: c.bitwiseXOR(F.shiftright(c, step))


def gray_to_z(code: Column, dimension: int, bits: int) -> Column:
    """Undo the exclusive or: each bit is the parity of those above it."""
    if is_narrow(dimension, bits):
        for step in (1, 2, 4, 8, 16, 32):
            code = _let(code, _xor_down(step))
        return code
    width = dimension * bits
    ones = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.length(F.replace(F.substr(code, F.lit(1), i), F.lit("0"), F.lit(""))) % 2)
    return F.array_join(F.transform(ones, lambda x: x.cast("string")), "")


def gray_decode(code: Column, dimension: int, bits: int) -> Column:
    return z_decode(gray_to_z(code, dimension, bits), dimension, bits)


def hilbert_axes(points: np.ndarray, bits: int) -> np.ndarray:
    """Skilling's transform, rows of coordinates to transposed Hilbert indexes (AIP Conf. Proc. 707, 2004)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    return (x ^ t).T


def hilbert_points(index: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``hilbert_axes``."""
    x = index.T.astype(np.int64).copy()
    n = len(x)
    t = x[n - 1] >> 1
    for i in range(n - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= t
    q = 2
    while q != 1 << bits:
        for i in range(n - 1, -1, -1):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, t)
            x[i] ^= t
        q <<= 1
    return x.T


def _rows(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(flat) != len(column) * dimension:
        raise ValueError(f"every point needs {dimension} coordinates")
    return flat.reshape(-1, dimension).astype(np.int64)


def _hilbert_column(transform, dimension: int, bits: int):
    def column(points: pa.Array) -> pa.Array:
        out = transform(_rows(points, dimension), bits)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dimension), pa.array(np.ascontiguousarray(out).ravel()))

    return F.arrow_udf(column, "array<bigint>")


def hilbert_transpose(coords: Column, dimension: int, bits: int) -> Column:
    """Coordinates whose Z code is the Hilbert index of ``coords``; select it as a column before encoding."""
    return _hilbert_column(hilbert_axes, dimension, bits)(coords)


def hilbert_decode(code: Column, dimension: int, bits: int) -> Column:
    return _hilbert_column(hilbert_points, dimension, bits)(z_decode(code, dimension, bits))


def zero_pad(code: Column, width: int) -> Column:
    """Decimal digits padded to ``width``, so that text sorts like numbers."""
    return F.lpad(code.cast("string"), width, "0")


def code_digits(dimension: int, bits: int = 32) -> int:
    """Decimal digits of the largest code."""
    return len(str((1 << (dimension * bits)) - 1))
