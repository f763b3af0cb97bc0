import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions import curves


def interleaved(point, bits):
    code = 0
    for p in range(bits - 1, -1, -1):
        for c in point:
            code = code << 1 | (c >> p) & 1
    return code


def frame(spark, points):
    return spark.createDataFrame([(i, p) for i, p in enumerate(points)], "id int, coords array<bigint>")


def some_points(d, bits, n=60):
    r = random.Random(d * 100 + bits)
    return [[r.randrange(1 << bits) for _ in range(d)] for _ in range(n)] + [[0] * d, [(1 << bits) - 1] * d]


def test_known_codes(spark):
    z = frame(spark, [[5, 3]]).select(curves.z_encode(F.col("coords"), 2, 31).alias("z")).first().z
    assert z == 39
    assert curves.code_digits(2) == 20 and curves.code_digits(9) == 87
    padded = spark.range(1).select(curves.zero_pad(F.lit(z), 20).alias("p")).first().p
    assert padded == "00000000000000000039"


@pytest.mark.parametrize("d,bits", [(1, 8), (2, 31), (4, 15), (9, 7), (3, 32), (9, 32)])
def test_z_and_gray(spark, d, bits):
    points = some_points(d, bits)
    c = F.col("coords")
    coded = frame(spark, points).select("id", "coords", curves.z_encode(c, d, bits).alias("z"), curves.gray_encode(c, d, bits).alias("g"))
    back = coded.select("*", curves.z_decode(F.col("z"), d, bits).alias("zb"), curves.gray_decode(F.col("g"), d, bits).alias("gb")).orderBy("id").collect()
    narrow = curves.is_narrow(d, bits)
    for row, point in zip(back, points):
        want = interleaved(point, bits)
        number = (lambda x: x) if narrow else (lambda x: int(x, 2))
        assert number(row.z) == want and number(row.g) == want ^ (want >> 1)
        assert row.zb == point and row.gb == point
        assert narrow or len(row.z) == d * bits


@pytest.mark.parametrize("d,bits", [(2, 4), (3, 3), (4, 15), (9, 7)])
def test_hilbert_round_trip(spark, d, bits):
    points = some_points(d, bits)
    t = frame(spark, points).withColumn("t", curves.hilbert_transpose(F.col("coords"), d, bits)).select("id", curves.z_encode(F.col("t"), d, bits).alias("h"))
    back = t.select("id", curves.hilbert_decode(F.col("h"), d, bits).alias("b")).orderBy("id").collect()
    assert [r.b for r in back] == points


@pytest.mark.parametrize("d,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_by_one(d, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    code = [interleaved(x, bits) for x in curves.hilbert_axes(grid, bits).tolist()]
    path = grid[np.argsort(code)]
    assert len(set(code)) == len(grid)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
