"""Space-filling curves over grids, voxels and patches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.operators.prefix import grouped_prefix


def grid(df: DataFrame, size: float, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """df with gx, gy, gz: cells of a grid that starts at the least coordinate of all rows."""
    low = df.agg(*[F.min(c).alias(f"__{c}") for c in (x, y, z)]).first()
    if low[0] is None:
        return df.withColumns({f"g{c}": F.lit(None).cast("int") for c in "xyz"})
    return df.withColumns({f"g{n}": F.floor((F.col(c) - F.lit(low[i])) / size).cast("int") for i, (n, c) in enumerate(zip("xyz", (x, y, z)))})


def bit_depth(df: DataFrame) -> int:
    """Bits that the largest cell number of gx, gy, gz needs."""
    m = df.agg(F.max(F.greatest("gx", "gy", "gz"))).first()[0] or 0
    if int(m).bit_length() > 16:
        raise ValueError("a grid may have 16 bits a side")
    return int(m).bit_length()


def morton(x: Column, y: Column, z: Column, depth: int) -> Column:
    """Bits of x, y, z in turn: bit i of x, y, z is bit 3i + 2, 3i + 1, 3i of the code."""
    out = F.lit(0).cast("long")
    for i in range(depth):
        for c, place in ((x, 3 * i + 2), (y, 3 * i + 1), (z, 3 * i)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), place))
    return out


def morton_decode(code: Column, depth: int) -> Column:
    """(x, y, z) of a code."""
    parts = []
    for first in (2, 1, 0):
        out = F.lit(0).cast("long")
        for i in range(depth):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(code, 3 * i + first).bitwiseAND(F.lit(1).cast("long")), i))
        parts.append(out)
    return F.struct(*[p.cast("int").alias(n) for p, n in zip(parts, "xyz")])


def with_batch(code: Column, batch: Column, depth: int) -> Column:
    """The code with the batch number in the bits above it."""
    return F.shiftleft(batch.cast("long"), 3 * depth).bitwiseOR(code)


def hilbert_codes(points: np.ndarray, depth: int) -> np.ndarray:
    """Place of each grid point (n x 3) on the Hilbert curve: from the highest bit down, each
    point is turned into the frame of the sub-cube it lies in, whose bits are a Gray code of the
    sub-cube's place."""
    x = points.astype(np.int64).T.copy()
    top = 1 << (depth - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(3):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    x[1] ^= x[0]
    x[2] ^= x[1]
    carry = np.zeros_like(x[0])
    q = top
    while q > 1:
        carry ^= np.where((x[2] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= carry
    code = np.zeros_like(carry)
    for b in range(depth - 1, -1, -1):
        for i in range(3):
            code = code << 1 | (x[i] >> b & 1)
    return code


def hilbert_points(codes: np.ndarray, depth: int) -> np.ndarray:
    """The grid points of places on the Hilbert curve."""
    x = np.zeros((3, len(codes)), np.int64)
    for b in range(depth):
        for i in range(3):
            x[i] |= (codes >> (3 * b + 2 - i) & 1) << b
    last = x[2] >> 1
    x[2] ^= x[1]
    x[1] ^= x[0]
    x[0] ^= last
    q = 2
    while q != 1 << depth:
        low = q - 1
        for i in (2, 1, 0):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q <<= 1
    return x.T


def hilbert(x: Column, y: Column, z: Column, depth: int) -> Column:
    """Place on the Hilbert curve, computed on Arrow batches."""
    @F.pandas_udf(T.LongType())
    def code(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_codes(np.stack([a, b, c], 1), depth))

    return code(x.cast("long"), y.cast("long"), z.cast("long"))


def hilbert_decode(code: Column, depth: int) -> Column:
    """(x, y, z) of a place on the Hilbert curve, computed on Arrow batches."""
    @F.pandas_udf("x long, y long, z long")
    def cell(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(hilbert_points(c.to_numpy(np.int64), depth), columns=["x", "y", "z"])

    return cell(code)


def curve_rank(df: DataFrame, code: str, key: str) -> DataFrame:
    """df with place: the row's number (from 0) along the curve, ties by key; so place is the
    inverse of the sorting permutation."""
    return grouped_prefix(df, [], [code, key]).withColumn("place", F.col("rank") - 1).drop("rank")


def voxel_pool(df: DataFrame, code: str, key: str, levels: int, values: list[str]) -> DataFrame:
    """One row per coarser cell (code without its lowest 3 x levels bits): n, head (the smallest
    key), and sum, mean, least and most of each value."""
    aggs = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("sum", F.sum), ("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(F.shiftright(F.col(code), 3 * levels).alias("cell")).agg(F.count("*").alias("n"), F.min(key).alias("head"), *aggs)


def voxel_unpool(fine: DataFrame, coarse: DataFrame, code: str, levels: int, value: str, pooled: str) -> DataFrame:
    """fine with value + the pooled value of its cell, as `unpooled`."""
    return fine.withColumn("cell", F.shiftright(F.col(code), 3 * levels)).join(coarse.select("cell", F.col(pooled).alias("__up")), "cell").withColumn("unpooled", F.col(value) + F.col("__up")).drop("__up")


def patches(df: DataFrame, cloud: str, place: str, size: int) -> DataFrame:
    """df with patch and slot: runs of `size` rows of each cloud in the order of place (from 0).

    A cloud of more than one patch has its last one filled up with the rows at the same slots of
    the patch before (they occur twice, borrowed = true); smaller clouds keep one short patch."""
    n = df.groupBy(cloud).agg(F.count("*").alias("__n"))
    d = df.join(n, cloud).withColumns({"patch": (F.col(place) / size).cast("long"), "slot": (F.col(place) % size).cast("int"), "borrowed": F.lit(False)})
    last = F.ceil(F.col("__n") / size) - 1
    short = (F.col("__n") > size) & (F.col("__n") % size != 0)
    lent = d.filter(short & (F.col("patch") == last - 1) & (F.col("slot") >= F.col("__n") % size)).withColumns({"patch": last, "borrowed": F.lit(True)})
    return d.unionByName(lent).drop("__n")


def offsets(df: DataFrame, cloud: str) -> DataFrame:
    """cloud, n, start, stop: how clouds lie behind one another, in the order of their key."""
    n = df.groupBy(cloud).agg(F.count("*").alias("n"))
    return grouped_prefix(n, [], [cloud], "n").select(cloud, "n", F.col("before").alias("start"), (F.col("before") + F.col("n")).alias("stop"))
