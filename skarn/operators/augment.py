"""Samples and augmentations that depend on keys and seeds only, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators import vectors as V
from skarn.operators.prefix import grouped_prefix


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that follows from the seed and the key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def normal(seed: int, *key: Column) -> Column:
    """A standard normal number from two uniform ones."""
    u = F.greatest(uniform(seed, *key), F.lit(1e-300))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * uniform(seed + 7919, *key))


def record_seed(seed: int, index: Column) -> Column:
    return F.lit(seed) + index * 100003


def joint_config(kind: Column, lower: Column, upper: Column, seed: int, *key: Column) -> Column:
    """A joint position: half of the time within a quarter of the range about its middle, else
    anywhere in it; 0 for fixed joints (code 3)."""
    u = uniform(seed + 1, *key)
    near = (lower + upper) / 2 + (u - 0.5) * 0.5 * (upper - lower)
    return F.when(kind == 3, 0.0).when(uniform(seed, *key) < 0.5, near).otherwise(lower + u * (upper - lower))


def noise(value: Column, sigma: float, seed: int, *key: Column) -> Column:
    return value if sigma <= 0 else value + sigma * normal(seed, *key)


def yaw(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """x and y after a turn about z."""
    return F.cos(angle) * x - F.sin(angle) * y, F.sin(angle) * x + F.cos(angle) * y


def drop_share(df: DataFrame, group: list[str], key: str, share: float, seed: int) -> DataFrame:
    """Each group without a share of its rows: round((1 - share) n) stay, those of the smallest
    hashes."""
    n = df.groupBy(*group).agg(F.count("*").alias("__n"))
    ranked = grouped_prefix(df.withColumn("__h", F.xxhash64(F.lit(seed), key)), group, ["__h", key])
    return ranked.join(n, group).filter(F.col("rank") <= F.bround(F.col("__n") * (1 - share))).select(*df.columns)


def resample(df: DataFrame, group: list[str], key: str, size: int, seed: int) -> DataFrame:
    """`size` rows of each group with slot 0 .. size - 1: larger groups lose rows at random,
    smaller ones are gone through again."""
    n = df.groupBy(*group).agg(F.count("*").alias("__n"))
    ranked = grouped_prefix(df.withColumn("__h", F.xxhash64(F.lit(seed), key)), group, ["__h", key]).join(n, group).filter(F.col("rank") <= size)
    slots = F.sequence(F.col("rank") - 1, F.lit(size - 1).cast("long"), F.least(F.col("__n"), F.lit(size)).cast("long"))
    return ranked.select(*df.columns, F.explode(slots).alias("slot"))


def surface_points(faces: DataFrame, mesh: str, face: str, area: str, n: int, seed: int) -> DataFrame:
    """n points of each mesh as (mesh, k, face, a, b): a face by its share of the area, and
    coordinates folded into its triangle. Each face finds the numbers that fall in its part of
    the running area, so no table of all faces is searched."""
    total = faces.groupBy(mesh).agg(F.sum(area).alias("__all"))
    run = grouped_prefix(faces.select(mesh, face, area), [mesh], [face, mesh], area).join(total, mesh)
    lo, hi = F.col("before") / F.col("__all") * n, (F.col("before") + F.col(area)) / F.col("__all") * n
    # one number per stratum k: k + u, so that every mesh has exactly n
    ks = F.filter(F.sequence(F.floor(lo), F.least(F.ceil(hi), F.lit(n - 1).cast("long"))), lambda k: (k + uniform(seed, F.col(mesh), k) >= lo) & (k + uniform(seed, F.col(mesh), k) < hi))
    p = run.filter(F.col(area) > 0).select(mesh, face, F.explode(ks).alias("k"))
    u, v = uniform(seed + 1, F.col(mesh), F.col("k")), uniform(seed + 2, F.col(mesh), F.col("k"))
    return p.select(mesh, "k", face, F.when(u + v > 1, 1 - u).otherwise(u).alias("a"), F.when(u + v > 1, 1 - v).otherwise(v).alias("b"))


def scaled(df: DataFrame, group: str, factor: Column) -> DataFrame:
    """df (group, x, y, z) scaled about each group's centroid by a factor of its own."""
    mid = df.groupBy(group).agg(*[F.avg(c).alias(f"__m{c}") for c in "xyz"])
    out = df.join(mid, group).withColumn("__s", factor)
    return out.withColumns({c: (F.col(c) - F.col(f"__m{c}")) * F.col("__s") + F.col(f"__m{c}") for c in "xyz"}).select(*df.columns)


def random_motion(group: Column, seed: int, reach: float) -> tuple[Column, Column]:
    """(rotation, shift) that follow from seed and group: any axis and angle, a shift within reach."""
    z = 2 * uniform(seed, group) - 1
    turn = 2 * F.pi() * uniform(seed + 1, group)
    flat = F.sqrt(F.greatest(1 - z * z, F.lit(0.0)))
    axis = F.array(flat * F.cos(turn), flat * F.sin(turn), z)
    return V.rodrigues(axis, 2 * F.pi() * uniform(seed + 2, group)), F.array(*[(2 * uniform(seed + 3 + i, group) - 1) * reach for i in range(3)])


def augment(df: DataFrame, group: str, key: str, seed: int, reach: float = 0.1, scale: tuple[float, float] = (0.9, 1.1), sigma: float = 0.002, drop: float = 0.1) -> DataFrame:
    """Clouds df (group, key, x, y, z, and ax, ay, az: an axis) after a random motion, which only
    turns the axes, a random scale about the centroid, noise, and the loss of a share of the
    points, in this order. Everything follows from seed, group and key, so a repeated task or
    another partitioning gives the same points."""
    r, t = random_motion(F.col(group), seed, reach)
    d = df.withColumns({"__p": V.move(r, t, F.array("x", "y", "z")), "__a": V.turn(r, F.array("ax", "ay", "az"))})
    d = d.withColumns({**{c: F.col("__p")[i] for i, c in enumerate("xyz")}, **{f"a{c}": F.col("__a")[i] for i, c in enumerate("xyz")}}).select(*df.columns)
    d = scaled(d, group, scale[0] + (scale[1] - scale[0]) * uniform(seed + 9, F.col(group)))
    d = d.withColumns({c: noise(F.col(c), sigma, seed + 20 + i, F.col(group), F.col(key)) for i, c in enumerate("xyz")})
    return drop_share(d, [group], key, drop, seed + 40)
