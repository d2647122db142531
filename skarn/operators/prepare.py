"""Preparing training rows: limits, splits, padding, repair and parents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.prefix import grouped_prefix
from skarn.sources.tables import materialize, ship


def merged_limits(override: Column, template: Column, observed: Column, collision: Column, margin: float = 4.0) -> Column:
    """(lower, upper): an override as it is; else the template, or the observed range widened
    about its middle, cut by collision limits, which stand alone where nothing is left."""
    mid, half = (observed["lower"] + observed["upper"]) / 2, (observed["upper"] - observed["lower"]) / 2
    lo, hi = F.coalesce(template["lower"], mid - half * margin), F.coalesce(template["upper"], mid + half * margin)
    cut_lo, cut_hi = F.greatest(lo, collision["lower"]), F.least(hi, collision["upper"])
    empty = cut_hi <= cut_lo
    return F.struct(
        F.when(override.isNotNull(), override["lower"]).when(empty, collision["lower"]).otherwise(cut_lo).alias("lower"),
        F.when(override.isNotNull(), override["upper"]).when(empty, collision["upper"]).otherwise(cut_hi).alias("upper"),
    )


def parent_by_stillness(motion: DataFrame, scene: str, body: str, step: str, value: str, block: int = 2048) -> DataFrame:
    """body, parent: for each body the one of its scene with less motion in all whose motion over
    the steps has the largest product with its own (both to 2 decimals), ties by body; null for
    the stillest and for those that share no step with a stiller one. Bodies are numbers, and each
    is in one scene. Values of one body and step are added up; null values count nothing, but a
    body whose product is null is a parent where there is no other. Rows without a step count for
    a body's whole motion only; bodies without a scene or any value meet none.

    The products of a scene are those of all pairs, so the work grows with the square of its
    bodies, but no pair is written: each scene is cut into blocks of so many bodies by their whole
    motion, a block meets itself and the stiller ones as arrays in one task each, and only the
    best of a block is kept for each body. What is shuffled is a body per block of its scene.
    """
    spark = motion.sparkSession
    ship(spark)
    m = motion.groupBy(F.col(scene).alias("s"), F.col(body).alias("b"), F.col(step).alias("t")).agg(F.sum(value).alias("v"))
    cell = F.when(F.col("t").isNotNull(), F.struct("t", F.col("v").cast("double").alias("v")))
    bodies = materialize(m.groupBy("s", "b").agg(F.round(F.sum("v"), 2).cast("double").alias("total"), F.collect_list(cell).alias("cells")), "bodies")
    ranked = grouped_prefix(bodies.filter("s is not null and b is not null and total is not null"), ["s"], ["total", "b"])
    ranked = materialize(ranked.select("s", "b", "total", "cells", F.floor((F.col("rank") - 1) / block).cast("int").alias("at")), "ranked")
    last = ranked.groupBy("s").agg(F.max("at").alias("last"))
    n, zero = int(spark.conf.get("spark.sql.shuffle.partitions")), F.lit(0)  # of its own, as tasks of small tables and much work would be put together
    children = ranked.withColumn("of", F.explode(F.sequence(zero, "at"))).repartition(n, "s", "at", "of")
    parents = ranked.withColumnRenamed("at", "of").join(last, "s").withColumn("at", F.explode(F.sequence("of", "last")))
    parents = parents.select(*[F.col(c).alias(c) for c in children.columns]).repartition(n, "s", "at", "of")
    kind = bodies.schema["b"].dataType.simpleString()
    best = children.groupBy("s", "at", "of").cogroup(parents.groupBy("s", "at", "of")).applyInArrow(lambda a, b: _stiller(a, b), f"child {kind}, parent {kind}, dot double")
    best = best.groupBy(F.col("child").alias("b")).agg(F.max_by("parent", F.struct("dot", -F.col("parent"))).alias("parent"))
    return bodies.select("b").join(best, "b", "left").select(F.col("b").alias(body), "parent")


@np.errstate(invalid="ignore", over="ignore")  # infinite and NaN values stay what they are
def _stiller(children: pa.Table, parents: pa.Table, rows: int = 256) -> pa.Table:
    """child, parent, dot: of the bodies of parents (b, total, cells) the best for each one of
    children, so many children at a time; those without any are left out."""
    parents = parents.sort_by("b")
    n, m = children.num_rows, parents.num_rows
    cells = [pa.concat_arrays(x.column("cells").chunks) for x in (children, parents) if x.num_rows]
    if len(cells) < 2:
        return pa.table({"child": children.column("b").slice(0, 0), "parent": parents.column("b").slice(0, 0), "dot": pa.array([], pa.float64())})
    owner = [np.repeat(np.arange(len(c)), c.value_lengths().to_numpy()) for c in cells]
    step, val = ([c.flatten().field(i) for c in cells] for i in (0, 1))
    code = np.split(pc.rank(pa.concat_arrays(step), tiebreaker="dense").to_numpy(), [len(owner[0])])
    null = [v.is_null().to_numpy(zero_copy_only=False) for v in val]
    val = [v.to_numpy(zero_copy_only=False) for v in val]
    shared = np.intersect1d(*code)  # in the order of the steps
    of = [[np.flatnonzero(c == k) for k in shared] for c in code]
    ta, tb = (x.column("total").to_numpy() for x in (children, parents))
    at, dots, nulls, found = [], [], [], []
    for start in range(0, n, rows):
        size = min(rows, n - start)
        dot, met, some = np.zeros((size, m)), np.zeros((size, m), bool), np.zeros((size, m), bool)
        for i, j in zip(*of):
            i = i[slice(*np.searchsorted(owner[0][i], [start, start + size]))]
            met[np.ix_(owner[0][i] - start, owner[1][j])] = True
            i, j = i[~null[0][i]], j[~null[1][j]]
            if len(i) == size and len(j) == m:
                dot += np.multiply.outer(val[0][i], val[1][j])
                some[:] = True
            else:
                here = np.ix_(owner[0][i] - start, owner[1][j])
                dot[here] += np.multiply.outer(val[0][i], val[1][j])
                some[here] = True
        a = ta[start : start + size, None]
        met &= (tb < a) | (np.isnan(a) & ~np.isnan(tb))  # NaN is the largest
        some &= met
        dot *= 100
        whole = np.trunc(dot)
        whole += np.copysign(np.abs(dot - whole) >= 0.5, dot)
        score = np.where(some, whole, -np.inf)
        top, each = score.argmax(1), np.arange(size)
        none = np.flatnonzero(score[each, top] == -np.inf)  # products of minus infinity, null ones, or no stiller body
        top[none] = np.where(some[none].any(1), some[none].argmax(1), met[none].argmax(1))
        kept = np.flatnonzero(met[each, top])
        at.append(kept + start)
        found.append(top[kept])
        dots.append(score[kept, top[kept]] / 100)
        nulls.append(~some[kept, top[kept]])
    at, found, dots, nulls = (np.concatenate(x) for x in (at, found, dots, nulls))
    return pa.table({"child": children.column("b").take(pa.array(at)), "parent": parents.column("b").take(pa.array(found)), "dot": pa.array(dots, mask=nulls)})


def pad(values: Column, size: int, fill: Column) -> Column:
    """The first `size` values of an array, filled up at its end."""
    return F.slice(F.concat(F.coalesce(values, F.array().cast("array<int>")), F.array_repeat(fill, size)), 1, size)


def mask(values: Column, size: int) -> Column:
    """True for the slots of `pad` that hold a value."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: i <= F.coalesce(F.size(values), F.lit(0)))


def group_split(df: DataFrame, key: str, stratum: str | None, share: float) -> DataFrame:
    """key, part ('val' or 'train'): of each stratum's distinct keys, in the order of their md5, at
    least one and else the rounded share (half to even) to val; lone keys of a stratum to train
    (without strata, to val)."""
    by = [stratum] if stratum else []
    k = df.select(key, *by).distinct()
    ranked = grouped_prefix(k.withColumn("__md5", F.md5(F.col(key).cast("string"))), by, ["__md5", key, *by]).withColumnRenamed("rank", "rn")
    n = k.groupBy(*by, *([] if by else [F.lit(1).alias("__one")])).agg(F.count("*").alias("n"))
    ranked = ranked.join(n, by) if by else ranked.withColumn("__one", F.lit(1)).join(n, "__one")
    take = F.greatest(F.lit(1), F.bround(F.col("n") * share).cast("int"))
    if stratum:
        take = F.when(F.col("n") >= 2, take).otherwise(0)
    return ranked.select(key, *by, F.when(F.col("rn") <= take, "val").otherwise("train").alias("part"))
