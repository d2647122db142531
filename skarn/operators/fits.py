"""Rigid motions and circles fitted to groups of any size.

Both fits need sums only. Spark adds them up as partial aggregates, so a group of a third of all
rows is spread over all tasks, and one small matrix per group is then solved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators import vectors as V
from skarn.operators.estimate import screw
from skarn.sources.tables import ship


def _centred(df: DataFrame, keys: list[str], names: str) -> DataFrame:
    """df without rows that lack a coordinate, with the group's size n and coordinates c<name>
    about its mean m<name>."""
    d = df.select(*keys, *names).dropna(subset=list(names))
    m = d.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in names])
    return d.join(m, keys).withColumns({f"c{c}": F.col(c) - F.col(f"m{c}") for c in names})


def rigid_fits(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, amount, axis, rotation, shift, residual: the motion that takes points x, y, z
    onto u, v, w with least squares in each group, never mirroring, and its screw. Rows that lack
    a coordinate are left out; a null key is a group."""
    ship(df.sparkSession)
    c = _centred(df, keys, "xyzuvw")
    cross = [F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"h{a}{b}") for a in "xyz" for b in "uvw"]
    size = F.sum(sum((F.col(f"c{a}") * F.col(f"c{a}") for a in "yzuvw"), F.col("cx") * F.col("cx"))).alias("ss")
    s = c.groupBy(*keys, "n", *[f"m{a}" for a in "xyzuvw"]).agg(*cross, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for r in d.to_dict("records"):
                h = np.array([[r[f"h{a}{b}"] for b in "uvw"] for a in "xyz"])
                u, _, vt = np.linalg.svd(h)
                turn = vt.T @ np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0]) @ u.T
                shift = np.array([r["mu"], r["mv"], r["mw"]]) - turn @ np.array([r["mx"], r["my"], r["mz"]])
                way = screw(turn, shift)
                left = max(r["ss"] - 2 * np.trace(turn @ h), 0.0) / r["n"]
                out.append((*[r[k] for k in keys], way["kind"], float(way["amount"]), way["axis"].tolist(), turn.ravel().tolist(), shift.tolist(), float(np.sqrt(left))))
            yield pd.DataFrame(out, columns=[*keys, "kind", "amount", "axis", "rotation", "shift", "residual"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return s.mapInPandas(run, f"{kinds}, kind string, amount double, axis array<double>, rotation array<double>, shift array<double>, residual double")


def circle_fits(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, centre, normal, radius, residual, score: the circle through each group's points x,
    y, z: the plane of least spread, a linear fit in it, the root mean square distance from the
    plane, and exp(-4 x mean distance from the circle / radius). Fewer than three points have
    radius 0, an infinite residual and score 0. The distances need a second pass over the rows."""
    ship(df.sparkSession)
    c = _centred(df, keys, "xyz")
    at = [F.col("cx"), F.col("cy"), F.col("cz")]
    order2 = [(i, j) for i in range(3) for j in range(i, 3)]
    order3 = [(i, j, k) for i, j in order2 for k in range(j, 3)]
    sums = [F.sum(at[i] * at[j]).alias(f"s{i}{j}") for i, j in order2] + [F.sum(at[i] * at[j] * at[k]).alias(f"s{i}{j}{k}") for i, j, k in order3]
    s = c.groupBy(*keys, "n", "mx", "my", "mz").agg(*sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for r in d.to_dict("records"):
                m2 = np.array([[r["s" + "".join(map(str, sorted(x)))] for x in ((i, 0), (i, 1), (i, 2))] for i in range(3)])
                m3 = np.array([[[r["s" + "".join(map(str, sorted((i, j, k))))] for k in range(3)] for j in range(3)] for i in range(3)])
                _, axes = np.linalg.eigh(m2)
                p, q, normal = axes[:, 2], axes[:, 1], axes[:, 0]
                uv = np.stack([p, q])
                second, third = uv @ m2 @ uv.T, np.einsum("ijk,ai,bj,ck->abc", m3, uv, uv, uv)
                a = np.zeros((3, 3))
                a[:2, :2], a[2, 2] = 4 * second, r["n"]
                b = np.array([2 * (third[0, 0, 0] + third[0, 1, 1]), 2 * (third[1, 0, 0] + third[1, 1, 1]), np.trace(second)])
                mid = np.linalg.lstsq(a, b, rcond=None)[0]
                radius = float(np.sqrt(max(mid[2] + mid[0] ** 2 + mid[1] ** 2, 0.0))) if r["n"] >= 3 else 0.0
                centre = np.array([r["mx"], r["my"], r["mz"]]) + (mid[0] * p + mid[1] * q if r["n"] >= 3 else 0)
                out.append((*[r[k] for k in keys], r["n"], centre.tolist(), (normal if r["n"] >= 3 else np.array([0.0, 0.0, 1.0])).tolist(), radius))
            yield pd.DataFrame(out, columns=[*keys, "n", "centre", "normal", "radius"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    found = s.mapInPandas(run, f"{kinds}, n bigint, centre array<double>, normal array<double>, radius double")
    rel = V.minus(F.array("x", "y", "z"), F.col("centre"))
    high = V.dot(rel, F.col("normal"))
    off = F.abs(F.sqrt(F.greatest(V.dot(rel, rel) - high * high, F.lit(0.0))) - F.col("radius"))
    j = df.select(*keys, "x", "y", "z").dropna(subset=["x", "y", "z"]).join(found, keys)
    few = F.col("n") < 3
    score = F.exp(-4 * F.avg(off) / F.greatest(F.col("radius"), F.lit(1e-9)))
    return j.groupBy(*keys, "n", "centre", "normal", "radius").agg(F.sqrt(F.avg(high * high)).alias("r"), score.alias("s")).select(*keys, "n", "centre", "normal", "radius", F.when(few, float("inf")).otherwise(F.col("r")).alias("residual"), F.when(few, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s")))).alias("score"))


def boundary_joints(boundary: DataFrame, centres: DataFrame, least_edges: int = 6, revolute: float = 0.55) -> DataFrame:
    """mesh, la, lb, kind, origin, axis, radius, edges, confidence of the joint between two labels,
    from the vertices on their boundary.

    boundary: mesh, la, lb (parent and child), edges (of the pair), x, y, z per vertex; centres:
    mesh, label, centre. Fewer edges than least_edges or than three vertices make a fixed joint
    along z in the middle of the labels' centres, of confidence 0; else the circle through the
    vertices gives origin and axis, turned towards the child, and a revolute joint if its score
    is at least `revolute`, a fixed one if not."""
    keys = ["mesh", "la", "lb", "edges"]
    f = circle_fits(boundary, keys)
    of = lambda side: centres.select("mesh", F.col("label").alias(side), F.col("centre").alias(f"c_{side}"))
    j = f.join(of("la"), ["mesh", "la"], "left").join(of("lb"), ["mesh", "lb"], "left")
    poor = (F.col("edges") < least_edges) | (F.col("n") < 3)
    ahead = V.dot(V.minus(F.col("c_lb"), F.col("c_la")), F.col("normal")) >= 0
    axis = F.when(poor, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).when(ahead, F.col("normal")).otherwise(V.times(F.col("normal"), F.lit(-1.0)))
    origin = F.when(poor, V.times(V.plus(F.col("c_la"), F.col("c_lb")), F.lit(0.5))).otherwise(F.col("centre"))
    return j.select("mesh", "la", "lb", F.when(~poor & (F.col("score") >= revolute), "revolute").otherwise("fixed").alias("kind"), origin.alias("origin"), axis.alias("axis"), F.when(poor, 0.0).otherwise(F.col("radius")).alias("radius"), "edges", F.when(poor, 0.0).otherwise(F.col("score")).alias("confidence"))


def joint_source(geometric: Column, motion: Column, model: Column) -> Column:
    """The joint (struct of kind, axis and origin) that counts: the geometric one, else the motion's
    as revolute, else the model's, else a fixed one along z; with where it came from."""
    fixed = F.struct(F.lit("fixed").alias("kind"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("axis"), F.array(*[F.lit(0.0)] * 3).alias("origin"))
    pick = lambda name, s, kind=None: F.struct(F.lit(name).alias("origin_of"), (F.lit(kind) if kind else s["kind"]).alias("kind"), s["axis"].alias("axis"), s["origin"].alias("origin"))
    return F.when(geometric.isNotNull(), pick("geometric", geometric)).when(motion.isNotNull(), pick("motion", motion, "revolute")).when(model.isNotNull(), pick("model", model)).otherwise(pick("default", fixed))
