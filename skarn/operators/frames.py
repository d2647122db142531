"""Frames along trees, axes of groups, close pairs and boards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators import vectors as V
from skarn.operators.graph import connected_components
from skarn.operators.prefix import grouped_prefix
from skarn.sources.tables import discard, materialize


def compose_frames(df: DataFrame, node: str, parent: str, rotation: str, shift: str, max_rounds: int = 64) -> DataFrame:
    """node, r, t: each node's frame in its root's, from frames relative to their parents.

    Pointer doubling: each round joins a node's frame with its ancestor's, so the distance doubles.
    Nodes must be unique; one whose parent is null, absent or itself is a root and keeps its own
    frame. Raises where parents form a cycle."""
    rows = df.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.col(rotation).alias("r"), F.col(shift).alias("t"))
    known = rows.select(F.col("node").alias("up"), F.lit(True).alias("has"))
    state = materialize(rows.join(known, "up", "left").select("node", F.when(F.col("has") & (F.col("up") != F.col("node")), F.col("up")).alias("up"), "r", "t"), "frames")
    for _ in range(max_rounds):
        if not state.filter("up is not null").limit(1).count():
            return state.select("node", "r", "t")
        above = state.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("r").alias("ra"), F.col("t").alias("ta"))
        moved = state.filter("up is not null").join(above, "up").select("node", F.col("far").alias("up"), V.matmul(F.col("ra"), F.col("r")).alias("r"), V.move(F.col("ra"), F.col("ta"), F.col("t")).alias("t"))
        after = materialize(state.filter("up is null").unionByName(moved), "frames")
        discard(state)
        state = after
    raise RuntimeError("the parents form a cycle")


def mean_axes(df: DataFrame, group: str, order: list[str], axis: str) -> DataFrame:
    """group, axis, n, spread: the mean direction of undirected axes, each turned to the side of the
    group's first one, and the largest angle from it in degrees."""
    first = df.groupBy(group).agg(F.min(F.struct(*order, axis)).alias("f")).select(group, F.col(f"f.{axis}").alias("__first"))
    a = df.join(first, group).withColumn("__a", V.times(F.col(axis), F.when(V.dot(F.col(axis), F.col("__first")) < 0, -1.0).otherwise(1.0)))
    m = a.groupBy(group).agg(*[F.avg(F.col("__a")[i]).alias(f"m{i}") for i in range(3)], F.count("*").alias("n")).select(group, "n", V.unit(F.array("m0", "m1", "m2")).alias("mean"))
    return a.join(m, group).groupBy(group, "n", "mean").agg(F.max(V.axis_angle_error(F.col(axis), F.col("mean"))).alias("spread")).select(group, F.col("mean").alias("axis"), "n", "spread")


def pairs_within(points: DataFrame, key: str, tolerance: float) -> DataFrame:
    """a, b, distance for pairs a < b of points (key, x, y, z) nearer than the tolerance. Points meet
    those of the 27 cells of that width around them, so only near ones are compared."""
    cell = [F.floor(F.col(c) / tolerance).alias(f"c{c}") for c in "xyz"]
    home = points.dropna(subset=["x", "y", "z"]).select(F.col(key).alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *cell)
    ask = points.dropna(subset=["x", "y", "z"]).select(F.col(key).alias("a"), "x", "y", "z", *cell)
    for c in "xyz":
        ask = ask.withColumn("s", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("s")).drop("s")
    d = F.sqrt((F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")) + (F.col("z") - F.col("bz")) * (F.col("z") - F.col("bz")))
    return ask.join(home, ["cx", "cy", "cz"]).filter("a < b").select("a", "b", d.alias("distance")).filter(F.col("distance") < tolerance)


def merge_close(points: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, body: points joined through pairs nearer than the tolerance, numbered without gaps."""
    comp = connected_components(pairs_within(points, key, tolerance), "a", "b")
    all_ = points.select(key).join(comp.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("component"))
    ids = grouped_prefix(all_.select("component").distinct(), [], ["component"]).select("component", (F.col("rank") - 1).alias("body"))
    return all_.join(ids, "component").select(key, "body")


def match_or_reject(rows: DataFrame, key: str, table: DataFrame, other: str, reason: str) -> DataFrame:
    """rows with the table's columns where the keys meet, and `rejected`: the reason where not."""
    hit = table.withColumn("__hit", F.lit(True))
    return rows.join(hit, F.col(key) == F.col(other), "left").withColumn("rejected", F.when(F.col("__hit").isNull(), reason)).drop("__hit")


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Red, green and blue of a hue in [0, 1)."""
    k = lambda n: F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
    part = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(k(n), 4 - k(n), F.lit(1.0)))
    return F.array(part(5), part(3), part(1))


def palette(label: Column) -> Column:
    """A colour per label: hues a golden ratio apart."""
    return hsv_to_rgb(F.pmod(label * 0.618033988749895, F.lit(1.0)), F.lit(0.65), F.lit(0.95))


def marker_centre(marker: Column, columns: int, side: float, gap: float) -> Column:
    """Centre of a marker on a board, from its number."""
    step = side + gap
    return F.array(F.pmod(marker, F.lit(columns)) * step + side / 2, F.floor(marker / columns) * step + side / 2)


def ray_through(px: Column, py: Column, f: float, cx: float, cy: float) -> Column:
    """Unit ray of a pixel."""
    return V.unit(F.array((px - cx) / f, (py - cy) / f, F.lit(1.0)))


def focal_of_view(width: float, degrees: float) -> float:
    """The focal length in pixels of a camera that sees so many degrees across its width."""
    return width / (2 * math.tan(math.radians(degrees) / 2))


def sweep_poses(joints: int, angle: float) -> list[tuple[int, float]]:
    """(joint, angle) of the home pose (joint -1) and of each joint turned there and back."""
    return [(-1, 0.0)] + [(j, a) for j in range(joints) for a in (angle, -angle)]


def topology_mode(parents: Column) -> Column:
    """auto without joints, serial where no link has two children, else tree."""
    kids = F.filter(F.coalesce(parents, F.array().cast("array<int>")), lambda p: p >= 0)
    return F.when(F.coalesce(F.size(parents), F.lit(0)) == 0, "auto").when(F.size(F.array_distinct(kids)) == F.size(kids), "serial").otherwise("tree")


def link_name(i: Column) -> Column:
    return F.when(i == 0, "base").otherwise(F.concat(F.lit("link"), i.cast("string")))


def default_physics(dof: Column) -> Column:
    """Default damping, friction, effort and speed per joint."""
    n = F.coalesce(dof, F.lit(0))
    return F.struct(*[F.array_repeat(F.lit(x), n).alias(k) for k, x in (("damping", 0.1), ("friction", 0.05), ("effort", 100.0), ("velocity", 2.0))])


PRIOR = "robot_class string, expected_dof int, expected_link_count int, expected_chain_topology string, visible_joints array<struct<description: string, axis_hint: string, location: string>>, confidence double, visual_summary string"
CRITIQUE = "matches_well boolean, overall_score double, issues array<struct<type: string, severity: string, description: string, affected_links: array<int>, suggested_action: string>>, auto_fix_merges array<struct<target: int, sources: array<int>, rationale: string>>, summary string"


def read_critiques(df: DataFrame, text: str) -> DataFrame:
    """df with critique (merges without a target or sources left out) and severe: whether an issue
    is high or critical."""
    c = df.withColumn("critique", F.from_json(text, CRITIQUE))
    merges = F.filter(F.coalesce("critique.auto_fix_merges", F.array().cast("array<struct<target: int, sources: array<int>, rationale: string>>")), lambda m: m["target"].isNotNull() & (F.coalesce(F.size(m["sources"]), F.lit(0)) > 0))
    severe = F.coalesce(F.exists("critique.issues", lambda i: i["severity"].isin("high", "critical")), F.lit(False))
    return c.withColumns({"critique": F.col("critique").withField("auto_fix_merges", merges), "severe": severe})


def read_priors(df: DataFrame, text: str) -> DataFrame:
    """df with prior (typed, defaults filled) and trusted: confidence of at least 0.7."""
    p = df.withColumn("prior", F.from_json(text, PRIOR))
    conf = F.coalesce("prior.confidence", F.lit(0.0))
    return p.withColumns({"prior": F.col("prior").withField("confidence", conf).withField("expected_chain_topology", F.coalesce("prior.expected_chain_topology", F.lit("serial"))), "trusted": conf >= 0.7})
