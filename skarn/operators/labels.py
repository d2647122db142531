"""Labels of mesh faces: user labels over predicted ones, and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.graph import connected_components
from skarn.operators.prefix import grouped_prefix


def merge_labels(faces: DataFrame, mesh: str, face: str, cluster: str, user: str, share: float = 0.30) -> DataFrame:
    """mesh, face, label: user labels laid over predicted clusters.

    A cluster of which more than `share` of the faces has one user label takes it whole; in others
    only the tagged faces do. What is left of the other clusters is numbered on from the largest
    user label in the order of the clusters' first faces; faces without a cluster keep -1. Of
    several user labels of one cluster the commonest counts, the one seen first winning ties.
    """
    keys = [mesh, cluster]
    n = faces.filter(F.col(cluster) >= 0).groupBy(*keys).agg(F.count("*").alias("__n"))
    top = faces.filter((F.col(cluster) >= 0) & F.col(user).isNotNull()).groupBy(*keys, user).agg(F.count("*").alias("__k"), F.min(face).alias("__f"))
    top = top.groupBy(*keys).agg(F.max(F.struct("__k", (-F.col("__f")).alias("f"), user)).alias("t")).select(*keys, F.col("t.__k").alias("__k"), F.col(f"t.{user}").alias("__u"))
    c = n.join(top, keys, "left").withColumn("__take", F.when(F.col("__k") / F.col("__n") > share, F.col("__u")))
    rows = faces.join(c.select(*keys, "__take"), keys, "left").withColumn("__set", F.coalesce(user, "__take"))
    rest = rows.filter(F.col("__set").isNull() & (F.col(cluster) >= 0)).groupBy(*keys).agg(F.min(face).alias("__first"))
    rest = grouped_prefix(rest, [mesh], ["__first", mesh, cluster]).select(*keys, F.col("rank").alias("__rank"))
    base = faces.groupBy(mesh).agg(F.coalesce(F.max(user), F.lit(-1)).alias("__base"))
    out = rows.join(rest, keys, "left").join(base, mesh)
    return out.select(mesh, face, F.when(F.col("__set").isNotNull(), F.col("__set")).when(F.col(cluster) >= 0, F.col("__base") + F.col("__rank")).otherwise(-1).cast("int").alias("label"))


def changed_labels(df: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """by, rows, changed, labels_before, labels_after."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("changed"), F.countDistinct(before).alias("labels_before"), F.countDistinct(after).alias("labels_after"))


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon: a ray to the right crosses its edges an odd number of times."""
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if ay == by:
            continue
        crosses = ((F.lit(float(ay)) > y) != (F.lit(float(by)) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        odd = odd != crosses
    return odd


def whole_faces(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh, face, label of the faces whose three corners (v0, v1, v2) have one label >= 0.

    vertices: mesh, v, label. Each face's corners meet their vertices in one equi-join."""
    c = faces.select("mesh", "face", F.explode(F.array("v0", "v1", "v2")).alias("v")).join(vertices.select("mesh", "v", "label"), ["mesh", "v"])
    g = c.groupBy("mesh", "face").agg(F.min("label").alias("label"), F.max("label").alias("most"), F.count("*").alias("n"))
    return g.filter("label = most and label >= 0 and n = 3").select("mesh", "face", "label")


def mesh_volumes(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh, volume, cx, cy, cz of closed meshes, as sums over signed tetrahedra. vertices: mesh, v,
    x, y, z. A mesh without volume has a null centre."""
    at = lambda k: vertices.select("mesh", F.col("v").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
    f = faces.join(at(0), ["mesh", "v0"]).join(at(1), ["mesh", "v1"]).join(at(2), ["mesh", "v2"])
    c = {k: [F.col(f"{n}{k}") for n in "xyz"] for k in range(3)}
    v = (c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])) / 6
    f = f.withColumn("__v", v)
    mid = [F.try_divide(F.sum(F.col("__v") * (c[0][i] + c[1][i] + c[2][i]) / 4), F.sum("__v")).alias(f"c{n}") for i, n in enumerate("xyz")]
    return f.groupBy("mesh").agg(F.sum("__v").alias("volume"), *mid)


def face_edges(faces: DataFrame) -> DataFrame:
    """mesh, face, a, b: the three edges of each face (v0, v1, v2), a < b."""
    ends = F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("v0", "v1"), ("v1", "v2"), ("v0", "v2"))])
    return faces.select("mesh", "face", F.explode(ends).alias("e")).select("mesh", "face", "e.a", "e.b").filter("a < b")


def face_adjacency(faces: DataFrame) -> DataFrame:
    """mesh, f1, f2, a, b: pairs of faces f1 < f2 that share the edge a, b. An edge is taken to have
    two faces; of more, as in broken meshes, each meets the first, so nothing is paired with all."""
    e = face_edges(faces)
    first = e.groupBy("mesh", "a", "b").agg(F.min("face").alias("f1"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return e.join(first, ["mesh", "a", "b"]).filter("face > f1").select("mesh", "f1", F.col("face").alias("f2"), "a", "b")


def label_boundaries(adjacency: DataFrame, labels: DataFrame) -> DataFrame:
    """mesh, la, lb, a, b: the shared edges of faces of two labels >= 0, the smaller label first.
    labels: mesh, face, label."""
    of = lambda f, name: labels.select("mesh", F.col("face").alias(f), F.col("label").alias(name))
    j = adjacency.join(of("f1", "l1"), ["mesh", "f1"]).join(of("f2", "l2"), ["mesh", "f2"]).filter("l1 <> l2 and l1 >= 0 and l2 >= 0")
    return j.select("mesh", F.least("l1", "l2").alias("la"), F.greatest("l1", "l2").alias("lb"), "a", "b")


def label_parts(adjacency: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """mesh, face, label, part, size: connected faces of one label, numbered from 0 in each mesh by
    their smallest face; parts of fewer than `least` faces have part -1."""
    key = lambda m, f: F.struct(F.col(m).alias("mesh"), F.col(f).alias("face"))
    of = lambda f, name: labels.select("mesh", F.col("face").alias(f), F.col("label").alias(name))
    same = adjacency.join(of("f1", "l1"), ["mesh", "f1"]).join(of("f2", "l2"), ["mesh", "f2"]).filter("l1 = l2")
    comp = connected_components(same.select(key("mesh", "f1").alias("src"), key("mesh", "f2").alias("dst")))
    comp = comp.select(F.col("node.mesh").alias("mesh"), F.col("node.face").alias("face"), F.col("component.face").alias("first"))
    rows = labels.join(comp, ["mesh", "face"], "left").withColumn("first", F.coalesce("first", "face"))
    size = rows.groupBy("mesh", "first").agg(F.count("*").alias("size"))
    ids = grouped_prefix(size.filter(F.col("size") >= least).select("mesh", "first"), ["mesh"], ["first", "mesh"]).select("mesh", "first", (F.col("rank") - 1).alias("part"))
    return rows.join(size, ["mesh", "first"]).join(ids, ["mesh", "first"], "left").select("mesh", "face", "label", F.coalesce("part", F.lit(-1)).cast("long").alias("part"), "size")
