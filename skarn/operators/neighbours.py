"""Nearest neighbours by grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.sources.tables import materialize


def nearest(queries: DataFrame, points: DataFrame, k: int, cell: float, max_rounds: int = 40) -> DataFrame:
    """id, pid, distance, place (1..k): the k nearest points of each query, ties by pid.

    queries: id, x, y, z; points: pid, x, y, z. Queries meet the points of the 27 cells around
    them in an equi-join. A query is settled when it has k hits no farther than one cell, since
    nothing outside the cells can be nearer; the others try again with cells twice as wide, until
    cells are as wide as the whole cloud. Fewer than k points give fewer rows; null coordinates
    have no neighbours.
    """
    xyz = ["x", "y", "z"]
    whole = lambda df: df.dropna(subset=xyz)
    q, p = materialize(whole(queries).select("id", *xyz), "queries"), materialize(whole(points).select("pid", *xyz), "points")
    ends = p.select(*xyz).unionByName(q.select(*xyz)).agg(*[F.max(c) - F.min(c) for c in xyz]).first()
    widest = max((float(e) for e in ends if e is not None), default=0.0)
    out = None
    for _ in range(max_rounds):
        at = lambda c: F.floor(F.col(c) / cell)  # noqa: E731, B023
        home = p.select("pid", *[F.col(c).alias(f"p{c}") for c in xyz], *[at(c).alias(f"c{c}") for c in xyz])
        step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        asked = q.select("id", *xyz, *[at(c).alias(f"b{c}") for c in xyz])
        for c in xyz:
            asked = asked.withColumn("s", step).withColumn(f"c{c}", F.col(f"b{c}") + F.col("s")).drop("s", f"b{c}")
        d = F.sqrt(sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in xyz[1:]), (F.col("x") - F.col("px")) * (F.col("x") - F.col("px"))))
        hits = asked.join(home, [f"c{c}" for c in xyz]).select("id", "pid", d.alias("distance"))
        hits = hits.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("distance", "pid"))).filter(F.col("place") <= k)
        hits = materialize(hits, "hits")
        if cell >= widest:
            return hits if out is None else out.unionByName(hits)
        done = hits.filter((F.col("place") == k) & (F.col("distance") <= cell)).select("id")
        settled = hits.join(done, "id", "left_semi")
        out = settled if out is None else out.unionByName(settled)
        q = materialize(q.join(done, "id", "left_anti"), "queries")
        if not q.limit(1).count():
            return out
        cell *= 2
    raise RuntimeError("neighbours were not found in time")
