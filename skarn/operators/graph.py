"""Graph operators: components, levels, adjacency and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.sources.tables import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the component is its smallest node. Nodes are those of the edges.

    Minimum-label propagation with pointer jumping. Each round takes the minimum over
    neighbours as a partial aggregate before its shuffle, so a hub that holds a third of all
    edges sends one row per task; labels are unique per node, so the joins are 1:n and AQE can
    split a hot side. Every round is written to the shared folder, which cuts the lineage.
    Null ends and self loops are ignored; no edges give no rows. Raises if labels still change
    after max_rounds (the number of rounds grows with the logarithm of the longest chain).
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v")
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = materialize(e.select(ways.alias("w")).select("w.u", "w.v").distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("m"))
        lower = labels.join(seen, F.col("node") == F.col("u"), "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = lower.join(up, "label", "left").select("node", F.least("label", "above").alias("label"), (F.least("label", "above") < F.col("old")).alias("moved"))
        after = materialize(jumped, "labels")
        discard(labels)
        labels = after
        if not after.filter("moved").limit(1).count():
            discard(both)
            return after.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
