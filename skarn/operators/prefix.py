"""Ranks and running sums of groups of any size.

A window over a hot group would sort it in one task. Here the rows are range-partitioned by the
order, each partition is ranked by itself, and the groups' totals per partition (one row per
group and partition) give each partition its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.sources.tables import materialize


def grouped_prefix(df: DataFrame, group: list[str], order: list, value: str | None = None) -> DataFrame:
    """df with `rank` (from 1) and, if a value is named, `before`: the sum of the values of the
    rows before it in its group. Nulls in group columns form a group; a null value counts 0.

    order must end in a unique column, so that equal rows cannot fill a partition and a repeated
    task gives the same ranks. The partitioned rows are written to the shared folder once, so
    that ranks and starts see the same partitions.
    """
    num = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    parts = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "parts")
    total = parts.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.sum(num).alias("__s"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s0"))
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    out = parts.withColumn("__rn", F.row_number().over(inside))
    if value:
        out = out.withColumn("__rs", F.coalesce(F.sum(num).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("__part") == F.col("__p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    out = out.join(start, same)
    return out.select(*df.columns, (F.col("__rn") + F.col("__n0")).alias("rank"), *([(F.col("__rs") + F.col("__s0")).alias("before")] if value else []))
