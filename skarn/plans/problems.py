"""Queries of the general operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators.catalog import entries, entry_groups
from skarn.operators.hierarchy import cycle_links, link_forest
from skarn.operators.units import common_units
from skarn.sources.tables import materialize, newest, read_table


def p1_extents(spark: SparkSession, sf: str) -> DataFrame:
    """Every box and class in metres."""
    catalog = materialize(entries(read_table(spark, sf, "catalog_entry").select("entry_id", "source", "path", "dedup_group_id", "dup_of", "notes", "scale_class", "aabb_extent_m", "ingested_at")), "catalog")
    return common_units(catalog, read_table(spark, sf, "source_ref"), entry_groups(catalog))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose box is not in metres."""
    return p1_extents(spark, sf).filter(F.col("unit") != "m").select("entry_id", "unit")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Links on cycles, of both tables of examples."""
    shard = cycle_links(read_table(spark, sf, "shard_example"), "example_id", "joint_topology", "joint_valid", "nested", "created_at")
    train = cycle_links(read_table(spark, sf, "training_example"), "example_id", "joint_parents", "joint_children", "flat", "created_at")
    return shard.unionByName(train)


def p5_links(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth, root and descendants of every link of both tables of examples."""
    shard = newest(read_table(spark, sf, "shard_example").select("example_id", "joint_topology", "joint_valid", "created_at"), "example_id", "created_at")
    train = newest(read_table(spark, sf, "training_example").select("example_id", "joint_parents", "joint_children", "created_at"), "example_id", "created_at")
    return link_forest(shard, "example_id", "joint_topology", "joint_valid", "nested").unionByName(link_forest(train, "example_id", "joint_parents", "joint_children", "flat"))


QUERIES = {"p1_found": p1_found, "p1_extents": p1_extents, "p5_found": p5_found, "p5_links": p5_links}

ORACLES = {
    "p5_found": """
with recursive s as (select * from (select *, row_number() over (partition by example_id order by created_at desc nulls last) as rn from shard_example) where rn = 1),
g as (select * from (select *, row_number() over (partition by example_id order by created_at desc nulls last) as rn from training_example) where rn = 1),
joint as (
  select distinct example_id, t[1] as p, t[2] as c
  from (select example_id, unnest(joint_topology) as t, unnest(joint_valid) as ok from s)
  where ok and t[1] >= 0 and t[2] >= 0
  union
  select distinct example_id, p, c
  from (select example_id, unnest(joint_parents) as p, unnest(joint_children) as c from g)
  where p >= 0 and c >= 0),
walk as (
  select example_id, p as origin, c as place from joint
  union
  select w.example_id, w.origin, j.c from walk w join joint j on j.example_id = w.example_id and j.p = w.place)
select distinct example_id, cast(origin as integer) as link from walk where origin = place""",
}
