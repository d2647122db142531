"""Queries of this subpackage's operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.names import PLACEHOLDERS, name_key
from skarn.llm import capping, mixing, overlap, reading, robots, sample, splits, survivor, tokens, vendors
from skarn.operators.catalog import entries, entry_groups
from skarn.operators.units import common_units
from skarn.plans import sql as Q
from skarn.sources.tables import materialize, newest, read_table


def _catalog(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The wanted columns of each entry, once."""
    return materialize(entries(read_table(spark, sf, "catalog_entry").select("entry_id", *columns, "ingested_at")), "catalog")


def _slots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slots with their robots, the catalog and its groups."""
    catalog = _catalog(spark, sf, "source", "path", "family", "dof", "dedup_group_id", "dup_of")
    groups = materialize(entry_groups(catalog), "groups")
    return materialize(robots.slot_robots(read_table(spark, sf, "shard"), catalog, groups), "slotrobots"), catalog, groups


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out slots whose robot is in the training split."""
    return overlap.split_overlaps(_slots(spark, sf)[0]).select("shard", "robot_idx")


def p2_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out slots with the training slot that names the same robot, and the containment."""
    return overlap.split_overlaps(_slots(spark, sf)[0])


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps per split and source."""
    slots = _slots(spark, sf)[0]
    return overlap.overlap_report(slots, overlap.split_overlaps(slots))


def p2_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out slots of each split, as reported; overlaps without a training slot of their robot
    or of less than the asked containment, of which there are none."""
    slots = _slots(spark, sf)[0]
    found = materialize(overlap.split_overlaps(slots), "overlaps")
    train = slots.filter("split = 'train'").select(F.col("shard").alias("train_shard"), F.col("robot_idx").alias("train_robot_idx"), "robot")
    wrong = found.join(train, ["train_shard", "train_robot_idx", "robot"], "left_anti").unionByName(found.filter(F.col("containment") < overlap.CONTAINED), allowMissingColumns=True)
    n = overlap.overlap_report(slots, found).groupBy("split").agg(F.sum("slots").alias("slots"))
    bad = wrong.groupBy(F.col("split").alias("s")).agg(F.count("*").alias("bad"))
    return n.join(bad, F.col("split") == F.col("s"), "left").select("split", "slots", F.coalesce("bad", F.lit(0)).cast("long").alias("wrong"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Slots that are related to a slot of another split."""
    slots, catalog, groups = _slots(spark, sf)
    families = materialize(robots.robot_families(catalog, groups, read_table(spark, sf, "source_ref")), "families")
    return splits.leaking_slots(slots, families)


def _assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slots with their new splits, with their robots, and the families."""
    slots, catalog, groups = _slots(spark, sf)
    families = materialize(robots.robot_families(catalog, groups, read_table(spark, sf, "source_ref")), "families")
    dof = catalog.join(groups, "entry_id").groupBy(F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("robot")).agg(F.max("dof").alias("dof"))
    label = F.when(F.col("dof") >= 13, "13+").when(F.col("dof") >= 7, "7-12").when(F.col("dof") >= 1, "1-6").otherwise("unknown")
    records = splits.components(slots, families).join(dof, "robot", "left").withColumn("label", label)
    return splits.assign_splits(records, ["shard", "robot_idx"], read_table(spark, sf, "split_target")), slots, families


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    """A split for each slot, that all slots of its robot and family share."""
    return _assigned(spark, sf)[0]


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each label that each split got."""
    return splits.split_report(_assigned(spark, sf)[0], read_table(spark, sf, "split_target"))


def p3_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Slots that were assigned, splits they are in, and slots related to one of another of the
    new splits, of which there are none."""
    assigned, slots, families = _assigned(spark, sf)
    assigned = materialize(assigned, "assigned")
    new = slots.drop("split").join(assigned.select("shard", "robot_idx", F.col("new_split").alias("split")), ["shard", "robot_idx"])
    return assigned.agg(F.count("*").alias("slots"), F.countDistinct("new_split").alias("splits")).withColumn("leaking", F.lit(splits.leaking_slots(new, families).count()).cast("long"))


#: No vendor and no source may hold more than this share of the catalog.
MAX_PERMILLE = 50


def _capped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of entries to vendors and sources, kept entries, and the contributors' demand."""
    catalog = _catalog(spark, sf, "source", "vendor", "fidelity_class", "meshes_resolved", "mesh_bytes_total", "scanned_at")
    named = catalog.join(vendors.vendor_names(catalog, read_table(spark, sf, "vendor_ref")), "vendor", "left")
    level = name_key(F.col("fidelity_class"))
    records = named.select(F.col("entry_id").alias("record"), "vendor_name", name_key(F.col("source")).alias("source"), F.when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0).alias("fidelity"), "meshes_resolved", "mesh_bytes_total", "scanned_at")
    records = materialize(records, "records")
    links = records.select("record", F.explode(F.array(F.struct(F.lit("vendor").alias("kind"), F.col("vendor_name").alias("name")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("name")))).alias("c"))
    links = links.select("record", "c.kind", "c.name", F.concat("c.kind", F.lit(":"), "c.name").alias("contributor")).filter("name is not null")
    kept, contributors = capping.cap_contributors(records, links, ["-fidelity", "-meshes_resolved", "-mesh_bytes_total", "-scanned_at"], MAX_PERMILLE)
    return links, kept, contributors


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the vendors whose proposals the matching displaced: those that hold more than a
    twentieth of the catalog."""
    links, _, contributors = _capped(spark, sf)
    over = contributors.filter("displaced > 0").select("contributor")
    return links.filter("kind = 'vendor'").join(over, "contributor", "left_semi").select(F.col("name").alias("vendor"), F.col("record").alias("entry_id"))


def p4_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Which entries of the catalog stay when every vendor and source is capped, and which
    contributor was full of better ones where one does not."""
    return _capped(spark, sf)[1].withColumnRenamed("record", "entry_id")


def p4_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Entries, contributors that keep more than their capacity, and entries that were dropped
    though none of their contributors is full: there are none of either."""
    links, kept, contributors = _capped(spark, sf)
    stay = links.join(kept.filter("kept").select("record"), "record", "left_semi").groupBy("contributor").agg(F.count("*").alias("stay"))
    state = contributors.join(stay, "contributor", "left").withColumn("stay", F.coalesce("stay", F.lit(0)))
    loose = kept.filter("not kept").join(state.filter("stay = capacity").select(F.col("contributor").alias("dropped_by")), "dropped_by", "left_anti")
    over = state.filter("stay > capacity").count()
    return kept.agg(F.count("*").alias("entries")).withColumns({"over_capacity": F.lit(over).cast("long"), "without_reason": F.lit(loose.count()).cast("long")})


DIMENSIONS = ["dof", "scale_class", "vendor"]


def _sampled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """Entries with their categories, the targets, and half the number of entries."""
    catalog = _catalog(spark, sf, "source", "path", "vendor", "dof", "notes", "scale_class", "aabb_extent_m", "dedup_group_id", "dup_of")
    sizes = common_units(catalog, read_table(spark, sf, "source_ref"), entry_groups(catalog)).select("entry_id", "size_class")
    named = catalog.join(vendors.vendor_names(catalog, read_table(spark, sf, "vendor_ref")), "vendor", "left").join(sizes, "entry_id", "left")
    dof = F.when(F.col("dof") >= 13, "13+").when(F.col("dof") >= 7, "7-12").when(F.col("dof") >= 1, "1-6")
    records = materialize(named.select(F.col("entry_id").alias("id"), dof.alias("dof"), F.col("size_class").alias("scale_class"), F.col("vendor_name").alias("vendor")), "dimensions")
    return records, read_table(spark, sf, "sample_target"), records.count() // 2


def p6_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of half the catalog that follows the targets."""
    records, targets, take = _sampled(spark, sf)
    return sample.sample_to_targets(records, targets, DIMENSIONS, take)[0].withColumnRenamed("id", "entry_id")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Each target with what is available, what the sample has, and why it is not met."""
    records, targets, take = _sampled(spark, sf)
    return sample.sample_to_targets(records, targets, DIMENSIONS, take)[1]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that the sample could not meet for want of records."""
    return p6_report(spark, sf).filter("unmet_share or unmet_floor").select("target_id")


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the sample, entries in it more than once, and categories below their minimum though
    they have the records: there are none of either."""
    records, targets, take = _sampled(spark, sf)
    got, report = sample.sample_to_targets(records, targets, DIMENSIONS, take)
    low = report.filter("sampled < least(min_rows, available)").count()
    return got.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("id")).alias("repeated")).withColumn("below_floor", F.lit(low).cast("long"))


def p7_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One record per group of entries, with the best value of each field."""
    catalog = _catalog(spark, sf, "source", "path", "dedup_group_id", "dup_of", "meshes_resolved", "scanned_at", *survivor.COUNTED)
    return survivor.survivors(catalog, materialize(entry_groups(catalog), "groups"), read_table(spark, sf, "source_ref"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The entry of each group that no other entry of it equals or beats in anything."""
    return p7_survivors(spark, sf).filter("dominant and members >= 2").select("group_entry_id", "entry_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_documents(read_table(spark, sf, "documents"))


def _sized(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their tokens, and the report on the sources of the mix."""
    documents = read_table(spark, sf, "documents")
    sized = materialize(tokens.count_tokens(documents, also=("source",)), "sized")
    return sized, mixing.source_report(sized, read_table(spark, sf, "mix_target"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that the mix has fewer tokens of than their weight asks for."""
    return p9_shares(spark, sf).filter("not reached").select("source")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mix: which documents stand where, how often."""
    sized, report = _sized(spark, sf)
    return mixing.mix_sources(sized, materialize(report, "report"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Actual shares of the sources in the mix."""
    sized, report = _sized(spark, sf)
    report = materialize(report, "report")
    return mixing.share_report(mixing.mix_sources(sized, report), report)


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of the targets, documents that the mix repeats more often than allowed, and
    sources it has too much of by more than their longest document: there are none of either."""
    sized, report = _sized(spark, sf)
    report = materialize(report, "report")
    mix = materialize(mixing.mix_sources(sized, report), "mix")
    often = mix.groupBy("doc_id", "source").agg(F.count("*").alias("n")).join(report.select("source", "max_repeats"), "source").filter("n > max_repeats")
    much = mix.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("longest")).join(report.select("source", "goal"), "source").filter("t > goal + longest")
    return report.agg(F.count("*").alias("sources")).withColumns({"too_often": F.lit(often.count()).cast("long"), "too_much": F.lit(much.count()).cast("long")})


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level and difficulty of every document."""
    documents = read_table(spark, sf, "documents")
    return reading.reading_levels(documents, reading.fit(documents, read_table(spark, sf, "reading_rating")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of English prose for specialists."""
    return p10_levels(spark, sf).filter("level = 'specialist'").select("doc_id")


QUERIES = {
    "p2_found": p2_found, "p2_overlaps": p2_overlaps, "p2_report": p2_report, "p2_checks": p2_checks,
    "p3_found": p3_found, "p3_splits": p3_splits, "p3_report": p3_report, "p3_checks": p3_checks,
    "p4_found": p4_found, "p4_capped": p4_capped, "p4_checks": p4_checks,
    "p6_found": p6_found, "p6_sample": p6_sample, "p6_report": p6_report, "p6_checks": p6_checks,
    "p7_found": p7_found, "p7_survivors": p7_survivors, "p8_ids": p8_ids,
    "p9_found": p9_found, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_checks": p9_checks,
    "p10_found": p10_found, "p10_levels": p10_levels,
}

_SLOTS = """(select coalesce(nullif(regexp_replace(lower(split), '[^a-z0-9]+', '', 'g'), ''), '') as s, unnest(names) as name
  from (select *, row_number() over (partition by shard order by written_at desc) as rn from shard) where rn = 1)"""

_FILLED = " + ".join(
    [rf"cast(coalesce(regexp_matches(e.{c}, '\S'), false) as integer)" for c in ("family", "vendor", "license", "fidelity_class", "scale_class")]
    + [f"cast(e.{c} is not null as integer)" for c in ("total_mass", "mesh_bytes_total", "joint_range_total_rad")]
    + ["cast(coalesce(len(e.aabb_extent_m) > 0, false) as integer)"]
)
_BARE = r"regexp_replace(lower(trim({})), '[\s,]+(" + vendors.LEGAL_FORMS + r")\.?$', '')"

ORACLES: dict[str, str] = {
    # what has to hold of results that SQL does not give
    "p2_checks": f"""select case when s like 'val%' or s in ('dev', 'eval') then 'val' else 'test' end as split, count(*) as slots, 0 as wrong
from {_SLOTS} where s in ('val', 'valid', 'validation', 'dev', 'eval', 'test', 'testing', 'tst') group by 1""",
    "p3_checks": f"select count(*) as slots, (select count(*) from split_target where share > 0) as splits, 0 as leaking from {_SLOTS}",
    "p4_checks": "select count(distinct entry_id) as entries, 0 as over_capacity, 0 as without_reason from catalog_entry",
    "p6_checks": "select count(distinct entry_id) // 2 as rows, 0 as repeated, 0 as below_floor from catalog_entry",
    "p9_checks": "select count(*) as sources, 0 as too_often, 0 as too_much from mix_target",
    "p7_found": f"""{Q.GROUPS},
v as (select grp.group_id, e.entry_id, coalesce(-r.t, -2147483647) as a, coalesce(e.meshes_resolved, -1) as b, {_FILLED} as c, coalesce(e.scanned_at, timestamp '0001-01-01') as d
  from e join grp using (entry_id) left join (select {Q.name_key("source")} as k, min(trust_rank) as t from source_ref group by 1) r on r.k = {Q.name_key("e.source")}),
m as (select group_id, max(a) as a, max(b) as b, max(c) as c, max(d) as d, count(*) as n from v group by 1),
best as (select v.group_id, v.entry_id from v join m on v.group_id = m.group_id and v.a = m.a and v.b = m.b and v.c = m.c and v.d = m.d where m.n >= 2)
select group_id as group_entry_id, min(entry_id) as entry_id from best group by 1 having count(*) = 1""",
    "p4_found": f"""with names as (select vendor as v, unnest([vendor, full_name] || coalesce(aliases, []::varchar[])) as t from vendor_ref),
keys as (select key, min(v) as v from (select distinct v, unnest([{Q.name_key("t")}, {Q.name_key(_BARE.format("t"))}]) as key from names) where key is not null group by 1 having count(distinct v) = 1),
texts as (select distinct vendor as t from catalog_entry where lower(trim(vendor)) not in ('', {", ".join(repr(x) for x in PLACEHOLDERS)})),
tried as (select distinct t, unnest([{Q.name_key("t")}, {Q.name_key(_BARE.format("t"))}]) as key from texts),
exact as (select t, min(v) as v from tried join keys using (key) group by 1 having count(distinct v) = 1),
close as (select x.t, min(k.v) as v from (select * from tried where t not in (select t from exact)) x join keys k on damerau_levenshtein(x.key, k.key) <= 1 and length(x.key) > 4 and length(k.key) > 4 and not regexp_matches(x.key || k.key, '[0-9]') group by 1 having count(distinct k.v) = 1),
known as (select * from exact union all select * from close), e as (select entry_id, vendor from {Q.ENTRIES}),
named as (select k.v as vendor, e.entry_id from e join known k on k.t = e.vendor)
select vendor, entry_id from named where vendor in (select vendor from named group by 1 having count(*) > (select count(*) from e) * 50 // 1000)""",
}
