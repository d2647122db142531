"""Catalog queries: classification, reports, canonical records, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions import catalog as C
from skarn.functions.names import known, name_key
from skarn.operators import reports as R
from skarn.operators.catalog import entries, entry_groups
from skarn.operators.units import longest_side, scale_class
from skarn.plans import sql as Q
from skarn.sources.tables import materialize, newest, read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return entries(read_table(spark, sf, "catalog_entry"))


_TRAINABLE = "coalesce(status = 'ok' and dof >= 1 and coalesce(meshes_resolved, 0) + coalesce(meshes_unresolved, 0) > 0 and meshes_resolved / nullif(coalesce(meshes_resolved, 0) + coalesce(meshes_unresolved, 0), 0) >= 0.8, false)"
_STATUS = "case when status like 'load_failed%' then 'load_failed' when status like 'parse_failed%' then 'parse_failed' when status like 'skipped%' then 'skipped' else status end"


@query(f"""select {Q.name_key("source")} as source, {_STATUS} as status, count(*) as n, count(*) filter ({_TRAINABLE}) as n_trainable
from {Q.ENTRIES} group by all""")
def catalog_trainable(spark, sf):
    """Entries and trainable entries by source and kind of status."""
    ok = C.trainable(F.col("status"), F.col("dof"), F.col("meshes_resolved"), F.col("meshes_unresolved"))
    return _entries(spark, sf).groupBy(name_key(F.col("source")).alias("source"), C.status_class(F.col("status")).alias("status")).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_trainable"))


@query(f"""select case when mesh_bytes_total >= 5000000 then 'high' when mesh_bytes_total >= 500000 then 'medium' when mesh_bytes_total > 0 then 'low' else 'unknown' end as fidelity,
case when dof >= 13 then '13+' when dof >= 7 then '7-12' when dof >= 1 then '1-6' else 'unknown' end as dofs,
case when m is null or m <= 0 then 'unknown' when m > 50 then 'unit_bug' when m > 2.5 then 'huge' when m >= 1 then 'fullsize' when m >= 0.3 then 'tabletop' else 'compact' end as size, count(*) as n
from (select *, list_max(aabb_extent_m) as m from {Q.ENTRIES}) group by all""")
def size_buckets(spark, sf):
    """Entries by fidelity, degrees of freedom and size of the box as recorded."""
    e = _entries(spark, sf)
    return e.groupBy(C.fidelity_of_bytes(F.col("mesh_bytes_total")).alias("fidelity"), C.dof_bucket(F.col("dof")).alias("dofs"), scale_class(longest_side(F.col("aabb_extent_m"))).alias("size")).agg(F.count("*").alias("n"))


_STEM = r"regexp_replace(list_extract(string_split(lower(path), '/'), -1), '(.)\.[^.]*$', '\1')"
_GENERIC = "(" + ", ".join(f"'{x}'" for x in C.GENERIC_LEAVES) + ")"
_LEAF = f"""case when (s in {_GENERIC} or length(s) < 3) and u <> '' and u not in {_GENERIC} then u else s end"""
_LEAF_FROM = f"""(select *, regexp_replace({_STEM}, '_(description|urdf|xml|robot|model|mjcf|scene)$', '') as s,
regexp_replace(coalesce(list_extract(string_split(lower(path), '/'), -2), ''), '_(description|urdf|xml|robot|model|mjcf|scene|support)$', '') as u from {Q.ENTRIES})"""


@query(f"select entry_id, {_LEAF} as leaf, coalesce(regexp_matches({_STEM}, '^scene$|^scene_|_scene$'), false) as is_scene from {_LEAF_FROM}")
def model_leaves(spark, sf):
    """The name that identifies each entry's model, and whether it is a scene file."""
    return _entries(spark, sf).select("entry_id", C.model_leaf(F.col("path")).alias("leaf"), F.coalesce(C.is_scene(F.col("path")), F.lit(False)).alias("is_scene"))


_TAIL = r"""case when lower(path) like '%/%' then regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(lower(path), strpos(path, '/') + 1),
 '^urdf_files/random/[^/]+/?|^urdf_files/', ''), '^urdfs/robots/', ''), '^(data|examples)/((data|examples|pybullet|gym|pybullet_data)/)*', ''), '^(robosuite/models/assets/robots/|models/assets/robots/|models/assets/)', '') else lower(path) end"""


@query(f"select {_TAIL} || '@' || coalesce(dof, 0) || 'dof' as signature, count(*) as n from {Q.ENTRIES} group by all having count(*) > 0")
def tail_signatures(spark, sf):
    """Entries by path tail and degrees of freedom."""
    e = _entries(spark, sf)
    return e.groupBy(F.concat(C.path_tail(F.col("path")), F.lit("@"), F.coalesce(F.col("dof"), F.lit(0)).cast("string"), F.lit("dof")).alias("signature")).agg(F.count("*").alias("n"))


@query(f"""select entry_id, case when len(string_split(path, '/')) >= 3 and string_split(path, '/')[1] = 'loosebolt_dump' then string_split(path, '/')[2] end as folder,
lower(regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\\.[^.]*$', '\\1')) as stem,
concat_ws('/', string_split(path, '/')[1], list_extract(string_split(path, '/'), -2), regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\\.[^.]*$', '\\1')) as name_new,
concat_ws('/', string_split(path, '/')[1], regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\\.[^.]*$', '\\1')) as name_old from {Q.ENTRIES}""")
def name_keys(spark, sf):
    """Second directory of one source, and both forms of an entry's name."""
    p = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(p, -1), r"(?<=.)\.[^.]*$", "")
    return _entries(spark, sf).select(
        "entry_id", F.when((F.size(p) >= 3) & (p[0] == "loosebolt_dump"), p[1]).alias("folder"), F.lower(stem).alias("stem"),
        F.concat_ws("/", p[0], F.try_element_at(p, F.lit(-2)), stem).alias("name_new"), F.concat_ws("/", p[0], stem).alias("name_old"),
    )


#: Patterns in the order they are tried; earlier ones hide later ones.
PATTERNS = [(0, "_left", "left hand"), (1, "scene", "scenes"), (2, "mjx", "mjx"), (3, "loosebolt", "loosebolt"), (4, "robots/", "robots"), (5, "urdf", "any urdf")]
_PATTERNS = "(values " + ", ".join(f"({o}, '{p}', '{v}')" for o, p, v in PATTERNS) + ") as t(ord, pattern, vendor)"


@query(f"""with m as (select e.entry_id, min(t.ord) as ord from {Q.ENTRIES} e join {_PATTERNS} on contains(lower(e.path), t.pattern) group by 1)
select coalesce(t.vendor, '') as vendor, case when t.vendor is null then list_filter(string_split(lower(e.path), '/'), lambda x: x not in ('robots', 'urdf', 'data'))[1] else t.vendor end as family, count(*) as n
from {Q.ENTRIES} e left join m using (entry_id) left join {_PATTERNS} on t.ord = m.ord group by all""")
def first_pattern(spark, sf):
    """The first pattern that occurs in a path decides; else the first directory that is no stop word."""
    e = _entries(spark, sf)
    hit = F.coalesce(*[F.when(F.contains(F.lower("path"), F.lit(p)), v) for _, p, v in PATTERNS])
    first = F.get(F.filter(F.split(F.lower("path"), "/"), lambda x: ~x.isin("robots", "urdf", "data")), F.lit(0))
    return e.groupBy(F.coalesce(hit, F.lit("")).alias("vendor"), F.coalesce(hit, first).alias("family")).agg(F.count("*").alias("n"))


_LIC = " ".join("when " + " and ".join(f"contains(h, '{w}')" for w in ws) + f" then '{n}'" for n, ws in C.LICENCE_TEXTS)


@query(rf"""select case {_LIC} else 'Unknown' end as licence, regexp_matches(x, '<mujoco|<worldbody|<body') as model_xml, count(*) as n
from (select lower(substr(regexp_replace(text, '^\s+', ''), 1, 1500)) as h, lower(substr(text, 1, 4096)) as x from documents where text is not null) group by all""")
def licence_and_sniff(spark, sf):
    """Documents by licence words and by tags of simulation models."""
    d = read_table(spark, sf, "documents").filter("text is not null")
    return d.groupBy(C.licence_of(F.col("text")).alias("licence"), C.looks_like_robot_xml(F.col("text")).alias("model_xml")).agg(F.count("*").alias("n"))


@query(f"""select 'quality_tier' as dimension, quality_tier as category, count(*) as n from {Q.ENTRIES} group by all
union all select 'format', format, count(*) from {Q.ENTRIES} group by all union all select 'dof', cast(dof as varchar), count(*) from {Q.ENTRIES} group by all
union all select 'status', status, count(*) from {Q.ENTRIES} group by all""")
def counts_by_each(spark, sf):
    """Entries by each of several columns, in one pass."""
    return R.counts_by_each(_entries(spark, sf), ["quality_tier", "format", "dof", "status"])


@query(f"""select count(distinct case when trim(lower(vendor)) not in ('', 'unknown', 'n/a') then {Q.name_key("vendor")} end) as vendors, min(dof) as least_dof, max(dof) as most_dof from {Q.ENTRIES}""")
def vendor_summary(spark, sf):
    """Distinct vendors without placeholders; range of the degrees of freedom."""
    return _entries(spark, sf).agg(F.countDistinct(name_key(known(F.col("vendor")))).alias("vendors"), F.min("dof").alias("least_dof"), F.max("dof").alias("most_dof"))


_V = "coalesce(nullif(vendor, ''), '_unknown')"


@query(f"""select vendor, family, dof, path from (select {_V} as vendor, family, dof, path, row_number() over (partition by {_V} order by coalesce(family, '') , coalesce(dof, -1), path) as rn from {Q.ENTRIES}) where rn = 1""")
def first_family(spark, sf):
    """The first entry of each vendor by family, dof and path."""
    v = F.coalesce(F.nullif(F.col("vendor"), F.lit("")), F.lit("_unknown"))
    w = Window.partitionBy("v").orderBy(F.coalesce("family", F.lit("")), F.coalesce("dof", F.lit(-1)), "path")
    return _entries(spark, sf).select(v.alias("v"), "family", "dof", "path").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(F.col("v").alias("vendor"), "family", "dof", "path")


@query(f"""select * from (select 'most' as kind, {Q.name_key("source")} as source, count(*) as n from {Q.ENTRIES} group by all order by n desc, source limit 5)
union all select * from (select 'fewest', {Q.name_key("source")} as source, count(*) as n from {Q.ENTRIES} group by all order by n, source limit 10)
union all select * from (select 'first', {Q.name_key("source")} as source, count(*) as n from {Q.ENTRIES} group by all order by source limit 15)""")
def leading_sources(spark, sf):
    """Sources of most and fewest entries, and the first by name."""
    e = _entries(spark, sf).select(name_key(F.col("source")).alias("source"))
    first = e.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").limit(15)
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "source", "n")
    return tag(R.leaders(e, "source", 5), "most").unionByName(tag(R.leaders(e, "source", 10, True), "fewest")).unionByName(tag(first, "first"))


@query(f"select size, count(*) as groups from (select dedup_group_id, count(*) as size from {Q.ENTRIES} where dedup_group_id is not null group by 1) group by size")
def group_histogram(spark, sf):
    """How many group ids have how many entries."""
    return R.size_histogram(_entries(spark, sf), "dedup_group_id")


_CANON = f"""{Q.GROUPS},
ranked as (select e.entry_id, e.path, grp.group_id, row_number() over (partition by grp.group_id order by coalesce(r.trust_rank, 99), regexp_matches({_STEM.replace("path", "e.path")}, '^scene$|^scene_|_scene$'), -coalesce(e.meshes_resolved, 0), e.path) as rn,
 count(*) over (partition by grp.group_id) as size from e join grp using (entry_id) left join (select {Q.name_key("source")} as k, min(trust_rank) as trust_rank from source_ref group by 1) r on r.k = {Q.name_key("e.source")})"""


@query(f"{_CANON} select a.entry_id, cast(a.size as bigint) as size, b.path as canonical, a.entry_id = b.entry_id as is_canonical from ranked a join ranked b on a.group_id = b.group_id and b.rn = 1")
def canonical_pick(spark, sf):
    """Canonical entry of each group: source rank, no scene, most meshes, path."""
    e = materialize(_entries(spark, sf).select("entry_id", "source", "path", "meshes_resolved", "dedup_group_id", "dup_of"), "catalog")
    ref = read_table(spark, sf, "source_ref").select(name_key(F.col("source")).alias("k"), "trust_rank").groupBy("k").agg(F.min("trust_rank").alias("trust"))
    g = e.join(entry_groups(e), "entry_id").join(ref, name_key(F.col("source")) == F.col("k"), "left")
    order = F.struct(F.coalesce("trust", F.lit(99)), C.is_scene(F.col("path")), -F.coalesce("meshes_resolved", F.lit(0)), F.col("path"), F.col("entry_id"))
    top = g.groupBy("group_id").agg(F.min(order).alias("top"), F.count("*").alias("size"))
    return g.select("entry_id", "group_id").join(top, "group_id").select("entry_id", "size", F.col("top.path").alias("canonical"), (F.col("entry_id") == F.col("top.entry_id")).alias("is_canonical"))


@query(f"""with e as (select * from {Q.ENTRIES}), c as (select * from e where canonical_train_set),
g as (select dedup_group_id, count(*) filter (is_canonical) as k from e where coalesce(dedup_group_id, '') <> '' group by 1),
s as (select source || '/' || regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\\.[^.]*$', '\\1') as name, count(*) as k from c group by 1),
p as (select e.dedup_group_id, min(coalesce(r.trust_rank, 99)) as best, count(distinct e.source) as k, min(case when is_canonical then coalesce(r.trust_rank, 99) end) as own from e left join source_ref r on r.source = e.source where coalesce(e.dedup_group_id, '') <> '' group by 1)
select * from (values (1, 'fail', cast((select count(*) from g where k <> 1) as bigint)), (2, 'fail', (select count(*) from e where coalesce(dup_of, '') <> '' and dup_of not in (select path from e))),
(3, 'warn', (select count(*) from c where coalesce(license, '') in ('', 'Unknown'))), (4, 'fail', (select count(*) from c where coalesce(fidelity_class, '?') not in ('high', 'medium', 'low', 'unknown'))),
(5, 'warn', (select count(*) from c where not (coalesce(joint_range_total_rad, 0) > 0 or coalesce(joint_range_total_m, 0) > 0))), (6, 'warn', (select count(*) from s where k > 1)),
(7, 'fail', (select count(*) from e where coalesce(dedup_group_id, '') <> '' and coalesce(is_canonical, false) <> (dup_of is null))), (8, 'fail', (select count(*) from p where k > 1 and own is not null and own <> best))) as t(rule, severity, violations)""")
def validator(spark, sf):
    """Violations of the eight rules of a catalog, hard and soft."""
    e = materialize(_entries(spark, sf).select("entry_id", "source", "path", "license", "dedup_group_id", "is_canonical", "dup_of", "canonical_train_set", "fidelity_class", "joint_range_total_rad", "joint_range_total_m"), "catalog")
    c = e.filter("canonical_train_set")
    grouped = e.filter("dedup_group_id <> ''")
    ref = read_table(spark, sf, "source_ref").select("source", "trust_rank")
    rank = F.coalesce("trust_rank", F.lit(99))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    rules = [
        (1, "fail", grouped.groupBy("dedup_group_id").agg(F.count_if("is_canonical").alias("k")).filter("k <> 1")),
        (2, "fail", e.filter("dup_of <> ''").join(e.select(F.col("path").alias("dup_of")), "dup_of", "left_anti")),
        (3, "warn", c.filter(F.coalesce("license", F.lit("")).isin("", "Unknown"))),
        (4, "fail", c.filter(~F.coalesce("fidelity_class", F.lit("?")).isin("high", "medium", "low", "unknown"))),
        (5, "warn", c.filter(~((F.coalesce("joint_range_total_rad", F.lit(0)) > 0) | (F.coalesce("joint_range_total_m", F.lit(0)) > 0)))),
        (6, "warn", c.groupBy(F.concat("source", F.lit("/"), stem).alias("name")).agg(F.count("*").alias("k")).filter("k > 1")),
        (7, "fail", grouped.filter(F.coalesce("is_canonical", F.lit(False)) != F.col("dup_of").isNull())),
        (8, "fail", grouped.join(ref, "source", "left").groupBy("dedup_group_id").agg(F.min(rank).alias("best"), F.countDistinct("source").alias("k"), F.min(F.when(F.col("is_canonical"), rank)).alias("own")).filter("k > 1 and own <> best")),
    ]
    out = None
    for n, severity, df in rules:
        one = df.agg(F.count("*").alias("violations")).select(F.lit(n).alias("rule"), F.lit(severity).alias("severity"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{Q.GROUPS}, size as (select group_id, count(*) as n from grp group by 1 having count(*) > 2 order by group_id limit 8)
select grp.group_id, grp.entry_id, cast(size.n as bigint) as n from grp join size using (group_id)""")
def first_large_groups(spark, sf):
    """The first eight groups of more than two entries, with their members."""
    e = materialize(_entries(spark, sf).select("entry_id", "path", "dedup_group_id", "dup_of"), "catalog")
    g = materialize(entry_groups(e), "groups")
    top = g.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 2").orderBy("group_id").limit(8)
    return g.join(top, "group_id").select("group_id", "entry_id", "n")


_JOINTS = "(select example_id, j from (select example_id, unnest(joints) as j from (select * from (select *, row_number() over (partition by example_id order by created_at desc) as rn from shard_example) where rn = 1)))"
_SPAN = f"""case j.type when 1 then {2 * C.PI} when 0 then case when s < {4 * C.PI} then greatest(s, 0) when s is not null then {2 * C.PI} else 0 end when 2 then case when s > 0 then least(s, 10) else 0 end else 0 end"""


@query(f"""select example_id, round(sum(case when j.type in (0, 1) then {_SPAN} else 0 end), 4) as rad, round(sum(case when j.type = 2 then {_SPAN} else 0 end), 4) as m from
(select *, case when not isnan(j.lower) and not isnan(j.upper) then cast(j.upper as double) - cast(j.lower as double) end as s from {_JOINTS}) group by 1""")
def joint_ranges(spark, sf):
    """Range of each example's joints, turning and sliding."""
    x = newest(read_table(spark, sf, "shard_example").select("example_id", "joints", "created_at"), "example_id", "created_at")
    j = x.select("example_id", F.explode("joints").alias("j"))
    span = C.joint_span(F.col("j.type"), F.col("j.lower").cast("double"), F.col("j.upper").cast("double"))
    turning = F.col("j.type").isin(C.JOINT_CODES["revolute"], C.JOINT_CODES["continuous"])
    return j.groupBy("example_id").agg(F.round(F.sum(F.when(turning, span).otherwise(0.0)), 4).alias("rad"), F.round(F.sum(F.when(F.col("j.type") == 2, span).otherwise(0.0)), 4).alias("m"))


@query(f"""with x as (select j.type as kind, cast(j.lower as double) as lo, cast(j.upper as double) as hi, case when j.type = 2 then 2.0 else {C.PI} end as b from {_JOINTS}),
y as (select kind, kind = 1 or lo is null or hi is null or isnan(lo) or isnan(hi) or greatest(lo, -b) > least(hi, b) as bad, greatest(lo, -b) as l, least(hi, b) as h from x)
select kind, count(*) as n, count(*) filter (bad) as reset, round(sum(case when bad then {2 * C.PI} else h - l end), 2) as total from y group by 1""")
def limit_clamp(spark, sf):
    """Limits of joints cut for sampling, by type."""
    x = newest(read_table(spark, sf, "shard_example").select("example_id", "joints", "created_at"), "example_id", "created_at").select(F.explode("joints").alias("j"))
    lo, hi = F.col("j.lower").cast("double"), F.col("j.upper").cast("double")
    s = x.select(F.col("j.type").alias("kind"), C.sampling_limits(F.col("j.type"), lo, hi).alias("s"), lo.alias("lo"), hi.alias("hi"))
    reset = (F.col("s.lower") == -C.PI) & (F.col("s.upper") == C.PI) & ~F.coalesce((F.col("kind") != 1) & (F.col("lo") <= -C.PI) & (F.col("hi") >= C.PI), F.lit(False))
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(reset).alias("reset"), F.round(F.sum(F.col("s.upper") - F.col("s.lower")), 2).alias("total"))


@query(f"""select entry_id, cast(cast(cast(coalesce(total_mass, 0) as varchar) as decimal(18, 2)) as varchar) as mass, case when length(coalesce(notes, '')) > 60 then substr(notes, 1, 60) else coalesce(notes, '') end as notes,
'| ' || concat_ws(' | ', replace(coalesce(vendor, ''), '|', '\\|'), coalesce(family, ''), cast(coalesce(dof, 0) as varchar)) || ' |' as line from {Q.ENTRIES}""")
def report_lines(spark, sf):
    """Formatted rows for text reports (C20)."""
    return _entries(spark, sf).select(
        "entry_id", F.format_string("%.2f", F.round(F.coalesce("total_mass", F.lit(0.0)), 2)).alias("mass"), F.substring(F.coalesce("notes", F.lit("")), 1, 60).alias("notes"),
        F.concat(F.lit("| "), F.concat_ws(" | ", F.replace(F.coalesce("vendor", F.lit("")), F.lit("|"), F.lit("\\|")), F.coalesce("family", F.lit("")), F.coalesce("dof", F.lit(0)).cast("string")), F.lit(" |")).alias("line"),
    )


@query(f"""select {Q.name_key("source")} as source, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as percent from {Q.ENTRIES} group by 1""")
def source_percent(spark, sf):
    """Each source's percentage of the catalog."""
    n = _entries(spark, sf).groupBy(name_key(F.col("source")).alias("source")).agg(F.count("*").alias("n"))
    return n.select("source", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))  # one row per source
