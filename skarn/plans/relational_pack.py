"""Joins, windows, set operations and aggregates of the engine over the plain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skarn.operators import reports as R
from skarn.sources.tables import materialize, read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""select 'line without order' as what, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'customer with order', count(*) from customer where c_custkey in (select o_custkey from orders)""")
def semi_and_anti(spark, sf):
    """Membership in another table, kept and left out."""
    li, o, c = (read_table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    a = li.select("l_orderkey").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    b = c.select("c_custkey").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    one = lambda df, t: df.agg(F.count("*").alias("n")).select(F.lit(t).alias("what"), "n")
    return one(a, "line without order").unionByName(one(b, "customer with order"))


_E1 = "(select entry_id, source, path, string_split(path, '/')[1] || '/' || list_extract(string_split(path, '/'), -2) || '/' || regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\\.[^.]*$', '\\1') as new_name, string_split(path, '/')[1] || '/' || regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\\.[^.]*$', '\\1') as old_name from (select *, row_number() over (partition by entry_id order by ingested_at desc) as rn from catalog_entry) where rn = 1)"
_N1 = "(select distinct unnest(names) as name from shard)"


@query(f"""select n.name, coalesce(a.entry_id, b.entry_id) as entry_id, case when a.entry_id is not null then 'new' when b.entry_id is not null then 'old' else 'none' end as form
from {_N1} n left join (select new_name, min(entry_id) as entry_id from {_E1} group by 1) a on a.new_name = n.name left join (select old_name, min(entry_id) as entry_id from {_E1} group by 1) b on b.old_name = n.name""")
def prioritised_match(spark, sf):
    """Names matched in the newer form, else the older one."""
    from skarn.operators.catalog import entries

    e = entries(read_table(spark, sf, "catalog_entry").select("entry_id", "path", "ingested_at"))
    p = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(p, -1), r"(?<=.)\.[^.]*$", "")
    e = e.select("entry_id", F.concat_ws("/", p[0], F.try_element_at(p, F.lit(-2)), stem).alias("new_name"), F.concat_ws("/", p[0], stem).alias("old_name"))
    n = read_table(spark, sf, "shard").select(F.explode("names").alias("name")).distinct()
    a = e.groupBy(F.col("new_name").alias("name")).agg(F.min("entry_id").alias("a"))
    b = e.groupBy(F.col("old_name").alias("name")).agg(F.min("entry_id").alias("b"))
    return n.join(a, "name", "left").join(b, "name", "left").select("name", F.coalesce("a", "b").alias("entry_id"), F.when(F.col("a").isNotNull(), "new").when(F.col("b").isNotNull(), "old").otherwise("none").alias("form"))


_SETS = "(select l_orderkey as k, list_sort(list(l_linenumber)) as s from lineitem group by 1)"


@query(f"select cast(len(s) as integer) as lines, count(*) as groups, cast(max(n) as bigint) as largest from (select s, count(*) as n from {_SETS} group by 1) group by 1")
def multiset_match(spark, sf):
    """Orders with the same multiset of line numbers meet on the sorted array (E5)."""
    s = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("s"))
    return s.groupBy("s").agg(F.count("*").alias("n")).groupBy(F.size("s").alias("lines")).agg(F.count("*").alias("groups"), F.max("n").alias("largest"))


@query("""select e.entry_id, coalesce(nullif(nullif(e.license, ''), 'Unknown'), nullif(r.default_license, 'Unknown'), 'Unknown') as licence, coalesce(r.quality_tier, 'low') as tier
from (select *, row_number() over (partition by entry_id order by ingested_at desc) as rn from catalog_entry) e left join source_ref r on r.source = e.source where rn = 1""")
def licence_overlay(spark, sf):
    """Own value, else the source's default."""
    from skarn.operators.catalog import entries

    e = entries(read_table(spark, sf, "catalog_entry").select("entry_id", "source", "license", "ingested_at"))
    r = read_table(spark, sf, "source_ref").select("source", "default_license", F.col("quality_tier").alias("t"))
    said = lambda c: F.nullif(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    return e.join(r, "source", "left").select("entry_id", F.coalesce(said("license"), said("default_license"), F.lit("Unknown")).alias("licence"), F.coalesce("t", F.lit("low")).alias("tier"))


@query("""with p as (select p_partkey, p_size, case when p_partkey % 7 = 0 then -1.0 end as o_lo, case when p_partkey % 7 = 0 then 1.0 end as o_hi, case when p_partkey % 3 = 0 then -p_size / 10.0 end as t_lo, case when p_partkey % 3 = 0 then p_size / 20.0 end as t_hi,
 -p_size / 50.0 as s_lo, p_size / 25.0 as s_hi, p_size / 40.0 - 0.5 as c_lo, p_size / 30.0 as c_hi from part),
b as (select *, coalesce(o_lo, t_lo, (s_lo + s_hi) / 2 - (s_hi - s_lo) / 2 * 4) as lo, coalesce(o_hi, t_hi, (s_lo + s_hi) / 2 + (s_hi - s_lo) / 2 * 4) as hi from p)
select p_partkey, round(case when o_lo is not null then lo when least(hi, c_hi) <= greatest(lo, c_lo) then c_lo else greatest(lo, c_lo) end, 4) as lower, round(case when o_lo is not null then hi when least(hi, c_hi) <= greatest(lo, c_lo) then c_hi else least(hi, c_hi) end, 4) as upper from b""")
def limit_precedence(spark, sf):
    """Override, else template, else widened observation; cut by collision limits."""
    from skarn.operators.prepare import merged_limits

    size = F.col("p_size").cast("double")
    pair = lambda lo, hi: F.struct(lo.alias("lower"), hi.alias("upper"))
    p = read_table(spark, sf, "part").select("p_partkey", merged_limits(
        F.when(F.col("p_partkey") % 7 == 0, pair(F.lit(-1.0), F.lit(1.0))), F.when(F.col("p_partkey") % 3 == 0, pair(-size / 10, size / 20)),
        pair(-size / 50, size / 25), pair(size / 40 - 0.5, size / 30)).alias("m"))
    return p.select("p_partkey", F.round("m.lower", 4).alias("lower"), F.round("m.upper", 4).alias("upper"))


@query("""with a as (select row_number() over (order by s_suppkey) as k, s_suppkey from supplier), b as (select row_number() over (order by n_nationkey) as k, n_name from nation)
select cast(k as bigint) as k, s_suppkey, n_name, case when s_suppkey is null or n_name is null then 'unpaired' else 'pair' end as state from a full join b using (k)""")
def positional_join(spark, sf):
    """The k-th row of one list with the k-th of another; gaps are shown."""
    from skarn.operators.prefix import grouped_prefix

    a = grouped_prefix(read_table(spark, sf, "supplier").select("s_suppkey"), [], ["s_suppkey"]).withColumnRenamed("rank", "k")
    b = grouped_prefix(read_table(spark, sf, "nation").select("n_nationkey", "n_name"), [], ["n_nationkey"]).select(F.col("rank").alias("k"), "n_name")
    j = a.join(b, "k", "full_outer")
    return j.select(F.col("k").cast("long").alias("k"), "s_suppkey", "n_name", F.when(F.col("s_suppkey").isNull() | F.col("n_name").isNull(), "unpaired").otherwise("pair").alias("state"))


@query("""select s as sigma, cast(t as integer) as seed, count(n_nationkey) as n from (select unnest([0.5::double, 1.0::double, 2.0::double]) as s) cross join (select unnest([0, 1, 2]) as t) left join nation on n_nationkey % 3 = t group by all""")
def sweep_grid(spark, sf):
    """Every combination of two short parameter lists, with rows per seed."""
    n = read_table(spark, sf, "nation").select((F.col("n_nationkey") % 3).alias("seed"))
    lists = spark.range(1).select(F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("sigma")).select("sigma", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seed"))
    return lists.join(n.withColumn("hit", F.lit(1)), "seed", "left").groupBy("sigma", "seed").agg(F.count("hit").alias("n"))


@query("""with f as (select o_custkey as mesh, row_number() over (partition by o_custkey order by o_orderkey) as face, o_orderpriority as label from orders)
select least(a.label, b.label) as la, greatest(a.label, b.label) as lb, count(*) as weight from f a join f b on a.mesh = b.mesh and b.face = a.face + 1 where a.label <> b.label group by all""")
def label_adjacency(spark, sf):
    """Edges between rows that touch, counted per pair of labels, both directions as one."""
    from skarn.operators.prefix import grouped_prefix

    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("label"))
    f = materialize(grouped_prefix(o, ["o_custkey"], ["o_orderkey"]), "faces")
    b = f.select("o_custkey", (F.col("rank") - 1).alias("rank"), F.col("label").alias("next"))
    return f.join(b, ["o_custkey", "rank"]).filter("label <> next").groupBy(F.least("label", "next").alias("la"), F.greatest("label", "next").alias("lb")).agg(F.count("*").alias("weight"))


@query("select event_type, count(*) as n, round(avg(value), 6) as value_mean, round(stddev_pop(value), 6) as value_std from (select event_type, case when event_id % 10 = 0 then null else value end as value from events) group by 1")
def nan_aware(spark, sf):
    """Mean and population deviation that leave NaN out."""
    e = read_table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), *R.nan_stats(F.col("value"), "value")).select("event_type", "n", F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 6).alias("value_std"))


@query("""select l_returnflag, round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std, count(*) as batches from (select l_returnflag, l_orderkey // 1000 as batch, avg(l_quantity) as m from lineitem group by all) group by 1""")
def batch_means(spark, sf):
    """Unweighted mean of batch means, in two levels."""
    b = read_table(spark, sf, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_orderkey") / 1000).alias("batch")).agg(F.avg("l_quantity").alias("m"))
    return b.groupBy("l_returnflag").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("std"), F.count("*").alias("batches"))


@query("select l_shipmode as k, n, round(low, 4) as low, round(median, 4) as median, round(p90, 4) as p90, round(high, 4) as high from (select l_returnflag as l_shipmode, count(*) as n, min(l_extendedprice) as low, quantile_cont(l_extendedprice, 0.5) as median, quantile_cont(l_extendedprice, 0.9) as p90, max(l_extendedprice) as high from lineitem group by 1)")
def percentiles(spark, sf):
    """Exact percentiles with linear interpolation."""
    s = R.spread(read_table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return s.select(F.col("l_returnflag").alias("k"), "n", *[F.round(c, 4).alias(c) for c in ("low", "median", "p90", "high")])


@query("""with c as (select l_suppkey, l_linenumber, count(*) as n from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_linenumber) as rn, sum(n) over (partition by l_suppkey) as total from c)
select l_suppkey, l_linenumber, n, round(n / total, 6) as share from r where rn = 1""")
def majority_vote(spark, sf):
    """Commonest value per group, the lowest winning ties, with its share."""
    out = R.share_of_top(read_table(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber")
    return out.select("l_suppkey", "l_linenumber", "n", F.round("share", 6).alias("share"))


@query("select a, count(*) as n from (select case when l_linenumber = p.p_size % 7 + 1 and l_linenumber <> l_suppkey % 7 + 1 then l_linenumber when l_suppkey % 7 = p.p_size % 7 then l_suppkey % 7 + 1 else l_linenumber end as a from lineitem join part p on p.p_partkey = l_partkey) group by 1")
def three_way_mode(spark, sf):
    """Of three labels the one that two share, else the first (F16)."""
    li = read_table(spark, sf, "lineitem").join(read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    a, b, c = F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 7 + 1, (F.col("p_size") % 7 + 1).cast("long")
    return li.select(F.when((b == c) & (a != b), b).otherwise(a).alias("a")).groupBy("a").agg(F.count("*").alias("n"))


@query("select user_id, bool_and(value < 100) as all_small, bool_or(value > 90) as any_large, count(*) filter (event_type <> 'view') as changed, count(distinct event_type) as kinds from events group by 1")
def boolean_aggregates(spark, sf):
    """All, any and changed rows of a group."""
    return read_table(spark, sf, "events").groupBy("user_id").agg(F.bool_and(F.col("value") < 100).alias("all_small"), F.bool_or(F.col("value") > 90).alias("any_large"), F.count_if(F.col("event_type") != "view").alias("changed"), F.countDistinct("event_type").alias("kinds"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn from lineitem) where rn = 1""")
def keep_first(spark, sf):
    """The first row per key (H1); only the key and the order are shuffled."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return read_table(spark, sf, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("select o_orderkey, cast(row_number() over (order by o_totalprice, o_orderkey) - 1 as bigint) as pos, cast((row_number() over (order by o_totalprice, o_orderkey) - 1) // 1000 as bigint) as chunk from orders")
def chunks(spark, sf):
    """Positions and blocks of a fixed size over a whole table."""
    return R.chunk_ids(read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 1000).select("o_orderkey", "pos", "chunk")


@query("select l_suppkey, l_partkey, cast(dense_rank() over (partition by l_suppkey order by l_partkey) - 1 as bigint) as id from (select distinct l_suppkey, l_partkey from lineitem)")
def dense_renumber(spark, sf):
    """Ids without gaps, per group."""
    return R.dense_ids(read_table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct(), "l_partkey", ["l_suppkey"])


@query("""select user_id, count(*) as pairs, round(sum(abs(d)), 3) as path, count(*) filter (d > 0) as rises, round(max(abs(v - first)), 4) as far from
(select user_id, value as v, lead(value) over w - value as d, first_value(value) over w as first from events window w as (partition by user_id order by ts, event_id)) where d is not null group by 1""")
def consecutive_pairs(spark, sf):
    """Steps from each state to the next, and distance from the first."""
    e = R.next_rows(read_table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value")
    e = e.select("user_id", F.col("value").alias("v"), (F.col("next") - F.col("value")).alias("d"), "first").filter("d is not null")
    return e.groupBy("user_id").agg(F.count("*").alias("pairs"), F.round(F.sum(F.abs("d")), 3).alias("path"), F.count_if(F.col("d") > 0).alias("rises"), F.round(F.max(F.abs(F.col("v") - F.col("first"))), 4).alias("far"))


@query("""with n as (select l_suppkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1), c as (select list_sort(list(n), 'desc') as s, count(*) as k from n)
select n.l_suppkey, n.n from n, c where n.n >= case when k > 52 then greatest(150, s[51] + 1) else 150 end""")
def adaptive_floor(spark, sf):
    """Groups above a floor that rises when there are too many; ties at the cut all go."""
    n = materialize(read_table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n")), "sizes")
    top = n.orderBy(F.col("n").desc()).limit(51).agg(F.min("n").alias("cut")).first()
    floor = max(150, top.cut + 1) if n.count() > 52 else 150
    return n.filter(F.col("n") >= floor)


@query("""select 'both' as part, count(*) as n from (select n_nationkey as k from nation where n_nationkey in (select c_nationkey from customer) intersect select s_nationkey from supplier)
union all select 'either', count(*) from (select c_nationkey from customer union select s_nationkey from supplier) union all select 'only customers', count(*) from (select c_nationkey from customer except select s_nationkey from supplier)
union all select 'all rows', count(*) from (select c_nationkey from customer union all select s_nationkey from supplier) union all select 'delta', (select count(distinct c_nationkey) from customer) - (select count(distinct s_nationkey) from supplier)""")
def set_operations(spark, sf):
    """Intersection, union, difference, union all and difference of sizes."""
    c, s = (read_table(spark, sf, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    both, either, only, rows = c.intersect(s), c.union(s).distinct(), c.subtract(s), c.unionByName(s)
    one = lambda df, t: df.agg(F.count("*").alias("n")).select(F.lit(t).alias("part"), "n")
    side = c.select("k", F.lit(1).alias("w")).distinct().unionByName(s.select("k", F.lit(-1).alias("w")).distinct())
    delta = side.agg(F.sum("w").alias("n")).select(F.lit("delta").alias("part"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return one(both, "both").unionByName(one(either, "either")).unionByName(one(only, "only customers")).unionByName(one(rows, "all rows")).unionByName(delta)


@query("select 0 as left_only, (select count(*) from lineitem) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as right_only, false as equal")
def table_difference(spark, sf):
    """Rows of two tables that have no partner, repeats counted."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    once = li.distinct()
    a = once.exceptAll(li).agg(F.count("*").cast("int").alias("left_only"))
    b = li.exceptAll(once).agg(F.count("*").alias("right_only"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").select("left_only", "right_only", ((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("equal"))


@query("select cast(json_extract(props, '$.k') as integer) % 10 as k, event_type, count(*) as n from events group by all")
def json_groups(spark, sf):
    """Fields of JSON texts."""
    e = read_table(spark, sf, "events").select(F.from_json("props", "k int").getField("k").alias("k"), "event_type")
    return e.groupBy((F.col("k") % 10).alias("k"), "event_type").agg(F.count("*").alias("n"))


@query("""with t as (select s_suppkey as id, s_nationkey, s_acctbal from supplier) select id, s_acctbal, state from (select id, s_acctbal, row_number() over (partition by s_nationkey order by s_acctbal desc, id) as rn, case when s_acctbal > 5000 then 'well' else 'less' end as state from t) where rn <= 2""")
def first_two(spark, sf):
    """The best two rows per key, before the shuffle too."""
    w = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    s = read_table(spark, sf, "supplier").withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return s.select(F.col("s_suppkey").alias("id"), "s_acctbal", F.when(F.col("s_acctbal") > 5000, "well").otherwise("less").alias("state"))


@query("""with g as (select 'R' || r_regionkey as node, cast(null as varchar) as parent from region union all select 'N' || n_nationkey, 'R' || n_regionkey from nation union all select 'C' || c_custkey, 'N' || c_nationkey from customer)
select a.node, coalesce(c.node, b.node, a.node) as root, case when b.node is null then 0 when c.node is null then 1 else 2 end as depth, cast(case when b.node is null then 1 when c.node is null then 2 else 3 end as integer) as steps from g a left join g b on b.node = a.parent left join g c on c.node = b.parent""")
def tree_levels(spark, sf):
    """Depth, root and path length in a tree of unknown depth, by pointer doubling."""
    from skarn.operators.hierarchy import hierarchy

    r, n, c = (read_table(spark, sf, t) for t in ("region", "nation", "customer"))
    tag = lambda t, k: F.concat(F.lit(t), F.col(k).cast("string"))
    rows = r.select(tag("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")).unionByName(n.select(tag("N", "n_nationkey").alias("node"), tag("R", "n_regionkey").alias("parent"))).unionByName(c.select(tag("C", "c_custkey").alias("node"), tag("N", "c_nationkey").alias("parent")))
    h = hierarchy(rows, "node", "parent")
    return h.select("node", "root", "depth", F.size("path").alias("steps"))


@query("""with recursive e as (select distinct l_suppkey as a, l_partkey + 100000 as b from lineitem where l_quantity = 50 and l_suppkey % 5 = 0 and l_orderkey % 4 = 0), x as (select a, b from e union select b, a from e),
r as (select a as s, a as t from x union select r.s, x.b from r join x on x.a = r.t) select cast(s as bigint) as node, cast(min(t) as bigint) as component from r group by 1""")
def bipartite_components(spark, sf):
    """The components of a few links only, which recursive SQL can check; `supplier_part_components`
    has those of all links."""
    from skarn.operators.graph import connected_components

    li = read_table(spark, sf, "lineitem").filter("l_quantity = 50 and l_suppkey % 5 = 0 and l_orderkey % 4 = 0")
    return connected_components(li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 100000).alias("dst")).distinct())


@query()
def supplier_part_components(spark, sf):
    """Connected components of all suppliers and parts of lineitem (G1, G2, G4): node, component.
    Nodes are S or P and the key, so no supplier meets a part of its number; links whose supplier
    or part is null are left out."""
    from skarn.operators.graph import connected_components

    tag = lambda t, k: F.concat(F.lit(t), F.col(k).cast("string"))
    return connected_components(read_table(spark, sf, "lineitem").select(tag("S", "l_suppkey").alias("src"), tag("P", "l_partkey").alias("dst")))


_MOVE = "(select user_id, hour(ts) % 6 as h, sum(value) as v from events group by all)"


@query(f"""with p as (select user_id, round(sum(v), 2) as total from {_MOVE} group by 1), d as (select a.user_id as child, b.user_id as parent, sum(x.v * y.v) as dot from p a join p b on b.total < a.total and a.user_id % 15 = b.user_id % 15 join {_MOVE} x on x.user_id = a.user_id join {_MOVE} y on y.user_id = b.user_id and y.h = x.h group by all)
select p.user_id, m.parent from p left join (select child, parent from (select *, row_number() over (partition by child order by round(dot, 2) desc, parent) as rn from d) where rn = 1) m on m.child = p.user_id""")
def parents_by_stillness(spark, sf):
    """Each body hangs on the stiller body whose motion resembles its own most."""
    from skarn.operators.prepare import parent_by_stillness

    e = read_table(spark, sf, "events").groupBy("user_id", (F.hour("ts") % 6).alias("h")).agg(F.sum("value").alias("v"))
    return parent_by_stillness(e.withColumn("scene", F.col("user_id") % 15), "scene", "user_id", "h", "v")
