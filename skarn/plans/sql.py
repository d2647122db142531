"""Pieces of SQL that several oracles share."""

ENTRIES = "(select * exclude (rn) from (select *, row_number() over (partition by entry_id order by ingested_at desc) as rn from catalog_entry) where rn = 1)"


def name_key(x: str) -> str:
    return f"nullif(regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g'), '')"


def path_key(x: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim({x})), '\', '/'), '\s*/+[\s/]*', '/', 'g'), '^(\./|/)+', ''), '[-\s]+', '_', 'g'), '')"


def group_key(x: str) -> str:
    return rf"nullif(replace(regexp_replace(replace(regexp_replace(lower({x}), '\s+', '', 'g'), '\', '/'), '^(\./)+', ''), '-', '_'), '')"


#: Common table expressions e (entries once) and grp (entry_id, group_id).
GROUPS = f"""
with recursive e as (select * from {ENTRIES}),
k as (select entry_id, {group_key("dedup_group_id")} as gid, {path_key("path")} as p, {path_key("dup_of")} as d from e),
hub as (select gid, min(entry_id) as m from k where gid is not null group by gid),
link as (select k.entry_id as s, hub.m as t from k join hub on k.gid = hub.gid union select a.entry_id, b.entry_id from k a join k b on a.d = b.p),
edge as (select s, t from link union select t, s from link),
reach as (select entry_id as s, entry_id as t from e union select r.s, x.t from reach r join edge x on r.t = x.s),
grp as (select s as entry_id, min(t) as group_id from reach group by s)"""
