"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.graph import connected_components
from skarn.operators.prefix import grouped_prefix
from skarn.sources.tables import materialize

#: Components of at least this share of all records are placed one by one, since there are at most
#: 1 / LARGE of them; smaller ones are placed with all others of their size.
LARGE = 0.001


def record_entities(slots: DataFrame, families: DataFrame) -> DataFrame:
    """The bipartite graph: (shard, robot_idx, split, entity), an entity being a robot or a
    family of a robot. Slots that name no robot have no edge."""
    named = slots.filter("robot is not null")
    own = named.select("shard", "robot_idx", "split", F.col("robot").alias("entity"))
    return own.unionByName(named.join(families, "robot").select("shard", "robot_idx", "split", F.concat(F.lit("f"), F.col("family")).alias("entity")))


def components(slots: DataFrame, families: DataFrame) -> DataFrame:
    """(shard, robot_idx, split, robot, component) for each slot, by minimum-label propagation
    over the bipartite graph. All slots of a robot meet in the robot's node, so the propagation
    runs over robots and families alone, however many slots they have; a slot that names no
    robot is a component of its own."""
    edges = families.select(F.col("robot").alias("src"), F.concat(F.lit("f"), F.col("family")).alias("dst"))
    comp = connected_components(edges).select(F.col("node").alias("robot"), "component")
    alone = F.concat(F.lit("s"), F.coalesce("shard", F.lit("")), F.lit("#"), F.col("robot_idx").cast("string"))
    return slots.join(comp, "robot", "left").withColumn("component", F.coalesce("component", "robot", alone)).select("shard", "robot_idx", "split", "robot", "component")


def leaking_slots(slots: DataFrame, families: DataFrame) -> DataFrame:
    """(shard, robot_idx) of each slot that shares a robot or a family with a slot of another
    split. Components that lie in one split cannot leak and are left out first; then the first
    round of the propagation, with splits as labels, tells which entities two splits share. Both
    labels are partial aggregates, so a family of a third of all slots is no hot task. Slots
    whose split is null are compared as a split of that name."""
    at = F.coalesce("split", F.lit(""))
    whole = materialize(components(slots, families).withColumn("split", at), "components")
    mixed = whole.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo < hi").select("component")
    edges = record_entities(whole.join(mixed, "component", "left_semi"), families)
    shared = edges.groupBy("entity").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo < hi").select("entity")
    return edges.join(shared, "entity", "left_semi").select("shard", "robot_idx").distinct()


def assign_splits(records: DataFrame, key: list[str], targets: DataFrame) -> DataFrame:
    """key, component, label, new_split: all records of a component in one split.

    records: key columns, component, label (a stratum, of which there are few); targets: split,
    share. Components are placed from the largest to the smallest, each size minding what the
    shares of all labels lack after the larger ones, so that the small ones even out what the
    large ones disturb. Those of at least LARGE of all records go one after another where they
    disturb the shares of all labels least. The others go by powers of two of their size: of one
    size, the components of each stratum (their commonest label) stand in a random order, running
    sums of their sizes are cut at what each split lacks of the label, and the labels of all
    records placed are counted again. A null label is the label ''. Components are never cut, so
    one larger than any share goes where it disturbs least. Without targets, or records, no rows.
    """
    shares = {r.split: float(r.share) for r in targets.filter("split is not null and share > 0").groupBy("split").agg(F.max("share").alias("share")).collect()}
    shares = {k: v / sum(shares.values()) for k, v in sorted(shares.items())}
    if not shares:
        return records.limit(0).select(*key, "component", "label", F.lit("").alias("new_split"))
    r = materialize(records.select(*key, "component", F.coalesce("label", F.lit("")).alias("label")), "records")
    sizes = materialize(r.groupBy("component", "label").agg(F.count("*").alias("n")), "labels")
    by_comp = materialize(sizes.groupBy("component").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).select("component", "n", F.col("top.label").alias("stratum")), "sizes")
    totals = {x.label: x.n for x in sizes.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    everything = sum(totals.values())
    big = by_comp.filter(F.col("n") >= LARGE * everything).select("component")
    held = {s: dict.fromkeys(totals, 0) for s in shares}
    placed: dict[str, str] = {}
    rows: dict[str, dict] = {}
    for x in sizes.join(big, "component", "left_semi").collect():
        rows.setdefault(x.component, {})[x.label] = x.n
    for comp, counts in sorted(rows.items(), key=lambda kv: (-sum(kv[1].values()), kv[0])):
        def cost(s: str) -> float:
            return sum(((held[s][k] + v - shares[s] * totals[k]) ** 2 - (held[s][k] - shares[s] * totals[k]) ** 2) / (shares[s] * totals[k]) for k, v in counts.items())  # noqa: B023

        best = min(shares, key=lambda s: (cost(s), s))
        placed[comp] = best
        for k, v in counts.items():
            held[best][k] += v
    spark = records.sparkSession
    small = by_comp.join(big, "component", "left_anti").withColumns({"octave": F.floor(F.log2("n")).cast("int"), "__h": F.xxhash64("component")})
    ranked = materialize(grouped_prefix(small, ["octave", "stratum"], ["__h", "component"], "n"), "ranked")
    sums = {(x.octave, x.stratum): x.n for x in ranked.groupBy("octave", "stratum").agg(F.sum("n").alias("n")).collect()}  # sizes' logarithms x labels
    kind = "octave int, label string, new_split string, low double, high double"
    cuts: list[tuple] = []

    def spots(rows: list[tuple], of: DataFrame) -> DataFrame:
        cut = spark.createDataFrame(rows, kind).withColumnsRenamed({"octave": "__o", "label": "__l"})
        middle = F.col("before") + F.col("n") / 2
        return of.join(cut, (F.col("octave") == F.col("__o")) & (F.col("stratum") == F.col("__l")) & (middle >= F.col("low")) & (middle < F.col("high"))).select("component", "new_split")

    octaves = sorted({o for o, _ in sums}, reverse=True)
    for octave in octaves:
        new = []
        for label in [x for o, x in sums if o == octave]:
            lack = {s: max(shares[s] * totals[label] - held[s][label], 0.0) for s in shares}
            if not sum(lack.values()):
                lack = dict(shares)
            whole, below = sum(lack.values()), 0.0
            for k, s in enumerate(shares):
                top = sums[octave, label] + 1.0 if k + 1 == len(shares) else (below + lack[s]) / whole * sums[octave, label]
                new.append((octave, label, s, below / whole * sums[octave, label], top))
                below += lack[s]
        cuts += new
        if octave != octaves[-1]:
            for x in spots(new, ranked.filter(F.col("octave") == octave)).join(sizes, "component").groupBy("new_split", "label").agg(F.sum("n").alias("n")).collect():
                held[x.new_split][x.label] += x.n
    both = spots(cuts, ranked)
    if placed:
        both = both.unionByName(spark.createDataFrame(list(placed.items()), "component string, new_split string"))
    return r.join(both, "component").select(*key, "component", "label", "new_split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """new_split, label, records, share, target: the share of each label that each split got."""
    n = assigned.groupBy("new_split", "label").agg(F.count("*").alias("records"))
    return n.withColumn("share", F.round(F.col("records") / F.sum("records").over(Window.partitionBy("label")), 6)).join(targets.select(F.col("split").alias("new_split"), F.col("share").alias("target")), "new_split", "left")
