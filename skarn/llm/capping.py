"""Capping records per dominant contributor, by distributed b-matching."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.prefix import grouped_prefix
from skarn.sources.tables import discard, materialize

#: Rows of one block of the order; within a block places are counted in one task.
BLOCK = 1_000_000
#: A threshold that holds every proposal.
ALL = 2**62


def _numbers(values: list[int]) -> Column:
    """A constant array: one literal that the optimizer folds, however many numbers it has."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _step(pos: Column, contributors: Column, thresholds: Column, full: Column) -> Column:
    """1 where all of a record's contributors hold it, -1 - c where c is full, else 0."""
    held = F.forall(contributors, lambda c: pos <= thresholds[c])
    gone = F.array_max(F.transform(contributors, lambda c: F.when(full[c] == 1, c)))
    return F.when(held, F.lit(1)).when(gone.isNotNull(), -1 - gone).otherwise(0)


def cap_contributors(records: DataFrame, edges: DataFrame, order: list[str], max_permille: int) -> tuple[DataFrame, DataFrame]:
    """(kept, contributors): which records stay so that no contributor exceeds its capacity.

    records: record (unique), with the columns of `order` ('-name' for descending; nulls last;
    record breaks ties); edges: record, contributor, each record with any number of contributors.
    A contributor's capacity is max_permille of all records, rounded down. kept: record, kept,
    dropped_by (a contributor that was full of better records, null for kept ones). contributors:
    contributor, demand, capacity, displaced (how many proposals it displaced in the first round).

    Suitor matching with capacities: every open record proposes to all its contributors; a
    contributor holds the best proposals up to what is left of its capacity and displaces the
    rest. A record held by all its contributors is kept, since no better record can displace it;
    one of a full contributor is dropped and withdraws its other proposals, which lets displaced
    ones move up in the next round. It ends with the matching of the greedy order: a record is
    dropped only if one of its contributors is full of better ones. Repeated edges count once;
    edges without a contributor or of unknown records are ignored; records without edges are kept.

    Contributors within their capacity displace nothing and take no part; the others number at
    most edges / capacity, and only their thresholds (the place in the order of the last proposal
    held) come to the driver, one number each. In every round the contributor of the smallest
    threshold keeps all it holds and is full, so there are at most as many rounds as contributors
    above their capacity. A round counts open proposals per contributor and block of the order,
    ranks the one block in which a threshold falls, and rewrites the open records, which are map
    steps but for those counts, so a contributor of a third of all records is spread over many
    tasks. What became of a record is worked out last, in one pass, from the rounds' thresholds.
    """
    total = records.count()
    capacity = total * max_permille // 1000
    cols = [f"__o{i}" for i in range(len(order))]
    ranked = records.select("record", *[F.col(c.lstrip("-")).alias(a) for a, c in zip(cols, order)])
    keys = [(F.col(a).desc_nulls_last() if c.startswith("-") else F.col(a).asc_nulls_last()) for a, c in zip(cols, order)]
    ranked = grouped_prefix(ranked, [], [*keys, "record"]).select("record", F.col("rank").alias("pos"))
    links = edges.select("record", "contributor").filter("contributor is not null").distinct().join(records.select("record"), "record", "left_semi")
    demand = materialize(links.groupBy("contributor").agg(F.count("*").alias("demand")), "demand")
    over = [r.contributor for r in demand.filter(F.col("demand") > capacity).orderBy("contributor").collect()]  # at most edges / capacity
    spark = records.sparkSession
    ids = spark.createDataFrame(list(enumerate(over)), f"c int, contributor {edges.schema['contributor'].dataType.simpleString()}")
    theirs = links.join(ids, "contributor").groupBy("record").agg(F.collect_set("c").alias("cs"))
    size = min(BLOCK, total // 64 + 1)
    state = materialize(ranked.join(theirs, "record", "left").withColumn("block", (F.col("pos") / size).cast("long")), "order")
    open_ = state.filter("cs is not null")
    left = [capacity] * len(over)
    rounds: list[tuple[list[int], list[int]]] = []
    displaced: list[int] = []
    own: DataFrame | None = None
    while over:
        proposals = open_.select("pos", "block", F.explode("cs").alias("c"))
        counts = proposals.groupBy("c", "block").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("c").orderBy("block"))
        counts = counts.withColumns({"upto": upto, "whole": F.sum("n").over(Window.partitionBy("c"))})
        room = counts.withColumn("room", _numbers(left)[F.col("c")])
        crossed = room.filter("whole > room and upto > room and upto - n <= room").select("c", "block", (F.col("room") - (F.col("upto") - F.col("n"))).alias("place"), "whole")
        here = proposals.join(crossed, ["c", "block"]).withColumn("at", F.row_number().over(Window.partitionBy("c").orderBy("pos")))
        thresholds, seen = [ALL] * len(over), [0] * len(over)
        for r in here.filter(F.col("at") == F.col("place") + 1).select("c", "pos", "whole").collect():  # one row per contributor
            thresholds[r.c], seen[r.c] = r.pos - 1, r.whole
        if not rounds:
            displaced = [max(0, n - capacity) for n in seen]
        if min(thresholds) == ALL:  # all that is open is held
            rounds.append((thresholds, [0] * len(over)))
            break
        held = F.forall("cs", lambda c: F.col("pos") <= _numbers(thresholds)[c])
        used = {r.c: r.n for r in open_.filter(held).select(F.explode("cs").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
        left = [n - used.get(c, 0) for c, n in enumerate(left)]
        full = [int(n == 0) for n in left]
        rounds.append((thresholds, full))
        after = materialize(open_.filter(_step(F.col("pos"), F.col("cs"), _numbers(thresholds), _numbers(full)) == 0), "open")
        if own is not None:
            discard(own)
        open_ = own = after
    fate = F.lit(1)
    if rounds:
        plan = F.from_json(F.lit(json.dumps([{"t": t, "f": f} for t, f in rounds])), "array<struct<t:array<bigint>,f:array<bigint>>>")
        fate = F.aggregate(plan, F.lit(0), lambda acc, r: F.when(acc != 0, acc).otherwise(_step(F.col("pos"), F.col("cs"), r["t"], r["f"]).cast("int")))
        fate = F.when(F.col("cs").isNull(), 1).otherwise(fate)
    fates = materialize(state.withColumn("fate", fate), "fates")
    kept = fates.withColumn("c", F.when(F.col("fate") < 0, -1 - F.col("fate")).cast("int")).join(ids.withColumnRenamed("contributor", "dropped_by"), "c", "left").select("record", (F.col("fate") == 1).alias("kept"), "dropped_by")
    out = demand.join(ids.withColumn("displaced", _numbers(displaced)[F.col("c")]), "contributor", "left")
    return kept, out.select("contributor", "demand", F.lit(capacity).cast("long").alias("capacity"), F.coalesce("displaced", F.lit(0)).cast("long").alias("displaced"))
