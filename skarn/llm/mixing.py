"""Mixing sources to target weights, scheduled as proportionate (Pfair) shares."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.names import name_key
from skarn.operators.prefix import grouped_prefix
from skarn.sources.tables import materialize, ship

#: Tokens of a block, the unit that takes one slot.
BLOCK_TOKENS = 4096


def schedule(goals: dict[str, tuple[float, int]]) -> Iterator[tuple[str, int]]:
    """(source, k) for slot 0, 1, 2 ...: the k-th block of which source takes the slot.

    goals: weight and number of blocks of each source. In an ideal mix all sources advance at
    once, each at its weight over those of the sources that still have blocks; progress there is
    virtual time, of which a slot takes 1 / (sum of their weights). Block k of a source of weight
    w is released at k / w and due at (k + 1) / w. In each slot the released block with the
    earliest deadline runs (larger weights, then names win ties), so each source stays within one
    block of the ideal mix at every slot, for any number of sources and any weights: deadlines
    come from k and w alone and nothing adds up over time. A source that runs out hands its slots
    on to the others by their weights. No slot stays empty; memory is the number of sources.
    """
    live = {s: (float(w), n) for s, (w, n) in goals.items() if w > 0 and n > 0}
    waiting = [(0.0, s, 0) for s in sorted(live)]
    heapq.heapify(waiting)
    ready: list[tuple[float, float, str, int]] = []
    ends = sorted((n / w, w) for w, n in live.values())  # virtual times at which sources run out
    sums = [0.0]
    for _, w in reversed(ends):
        sums.append(sums[-1] + w)
    active = sums[-1]  # the weights of the sources that still have blocks
    gone, phase_at, phase_time = 0, 0.0, 0.0  # sources that ran out, and the slot and virtual time since then
    for slot in range(sum(n for _, n in live.values())):
        while gone < len(ends) and phase_at + (ends[gone][0] - phase_time) * active <= slot:
            phase_at, phase_time = phase_at + (ends[gone][0] - phase_time) * active, ends[gone][0]
            gone += 1
            active = sums[len(ends) - gone]
        now = phase_time + (slot - phase_at) / active if gone < len(ends) else float("inf")
        while waiting and (waiting[0][0] <= now * (1 + 1e-12) or not ready):
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, ((k + 1) / live[s][0], -live[s][0], s, k))
        _, _, s, k = heapq.heappop(ready)
        yield s, k
        if k + 1 < live[s][1]:
            heapq.heappush(waiting, ((k + 1) / live[s][0], s, k + 1))


def source_report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """source, weight, max_repeats, tokens, total, needed, goal for each source of the targets.

    documents: source, n_tokens; targets: source, weight, max_repeats. total is the tokens of all
    documents, of sources without a target too, needed is weight x total, and goal what of it the
    source can give by repeating its documents max_repeats times. Spellings of one source count
    together; null weights and repeats count 0; targets named twice keep the larger weight.
    """
    d = documents.groupBy(name_key(F.col("source")).alias("__key")).agg(F.sum("n_tokens").alias("tokens"))
    d = materialize(d.withColumn("tokens", F.coalesce("tokens", F.lit(0))), "sums")
    total = d.agg(F.sum("tokens").alias("t")).first().t or 0  # one row of sums
    w = F.coalesce(F.col("weight"), F.lit(0.0))
    t = targets.withColumn("__key", name_key(F.col("source"))).groupBy("__key").agg(F.max(F.struct(w.alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), "source")).alias("x")).select("__key", "x.*")
    out = t.join(d, "__key", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "total": F.lit(total).cast("long")})
    need = F.col("weight").cast("decimal(18,9)") * F.col("total")
    return out.withColumn("needed", need).withColumn("goal", F.least(F.ceil("needed").cast("decimal(38,0)"), F.col("max_repeats").cast("decimal(18,0)") * F.col("tokens")).cast("long"))


def mix_sources(documents: DataFrame, report: DataFrame, seed: int = 17, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, pass, n_tokens, slot, offset: the mix, in the order of slot, then offset.

    documents: doc_id (unique), source, n_tokens; report: of `source_report`. Each source's
    documents stand in a random order (hash of seed and doc_id) and are gone through again, up to
    max_repeats times, until they reach weight x total tokens; so the mix is as large as the
    corpus but for what sources cannot give. The source's tokens, in that order, are cut into
    blocks for `schedule`. A document goes out whole, in the slot of the block that holds its
    middle, and the slots of the other blocks it fills stay without documents; so at every slot a
    source is less than one block and half a document away from the ideal mix, and with its last
    document, which goes out though it may reach beyond the goal, one block and a document.

    The schedule is made in one task from the goals alone (one row per target), and written as it
    is made, a step per block: at 10^13 tokens blocks of 2^20 tokens keep it to minutes. Running
    sums of documents are taken across partitions, so a source of a third of all documents is
    spread over many tasks. Documents of sources without a target or weight, and those of no
    tokens, are left out.
    """
    goals = report.filter("weight > 0 and goal > 0").select("__key", "source", "weight", "tokens", "goal")
    plan = {r["__key"]: (float(r.weight), -(-r.goal // block_tokens)) for r in goals.collect()}  # one per target
    spark = documents.sparkSession
    ship(spark)

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _b in _:
            if not _b.num_rows:
                continue
            keys, ks, first = [], [], 0
            for s, k in schedule(plan):
                keys.append(s)
                ks.append(k)
                if len(ks) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ks, pa.int64()), pa.array(range(first, first + len(ks)), pa.int64())], ["__key", "k", "slot"])
                    first += len(ks)
                    keys, ks = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ks, pa.int64()), pa.array(range(first, first + len(ks)), pa.int64())], ["__key", "k", "slot"])

    slots = materialize(spark.range(1, numPartitions=1).mapInArrow(run, "__key string, k long, slot long"), "slots")
    d = documents.select("doc_id", name_key(F.col("source")).alias("__key"), "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("__h")).filter("n_tokens > 0").join(goals.select("__key"), "__key", "left_semi")
    ranked = grouped_prefix(d, ["__key"], ["__h", "doc_id"], "n_tokens").join(goals, "__key")
    # a document's passes that begin below the goal
    last = F.floor((F.col("goal") - F.col("before") - 1) / F.col("tokens")).cast("long")
    rows = ranked.filter("before < goal").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("offset", F.col("pass") * F.col("tokens") + F.col("before"))
    middle = F.least(F.col("offset") + F.floor(F.col("n_tokens") / 2), F.col("goal") - 1)
    rows = rows.withColumn("k", F.floor(middle / block_tokens).cast("long"))
    return rows.join(slots, ["__key", "k"]).select("doc_id", "source", F.col("pass").cast("int").alias("pass"), "n_tokens", "slot", "offset")


def share_report(mix: DataFrame, report: DataFrame) -> DataFrame:
    """source, weight, tokens, max_repeats, needed, documents, mixed_tokens, share, reached: what
    of its weight each source got in the mix. reached: the mix has weight x total tokens of it;
    documents go out whole, so a source that reaches its weight may exceed it by part of one."""
    got = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("mixed_tokens"))
    got = got.withColumn("share", F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))))  # one row per target
    out = report.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    return out.select("source", "weight", "tokens", "max_repeats", F.col("needed").cast("double").alias("needed"), F.coalesce("documents", F.lit(0)).alias("documents"), "mixed_tokens", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"), (F.col("mixed_tokens") >= F.col("needed")).alias("reached"))
