"""Mixing sources to target weights (problem 9): Pfair scheduling of blocks.

A mix is cut into ``SLOTS`` slots of equal token size. A source of weight w releases its k-th block
at slot floor(k / w) and must have it placed by ceil((k + 1) / w); earliest deadline first on one
processor meets all deadlines, so after every slot each source is within one block of its share.
A block that a source cannot fill keeps its slot, in part or wholly idle: such sources are short.
Schedules have a fixed number of slots, so a mix is met within one in ``SLOTS`` of its size whatever
that is; documents are tied to blocks by running sums of tokens taken per bucket, so no source is
ever in one task.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaryn.runtime import written

#: Slots of a schedule: the precision of a mix, not a limit on its size. Bits of the hash that make the buckets of a source's running sums.
SLOTS, BUCKET_BITS = 5000, 16
#: Rows of the plan (sources of mixes times their repeats) that are broadcast at most; a larger plan is joined by shuffling.
PLAN_ROWS = 100_000
SCHEDULE = "mix_name string, source string, block bigint, slot bigint, need double, have double"


def targets(mixes: DataFrame) -> DataFrame:
    """``mix_name``, ``source``, ``quota`` (tokens), ``share`` and ``max_repeats``; weights that are null or not positive count 0."""
    m = mixes.where("mix_name IS NOT NULL AND source IS NOT NULL").withColumn("_w", F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)))
    all_of = F.sum("_w").over(W.partitionBy("mix_name"))
    share = F.when(all_of > 0, F.col("_w") / all_of).otherwise(0.0)
    return m.select("mix_name", "source", (share * F.coalesce("total_tokens", F.lit(0))).alias("quota"), share.alias("share"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))


def supply(mixes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``targets`` with the ``supply`` of each source: tokens of all its documents, 0 for a source without any.

    ``sizes`` has ``source`` and ``tokens`` per document. A hot source is one row per task before the shuffle.
    """
    have = sizes.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("supply"))
    return targets(mixes).join(have, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))


def short_sources(mixes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``mix_name``, ``source`` of those that leave slots of the schedule idle, in part or wholly, and whose quota is
    more than all their documents repeated ``max_repeats`` times."""
    plan = written(supply(mixes, sizes), "mix_plan")
    slots = plan.groupBy("mix_name").applyInPandas(_schedule, SCHEDULE)
    idle = slots.where("have < need").select("mix_name", "source").distinct()
    exact = plan.where(F.col("quota") > F.col("max_repeats") * F.col("supply")).select("mix_name", "source")
    return idle.join(exact, ["mix_name", "source"], "left_semi")


def pfair(weights: dict[str, float], blocks: dict[str, int], slots: int = SLOTS) -> list[tuple[str, int, int]]:
    """(source, block, slot) by earliest deadline first; a source stops after its number of ``blocks``, idle slots stay empty."""
    waiting: list[tuple[int, str, int]] = [(0, s, 0) for s in sorted(weights) if weights[s] > 0 and blocks.get(s, 0) > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(slots + len(weights)):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((k + 1) / weights[s] - 1e-9), s, k))
        if ready:
            _, s, k = heapq.heappop(ready)
            out.append((s, k, t))
            if k + 1 < blocks[s]:
                heapq.heappush(waiting, (math.floor((k + 1) / weights[s] + 1e-9), s, k + 1))
    return out


def _schedule(pdf: pd.DataFrame) -> pd.DataFrame:
    mix, total = pdf["mix_name"].iloc[0], pdf["total_tokens"].iloc[0]
    size = max(total / SLOTS, 1e-9)
    pdf = pdf.groupby("source", as_index=False).agg({"quota": "sum", "share": "sum", "max_repeats": "max", "supply": "max"})
    quota = dict(zip(pdf["source"], pdf["quota"], strict=True))
    limit = {s: min(q, float(r) * h) for s, q, r, h in zip(pdf["source"], pdf["quota"], pdf["max_repeats"], pdf["supply"], strict=True)}
    rows = pfair(dict(zip(pdf["source"], pdf["share"], strict=True)), {s: math.ceil(q / size - 1e-9) for s, q in quota.items()})
    upto = lambda end, k: min(max(end - k * size, 0.0), size)
    return pd.DataFrame([(mix, s, k, t, upto(quota[s], k), upto(limit[s], k)) for s, k, t in rows], columns=["mix_name", "source", "block", "slot", "need", "have"])


def mixed(mixes: DataFrame, sizes: DataFrame, seed: int = 17) -> DataFrame:
    """``mix_name``, ``slot``, ``source``, ``doc_id``, ``repeat``, ``start``, ``tokens``: the documents drawn, in order of slot and start.

    Documents of a source come in an order hashed from id and ``seed``; after the last one they start
    over, ``max_repeats`` times at most. A document is drawn if it starts before the source's quota,
    so a source overshoots by less than a document. Sources that are short leave their slots empty.
    A source named twice in a mix has the sum of its quotas in the schedule. Documents without tokens,
    null sources and sources of no mix are not drawn. Document ids that occur twice are two documents.
    """
    plan = written(supply(mixes, sizes), "mix_plan")
    schedule = plan.groupBy("mix_name").applyInPandas(_schedule, SCHEDULE).select("mix_name", "source", "block", "slot")
    wanted = plan.select("source").distinct()
    docs = sizes.where("tokens > 0").join(wanted, "source", "left_semi").withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    docs = docs.withColumn("_b", F.shiftrightunsigned("_h", 64 - BUCKET_BITS).cast("int"))  # ranges of the hash
    sums = docs.groupBy("source", "_b").agg(F.sum("tokens").alias("_sum"))
    sums = sums.select("source", "_b", (F.sum("_sum").over(W.partitionBy("source").orderBy("_b")) - F.col("_sum")).alias("_before"))
    inside = W.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    docs = docs.withColumn("_in", F.sum("tokens").over(inside) - F.col("tokens")).join(sums, ["source", "_b"])
    docs = docs.select("source", "doc_id", "tokens", (F.col("_before") + F.col("_in")).alias("_at"))
    limit = F.least("quota", F.col("max_repeats") * F.col("supply"))
    rounds = plan.where("supply > 0").select("mix_name", "source", "supply", limit.alias("_limit"), (F.col("total_tokens") / SLOTS).alias("_size"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(limit / F.nullif("supply", F.lit(0))) - 1, F.lit(0)).cast("int"))).alias("repeat"))
    rounds = written(rounds, "mix_rounds")
    drawn = docs.join(F.broadcast(rounds) if rounds.count() <= PLAN_ROWS else rounds, "source").withColumn("start", F.col("_at") + F.col("repeat") * F.col("supply")).where("start < _limit")
    drawn = drawn.withColumn("block", F.floor(F.col("start") / F.nullif("_size", F.lit(0.0))))
    return drawn.join(schedule, ["mix_name", "source", "block"], "left").select("mix_name", "slot", "source", "doc_id", "repeat", "start", "tokens")


def shares(mixes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each mix's sources with target and reached shares, tokens, documents and the most often that one was used."""
    drawn = mixed(mixes, sizes).groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), (F.max("repeat") + 1).alias("repeats"))
    out = targets(mixes).select("mix_name", "source", "quota", F.col("share").alias("target_share")).join(drawn, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "repeats"])
    return out.withColumn("share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(W.partitionBy("mix_name")), F.lit(0)), F.lit(0.0)))


def deviations(mixes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``mix_name``, ``source``, ``blocks``, ``most``: how many blocks a source is ahead of or behind its share of the slots so
    far at most, over all slots of the schedule. Pfair keeps it under one."""
    plan = written(supply(mixes, sizes), "mix_plan")
    slots = plan.groupBy("mix_name").applyInPandas(_schedule, SCHEDULE)
    weights = plan.groupBy("mix_name", "source").agg(F.sum("share").alias("share"))
    placed = slots.join(weights, ["mix_name", "source"])
    ahead, behind = F.col("block") + 1 - F.col("share") * (F.col("slot") + 1), F.col("share") * F.col("slot") - F.col("block")
    return placed.groupBy("mix_name", "source").agg(F.count("*").alias("blocks"), F.max(F.greatest(ahead, behind)).alias("most"))
