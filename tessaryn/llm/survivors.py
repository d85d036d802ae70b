"""Best representative of each duplicate group (problem 6): currency reasoning.

Rows with an instant are ordered by it. For the others a precedence of value forms is learned from
timestamped rows: a form that regularly gives way to another is the older one. Each group's forms
are partially ordered by the learned edges, and the forms that no other form of the group succeeds
are the latest. Declared preferences (trust, row id) settle what the partial order leaves open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaryn.functions.moments import with_instant
from tessaryn.functions.text import bare, missing
from tessaryn.runtime import written

#: A learned edge needs so many more transitions one way than the other, and so large a share of them.
MIN_LEAD, MIN_SHARE = 20, 0.6


def form(c: Column) -> Column:
    """The form of a value: runs of lower-case letters a, of capitals A, of digits 9; the rest as it is."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\p{N}+", "9")


def prepared(df: DataFrame, sources: DataFrame, id_col: str, row_col: str, time_col: str, source_col: str, fields: list[str]) -> DataFrame:
    """``group_key``, ``row_id``, ``instant``, ``rank`` (lower is more trusted, null for none) and the fields."""
    s = sources.select(F.col("source_system").alias("_source"), "default_zone", "day_order", F.col("trust_rank").alias("rank")).where("_source IS NOT NULL").dropDuplicates(["_source"])
    out = df.select(
        bare(F.col(id_col)).alias("group_key"), F.col(row_col).cast("bigint").alias("row_id"), F.col(time_col).alias("_time"), F.col(source_col).alias("_of"), *[F.col(f).cast("string").alias(f) for f in fields]
    ).where("group_key <> ''")
    out = out.join(s, F.col("_of") == F.col("_source"), "left")
    out = with_instant(out, "instant", F.col("_time"), F.col("default_zone"), F.col("day_order"))
    return out.select("group_key", "row_id", "instant", "rank", *fields)


def _preference(*first: Column) -> Column:
    return F.struct(*first, F.coalesce(-F.col("rank"), F.lit(-(2**31) + 1)).alias("trust"), F.col("row_id").alias("row"))


def surviving_rows(prep: DataFrame, fields: list[str], edges: DataFrame | None = None) -> DataFrame:
    """``group_row_id``, ``field_name``, ``value_row_id`` for each group of two or more rows.

    Nulls, blanks and placeholders never survive; a field with nothing else has no row. Without
    ``edges``: the latest instant wins, rows without one come last, then the smaller rank, then the
    larger row id. With ``edges`` (from ``learned_edges``) a value without instant whose form succeeds
    the latest dated one, and the latest form where no value has an instant, win over rank and row id.
    One hash aggregation; a hot group is one row per task before the shuffle.
    """
    order = _preference(F.col("instant"))  # a null instant sorts first
    best = [F.max_by("row_id", F.when(~missing(F.col(f)), order)).alias(f"_b{i}") for i, f in enumerate(fields)]
    groups = prep.groupBy("group_key").agg(F.min("row_id").alias("group_row_id"), F.count("*").alias("_n"), *best).where("_n > 1")
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_b{i}").alias("value_row_id")) for i, f in enumerate(fields)])
    if edges is None:
        return groups.select("group_row_id", F.explode(pairs).alias("_v")).select("group_row_id", "_v.*").where("value_row_id IS NOT NULL")

    states = _states(prep, fields)
    dated = states.where("instant IS NOT NULL")
    last = dated.groupBy("group_key", "field_name").agg(F.max_by("state", F.struct("instant", "pref")).alias("state"))
    undated = states.where("last_undated IS NOT NULL").select("group_key", "field_name", "state")
    open_ones = last.union(undated).distinct()
    later = open_ones.join(edges, ["field_name", "state"]).select("group_key", "field_name", "state", F.col("next_state").alias("_next"))
    there = open_ones.select("group_key", "field_name", F.col("state").alias("_next"))
    beaten = later.join(there, ["group_key", "field_name", "_next"], "left_semi").select("group_key", "field_name", "state").distinct()
    live = open_ones.join(beaten, ["group_key", "field_name", "state"], "left_anti")
    pick = live.join(states, ["group_key", "field_name", "state"]).groupBy("group_key", "field_name").agg(F.max_by("pref.row", F.struct("instant", "pref")).alias("value_row_id"))
    return pick.join(groups.select("group_key", "group_row_id"), "group_key").select("group_row_id", "field_name", "value_row_id")


def _long(prep: DataFrame, fields: list[str]) -> DataFrame:
    values = F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(~missing(F.col(f)), form(F.col(f))).alias("state")) for f in fields])
    return prep.select("group_key", "row_id", "instant", "rank", F.explode(values).alias("_v")).select("group_key", "row_id", "instant", "rank", "_v.*").where("state IS NOT NULL")


def _states(prep: DataFrame, fields: list[str]) -> DataFrame:
    """Each group's forms by field, with the best dated row or else the best undated one."""
    return (
        _long(prep, fields)
        .groupBy("group_key", "field_name", "state")
        .agg(F.max("instant").alias("instant"), F.max_by(_preference(), F.struct(F.col("instant"), _preference())).alias("pref"), F.max(F.when(F.col("instant").isNull(), F.col("row_id"))).alias("last_undated"))
    )


def learned_edges(prep: DataFrame, fields: list[str], min_lead: int = MIN_LEAD, min_share: float = MIN_SHARE) -> DataFrame:
    """``field_name``, ``state``, ``next_state``: forms that give way to others in timestamped rows.

    Transitions are counted exactly between neighbours in time. The lag is taken inside each day of a
    group and between days, so that no window holds more than one group's day or one row per day.
    Edges follow a score by which forms are totally ordered, so they have no cycle.
    """
    day = F.to_date("instant")
    rows = _long(prep, fields).where("instant IS NOT NULL").select("group_key", "field_name", "state", "instant", "row_id", day.alias("_day"))
    in_day = W.partitionBy("group_key", "field_name", "_day").orderBy("instant", "row_id")
    within = rows.select("field_name", F.lag("state").over(in_day).alias("state"), F.col("state").alias("next_state"))
    at = F.struct("instant", "row_id")
    days = rows.groupBy("group_key", "field_name", "_day").agg(F.min_by("state", at).alias("_first"), F.max_by("state", at).alias("_last"))
    by_day = W.partitionBy("group_key", "field_name").orderBy("_day")
    across = days.select("field_name", F.lag("_last").over(by_day).alias("state"), F.col("_first").alias("next_state"))
    moves = within.union(across).where("state <> next_state").groupBy("field_name", "state", "next_state").agg(F.count("*").alias("n"))
    moves = written(moves, "transitions")
    back = moves.select("field_name", F.col("next_state").alias("state"), F.col("state").alias("next_state"), F.col("n").alias("_m"))
    lead = moves.join(back, ["field_name", "state", "next_state"], "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    lead = lead.where((F.col("n") - F.col("_m") >= min_lead) & (F.col("n") >= min_share * (F.col("n") + F.col("_m"))))
    ends = moves.select("field_name", F.explode(F.array(F.struct(F.col("state").alias("s"), (-F.col("n")).alias("d"), "n"), F.struct(F.col("next_state").alias("s"), F.col("n").alias("d"), "n"))).alias("e"))
    score = ends.groupBy("field_name", F.col("e.s").alias("s")).agg((F.sum("e.d") / F.sum("e.n")).alias("score"))
    a = score.select("field_name", F.col("s").alias("state"), F.col("score").alias("_a"))
    b = score.select("field_name", F.col("s").alias("next_state"), F.col("score").alias("_b"))
    return lead.join(a, ["field_name", "state"]).join(b, ["field_name", "next_state"]).where("_b > _a").select("field_name", "state", "next_state")


def evidence(prep: DataFrame, fields: list[str]) -> DataFrame:
    """How well the learned order does where the truth is known: ``field_name``, ``edges``, ``n``, ``decided``, ``right``, ``right_without``.

    Precedence is learned from four fifths of the groups. In the others all instants are hidden, and the
    value chosen is held against the one of the latest instant: ``n`` choices between values that
    differ, ``decided`` of them by the learned order (another row than trust and row id would give),
    ``right`` with it, ``right_without`` by trust and row id alone. Writes tables.
    """
    held = F.pmod(F.xxhash64("group_key"), F.lit(5)) == 0
    edges = written(learned_edges(prep.where(~held), fields), "edges")
    test = written(prep.where(held), "held_out")
    hidden = test.withColumn("instant", F.lit(None).cast(prep.schema["instant"].dataType))
    values = F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(~missing(F.col(f)), bare(F.col(f))).alias("value")) for f in fields])
    long = test.select("group_key", "row_id", "instant", F.explode(values).alias("v")).select("group_key", "row_id", "instant", "v.*").where("value IS NOT NULL")
    open_ones = long.groupBy("group_key", "field_name").agg(F.count_distinct("value").alias("_k"), F.count("instant").alias("_d")).where("_k > 1 AND _d > 0")
    first = test.groupBy("group_key").agg(F.min("row_id").alias("group_row_id"))
    out = open_ones.join(first, "group_key").select("group_row_id", "field_name")
    for name, chosen in (("true", surviving_rows(test, fields)), ("with", surviving_rows(hidden, fields, edges)), ("without", surviving_rows(hidden, fields))):
        value = long.select(F.col("row_id").alias("value_row_id"), "field_name", F.col("value").alias(f"_{name}"))
        out = out.join(chosen.join(value, ["value_row_id", "field_name"]).select("group_row_id", "field_name", f"_{name}", F.col("value_row_id").alias(f"_row_{name}")), ["group_row_id", "field_name"])
    got = out.groupBy("field_name").agg(F.count("*").alias("n"), F.count_if(F.col("_row_with") != F.col("_row_without")).alias("decided"), F.count_if(F.col("_with") == F.col("_true")).alias("right"), F.count_if(F.col("_without") == F.col("_true")).alias("right_without"))
    known = edges.groupBy("field_name").agg(F.count("*").alias("edges"))
    return got.join(known, "field_name", "left").select("field_name", F.coalesce("edges", F.lit(0)).alias("edges"), "n", "decided", "right", "right_without")
