"""Issue reports from rule flags: counts, shares, examples, and comparisons of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaryn.functions.text import strip
from tessaryn.operators import duplicates, rules
from tessaryn.operators.rules import APPLICATION_RULES, SEVERITY, SPENDING_RULES, Rule
from tessaryn.runtime import written

EXAMPLES = 5
# The rules of the comparison before and after cleaning, and how they are labelled.
METRICS = [
    ("R_APP_002", "Missing required applicant fields"), ("R_APP_005", "Invalid email format"), ("R_APP_006", "Gender requires standardisation"), ("R_APP_008", "DOB not in ISO format"), ("R_APP_009", "DOB ambiguity"),
    ("R_APP_010", "Annual income coercion issue"), ("R_APP_011", "Annual salary field drift"), ("R_APP_012", "Negative credit history months"), ("R_APP_013", "Negative savings balance"), ("R_APP_014", "Debt-to-income out of range"),
    ("R_APP_018", "Approved with credit history under 6 months"), ("R_SPN_001", "Spending missing category"), ("R_SPN_002", "Spending amount invalid"), ("R_SPN_003", "Spending amount negative"),
]


def severity_rank(c: Column, unknown: int = 99) -> Column:
    out = F.lit(unknown)
    for name, rank in SEVERITY.items():
        out = F.when(F.lower(c) == name, rank).otherwise(out)
    return out


def percent_of(count: Column, total: Column) -> Column:
    """Two places in whole-number arithmetic, halves up: no binary fraction decides a tie. 0 of nothing is 0."""
    n, t = count.cast("bigint"), total.cast("bigint")
    return F.when(t > 0, F.floor((n * 20000 + t) / (2 * t)) / 100.0).otherwise(0.0)


def flagged(df: DataFrame, flags: dict[str, Column], id_col: str = "application_id") -> DataFrame:
    """``_id`` and the names of the ``flags`` that are set, of every row. Writes a table, so that each flag is worked out once."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in flags.items()]))
    return written(df.select(F.col(id_col).cast("string").alias("_id"), hit.alias("_hit")), "flags")


def flag_counts(hits: DataFrame) -> DataFrame:
    """``flag``, ``count``, ``total`` of ``flagged`` rows; a flag that is set nowhere has no row."""
    total = hits.agg(F.count("*").alias("total"))
    return hits.select(F.explode("_hit").alias("flag")).groupBy("flag").agg(F.count("*").alias("count")).join(F.broadcast(total))  # one row


def flag_examples(hits: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """``flag``, ``example_application_ids``: the first ``n`` distinct flagged ids in text order.

    The smallest ids of every task are kept before the shuffle (rank with group limit), never all of a flag.
    """
    ids = hits.select("_id", F.explode("_hit").alias("flag")).where("_id IS NOT NULL").distinct()
    top = ids.withColumn("_r", F.row_number().over(W.partitionBy("flag").orderBy("_id"))).where(F.col("_r") <= n)
    return top.groupBy("flag").agg(F.array_join(F.array_sort(F.collect_list("_id")), "|").alias("example_application_ids"))


def rule_rows(df: DataFrame, flags: dict[str, Column], which: list[Rule], stage: str, examples: bool = True) -> DataFrame:
    """Report rows of the rules whose flag is set anywhere."""
    meta = F.array(*[F.struct(F.lit(r.flag).alias("flag"), F.lit(r.issue_group).alias("issue_group"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.field_path).alias("field_path"), F.lit(r.description).alias("description"), F.lit(r.severity).alias("severity"), F.lit(r.source_pre if stage == "pre" else r.source_post).alias("value_source")) for r in which])
    hits = flagged(df, flags)
    counts = flag_counts(hits).withColumn("m", F.explode(F.filter(meta, lambda m: m["flag"] == F.col("flag"))))
    if examples:
        counts = counts.join(flag_examples(hits), "flag", "left")
    shown = F.coalesce("example_application_ids", F.lit("")) if examples else F.lit("")
    return counts.select(F.lit(stage).alias("stage"), "m.issue_group", "m.rule_id", "m.field_path", "m.description", "count", percent_of(F.col("count"), F.col("total")).alias("percent"), "m.severity", shown.alias("example_application_ids"), "m.value_source")


def duplicate_rows(df: DataFrame, groups: DataFrame, stage: str, number_col: str = "raw_applicant_ssn", numbers: DataFrame | None = None) -> DataFrame:
    """R_DUP_001 to 004: rows and ids that repeat, numbers that repeat and those under several ids. ``numbers``: the repeated numbers, if known."""
    info = {r.rule_id: r for r in rules.RULES if r.rule_id.startswith("R_DUP")}
    total = df.agg(F.count("*").alias("total"))
    many = groups.where("dup_count > 1").select(F.col("application_id").alias("_id"), "dup_count")
    numbers = duplicates.repeated_numbers(df, number_col) if numbers is None else numbers
    holders = df.select(strip(F.col(number_col)).alias("number"), F.col("application_id").alias("_id")).join(numbers, "number")
    sources = {
        "R_DUP_001": (many.agg(F.coalesce(F.sum("dup_count"), F.lit(0)).alias("count")), many),
        "R_DUP_002": (many.agg(F.count("*").alias("count")), many),
        "R_DUP_003": (numbers.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("count")), holders),
        "R_DUP_004": (numbers.where("n_ids > 1").agg(F.count("*").alias("count")), holders.where("n_ids > 1")),
    }
    out = None
    for rule_id, (count, ids) in sources.items():
        r = info[rule_id]
        first = ids.where("_id IS NOT NULL").select("_id").distinct().orderBy("_id").limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list("_id")), "|").alias("example_application_ids"))
        row = count.crossJoin(total).crossJoin(first).where("count > 0").select(  # one row each
            F.lit(stage).alias("stage"), F.lit(r.issue_group).alias("issue_group"), F.lit(rule_id).alias("rule_id"), F.lit(r.field_path).alias("field_path"), F.lit(r.description).alias("description"), "count",
            percent_of(F.col("count"), F.col("total")).alias("percent"), F.lit(r.severity).alias("severity"), "example_application_ids", F.lit(r.source_pre if stage == "pre" else r.source_post).alias("value_source"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def quality_report(apps: DataFrame, spending: DataFrame, stage: str, groups: DataFrame, examples: bool = True, v6: bool = True, numbers: DataFrame | None = None) -> DataFrame:
    """All issues of a stage, by severity, count and rule. ``apps`` and ``spending`` are raw for ``pre``, cleaned for ``post``."""
    out = rule_rows(apps, rules.application_flags(stage, v6), APPLICATION_RULES, stage, examples)
    out = out.unionByName(duplicate_rows(apps, groups, stage, numbers=numbers)).unionByName(rule_rows(spending, rules.spending_flags(stage), SPENDING_RULES, stage, examples))
    return out.orderBy("stage", severity_rank(F.col("severity")), F.desc("count"), "rule_id")


def group_totals(report: DataFrame) -> DataFrame:
    """Issues by group, most first."""
    return report.groupBy("stage", "issue_group").agg(F.sum("count").alias("issues")).orderBy("stage", F.desc("issues"), "issue_group")


def before_after(report: DataFrame, groups: DataFrame) -> DataFrame:
    """Fourteen rule metrics and three fixed rows, before and after cleaning (A10)."""
    spark = report.sparkSession
    wanted = spark.createDataFrame([(i, r, m) for i, (r, m) in enumerate(METRICS)], "_i int, rule_id string, metric_label string")
    side = lambda s: report.where(F.col("stage") == s).select("rule_id", F.col("count").alias(f"{s}_count"), F.col("percent").alias(f"{s}_percent"), F.col("issue_group").alias(f"_{s}"))
    m = wanted.join(side("pre"), "rule_id", "left").join(side("post"), "rule_id", "left").fillna(0, ["pre_count", "post_count", "pre_percent", "post_percent"])
    m = m.select("_i", F.coalesce("_pre", "_post", F.lit("")).alias("issue_group"), "rule_id", "metric_label", "pre_count", "post_count", "pre_percent", "post_percent")
    t = groups.agg(F.sum("dup_count").alias("n"), F.coalesce(F.sum(F.when(F.col("dup_count") > 1, F.col("dup_count"))), F.lit(0)).alias("dup"), F.count_if(F.col("classification") == "conflict").alias("conflict"), F.count("*").alias("canonical"))
    n = F.col("n")
    fixed = F.array(*[
        F.struct(F.lit(20 + i).alias("_i"), F.lit(g).alias("issue_group"), F.lit(r).alias("rule_id"), F.lit(l).alias("metric_label"), a.alias("pre_count"), b.alias("post_count"), percent_of(a, n).alias("pre_percent"), percent_of(b, n).alias("post_percent"))
        for i, (g, r, l, a, b) in enumerate([("Uniqueness", "R_DUP_001", "Duplicate application_id rows", F.col("dup"), F.col("dup")), ("Uniqueness", "R_DUP_CONFLICT", "Duplicate conflict IDs", F.col("conflict"), F.col("conflict")), ("Remediation", "R_DUP_CANONICAL", "Canonical rows retained for analysis", n, F.col("canonical"))])
    ])
    all_rows = m.unionByName(t.select(F.explode(fixed).alias("x")).select("x.*"))
    return all_rows.select("issue_group", "rule_id", "metric_label", "pre_count", "post_count", (F.col("post_count") - F.col("pre_count")).alias("delta_count"), "pre_percent", "post_percent", F.round(F.col("post_percent") - F.col("pre_percent"), 2).alias("delta_percent"), "_i").orderBy("_i").drop("_i")


def rule_deltas(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Two reports side by side by rule (J4, A30): null deltas where one side is missing; texts from post, else pre."""
    keep = ["issue_group", "field_path", "description", "severity"]
    a = pre.select(F.col("rule_id").alias("_ra"), *[F.col(c).alias(f"_a_{c}") for c in keep], F.col("value_source").alias("pre_value_source"), F.col("count").alias("pre_count"), F.col("percent").alias("pre_percent"))
    b = post.select(F.col("rule_id").alias("_rb"), *[F.col(c).alias(f"_b_{c}") for c in keep], F.col("value_source").alias("post_value_source"), F.col("count").alias("post_count"), F.col("percent").alias("post_percent"))
    j = a.join(b, F.col("_ra") == F.col("_rb"), "full_outer")
    return j.select(
        F.coalesce("_ra", "_rb").alias("rule_id"), *[F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in keep], "pre_value_source", "post_value_source", "pre_count", "pre_percent", "post_count", "post_percent",
        (F.col("post_count") - F.col("pre_count")).alias("delta_count"), F.round(F.col("post_percent") - F.col("pre_percent"), 2).alias("delta_pp"),
    )


def top_improvements(deltas: DataFrame, n: int = 15) -> DataFrame:
    return deltas.orderBy(F.asc_nulls_last("delta_pp"), "rule_id").limit(n)


def residual_issues(deltas: DataFrame, n: int = 20) -> DataFrame:
    return deltas.where("post_percent > 0").orderBy(severity_rank(F.col("severity"), 9), F.desc("post_percent"), "rule_id").limit(n)
