"""Governance evidence: timestamp profiles, group checks, duplicate summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaryn.functions.fields import iso_instant, shortened
from tessaryn.functions.text import blank, strip


def timestamp_profile(df: DataFrame, dataset: str, col: str, as_of: str, id_col: str = "application_id", row_col: str = "application_row_id", examples: int = 10) -> DataFrame:
    """One row of missing, unparseable and future counts and shares and the first ids by row; nulls for an absent column."""
    if col not in df.columns:
        names = ["missing_count", "missing_pct", "parse_failed_count", "parse_failed_pct", "future_ts_count", "future_ts_pct"]
        return df.agg(F.count("*").alias("n_rows")).select(F.lit(dataset).alias("dataset"), F.lit(col).alias("field"), "n_rows", F.lit(0).alias("has_field"), *[F.lit(None).cast("bigint" if n.endswith("count") else "double").alias(n) for n in names], F.lit(None).cast("string").alias("example_ids"))
    raw = F.col(col).cast("string")
    parsed = F.col(col).cast("timestamp") if dict(df.dtypes)[col].startswith("timestamp") else iso_instant(raw)
    gone = blank(raw) | F.coalesce(F.lower(strip(raw)) == "nan", F.lit(False))
    failed, future = ~gone & parsed.isNull(), F.coalesce(parsed > F.to_timestamp(F.lit(as_of)) + F.expr("INTERVAL 1 DAY"), F.lit(False))
    d = df.select(F.col(id_col).cast("string").alias("_id"), F.col(row_col).alias("_row"), gone.alias("g"), failed.alias("p"), future.alias("f"))
    one = d.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(f"_{c}") for c in ("g", "p", "f")])
    first = d.where("g OR p OR f").orderBy("_row").limit(examples).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "_id"))), lambda x: x["_id"]), ",").alias("_e"))
    share = lambda c: F.col(c) / F.nullif("n_rows", F.lit(0))
    return one.crossJoin(first).select(  # one row each
        F.lit(dataset).alias("dataset"), F.lit(col).alias("field"), "n_rows", F.lit(1).alias("has_field"), F.col("_g").alias("missing_count"), share("_g").alias("missing_pct"), F.col("_p").alias("parse_failed_count"), share("_p").alias("parse_failed_pct"),
        F.col("_f").alias("future_ts_count"), share("_f").alias("future_ts_pct"), F.nullif("_e", F.lit("")).alias("example_ids"),
    )


def group_check(analysis: DataFrame, duplicates: DataFrame, col: str) -> DataFrame:
    """Duplicated and conflicting applications by group, nulls as ``missing``, largest first."""
    d = duplicates.select(F.col("application_id").alias("_id"), "classification").distinct()
    rows = analysis.join(d, F.col("application_id") == F.col("_id"), "left")
    g = rows.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("missing")).alias(col)).agg(F.count("*").alias("n_total"), F.count_if(F.col("classification").isNotNull()).alias("n_duplicated"), F.count_if(F.col("classification") == "conflict").alias("n_conflict"))
    return g.withColumns({"dup_rate": F.col("n_duplicated") / F.col("n_total"), "conflict_rate": F.col("n_conflict") / F.col("n_total")}).orderBy(F.desc("n_total"), col)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Each value's rows, nulls included, most first."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def duplicate_summary(report: DataFrame) -> DataFrame:
    """Number of duplicated ids by class, and the classes there are."""
    return report.agg(F.count("*").alias("n_ids"), *[F.count_if(F.col("classification") == k).alias(f"n_{k}") for k in ("exact", "versioned", "conflict")], F.array_join(F.array_sort(F.collect_set("classification")), "|").alias("classes"))


def evidence_card(report: DataFrame) -> DataFrame:
    """``part``, ``line``: the lines of the card on duplicated ids: totals, reasons of choice, note, and one example for each id (V8)."""
    one = report.agg(F.count("*").alias("n"), *[F.count_if(F.col("classification") == k).alias(k) for k in ("conflict", "versioned")], F.array_join(F.array_sort(F.collect_set("canonical_reason")), ", ").alias("why"))
    lines = [
        ("total", F.concat(F.lit("Total duplicated application_ids: "), F.col("n").cast("string"))),
        ("classes", F.concat(F.lit("Conflict duplicates: "), F.col("conflict").cast("string"), F.lit("   |   Versioned duplicates: "), F.col("versioned").cast("string"))),
        ("rule", F.concat(F.lit("Canonical selection rule observed: "), F.coalesce(F.nullif("why", F.lit("")), F.lit("n/a")))),
        ("note", F.lit("Governance note: fallback selection indicates a provenance/auditability gap (missing/unparseable timestamps).")),
    ]
    head = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("line")) for k, v in lines])).alias("x")).select("x.*")
    example = F.concat(F.coalesce("application_id", F.lit("None")), F.lit(": "), F.col("classification"), F.lit(" | diffs: "), shortened(strip(F.coalesce("example_differences", F.lit("")))))
    return head.union(report.select(F.lit("example").alias("part"), example.alias("line")))


def provenance_bars(profiles: DataFrame) -> DataFrame:
    """``dataset``, ``field``, ``measure``, ``percent`` of the shares of a profile (V7)."""
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(f"{m}_pct") * 100, 2).alias("percent")) for m in ("missing", "parse_failed", "future_ts")])
    return profiles.where("has_field = 1").select("dataset", "field", F.explode(measures).alias("x")).select("dataset", "field", "x.*")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A null-safe join whose right side must have every key once; a repeated key raises when the result is computed."""
    once = F.count("*").over(W.partitionBy(*keys))
    r = right.withColumn("_n", once).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys], F.when(F.col("_n") > 1, F.raise_error(F.lit("join key is not unique on the right side"))).alias("_ok"))
    out = left.join(r, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], how)
    return out.where(F.col("_ok").isNull()).drop("_ok", *[f"_k_{k}" for k in keys])
