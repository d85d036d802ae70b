"""Duplicate identifiers: canonical row, class and example differences per id (A1), repeated numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaryn.functions.fields import iso_instant
from tessaryn.functions.text import strip

LATEST, TIE, NO_TIME = "latest_processing_timestamp", "timestamp_tie_fallback_max_row_id", "missing_or_unparseable_timestamp_fallback_max_row_id"


def _key(cols: list[str]) -> Column:
    """A 128-bit hash under which nulls are equal to nulls only."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}))


def duplicate_groups(df: DataFrame, id_col: str = "application_id", row_col: str = "application_row_id", time_col: str = "raw_processing_timestamp", notes_col: str = "raw_notes", compare: list[str] | None = None) -> DataFrame:
    """One row per id (null ids are one group): ``dup_count``, ``classification``, ``canonical_row_id``, ``canonical_reason``.

    Canonical is the row of the latest timestamp, ties and groups without one by the largest row id.
    Classes: unique, exact (all compared columns equal), versioned (equal but for time and notes, or any
    timestamp there), conflict. One hash aggregation: a hot id is one row per task before the shuffle.
    """
    compare = compare or [c for c in df.columns if c.startswith("raw_")]
    core = [c for c in compare if c not in (time_col, notes_col)]
    t, row = F.col("_t"), F.col(row_col)
    rows = df.select(id_col, row_col, iso_instant(F.col(time_col)).alias("_t"), _key(compare).alias("_all"), _key(core).alias("_core"))
    g = rows.groupBy(id_col).agg(
        F.count("*").alias("dup_count"),
        F.max_by(row_col, F.struct(t, row)).alias("canonical_row_id"),
        F.max("_t").alias("_latest"),
        F.min("_all").alias("_a"), F.max("_all").alias("_b"), F.min("_core").alias("_c"), F.max("_core").alias("_d"),
        F.max_by(F.struct("_t"), F.struct(t, row)).alias("_top"),
    )
    ties = rows.join(g.where("dup_count > 1 AND _latest IS NOT NULL").select(F.col(id_col).alias("_id"), "_latest"), F.col(id_col).eqNullSafe(F.col("_id")) & (t == F.col("_latest")))
    ties = ties.groupBy("_id").agg(F.count("*").alias("_ties"))
    g = g.join(ties, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    reason = F.when(F.col("_latest").isNull(), NO_TIME).when(F.col("_ties") > 1, TIE).otherwise(LATEST)
    kind = F.when(F.col("dup_count") == 1, "unique").when(F.col("_a") == F.col("_b"), "exact").when((F.col("_c") == F.col("_d")) | F.col("_latest").isNotNull(), "versioned").otherwise("conflict")
    return g.select(id_col, "dup_count", kind.alias("classification"), "canonical_row_id", reason.alias("canonical_reason"))


def example_differences(df: DataFrame, groups: DataFrame, id_col: str = "application_id", row_col: str = "application_row_id", compare: list[str] | None = None) -> DataFrame:
    """``id_col``, ``example_differences``: the first five columns in which the first row (by row id) that differs from the canonical one does."""
    compare = compare or [c for c in df.columns if c.startswith("raw_")]
    many = groups.where("dup_count > 1")
    mine = df.join(many.select(F.col(id_col).alias("_id"), "canonical_row_id"), F.col(id_col).eqNullSafe(F.col("_id")))
    canon = mine.where(F.col(row_col) == F.col("canonical_row_id")).select(F.col("_id").alias("_cid"), F.struct(*compare).alias("_canon"))
    both = mine.where(F.col(row_col) != F.col("canonical_row_id")).join(canon, F.col("_id").eqNullSafe(F.col("_cid")))
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col("_canon")[c]), F.lit(c)) for c in compare]))
    both = both.select(F.col("_id").alias(id_col), F.col(row_col).alias("_row"), differ.alias("_diff")).where(F.size("_diff") > 0)
    return both.groupBy(id_col).agg(F.array_join(F.slice(F.min_by("_diff", "_row"), 1, 5), "|").alias("example_differences"))


def duplicate_report(df: DataFrame, **names) -> DataFrame:
    """The duplicated ids with class, canonical row, reason and example differences (empty if rows are equal)."""
    g = duplicate_groups(df, **names)
    d = example_differences(df, g).withColumnRenamed("application_id", "_eid")
    return g.where("dup_count > 1").join(d, F.col("application_id").eqNullSafe(F.col("_eid")), "left").select("application_id", "dup_count", "classification", "canonical_row_id", "canonical_reason", F.coalesce("example_differences", F.lit("")).alias("example_differences"))


def duplicate_metadata(df: DataFrame, groups: DataFrame, id_col: str = "application_id", row_col: str = "application_row_id") -> DataFrame:
    """Each row's ``is_duplicate_id``, ``is_canonical_for_analysis`` and ``has_conflict``."""
    g = groups.select(F.col(id_col).alias("_id"), "dup_count", "classification", "canonical_row_id")
    return df.select(row_col, id_col).join(g, F.col(id_col).eqNullSafe(F.col("_id"))).select(
        row_col, id_col, (F.col("dup_count") > 1).alias("is_duplicate_id"), (F.col(row_col) == F.col("canonical_row_id")).alias("is_canonical_for_analysis"), (F.col("classification") == "conflict").alias("has_conflict")
    )


def repeated_numbers(df: DataFrame, number_col: str = "raw_applicant_ssn", id_col: str = "application_id") -> DataFrame:
    """One row per stripped non-blank number on two or more rows: ``number``, ``n_rows``, ``n_ids``."""
    s = strip(F.col(number_col))
    rows = df.select(s.alias("number"), id_col).where("number <> ''")
    per_id = rows.groupBy("number", id_col).agg(F.count("*").alias("_n"))
    return per_id.groupBy("number").agg(F.sum("_n").alias("n_rows"), F.count(id_col).alias("n_ids")).where("n_rows > 1")
