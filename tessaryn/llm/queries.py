"""Queries of the problems tagged llm over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tessaryn.llm import content, copies, mixing, names, survivors, tokens
from tessaryn.runtime import written
from tessaryn.sources.tables import table

COPY_ENTRIES = {"raw_notes": ";"}
SURVIVOR_FIELDS = ["raw_applicant_full_name", "raw_applicant_email", "raw_applicant_zip_code", "raw_financial_annual_income", "raw_decision_loan_approved"]


def _copy_fields(df: DataFrame) -> list[str]:
    return ["application_id", *sorted(c for c in df.columns if c.startswith("raw_") and c != "raw_load_id")]


def _linked(spark: SparkSession, d: str, alone: bool = True) -> DataFrame:
    apps, fields = table(spark, d, "applications_curated_full"), ["raw_applicant_full_name", "raw_applicant_date_of_birth", "raw_applicant_zip_code"]
    return names.linked(apps, table(spark, d, "source_systems"), "application_row_id", *fields, "application_id", "raw_source_system", alone=alone)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows of one applicant whose names differ."""
    return names.variant_pairs(_linked(spark, d, alone=False))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """The applicant of every row with a name, by the smallest row of it."""
    rows = _linked(spark, d)
    first = rows.groupBy("entity").agg(F.min("row_id").alias("applicant_row_id"))
    return rows.join(first, "entity").select("row_id", "applicant_row_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per surplus copy of an application row."""
    app = table(spark, d, "applications_curated_full")
    return copies.surplus_copies(app, "application_row_id", _copy_fields(app), COPY_ENTRIES)


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    """The first row of every group and its number of copies."""
    app = table(spark, d, "applications_curated_full")
    return copies.collapsed(app, "application_row_id", _copy_fields(app), COPY_ENTRIES)


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return survivors.prepared(
        table(spark, d, "applications_curated_full"), table(spark, d, "source_systems"), "application_id", "application_row_id", "raw_processing_timestamp", "raw_source_system", SURVIVOR_FIELDS
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The row that gives each surviving value, by instant, trust and row id."""
    return survivors.surviving_rows(_prepared(spark, d), SURVIVOR_FIELDS)


def p6_currency(spark: SparkSession, d: str) -> DataFrame:
    """The same with values without instant ordered by the learned precedence of forms."""
    prep = written(_prepared(spark, d), "survivor_rows")
    return survivors.surviving_rows(prep, SURVIVOR_FIELDS, survivors.learned_edges(prep, SURVIVOR_FIELDS))


def p6_edges(spark: SparkSession, d: str) -> DataFrame:
    """The learned precedence of value forms."""
    return survivors.learned_edges(written(_prepared(spark, d), "survivor_rows"), SURVIVOR_FIELDS)


def p6_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The learned precedence held against groups whose instants were hidden from it."""
    return survivors.evidence(written(_prepared(spark, d), "survivor_rows"), SURVIVOR_FIELDS)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encoded(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text out of its ids again; null texts come back empty."""
    return tokens.decoded(written(p8_ids(spark, d), "ids"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"), keep=("source",))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of a mix that cannot fill their share within the allowed repeats."""
    return mixing.short_sources(table(spark, d, "mix_targets"), _sizes(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn for every mix, with the slot of the schedule."""
    return mixing.mixed(table(spark, d, "mix_targets"), written(_sizes(spark, d), "sizes"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of every source."""
    return mixing.shares(table(spark, d, "mix_targets"), written(_sizes(spark, d), "sizes"))


def p9_deviations(spark: SparkSession, d: str) -> DataFrame:
    """How far each source is ever from its share in the schedule, in blocks."""
    return mixing.deviations(table(spark, d, "mix_targets"), written(_sizes(spark, d), "sizes"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return content.scored(table(spark, d, "documents"), table(spark, d, "content_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are abusive, hateful or sexually explicit themselves."""
    return p10_scores(spark, d).where(F.col("score") >= content.THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of such documents by source."""
    return content.rates(table(spark, d, "documents"), p10_scores(spark, d))


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall on labels held out, by language."""
    return content.quality(table(spark, d, "documents"), table(spark, d, "content_labels"))


QUERIES = {"p10_quality": p10_quality, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates, "p9_found": p9_found, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_deviations": p9_deviations, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p4_found": p4_found, "p4_entities": p4_entities, "p5_found": p5_found, "p5_copies": p5_copies, "p6_found": p6_found, "p6_currency": p6_currency, "p6_edges": p6_edges, "p6_evidence": p6_evidence}
SQL: dict[str, str] = {"p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
