"""Queries of the general training-data problems (1, 2, 3, 7) over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaryn.operators import drift, load_profile
from tessaryn.operators.moments_dictionary import normalised_moments
from tessaryn.operators.nested import element_rows, pivoted, table_rows
from tessaryn.runtime import written
from tessaryn.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of the two fields that name exactly one instant or date and are not canonical yet."""
    kinds = {"raw_processing_timestamp": "instant", "raw_applicant_date_of_birth": "date"}
    out = normalised_moments(table(spark, d, "applications_curated_full"), table(spark, d, "source_systems"), kinds, "application_row_id", "raw_source_system")
    return out.drop("raw_value")


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every load and column of the two tables: exact aggregates and how far the classifier tells the load from others."""
    app = load_profile.profile(
        table(spark, d, "applications_curated_full"), "applications_curated_full", "raw_load_id", ["clean_debt_to_income", "clean_savings_balance", "clean_credit_history_months"], F.xxhash64("application_row_id")
    )
    report = table(spark, d, "data_quality_report")
    return app.union(load_profile.profile(report, "data_quality_report", "load_id", ["percent"], F.xxhash64("load_id", "stage", "rule_id", "field_path", "value_source", "description")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads and columns whose profile is out of line."""
    return p1_profile(spark, d).where("found").select("table_name", "load_id", "column_name")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object that is an element of an array in a payload, tied to the element that it lies in."""
    return element_rows(table(spark, d, "raw_records"))


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all flat tables with their values by name, each tied to its record and parent."""
    return table_rows(table(spark, d, "raw_records"))


def p2_spending(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the spending entries, a column for each name."""
    return pivoted(written(p2_tables(spark, d), "rows"), "spending_behavior[]")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each change of a feed's fields from one file to the next."""
    return drift.changes(table(spark, d, "raw_records"))


def p7_lifespans(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue: unbroken runs of each field and type in a feed."""
    foot = written(drift.footers(table(spark, d, "raw_records")), "footer_rows")
    return drift.lifespans(drift.fields(foot))


def p7_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The consistent column and cast of every field of every feed."""
    found, _, pairs = drift.catalogue(table(spark, d, "raw_records"))
    return drift.alias_table(pairs, found)


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """The values of all payloads in one consistent table."""
    return drift.consistent(table(spark, d, "raw_records"), written(p7_aliases(spark, d), "aliases"))


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p2_found": p2_found, "p2_tables": p2_tables, "p2_spending": p2_spending, "p3_found": p3_found, "p7_found": p7_found, "p7_lifespans": p7_lifespans, "p7_aliases": p7_aliases, "p7_table": p7_table}
SQL: dict[str, str] = {}
