"""The data-quality pipeline end to end (E1): raw records to reports, analysis table and inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaryn.operators import cleaning, duplicates, evidence, flatten, privacy, report, rules


def run(records: DataFrame, salt: str, id_col: str = "record_id", payload: str = "payload") -> dict[str, DataFrame]:
    """All tables of the pipeline by name, lazily; only the names of further top-level keys are read at once."""
    parsed = flatten.parsed(records, id_col, payload)
    return run_flat(flatten.flatten_applications(parsed), flatten.flatten_spending(parsed), salt)


def run_flat(raw: DataFrame, spending: DataFrame, salt: str) -> dict[str, DataFrame]:
    if "raw_notes" not in raw.columns:
        raw = raw.withColumn("raw_notes", F.lit(None).cast("string"))
    groups = duplicates.duplicate_groups(raw)
    clean, items = cleaning.clean_applications(raw), cleaning.clean_spending(spending)
    meta = duplicates.duplicate_metadata(raw, groups)
    curated = evidence.checked_join(clean, meta, ["application_row_id", "application_id"])
    issues = report.quality_report(raw, spending, "pre", groups).unionByName(report.quality_report(curated, items, "post", groups))
    analysis = privacy.analysis_table(curated, salt)
    return {
        "applications_curated_full": curated,
        "spending_clean": items,
        "applications_analysis": analysis,
        "duplicate_id_report": duplicates.duplicate_report(raw),
        "rule_catalog": rules.rule_catalog(raw.sparkSession),
        "data_quality_report": issues,
        "before_after_comparison": report.before_after(issues, groups),
        "pii_inventory": privacy.pii_inventory(raw.sparkSession, curated.columns, analysis.columns),
    }
