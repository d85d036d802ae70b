"""Raw JSON records to flat applications and spending items, types kept as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATHS = {
    "application_id": "$._id", "raw_processing_timestamp": "$.processing_timestamp",
    **{f"raw_applicant_{c}": f"$.applicant_info.{c}" for c in ("full_name", "email", "ssn", "ip_address", "gender", "date_of_birth", "zip_code")},
    **{f"raw_financial_{c}": f"$.financials.{c}" for c in ("annual_income", "annual_salary", "credit_history_months", "debt_to_income", "savings_balance")},
    **{f"raw_decision_{c}": f"$.decision.{c}" for c in ("loan_approved", "interest_rate", "approved_amount", "rejection_reason")},
}
KNOWN = {"_id", "processing_timestamp", "applicant_info", "financials", "decision", "spending_behavior"}


def parsed(df: DataFrame, id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """``application_row_id`` and the record as a variant; null and incomplete payloads and those that are no object are left out."""
    v = F.try_parse_json(F.col(payload))
    return df.select(F.col(id_col).alias("application_row_id"), v.alias("_v"), F.col(payload).alias("_p")).where(F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith("OBJECT"))


def optional_keys(records: DataFrame) -> list[str]:
    """The top-level keys beyond the known ones, sorted: the schema, one round trip."""
    keys = records.select(F.explode(F.json_object_keys("_p")).alias("k")).distinct()
    return sorted(r.k for r in keys.where(~F.col("k").isin(*KNOWN)).collect())


def flatten_applications(records: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The fixed columns and ``raw_<key>`` for each further key; missing and non-object parts give nulls."""
    extra = optional_keys(records) if extra is None else extra
    fixed = [F.try_variant_get("_v", p, "string").alias(c) for c, p in PATHS.items()]
    return records.select("application_row_id", *fixed, *[F.try_variant_get("_v", f"$['{k}']", "string").alias(f"raw_{k}") for k in extra])


def flatten_spending(records: DataFrame) -> DataFrame:
    """One row per object of ``spending_behavior`` with its 0-based place; anything but an array has none."""
    items = records.select("application_row_id", F.try_variant_get("_v", "$._id", "string").alias("application_id"), F.posexplode(F.try_variant_get("_v", "$.spending_behavior", "array<variant>")).alias("spending_index", "_i"))
    items = items.where(F.schema_of_variant("_i").startswith("OBJECT"))
    return items.select("application_row_id", "application_id", "spending_index", F.try_variant_get("_i", "$.category", "string").alias("raw_category"), F.try_variant_get("_i", "$.amount", "string").alias("raw_amount"))
