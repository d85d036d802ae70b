"""The rule catalogue and its predicates before and after cleaning (A12, section 2.5)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaryn.functions.fields import EMAIL, private_address
from tessaryn.functions.text import blank, number, strip, truth


@dataclass(frozen=True)
class Rule:
    rule_id: str
    flag: str
    issue_group: str
    field_path: str
    severity: str
    source_pre: str
    source_post: str
    description: str
    noted: bool = False  # the annotated path names the value source


# Identifiers, groups, paths, severities and wording of the rules.
RULES = [
    Rule("R_APP_001", "missing_processing_timestamp", "Completeness", "processing_timestamp", "high", "raw", "clean", "Missing or blank processing timestamp."),
    Rule("R_APP_002", "missing_required_applicant_field", "Completeness", "applicant_info.*", "high", "raw", "clean", "One or more required applicant fields missing or blank."),
    Rule("R_APP_003", "missing_ssn_and_ip", "Completeness", "applicant_info.ssn|applicant_info.ip_address", "high", "raw", "raw", "Both SSN and IP address are missing or blank."),
    Rule("R_APP_004", "blank_email", "Completeness", "applicant_info.email", "medium", "raw", "clean", "Email is missing or blank."),
    Rule("R_APP_005", "invalid_email", "Validity", "applicant_info.email", "medium", "raw", "clean", "Email does not match the expected format."),
    Rule("R_APP_006", "gender_needs_normalisation", "Consistency", "applicant_info.gender", "low", "raw", "clean", "Gender is not already in canonical form.", True),
    Rule("R_APP_007", "invalid_gender", "Validity", "applicant_info.gender", "medium", "raw", "clean", "Gender is outside the allowed values."),
    Rule("R_APP_008", "dob_non_iso_format", "Consistency", "applicant_info.date_of_birth", "low", "raw", "clean", "Date of birth is not in canonical YYYY-MM-DD form.", True),
    Rule("R_APP_009", "dob_ambiguous_format", "Consistency", "applicant_info.date_of_birth", "medium", "raw", "derived", "Date of birth matches the ambiguous NN/NN/YYYY pattern. When DOB is NN/NN/YYYY and both NN <= 12, parse as MM/DD/YYYY.", True),
    Rule("R_APP_010", "annual_income_string_type", "Consistency", "financials.annual_income", "low", "raw", "derived", "Annual income is stored as a string or cannot be coerced cleanly.", True),
    Rule("R_APP_011", "financial_field_drift_salary", "Consistency", "financials.annual_salary", "medium", "raw", "derived", "Annual salary is populated instead of annual income.", True),
    Rule("R_APP_012", "credit_history_negative", "Validity", "financials.credit_history_months", "high", "raw", "clean", "Credit history months is negative."),
    Rule("R_APP_013", "savings_negative", "Validity", "financials.savings_balance", "high", "raw", "clean", "Savings balance is negative."),
    Rule("R_APP_014", "dti_out_of_range", "Validity", "financials.debt_to_income", "high", "raw", "clean", "Debt-to-income is outside the allowed range [0, 1]."),
    Rule("R_APP_015", "approved_missing_required_fields", "Cross-field logic", "decision.loan_approved", "high", "raw", "clean", "Approved loan is missing interest_rate and/or approved_amount."),
    Rule("R_APP_016", "rejected_missing_reason", "Cross-field logic", "decision.rejection_reason", "medium", "raw", "clean", "Rejected loan is missing rejection_reason."),
    Rule("R_APP_017", "approved_credit_history_zero", "Cross-field logic", "financials.credit_history_months", "medium", "raw", "clean", "Loan approved with zero months of credit history."),
    Rule("R_APP_018", "approved_credit_history_lt6", "Cross-field logic", "financials.credit_history_months", "medium", "raw", "clean", "Loan approved with less than 6 months of credit history."),
    Rule("R_APP_019", "private_ip_address", "Privacy", "applicant_info.ip_address", "low", "raw", "raw", "IP address is in a private range and likely masked or synthetic."),
    Rule("R_SPN_001", "spending_missing_category", "Completeness", "spending_behavior[].category", "medium", "raw", "clean", "Spending category is missing or blank."),
    Rule("R_SPN_002", "spending_amount_non_numeric", "Validity", "spending_behavior[].amount", "high", "raw", "derived", "Spending amount cannot be parsed as numeric.", True),
    Rule("R_SPN_003", "spending_amount_negative", "Validity", "spending_behavior[].amount", "high", "raw", "clean", "Spending amount is negative.", True),
    Rule("R_DUP_001", "", "Uniqueness", "_id", "high", "metadata", "metadata", "Rows with duplicated application_id values."),
    Rule("R_DUP_002", "", "Uniqueness", "_id", "high", "metadata", "metadata", "Distinct application_id values that are duplicated."),
    Rule("R_DUP_003", "", "Uniqueness", "applicant_info.ssn", "high", "raw", "raw", "Rows where SSN repeats across one or more records."),
    Rule("R_DUP_004", "", "Uniqueness", "applicant_info.ssn", "high", "raw", "raw", "Distinct SSN values that appear across different application IDs."),
]
POST_ONLY = [
    Rule("R_DUP_CONFLICT", "", "Uniqueness", "_id", "high", "", "metadata", "Duplicated application IDs classified as conflicts."),
    Rule("R_DUP_CANONICAL", "", "Remediation", "_id", "medium", "", "metadata", "Canonical application rows retained for downstream analysis."),
]
APPLICATION_RULES = [r for r in RULES if r.rule_id.startswith("R_APP")]
SPENDING_RULES = [r for r in RULES if r.rule_id.startswith("R_SPN")]
SEVERITY = {"high": 0, "medium": 1, "low": 2}
REQUIRED = ["full_name", "email", "ssn", "ip_address", "gender", "date_of_birth", "zip_code"]
#: Annotated paths that do not follow from path and source.
_NOTES = {("post", "R_APP_009"): "applicant_info.date_of_birth_raw", ("post", "R_APP_010"): "financials.annual_income_clean", ("post", "R_APP_011"): "financials.annual_income_clean", ("post", "R_SPN_002"): "spending_behavior[].amount_clean"}


def catalog_rows() -> list[tuple]:
    """(stage, rule_id, issue_group, field_path, field_path_annotated, value_source, severity, description) of all rules."""
    rows = []
    for stage, rules in (("pre", RULES), ("post", RULES + POST_ONLY)):
        for r in rules:
            source = r.source_pre if stage == "pre" else r.source_post
            note = _NOTES.get((stage, r.rule_id), f"{r.field_path}_{source}") if r.noted else ""
            rows.append((stage, r.rule_id, r.issue_group, r.field_path, note, source, r.severity, r.description))
    return rows


def rule_catalog(spark: SparkSession) -> DataFrame:
    """54 rows: fixed by the rules."""
    return spark.createDataFrame(catalog_rows(), "stage string, rule_id string, issue_group string, field_path string, field_path_annotated string, value_source string, severity string, description string")


def _f(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def application_flags(stage: str, v6: bool = True) -> dict[str, Column]:
    """Flag name to a Boolean that is never null, over raw columns (``pre``) or cleaned ones (``post``)."""
    raw = lambda c: F.col(f"raw_{c}")
    clean = lambda c: F.col(f"clean_{c}")
    pre = stage == "pre"
    email = raw("applicant_email") if pre else clean("email")
    gender = F.lower(strip(raw("applicant_gender")))
    born = raw("applicant_date_of_birth") if pre else clean("date_of_birth").cast("string")
    income, salary = raw("financial_annual_income"), raw("financial_annual_salary")
    months = number(raw("financial_credit_history_months")) if pre else clean("credit_history_months")
    savings = number(raw("financial_savings_balance")) if pre else clean("savings_balance")
    dti = number(raw("financial_debt_to_income")) if pre else clean("debt_to_income")
    approved = truth(raw("decision_loan_approved")) if pre else clean("loan_approved")
    cleaned = {"email": "email", "gender": "gender", "date_of_birth": "date_of_birth", "zip_code": "zip_code"}
    required = [blank(raw(f"applicant_{c}")) if pre or c not in cleaned else blank(clean(c).cast("string")) for c in REQUIRED]
    odd_gender = ~blank(raw("applicant_gender")) & _f(~gender.isin("m", "f", "male", "female")) if pre else ~blank(clean("gender")) & _f(~clean("gender").isin("Male", "Female"))
    day, month = F.regexp_extract(strip(born), r"^(\d{1,2})/(\d{1,2})/\d{4}$", 1).try_cast("int"), F.regexp_extract(strip(born), r"^(\d{1,2})/(\d{1,2})/\d{4}$", 2).try_cast("int")
    terms = number(raw("decision_interest_rate")).isNull() | number(raw("decision_approved_amount")).isNull()
    return {
        "missing_processing_timestamp": blank(raw("processing_timestamp")) if pre else F.col("clean_processing_timestamp").isNull(),
        "missing_required_applicant_field": reduce(or_, required),
        "missing_ssn_and_ip": blank(raw("applicant_ssn")) & blank(raw("applicant_ip_address")),
        "blank_email": blank(email),
        "invalid_email": ~blank(email) & _f(~strip(email).rlike(EMAIL)),
        "gender_needs_normalisation": _f(gender.isin("m", "f")) if pre else odd_gender,
        "invalid_gender": odd_gender,
        "dob_non_iso_format": ~blank(born) & _f(~strip(born).rlike(r"^\d{4}-\d{2}-\d{2}$")),
        "dob_ambiguous_format": _f((day <= 12) & (month <= 12)) if pre else F.col("dob_ambiguous_flag"),
        "annual_income_string_type": ~blank(income) & number(income).isNull() if pre else clean("annual_income").isNull() & (~blank(income) | ~blank(salary)),
        "financial_field_drift_salary": blank(income) & ~blank(salary) if pre else F.col("annual_income_from_salary_flag"),
        "credit_history_negative": _f(months < 0),
        "savings_negative": _f(savings < 0),
        "dti_out_of_range": _f((dti < 0) | (dti > 1)),
        "approved_missing_required_fields": _f(approved & terms) if pre else F.col("approved_missing_terms_flag"),
        "rejected_missing_reason": _f(~approved & blank(raw("decision_rejection_reason"))) if pre else F.col("rejected_missing_reason_flag"),
        "approved_credit_history_zero": _f(approved & (months == 0)),
        "approved_credit_history_lt6": _f(approved & (months < 6)),
        "private_ip_address": private_address(raw("applicant_ip_address"), v6),
    }


def spending_flags(stage: str) -> dict[str, Column]:
    if stage == "post":
        return {"spending_missing_category": F.col("category_missing_flag"), "spending_amount_non_numeric": F.col("amount_invalid_flag"), "spending_amount_negative": F.col("amount_negative_flag")}
    amount = number(F.col("raw_amount"))
    return {"spending_missing_category": blank(F.col("raw_category")), "spending_amount_non_numeric": ~blank(F.col("raw_amount")) & amount.isNull(), "spending_amount_negative": _f(amount < 0)}
