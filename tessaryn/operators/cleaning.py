"""Cleaning of applications and spending items: raw columns stay, ``clean_*`` columns and flags are added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaryn.functions.fields import birth_date, iso_instant
from tessaryn.functions.text import blank, nullif_blank, number, strip, title, truth

CLEAN_COLUMNS = ["clean_email", "clean_gender", "clean_zip_code", "clean_rejection_reason", "clean_date_of_birth", "clean_processing_timestamp", "clean_annual_income", "clean_debt_to_income", "clean_savings_balance", "clean_interest_rate", "clean_approved_amount", "clean_credit_history_months", "clean_loan_approved"]
FLAGS = ["gender_standardized_flag", "dob_ambiguous_flag", "dob_parse_failed_flag", "annual_income_from_salary_flag", "credit_history_nullified_flag", "dti_nullified_flag", "savings_nullified_flag", "approved_missing_terms_flag", "rejected_missing_reason_flag"]


def _false(c):
    return F.coalesce(c, F.lit(False))


def clean_applications(df: DataFrame) -> DataFrame:
    """Raw applications with all clean columns and the nine flags. Nulls, blanks and values out of range become null."""
    raw = lambda c: F.col(f"raw_{c}")
    gender = F.lower(strip(raw("applicant_gender")))
    born, ambiguous, failed = birth_date(raw("applicant_date_of_birth"))
    income, salary = raw("financial_annual_income"), raw("financial_annual_salary")
    history, dti, savings = number(raw("financial_credit_history_months")), number(raw("financial_debt_to_income")), number(raw("financial_savings_balance"))
    step = df.withColumns({
        "clean_email": nullif_blank(raw("applicant_email"), lower=True),
        "clean_gender": F.when(gender.isin("m", "male"), "Male").when(gender.isin("f", "female"), "Female"),
        "gender_standardized_flag": _false(gender.isin("m", "f")),
        "clean_date_of_birth": born,
        "dob_ambiguous_flag": ambiguous,
        "dob_parse_failed_flag": failed,
        "clean_processing_timestamp": iso_instant(raw("processing_timestamp")),
        "clean_zip_code": nullif_blank(raw("applicant_zip_code")),
        "annual_income_from_salary_flag": blank(income) & ~blank(salary),
        "clean_annual_income": number(F.when(blank(income), salary).otherwise(income)),
        "credit_history_nullified_flag": _false(history < 0),
        "clean_credit_history_months": F.rint(F.when(history >= 0, history)).try_cast("bigint"),
        "dti_nullified_flag": _false((dti < 0) | (dti > 1)),
        "clean_debt_to_income": F.when(dti.between(0, 1), dti),
        "savings_nullified_flag": _false(savings < 0),
        "clean_savings_balance": F.when(savings >= 0, savings),
        "clean_loan_approved": truth(raw("decision_loan_approved")),
        "clean_interest_rate": number(raw("decision_interest_rate")),
        "clean_approved_amount": number(raw("decision_approved_amount")),
        "clean_rejection_reason": nullif_blank(raw("decision_rejection_reason")),
    })
    approved = F.col("clean_loan_approved")
    return step.withColumns({
        "approved_missing_terms_flag": _false(approved & (F.col("clean_interest_rate").isNull() | F.col("clean_approved_amount").isNull())),
        "rejected_missing_reason_flag": _false(~approved & F.col("clean_rejection_reason").isNull()),
    })


def clean_spending(df: DataFrame) -> DataFrame:
    """Spending items with category in title case, amount, and the flags of missing categories and of invalid and negative amounts."""
    amount = number(F.col("raw_amount"))
    category = nullif_blank(F.col("raw_category"))
    return df.withColumns({
        "category_clean": title(category),
        "category_missing_flag": category.isNull(),
        "amount_invalid_flag": ~blank(F.col("raw_amount")) & amount.isNull(),
        "amount_negative_flag": _false(amount < 0),
        "amount_clean": F.when(amount >= 0, amount),
    })
