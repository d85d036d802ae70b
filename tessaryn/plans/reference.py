"""Queries of the governance operators over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaryn.functions.fields import age_band, private_address
from tessaryn.operators import cleaning, duplicates, evidence, fairness, flatten, privacy, report, rules
from tessaryn.operators.rules import APPLICATION_RULES
from tessaryn.plans.reference_sql import SALT
from tessaryn.plans.reference_sql import SQL as SQL
from tessaryn.runtime import written
from tessaryn.sources.tables import table

AS_OF = "2025-07-01 00:00:00"
_SHOWN = ["group_median", "approval_rate", "privileged_rate", "unprivileged_rate", "disparate_impact", "demographic_parity_difference", "reference_rate", "four_fifths_line", "dup_rate", "conflict_rate", "fallback_rate", "female_rate", "male_rate", "missing_pct", "parse_failed_pct", "future_ts_pct"]


def _apps(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "applications_curated_full")


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "spending_clean")


def _rounded(df: DataFrame, places: int = 9, cols: list[str] = _SHOWN) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols if c in df.columns})


def _groups(s, d) -> DataFrame:
    return duplicates.duplicate_groups(_apps(s, d))


def _issues(s, d) -> DataFrame:
    """Both stages; groups and repeated numbers are worked out once for both, and the report once for all that is read off it."""
    a, i = _apps(s, d), _items(s, d)
    g, n = written(duplicates.duplicate_groups(a), "groups"), written(duplicates.repeated_numbers(a), "numbers")
    return written(report.quality_report(a, i, "pre", g, numbers=n).unionByName(report.quality_report(a, i, "post", g, numbers=n)), "issues")


def _deltas(s, d) -> DataFrame:
    x = _issues(s, d)
    return report.rule_deltas(x.where("stage = 'pre'"), x.where("stage = 'post'"))


def _analysis(s, d) -> DataFrame:
    return privacy.analysis_table(_apps(s, d), SALT)


def _outcome(s, d) -> DataFrame:
    return fairness.with_outcome(_analysis(s, d))


def _clean_applications(s, d) -> DataFrame:
    raw = _apps(s, d)
    raw = raw.drop(*cleaning.CLEAN_COLUMNS, *cleaning.FLAGS)
    out = cleaning.clean_applications(raw)
    shown = {"clean_date_of_birth": F.col("clean_date_of_birth").cast("string"), "clean_processing_timestamp": F.date_format("clean_processing_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    return out.withColumns(shown).select("application_row_id", *cleaning.CLEAN_COLUMNS, *cleaning.FLAGS)


def _clean_spending(s, d) -> DataFrame:
    raw = _items(s, d).select("application_row_id", "spending_index", "raw_category", "raw_amount")
    return cleaning.clean_spending(raw)


def _records(s, d) -> DataFrame:
    return flatten.parsed(table(s, d, "raw_records"))


def _inventory(s, d) -> DataFrame:
    a = _apps(s, d)
    return privacy.pii_inventory(s, a.columns, privacy.ANALYSIS_COLUMNS)


def _profiles(s, d) -> DataFrame:
    a = _apps(s, d)
    return evidence.timestamp_profile(a, "applications_curated_full", "raw_processing_timestamp", AS_OF).union(evidence.timestamp_profile(a, "applications_curated_full", "processing_timestamp", AS_OF))


def _leaks(s, d) -> DataFrame:
    return privacy.leak_scan(table(s, d, "documents"), ["text", "application_id", "source"])


def _masked(s, d, cols, policy) -> DataFrame:
    return privacy.masked_columns(_apps(s, d).select("application_row_id", *cols), cols, policy)


PII = ["raw_applicant_email", "raw_applicant_ssn", "raw_applicant_ip_address", "raw_applicant_full_name", "raw_applicant_date_of_birth"]


def _redacted(s, d) -> DataFrame:
    """Records as nested rows, masked leaf by leaf."""
    flat = flatten.flatten_applications(_records(s, d), [])
    nested = flat.select("application_row_id", F.struct(F.col("raw_applicant_full_name").alias("full_name"), F.col("raw_applicant_email").alias("email"), F.col("raw_applicant_ssn").alias("ssn"), F.col("raw_applicant_zip_code").alias("zip_code")).alias("applicant_info"), F.array(F.struct(F.col("raw_applicant_ip_address").alias("ip_address"))).alias("seen_at"))
    return privacy.redacted(nested)


def _boxes(s, d) -> DataFrame:
    return _rounded(fairness.box_data(_outcome(s, d), fairness.FEATURES), 6, ["q1", "median", "q3"])


def _impact(s, d) -> DataFrame:
    return _rounded(fairness.disparate_impact(fairness.gender_subset(_outcome(s, d)), "clean_gender", "Male", "Female"))


def _spending(s, d) -> DataFrame:
    return fairness.spending_by_gender(_outcome(s, d), _items(s, d), 6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_applications": _clean_applications,
    "clean_spending": _clean_spending,
    "rule_catalog": lambda s, d: rules.rule_catalog(s),
    "rule_report_pre": lambda s, d: report.rule_rows(_apps(s, d), rules.application_flags("pre"), APPLICATION_RULES, "pre"),
    "rule_report_post": lambda s, d: report.rule_rows(_apps(s, d), rules.application_flags("post"), APPLICATION_RULES, "post"),
    "quality_report": _issues,
    "issue_group_totals": lambda s, d: report.group_totals(_issues(s, d)),
    "before_after": lambda s, d: report.before_after(_issues(s, d), _groups(s, d)),
    "rule_deltas": _deltas,
    "top_improvements": lambda s, d: report.top_improvements(_deltas(s, d)).select("rule_id", "severity", "pre_percent", "post_percent", "delta_pp"),
    "residual_issues": lambda s, d: report.residual_issues(_deltas(s, d)).select("rule_id", "severity", "post_count", "post_percent"),
    "duplicate_groups": _groups,
    "duplicate_report": lambda s, d: duplicates.duplicate_report(_apps(s, d)),
    "duplicate_metadata": lambda s, d: duplicates.duplicate_metadata(_apps(s, d), _groups(s, d)),
    "duplicate_summary": lambda s, d: evidence.duplicate_summary(duplicates.duplicate_report(_apps(s, d))),
    "evidence_card": lambda s, d: evidence.evidence_card(duplicates.duplicate_report(_apps(s, d))),
    "repeated_ssn": lambda s, d: duplicates.repeated_numbers(_apps(s, d)),
    "analysis_table": _analysis,
    "pseudonym_metrics": lambda s, d: _rounded(privacy.pseudonym_metrics(_analysis(s, d), _apps(s, d))),
    "pseudonym_sources": lambda s, d: privacy.source_distribution(_analysis(s, d), "pseudo_id_source"),
    "pii_inventory": _inventory,
    "presence_matrix": lambda s, d: privacy.presence_matrix(_inventory(s, d))[0],
    "masked_columns": lambda s, d: _masked(s, d, PII, privacy.mask_for),
    "preview_columns": lambda s, d: _masked(s, d, [*PII, "raw_applicant_zip_code"], privacy.preview_mask_for),
    "safe_preview": lambda s, d: privacy.safe_preview(_apps(s, d).select("application_row_id", *PII), PII, "application_row_id"),
    "curated_preview": lambda s, d: privacy.safe_preview(_apps(s, d).select("application_row_id", *PII, "raw_applicant_zip_code"), [*PII, "raw_applicant_zip_code"], "application_row_id", 10, privacy.preview_mask_for),
    "direct_pii_fields": lambda s, d: privacy.presence_matrix(_inventory(s, d))[1],
    "pii_non_null": lambda s, d: privacy.non_null_counts(_apps(s, d), PII),
    "redact_struct": _redacted,
    "leak_scan": _leaks,
    "leak_summary": lambda s, d: privacy.leak_summary(_leaks(s, d)),
    "approval_by_gender": lambda s, d: _rounded(fairness.approval_table(fairness.gender_subset(_outcome(s, d)), "clean_gender")),
    "approval_by_age": lambda s, d: _rounded(fairness.approval_table(fairness.age_subset(_outcome(s, d)), "age_band")),
    "interaction": lambda s, d: _rounded(fairness.interaction_table(_outcome(s, d))),
    "disparate_impact": _impact,
    "age_impact": lambda s, d: _rounded(fairness.age_impact_table(_outcome(s, d))),
    "chi2_gender": lambda s, d: _rounded(fairness.chi2_statistic(fairness.gender_subset(_outcome(s, d)), "clean_gender"), 6, ["chi2"]),
    "chi2_age": lambda s, d: _rounded(fairness.chi2_statistic(fairness.age_subset(_outcome(s, d)), "age_band"), 6, ["chi2"]),
    "chi2_test": lambda s, d: fairness.chi2_test(fairness.gender_subset(_outcome(s, d)), "clean_gender"),
    "mann_whitney": lambda s, d: fairness.mann_whitney_statistics(fairness.gender_subset(_outcome(s, d)), fairness.FEATURES),
    "proxy_table": lambda s, d: fairness.proxy_table(_outcome(s, d)),
    "spearman": lambda s, d: _rounded(fairness.credit_age_statistic(_outcome(s, d)), 6, ["rho"]),
    "credit_age_test": lambda s, d: fairness.credit_age_correlation(_outcome(s, d)),
    "interest_rates": lambda s, d: _rounded(fairness.interest_rates(_outcome(s, d)), 6, ["male_median_rate", "female_median_rate", "male_mean_rate", "female_mean_rate"]),
    "interest_rate_test": lambda s, d: fairness.interest_rate_test(_outcome(s, d)),
    "rejection_reasons": lambda s, d: fairness.rejection_reasons(_outcome(s, d)),
    "spending_by_gender": _spending,
    "spending_gaps": lambda s, d: fairness.spending_gaps(fairness.spending_by_gender(_outcome(s, d), _items(s, d))),
    "fairness_summary": lambda s, d: fairness.fairness_summary(_outcome(s, d)),
    "heatmap": lambda s, d: _rounded(fairness.heatmap_data(_outcome(s, d))),
    "boxes": _boxes,
    "rate_marks": lambda s, d: _rounded(fairness.rate_marks(_outcome(s, d))),
    "interest_histogram": lambda s, d: _rounded(fairness.interest_histogram(_outcome(s, d))),
    "timestamp_profile": lambda s, d: _rounded(_profiles(s, d)),
    "provenance_bars": lambda s, d: evidence.provenance_bars(_profiles(s, d)),
    "group_check_gender": lambda s, d: _rounded(evidence.group_check(_analysis(s, d), duplicates.duplicate_report(_apps(s, d)), "clean_gender")),
    "group_check_age": lambda s, d: _rounded(evidence.group_check(_analysis(s, d), duplicates.duplicate_report(_apps(s, d)), "age_band")),
    "value_counts": lambda s, d: evidence.value_counts(_apps(s, d), "raw_source_system"),
    "flatten_records": lambda s, d: flatten.flatten_applications(_records(s, d)),
    "explode_items": lambda s, d: flatten.flatten_spending(_records(s, d)),
    "optional_keys": lambda s, d: s.createDataFrame([(k,) for k in flatten.optional_keys(_records(s, d))], "key string"),
    "private_ip": lambda s, d: _apps(s, d).groupBy(F.col("raw_applicant_ip_address").alias("address"), private_address(F.col("raw_applicant_ip_address")).alias("is_private")).agg(F.count("*").alias("n")),
    "age_bands": lambda s, d: _apps(s, d).groupBy(age_band(F.col("clean_date_of_birth")).alias("age_band")).agg(F.count("*").alias("n")),
    "report_extremes": lambda s, d: table(s, d, "data_quality_report").groupBy("stage", "severity").agg(F.count("*").alias("n"), F.count_distinct("load_id").alias("loads"), F.sum("count").alias("issues")),
}
