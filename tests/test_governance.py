import math

import pytest
from pyspark.sql import functions as F

from tessaryn.functions import fields, tails, text
from tessaryn.operators import cleaning, duplicates, evidence, fairness, flatten, privacy, report, rules
from tessaryn.plans import pipeline
from tessaryn.sources import files

RAW = {c: None for c in ["application_id", "raw_processing_timestamp", *(f"raw_applicant_{x}" for x in ("full_name", "email", "ssn", "ip_address", "gender", "date_of_birth", "zip_code")), *(f"raw_financial_{x}" for x in ("annual_income", "annual_salary", "credit_history_months", "debt_to_income", "savings_balance")), *(f"raw_decision_{x}" for x in ("loan_approved", "interest_rate", "approved_amount", "rejection_reason")), "raw_notes"]}


def apps(spark, *rows):
    data = [(i, *{**RAW, **r}.values()) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "application_row_id bigint, " + ", ".join(f"{c} string" for c in RAW))


def values(spark, func, xs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r.v for r in df.select("i", func(F.col("x")).alias("v")).orderBy("i").collect()]


def test_text_traps(spark):
    assert values(spark, text.number, ["1d", "nan", " 12 ", "1e3", "12.5f", "", None, "-.5", "inf", "0x1"]) == [None, None, 12.0, 1000.0, None, None, None, -0.5, math.inf, None]
    assert values(spark, text.strip, ["\t a b\n", "", None]) == ["a b", "", None]
    assert values(spark, text.title, ["food-dining", "o'neil PUB", "", None]) == ["Food-Dining", "O'Neil Pub", "", None]
    assert values(spark, text.truth, ["Yes", "0", " TRUE ", "1.0", None]) == [True, False, True, None, None]
    assert values(spark, text.missing, ["N/A", "--", " ", None, "?", "None;", "Nana"]) == [True, True, True, True, True, True, False]
    assert values(spark, text.blank, [None, "", " ", "x"]) == [True, True, True, False]


def test_masks(spark):
    assert values(spark, fields.mask_email, ["ann@x.org", "@x", "none", " ", None]) == ["a***@x.org", "***@x", "[REDACTED_EMAIL]", " ", None]
    assert values(spark, fields.mask_dob, ["05/12/1990", "1990-05-12", "19"]) == ["05/1-**-**", "1990-**-**", "XXXX-**-**"]
    assert values(spark, fields.mask_dob_year, ["05/12/1990", "x"]) == ["1990-**-**", "XXXX-**-**"]
    assert values(spark, fields.private_address, ["10.1.2.3", "172.32.0.1", "100.64.0.1", "203.0.113.9", "010.0.0.1", "::1", "2001:db8::1", "2a00::1", None, "1.2.3"]) == [True, False, False, True, False, True, True, False, False, False]
    assert values(spark, lambda c: fields.age_band(c.cast("date")), ["2001-01-02", "2000-12-31", "2030-01-01", "1950-01-01", None]) == ["<25", "25-34", None, "65+", None]


def test_cleaning(spark):
    rows = [
        dict(raw_applicant_gender=" m ", raw_applicant_date_of_birth="05/06/1990", raw_financial_annual_income="", raw_financial_annual_salary="5e3", raw_financial_credit_history_months="2.5", raw_financial_debt_to_income="1.2", raw_financial_savings_balance="-1", raw_decision_loan_approved="yes", raw_processing_timestamp="2024-01-15T10:00:00+0530"),
        dict(raw_applicant_gender="X", raw_applicant_date_of_birth="13/06/1990", raw_decision_loan_approved="n", raw_processing_timestamp="2024"),
        dict(raw_applicant_date_of_birth="00/00/1990"),
        dict(raw_applicant_date_of_birth="2001-1-5"),
    ]
    a, b, c, d = cleaning.clean_applications(apps(spark, *rows)).orderBy("application_row_id").collect()
    assert (a.clean_gender, a.gender_standardized_flag, str(a.clean_date_of_birth), a.dob_ambiguous_flag) == ("Male", True, "1990-05-06", True)
    assert (a.clean_annual_income, a.annual_income_from_salary_flag, a.clean_credit_history_months, a.dti_nullified_flag, a.clean_debt_to_income, a.savings_nullified_flag, a.approved_missing_terms_flag) == (5000.0, True, 2, True, None, True, True)
    assert str(a.clean_processing_timestamp) == "2024-01-15 04:30:00"
    assert (b.clean_gender, str(b.clean_date_of_birth), b.dob_ambiguous_flag, b.rejected_missing_reason_flag, b.clean_processing_timestamp) == (None, "1990-06-13", False, True, None)
    assert (c.clean_date_of_birth, c.dob_parse_failed_flag, c.dob_ambiguous_flag) == (None, True, False) and str(d.clean_date_of_birth) == "2001-01-05"


def test_duplicates(spark):
    base = dict(raw_applicant_ssn="1", raw_notes="a")
    rows = [dict(application_id="e", **base)] * 2 + [dict(application_id="v", raw_applicant_ssn="2", raw_notes=n) for n in "ab"] + [dict(application_id="c", raw_applicant_ssn=n) for n in "34"]
    rows += [dict(application_id="t", raw_applicant_ssn=n, raw_processing_timestamp="2024-01-01T00:00:00Z") for n in "56"] + [dict(application_id="l", raw_processing_timestamp=t) for t in ("2024-01-02T00:00:00Z", "bad", "2024-01-01T00:00:00Z")] + [dict(), dict(), dict(application_id="u")]
    df = apps(spark, *rows)
    g = {r.application_id: (r.dup_count, r.classification, r.canonical_row_id, r.canonical_reason) for r in duplicates.duplicate_groups(df).collect()}
    assert g["e"] == (2, "exact", 1, duplicates.NO_TIME) and g["v"][1:3] == ("versioned", 3) and g["c"][1] == "conflict" and g["t"] == (2, "versioned", 7, duplicates.TIE)
    assert g["l"] == (3, "versioned", 8, duplicates.LATEST) and g[None][0] == 2 and g["u"][1] == "unique"
    rep = {r.application_id: r.example_differences for r in duplicates.duplicate_report(df).collect()}
    assert rep["c"] == "raw_applicant_ssn" and rep["v"] == "raw_notes" and rep["e"] == ""
    meta = duplicates.duplicate_metadata(df, duplicates.duplicate_groups(df))
    assert meta.count() == len(rows) and meta.where("is_canonical_for_analysis").count() == len(g)
    assert duplicates.duplicate_groups(df.limit(0)).count() == 0


def test_catalog_and_reports(spark):
    assert rules.rule_catalog(spark).count() == 54
    assert ("post", "R_APP_010", "Consistency", "financials.annual_income", "financials.annual_income_clean", "derived", "low") in {r[:7] for r in rules.catalog_rows()}
    df = apps(spark, dict(application_id="a", raw_applicant_email="x"), dict(application_id="b", raw_applicant_email="a@b.c"), dict(application_id="a", raw_applicant_email="y"))
    rows = {r.rule_id: r for r in report.rule_rows(df, rules.application_flags("pre"), rules.APPLICATION_RULES, "pre").collect()}
    assert (rows["R_APP_005"]["count"], rows["R_APP_005"].percent, rows["R_APP_005"].example_application_ids) == (2, 66.67, "a") and "R_APP_012" not in rows
    none = report.rule_rows(df.limit(0), rules.application_flags("pre"), rules.APPLICATION_RULES, "pre")
    assert none.count() == 0 and none.columns[:2] == ["stage", "issue_group"]


def test_published_statistics(spark):
    """The contingency tables behind the published figures."""
    cells = [("Female", 127, 250), ("Male", 163, 247)]
    rows = [(g, 1 if i < a else 0) for g, a, n in cells for i in range(n)]
    df = spark.createDataFrame(rows, "clean_gender string, approved int")
    t = fairness.chi2_test(df, "clean_gender").first()
    assert (t.chi2, t.p_value, t.dof, t.significant_at_05) == (11.1823, 0.000826, 1, True)
    d = fairness.disparate_impact(df, "clean_gender", "Male", "Female").first()
    assert (round(d.disparate_impact, 4), round(d.demographic_parity_difference, 4), d.four_fifths_flag) == (0.7698, -0.1519, True)
    ages = dict(zip(fields.AGE_BANDS, [(6, 13), (71, 152), (114, 174), (56, 87), (35, 56), (7, 13)], strict=True))
    aged = spark.createDataFrame([(b, 1 if i < a else 0) for b, (a, n) in ages.items() for i in range(n)], "age_band string, approved int")
    t = fairness.chi2_test(aged, "age_band").first()
    assert (t.chi2, t.p_value, t.dof) == (14.7519, 0.011477, 5)
    assert [round(r.disparate_impact, 4) for r in fairness.age_impact_table(aged).collect()] == [0.9881, 1.4026, 1.3780, 1.3380, 1.1528]


def test_exact_u_of_very_unequal_samples():
    assert [sum(tails._orders(m, n)) for m, n in ((2, 3), (4, 5), (1, 7))] == [10, 126, 8] and tails._orders(2, 2) == [1, 1, 2, 1, 1]
    assert tails.mann_whitney_p(12_000, 5, 5_000, 0) == pytest.approx(0.8808135469913783) and tails.mann_whitney_p(4_000, 8, 1_000, 0) == 1.0


def test_published_fairness_values(spark):
    """163 of 247 men and 127 of 250 women approved: the published ratio, difference, p-value and texts."""
    cells = [("Male", 1, 163), ("Male", 0, 84), ("Female", 1, 127), ("Female", 0, 123)]
    df = spark.createDataFrame([(g, None, a, 4.0 + i % 2) for g, a, n in cells for i in range(n)], "clean_gender string, age_band string, approved int, clean_interest_rate double")
    p = fairness.chi2_test(df, "clean_gender").first()
    assert p.p_value == pytest.approx(0.000826, abs=5e-7) and p.significant_at_05
    first, second, *rest = fairness.fairness_summary(df).collect()
    assert (first.metric_value, second.metric_value, first.note) == ("0.7698", "-0.1519", "Female rate 50.8% vs Male 66.0%") and first.four_fifths_flag
    assert [r.note for r in rest] == ["n Male=163, n Female=127"]


def test_quantiles_are_exact(spark):
    rows = [(g, float(v)) for g, vs in (("a", [1, 2, 2, 7]), ("b", [5]), ("c", [3, 1, 9])) for v in vs]
    got = {r.g: (r.q, r.m) for r in fairness.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"q": 0.25, "m": 0.5}).collect()}
    assert got == {"a": (1.75, 2.0), "b": (5.0, 5.0), "c": (2.0, 3.0)}
    assert privacy.direct_columns(["SSN", "applicant_info.ssn", "x"], ["applicant_info.ssn"]) == (["applicant_info.ssn"], ["SSN"])


def test_tails():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12) and tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.mann_whitney_p(0, 3, 3, 0) == pytest.approx(0.1) and tails.mann_whitney_p(4.5, 3, 3, 0) == 1.0
    assert tails.mann_whitney_p(2, 5, 4, 0) == pytest.approx(4 / 63)


def test_rank_statistics_against_brute_force(spark):
    rows = [("Male" if i % 3 else "Female", float((i * 7) % 11), "25-34" if i % 2 else "<25", i % 2) for i in range(60)] + [("Male", None, None, 1)]
    df = spark.createDataFrame(rows, "clean_gender string, v double, age_band string, approved int").withColumn("clean_credit_history_months", F.col("v"))
    r = fairness.mann_whitney_statistics(df, ["v"]).first()
    m, f = [x[1] for x in rows if x[0] == "Male" and x[1] is not None], [x[1] for x in rows if x[0] == "Female"]
    assert (r.n1, r.n2, r.u_stat) == (len(m), len(f), sum((a > b) + (a == b) / 2 for a in m for b in f))
    rho = fairness.credit_age_statistic(df).first()
    assert rho.n == 60 and -1 <= rho.rho <= 1
    assert fairness.credit_age_correlation(df.limit(0)).first().spearman_rho is None


def test_privacy(spark):
    row = dict(application_id="a", raw_applicant_full_name="Ann", raw_applicant_ssn=" ", raw_applicant_email=" ")
    pid, source = privacy.pseudonym("s")
    got = apps(spark, row, dict(), dict(raw_applicant_ssn="1"), dict(raw_applicant_ssn=" 1")).select(pid.alias("p"), source.alias("s")).collect()
    assert [r.s for r in got] == ["name_dob_zip_fallback", "application_id_fallback", "ssn", "ssn"] and got[2].p == got[3].p and len({r.p for r in got}) == 3
    nested = spark.createDataFrame([(({"full_name": "Ann", "description": "d"}), [{"ssn": "123456789"}], ["x"])], "a struct<full_name:string,description:string>, l array<struct<ssn:string>>, email array<string>")
    r = privacy.redacted(nested).first()
    assert (r.a.full_name, r.a.description, r.l[0].ssn, r.email) == ("[REDACTED_NAME]", "[REDACTED_IP]", "***-**-6789", ["x"])
    assert values(spark, privacy.class_name, ["pii", "Quasi-identifier", "non pii", None, "Other "]) == ["PII", "Quasi-PII", "Non-PII", "Unknown", "Other"]
    a, b = spark.createDataFrame([], "field_path string, classification string, present_in string"), spark.createDataFrame([], "x string")
    assert privacy.best_inventory([b, a]) is a
    with pytest.raises(ValueError):
        privacy.best_inventory([b])


def test_checked_join_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string"), spark.createDataFrame([(1, "p"), (None, "q")], "k int, w string")
    assert sorted(r.w for r in evidence.checked_join(a, b, ["k"]).collect()) == ["p", "q"]
    with pytest.raises(Exception, match="not unique"):
        evidence.checked_join(a, b.union(b), ["k"]).collect()


def test_json_array_pipeline_and_sinks(spark, tmp_path):
    import json

    recs = [{"_id": "a", "applicant_info": {"ssn": "1", "gender": "f"}, "financials": {"annual_income": 10.5}, "decision": {"loan_approved": True}, "spending_behavior": [{"category": "food", "amount": -1}, "x"], "notes": "n"}, {"_id": "a", "applicant_info": "bad", "spending_behavior": {}}]
    (tmp_path / "in.json").write_text(json.dumps(recs))
    records = files.read_json_array(spark, str(tmp_path / "in.json"))
    assert flatten.optional_keys(flatten.parsed(records)) == ["notes"]
    out = pipeline.run(records, "salt")
    assert out["applications_curated_full"].count() == 2 and [r.amount_negative_flag for r in out["spending_clean"].collect()] == [True]
    assert out["applications_analysis"].count() == 1 and not [c for c in out["applications_analysis"].columns if c in privacy.DIRECT_PII]
    issues = out["data_quality_report"]
    assert {r.stage for r in issues.select("stage").distinct().collect()} == {"pre", "post"} and out["before_after_comparison"].count() == 17
    files.write_tables({"x": issues}, str(tmp_path / "t"))
    files.write_csv(issues, str(tmp_path / "c"))
    files.write_text(out["rule_catalog"], "rule_id", str(tmp_path / "txt"))
    assert files.first_readable(spark, [str(tmp_path / "no"), str(tmp_path / "c")]).endswith("c")
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a JSON array"):
        files.read_json_array(spark, str(tmp_path / "bad.json")).collect()


def test_stream(spark, tmp_path):
    from tessaryn.streaming.validate import validate_stream

    df = apps(spark, dict(application_id="a"), dict(application_id="b"))
    df.write.parquet(str(tmp_path / "in"))
    q = validate_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("rule_id = 'R_APP_004'").first()["count"] == 2


def test_registered_queries_judge_both_address_families(spark, tmp_path):
    import ipaddress

    from tessaryn.plans import reference

    seen = ["2001:db8:30::cd", "fd00::1", "fe80::1", "2a00:1450::1", "10.0.0.1", "8.8.8.8", "1.2.3.4:80", None]
    want = {}
    for a in seen:
        try:
            want[a] = ipaddress.ip_address(a).is_private
        except ValueError:
            want[a] = False
    apps(spark, *[dict(application_id=f"a{i}", raw_applicant_ip_address=a) for i, a in enumerate(seen)]).write.parquet(str(tmp_path / "applications_curated_full.parquet"))
    assert {r.address: r.is_private for r in reference.QUERIES["private_ip"](spark, str(tmp_path)).collect()} == want
    row = reference.QUERIES["rule_report_pre"](spark, str(tmp_path)).where("rule_id = 'R_APP_019'").first()
    assert (row["count"], row.example_application_ids) == (4, "a0|a1|a2|a4")
