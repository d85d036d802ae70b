"""ANSI SQL (DuckDB) that says the same as the queries of ``plans.reference``."""

from __future__ import annotations

import ipaddress

from tessaryn.functions.fields import AGE_BANDS, PRIVATE_V4
from tessaryn.operators import rules
from tessaryn.operators.duplicates import LATEST, NO_TIME, TIE
from tessaryn.operators.fairness import FEATURES
from tessaryn.operators.flatten import PATHS
from tessaryn.operators.privacy import ANALYSIS_COLUMNS, INVENTORY, LEAKS
from tessaryn.operators.report import METRICS

APPS, ITEMS, RECORDS = "applications_curated_full", "spending_clean", "raw_records"
_SP = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def percent(n: str, total: str) -> str:
    """Exact, halves up: no binary fraction decides a tie."""
    return f"(CAST((({n}) * 20000 + ({total})) // (2 * ({total})) AS DOUBLE) / 100)"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def some(x: str) -> str:
    return f"(NOT {blank(x)})"


def nullif_blank(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def number(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN regexp_matches({s}, '(?i)^[+-]?(\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?$|^[+-]?inf(inity)?$') THEN TRY_CAST({s} AS DOUBLE) END)"


def truth(x: str) -> str:
    s = f"lower({strip(x)})"
    return f"(CASE WHEN {s} IN ('true','1','yes','y') THEN true WHEN {s} IN ('false','0','no','n') THEN false END)"


def yes(x: str) -> str:
    return f"coalesce({x}, false)"


def iso_instant(x: str) -> str:
    s = strip(x)
    ok = f"regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d{{1,9}})?)?( ?(Z|[+-]\\d{{2}}:?\\d{{2}}))?)?$')"
    wall = f"TRY_CAST(CASE WHEN length({s}) = 10 THEN {s} || ' 00:00:00' ELSE replace(substr({s}, 1, 10) || ' ' || substr({s}, 12, 5), 'T', ' ') || CASE WHEN substr({s}, 17, 1) = ':' THEN regexp_extract({s}, '(:\\d\\d(\\.\\d{{1,6}})?)\\d*( ?(Z|[+-]\\d{{2}}:?\\d{{2}}))?$', 1) ELSE ':00' END END AS TIMESTAMP)"
    sign = f"(CASE WHEN regexp_extract({s}, '([+-])\\d{{2}}:?\\d{{2}}$', 1) = '-' THEN 1 ELSE -1 END)"
    offset = f"(CASE WHEN length({s}) > 10 AND regexp_matches({s}, '[+-]\\d{{2}}:?\\d{{2}}$') THEN {sign} * (CAST(regexp_extract({s}, '[+-](\\d{{2}}):?\\d{{2}}$', 1) AS INT) * 60 + CAST(right({s}, 2) AS INT)) ELSE 0 END)"
    return f"(CASE WHEN {ok} THEN {wall} + to_minutes({offset}) END)"


def band(x: str) -> str:
    y = f"(date_diff('day', {x}, DATE '2026-01-01') / 365.25)"
    return f"(CASE WHEN {y} < 0 THEN NULL WHEN {y} < 25 THEN '<25' WHEN {y} < 35 THEN '25-34' WHEN {y} < 45 THEN '35-44' WHEN {y} < 55 THEN '45-54' WHEN {y} < 65 THEN '55-64' WHEN {y} >= 65 THEN '65+' END)"


def rank(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} = {q(b)} THEN {i}" for i, b in enumerate(AGE_BANDS)) + " END)"


# The IPv6 ranges that are private or reserved, and the ranges in them that are not.
PRIVATE_V6 = ["::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"]
PUBLIC_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


def private_v4(x: str) -> str:
    s, octet = strip(x), r"(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    n = "(" + " + ".join(f"CAST(split_part({s}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in (1, 2, 3, 4)) + ")"
    nets = [ipaddress.ip_network(b) for b in PRIVATE_V4]
    inside = " OR ".join(f"{n} BETWEEN {int(b[0])} AND {int(b[-1])}" for b in nets)
    return f"(CASE WHEN {x} IS NULL THEN false WHEN regexp_matches({s}, '^{octet}(\\.{octet}){{3}}$') THEN ({inside}) ELSE false END)"


def private_v6(x: str) -> str:
    """Addresses of hexadecimal groups: written out to 32 digits and held against the ranges."""
    s = f"lower({strip(x)})"
    side = lambda i: f"list_filter(string_split(split_part({s}, '::', {i}), ':'), lambda g: g <> '')"
    full = f"array_to_string(list_transform(list_concat(list_concat({side(1)}, list_transform(range(8 - len({side(1)}) - len({side(2)})), lambda z: '0')), {side(2)}), lambda g: lpad(g, 4, '0')), '')"
    groups = f"(len({side(1)}) + len({side(2)}))"
    ok = f"regexp_matches({s}, '^([0-9a-f]{{1,4}}(:[0-9a-f]{{1,4}})*)?(::)?([0-9a-f]{{1,4}}(:[0-9a-f]{{1,4}})*)?$') AND (CASE WHEN contains({s}, '::') THEN {groups} <= 7 ELSE {groups} = 8 END)"
    within = lambda blocks: " OR ".join(f"{full} BETWEEN '{int(b[0]):032x}' AND '{int(b[-1]):032x}'" for b in map(ipaddress.ip_network, blocks))
    return f"(CASE WHEN {ok} THEN ({within(PRIVATE_V6)}) AND NOT ({within(PUBLIC_V6)}) ELSE false END)"


def private_address(x: str) -> str:
    return f"(CASE WHEN contains(coalesce({x}, ''), ':') THEN {private_v6(x)} ELSE {private_v4(x)} END)"


def flag_sql(stage: str) -> dict[str, str]:
    raw, clean, pre = (lambda c: f"raw_{c}"), (lambda c: f"clean_{c}"), stage == "pre"
    email = raw("applicant_email") if pre else clean("email")
    gender = f"lower({strip(raw('applicant_gender'))})"
    born = raw("applicant_date_of_birth") if pre else "CAST(clean_date_of_birth AS VARCHAR)"
    income, salary = raw("financial_annual_income"), raw("financial_annual_salary")
    months, savings, dti = ((number(raw(f"financial_{c}")) if pre else clean(c)) for c in ("credit_history_months", "savings_balance", "debt_to_income"))
    ok = truth(raw("decision_loan_approved")) if pre else clean("loan_approved")
    own = {"email", "gender", "zip_code"}
    required = [blank(raw(f"applicant_{c}") if pre or c not in own | {"date_of_birth"} else born if c == "date_of_birth" else clean(c)) for c in rules.REQUIRED]
    odd = f"{some(raw('applicant_gender'))} AND {gender} NOT IN ('m','f','male','female')" if pre else f"{some(clean('gender'))} AND clean_gender NOT IN ('Male','Female')"
    part = lambda i: f"TRY_CAST(regexp_extract({strip(born)}, '^(\\d{{1,2}})/(\\d{{1,2}})/\\d{{4}}$', {i}) AS INT)"
    terms = f"({number(raw('decision_interest_rate'))} IS NULL OR {number(raw('decision_approved_amount'))} IS NULL)"
    return {
        "missing_processing_timestamp": blank(raw("processing_timestamp")) if pre else "clean_processing_timestamp IS NULL",
        "missing_required_applicant_field": " OR ".join(required),
        "missing_ssn_and_ip": f"{blank(raw('applicant_ssn'))} AND {blank(raw('applicant_ip_address'))}",
        "blank_email": blank(email),
        "invalid_email": f"{some(email)} AND NOT regexp_matches({strip(email)}, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')",
        "gender_needs_normalisation": f"{gender} IN ('m','f')" if pre else odd,
        "invalid_gender": odd,
        "dob_non_iso_format": f"{some(born)} AND NOT regexp_matches({strip(born)}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')",
        "dob_ambiguous_format": f"{part(1)} <= 12 AND {part(2)} <= 12" if pre else "dob_ambiguous_flag",
        "annual_income_string_type": f"{some(income)} AND {number(income)} IS NULL" if pre else f"clean_annual_income IS NULL AND ({some(income)} OR {some(salary)})",
        "financial_field_drift_salary": f"{blank(income)} AND {some(salary)}" if pre else "annual_income_from_salary_flag",
        "credit_history_negative": f"{months} < 0",
        "savings_negative": f"{savings} < 0",
        "dti_out_of_range": f"{dti} < 0 OR {dti} > 1",
        "approved_missing_required_fields": f"{ok} AND {terms}" if pre else "approved_missing_terms_flag",
        "rejected_missing_reason": f"NOT {ok} AND {blank(raw('decision_rejection_reason'))}" if pre else "rejected_missing_reason_flag",
        "approved_credit_history_zero": f"{ok} AND {months} = 0",
        "approved_credit_history_lt6": f"{ok} AND {months} < 6",
        "private_ip_address": private_address(raw("applicant_ip_address")),
    }


def spending_flag_sql(stage: str) -> dict[str, str]:
    if stage == "post":
        return {"spending_missing_category": "category_missing_flag", "spending_amount_non_numeric": "amount_invalid_flag", "spending_amount_negative": "amount_negative_flag"}
    return {"spending_missing_category": blank("raw_category"), "spending_amount_non_numeric": f"{some('raw_amount')} AND {number('raw_amount')} IS NULL", "spending_amount_negative": f"{number('raw_amount')} < 0"}


def rule_rows_sql(stage: str, table: str, which: list[rules.Rule]) -> str:
    """One row per rule with issues, out of the single row of ``_c_{stage}_{table}``."""
    out = []
    for r in which:
        count = f"{r.flag}_n"
        out.append(
            f"SELECT {q(stage)} AS stage, {q(r.issue_group)} AS issue_group, {q(r.rule_id)} AS rule_id, {q(r.field_path)} AS field_path, {q(r.description)} AS description, {count} AS \"count\", "
            f"{percent(count, 'total')} AS percent, {q(r.severity)} AS severity, coalesce(array_to_string(list_slice({r.flag}_ids, 1, 5), '|'), '') AS example_application_ids, "
            f"{q(r.source_pre if stage == 'pre' else r.source_post)} AS value_source FROM _c_{stage}_{table} WHERE {count} > 0"
        )
    return " UNION ALL ".join(out)


def flags_cte(stage: str, table: str, flags: dict[str, str]) -> str:
    """Flags of every row; then counts and flagged ids of all rules in one pass."""
    rows = "SELECT application_id, " + ", ".join(f"{yes(f'({e})')} AS {n}" for n, e in flags.items()) + f" FROM {table}"
    each = ", ".join(f"count(*) FILTER ({n}) AS {n}_n, list_sort(list(DISTINCT application_id) FILTER ({n} AND application_id IS NOT NULL)) AS {n}_ids" for n in flags)
    return f"_c_{stage}_{table} AS MATERIALIZED (SELECT count(*) AS total, {each} FROM ({rows}))"


_RAW = ["raw_processing_timestamp", "raw_applicant_full_name", "raw_applicant_email", "raw_applicant_ssn", "raw_applicant_ip_address", "raw_applicant_gender", "raw_applicant_date_of_birth", "raw_applicant_zip_code", "raw_financial_annual_income", "raw_financial_annual_salary", "raw_financial_credit_history_months", "raw_financial_debt_to_income", "raw_financial_savings_balance", "raw_decision_loan_approved", "raw_decision_interest_rate", "raw_decision_approved_amount", "raw_decision_rejection_reason", "raw_load_id", "raw_notes", "raw_source_system"]
_CORE = [c for c in _RAW if c not in ("raw_processing_timestamp", "raw_notes")]
GROUPS = f"""_t AS (SELECT application_id, application_row_id, {iso_instant('raw_processing_timestamp')} AS t, {{pack_all}} AS pa, {{pack_core}} AS pc FROM {APPS}),
_l AS (SELECT *, max(t) OVER (PARTITION BY application_id) AS latest FROM _t),
groups AS MATERIALIZED (SELECT application_id, count(*) AS dup_count,
 CASE WHEN count(*) = 1 THEN 'unique' WHEN count(DISTINCT pa) = 1 THEN 'exact' WHEN count(DISTINCT pc) = 1 OR max(t) IS NOT NULL THEN 'versioned' ELSE 'conflict' END AS classification,
 coalesce(max(application_row_id) FILTER (t = latest), max(application_row_id)) AS canonical_row_id,
 CASE WHEN max(t) IS NULL THEN {q(NO_TIME)} WHEN count(*) FILTER (t = latest) > 1 THEN {q(TIE)} ELSE {q(LATEST)} END AS canonical_reason
 FROM _l GROUP BY application_id)"""
_pack = lambda cols: "concat_ws(chr(1), " + ", ".join(f"coalesce('=' || {c}, '0')" for c in cols) + ")"
GROUPS = GROUPS.replace("{pack_all}", _pack(_RAW)).replace("{pack_core}", _pack(_CORE))

_DIFF = "list_filter([" + ", ".join(f"CASE WHEN r.{c} IS DISTINCT FROM c.{c} THEN {q(c)} END" for c in _RAW) + "], lambda x: x IS NOT NULL)"
REPORT = f"""_d AS (SELECT g.application_id, {_DIFF} AS d, r.application_row_id AS rid FROM groups g JOIN {APPS} r ON r.application_id IS NOT DISTINCT FROM g.application_id
 JOIN {APPS} c ON c.application_row_id = g.canonical_row_id WHERE g.dup_count > 1 AND r.application_row_id <> g.canonical_row_id),
_e AS (SELECT application_id, array_to_string(list_slice(arg_min(d, rid), 1, 5), '|') AS example_differences FROM _d WHERE len(d) > 0 GROUP BY application_id),
dup_report AS (SELECT g.*, coalesce(e.example_differences, '') AS example_differences FROM groups g LEFT JOIN _e e ON e.application_id IS NOT DISTINCT FROM g.application_id WHERE g.dup_count > 1)"""

_ssn = strip("raw_applicant_ssn")
NUMBERS = f"numbers AS MATERIALIZED (SELECT {_ssn} AS number, count(*) AS n_rows, count(DISTINCT application_id) AS n_ids FROM {APPS} WHERE {some('raw_applicant_ssn')} GROUP BY 1 HAVING count(*) > 1)"


def duplicate_rows_sql(stage: str) -> str:
    info = {r.rule_id: r for r in rules.RULES}
    holders = f"{APPS} a JOIN numbers n ON n.number = {strip('a.raw_applicant_ssn')}"
    src = {
        "R_DUP_001": ("(SELECT coalesce(sum(dup_count), 0) FROM groups WHERE dup_count > 1)", "groups a", "a.dup_count > 1"),
        "R_DUP_002": ("(SELECT count(*) FROM groups WHERE dup_count > 1)", "groups a", "a.dup_count > 1"),
        "R_DUP_003": ("(SELECT coalesce(sum(n_rows), 0) FROM numbers)", holders, "true"),
        "R_DUP_004": ("(SELECT count(*) FROM numbers WHERE n_ids > 1)", holders, "n.n_ids > 1"),
    }
    out = []
    for rid, (count, table, where) in src.items():
        r = info[rid]
        out.append(
            f"SELECT {q(stage)}, {q(r.issue_group)}, {q(rid)}, {q(r.field_path)}, {q(r.description)}, CAST({count} AS BIGINT), {percent(f'CAST({count} AS BIGINT)', f'(SELECT count(*) FROM {APPS})')}, {q(r.severity)}, "
            f"(SELECT coalesce(string_agg(i, '|' ORDER BY i), '') FROM (SELECT DISTINCT a.application_id AS i FROM {table} WHERE {where} AND a.application_id IS NOT NULL ORDER BY i LIMIT 5)), {q(r.source_pre)} WHERE {count} > 0"
        )
    return " UNION ALL ".join(out)


def stage_ctes(*stages: str) -> str:
    return ", ".join(x for s in stages for x in (flags_cte(s, APPS, flag_sql(s)), flags_cte(s, ITEMS, spending_flag_sql(s))))


def stage_rows(stage: str) -> str:
    return " UNION ALL ".join([rule_rows_sql(stage, APPS, rules.APPLICATION_RULES), duplicate_rows_sql(stage), rule_rows_sql(stage, ITEMS, rules.SPENDING_RULES)])


ISSUES = f"WITH {GROUPS}, {NUMBERS}, {stage_ctes('pre', 'post')}, issues AS MATERIALIZED ({stage_rows('pre')} UNION ALL {stage_rows('post')})"
DELTAS = f"""{ISSUES}, deltas AS (SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(b.issue_group, a.issue_group) AS issue_group, coalesce(b.field_path, a.field_path) AS field_path, coalesce(b.description, a.description) AS description, coalesce(b.severity, a.severity) AS severity,
 a.value_source AS pre_value_source, b.value_source AS post_value_source, a."count" AS pre_count, a.percent AS pre_percent, b."count" AS post_count, b.percent AS post_percent, b."count" - a."count" AS delta_count, round(b.percent - a.percent, 2) AS delta_pp
 FROM (SELECT * FROM issues WHERE stage = 'pre') a FULL JOIN (SELECT * FROM issues WHERE stage = 'post') b ON a.rule_id = b.rule_id)"""
_SEV = "(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END)"

SALT = "example-salt"
_name = lambda c: strip(f"raw_applicant_{c}")
PSEUDO = f"""CASE WHEN {some('raw_applicant_ssn')} THEN 'ssn:' || {_name('ssn')} WHEN {some('raw_applicant_email')} THEN 'email:' || lower({_name('email')})
 WHEN {some('raw_applicant_full_name')} OR {some('raw_applicant_date_of_birth')} OR {some('raw_applicant_zip_code')} THEN 'name_dob_zip:' || coalesce(lower({_name('full_name')}), 'none') || '|' || coalesce({_name('date_of_birth')}, 'None') || '|' || coalesce({_name('zip_code')}, 'None')
 ELSE 'application:' || coalesce(application_id, 'None') || '|row:' || CAST(application_row_id AS VARCHAR) END"""
SOURCE = f"CASE WHEN {some('raw_applicant_ssn')} THEN 'ssn' WHEN {some('raw_applicant_email')} THEN 'email_fallback' WHEN {some('raw_applicant_full_name')} OR {some('raw_applicant_date_of_birth')} OR {some('raw_applicant_zip_code')} THEN 'name_dob_zip_fallback' ELSE 'application_id_fallback' END"
ANALYSIS = f"""_a AS (SELECT *, sha256({q(SALT + '|')} || {PSEUDO}) AS applicant_pseudo_id, {SOURCE} AS pseudo_id_source, {band('clean_date_of_birth')} AS age_band, row_number() OVER (PARTITION BY application_id ORDER BY application_row_id) AS r FROM {APPS} WHERE is_canonical_for_analysis),
analysis AS MATERIALIZED (SELECT application_id, applicant_pseudo_id, pseudo_id_source, pseudo_id_source <> 'ssn' AS pseudo_id_fallback_used_flag, age_band, age_band IS NULL AS age_band_missing_flag, {', '.join(ANALYSIS_COLUMNS[6:])}, CASE WHEN clean_loan_approved THEN 1 ELSE 0 END AS approved FROM _a WHERE r = 1),
gs AS (SELECT * FROM analysis WHERE clean_gender IN ('Male','Female')), ags AS (SELECT * FROM analysis WHERE age_band IS NOT NULL)"""
_OUT = ", ".join(ANALYSIS_COLUMNS)
RATES = "count(approved) AS n, CAST(sum(approved) AS BIGINT) AS approved_n, round(avg(approved), 9) AS approval_rate"


def impact_sql(rows: str) -> str:
    return f"SELECT privileged_group, unprivileged_group, privileged_n, unprivileged_n, round(privileged_rate, 9) AS privileged_rate, round(unprivileged_rate, 9) AS unprivileged_rate, round(CASE WHEN privileged_rate > 0 THEN unprivileged_rate / privileged_rate END, 9) AS disparate_impact, round(unprivileged_rate - privileged_rate, 9) AS demographic_parity_difference, coalesce(CASE WHEN privileged_rate > 0 THEN unprivileged_rate / privileged_rate END < 0.8, false) AS four_fifths_flag FROM ({rows})"


def chi2_sql(table: str, col: str) -> str:
    return f"""WITH {ANALYSIS}, cells AS (SELECT {col} AS g, approved AS o, count(*) AS n FROM {table} GROUP BY 1, 2), r AS (SELECT g, sum(n) AS r FROM cells GROUP BY 1), c AS (SELECT o, sum(n) AS c FROM cells GROUP BY 1), t AS (SELECT sum(n) AS t FROM cells),
grid AS (SELECT r.g, c.o, r.r * c.c * 1.0 / t.t AS e, abs(coalesce(cells.n, 0) - r.r * c.c * 1.0 / t.t) AS d FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN cells ON cells.g = r.g AND cells.o = c.o), k AS (SELECT (SELECT count(*) - 1 FROM r) * (SELECT count(*) - 1 FROM c) AS dof)
SELECT round(sum(CASE WHEN k.dof = 1 THEN (d - least(0.5, d)) * (d - least(0.5, d)) / e ELSE d * d / e END), 6) AS chi2, CAST(max(k.dof) AS BIGINT) AS dof FROM grid CROSS JOIN k"""


_LONG = " UNION ALL ".join(f"SELECT {q(f)} AS feature, clean_gender, CAST({f} AS DOUBLE) AS v FROM gs WHERE {f} IS NOT NULL" for f in FEATURES)
_MASKED = {"raw_applicant_email": f"CASE WHEN {blank('raw_applicant_email')} THEN raw_applicant_email WHEN contains({_name('email')}, '@') THEN left(split_part({_name('email')}, '@', 1), 1) || '***@' || regexp_replace({_name('email')}, '^[^@]*@', '') ELSE '[REDACTED_EMAIL]' END",
           "raw_applicant_ssn": f"CASE WHEN {blank('raw_applicant_ssn')} THEN raw_applicant_ssn ELSE '***-**-' || right({_name('ssn')}, 4) END",
           "raw_applicant_ip_address": f"CASE WHEN {blank('raw_applicant_ip_address')} THEN raw_applicant_ip_address ELSE '[REDACTED_IP]' END",
           "raw_applicant_full_name": f"CASE WHEN {blank('raw_applicant_full_name')} THEN raw_applicant_full_name ELSE '[REDACTED_NAME]' END"}
_DOB = "raw_applicant_date_of_birth"
_MASK_DOB = f"CASE WHEN {blank(_DOB)} THEN {_DOB} ELSE CASE WHEN length({strip(_DOB)}) >= 4 THEN left({strip(_DOB)}, 4) ELSE 'XXXX' END || '-**-**' END"
_MASK_YEAR = f"CASE WHEN {blank(_DOB)} THEN {_DOB} ELSE coalesce(nullif(regexp_extract({_DOB}, '((?:19|20)\\d\\d)', 1), ''), 'XXXX') || '-**-**' END"
_iso = lambda i: f"regexp_extract({strip(_DOB)}, '^(\\d{{4}})[-/](\\d{{1,2}})[-/](\\d{{1,2}})$', {i})"
_sla = lambda i: f"regexp_extract({strip(_DOB)}, '^(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}})$', {i})"
_dt = lambda y, m, d: f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
BORN = f"(CASE WHEN {_iso(1)} <> '' THEN {_dt(_iso(1), _iso(2), _iso(3))} WHEN {_sla(1)} <> '' THEN CASE WHEN CAST({_sla(1)} AS INT) > 12 THEN {_dt(_sla(3), _sla(2), _sla(1))} ELSE {_dt(_sla(3), _sla(1), _sla(2))} END END)"
_inc, _sal = "raw_financial_annual_income", "raw_financial_annual_salary"
_m, _dti, _sav, _ok = number("raw_financial_credit_history_months"), number("raw_financial_debt_to_income"), number("raw_financial_savings_balance"), truth("raw_decision_loan_approved")
_rate, _amt, _why = number("raw_decision_interest_rate"), number("raw_decision_approved_amount"), nullif_blank("raw_decision_rejection_reason")
_g = f"lower({strip('raw_applicant_gender')})"
_cat = nullif_blank("raw_category")
_LEAK_COLS = ["text", "application_id", "source"]
_TS = "{d}"


def profile_sql(col: str, is_time: bool) -> str:
    parsed = f"CAST({col} AS TIMESTAMP)" if is_time else iso_instant(col)
    gone = f"({col} IS NULL)" if is_time else f"({blank(col)} OR lower({strip(col)}) = 'nan')"
    return f"""SELECT {q(APPS)} AS dataset, {q(col)} AS field, count(*) AS n_rows, 1 AS has_field, count(*) FILTER (g) AS missing_count, round(count(*) FILTER (g) * 1.0 / count(*), 9) AS missing_pct, count(*) FILTER (p) AS parse_failed_count, round(count(*) FILTER (p) * 1.0 / count(*), 9) AS parse_failed_pct,
 count(*) FILTER (f) AS future_ts_count, round(count(*) FILTER (f) * 1.0 / count(*), 9) AS future_ts_pct, (SELECT nullif(string_agg(application_id, ',' ORDER BY application_row_id), '') FROM (SELECT * FROM (SELECT application_id, application_row_id, {gone} AS g, NOT {gone} AND {parsed} IS NULL AS p, coalesce({parsed} > TIMESTAMP '2025-07-01 00:00:00' + INTERVAL 1 DAY, false) AS f FROM {APPS}) WHERE g OR p OR f ORDER BY application_row_id LIMIT 10)) AS example_ids
 FROM (SELECT {gone} AS g, NOT {gone} AND {parsed} IS NULL AS p, coalesce({parsed} > TIMESTAMP '2025-07-01 00:00:00' + INTERVAL 1 DAY, false) AS f FROM {APPS})"""


_PROFILES = f"{profile_sql('raw_processing_timestamp', False)} UNION ALL SELECT {q(APPS)}, 'processing_timestamp', count(*), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {APPS}"
_OBJ = f"(SELECT record_id, CAST(payload AS JSON) AS p FROM {RECORDS} WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT')"

SQL = {
    "clean_applications": f"""SELECT application_row_id, lower({nullif_blank('raw_applicant_email')}) AS clean_email, CASE WHEN {_g} IN ('m','male') THEN 'Male' WHEN {_g} IN ('f','female') THEN 'Female' END AS clean_gender, {yes(f"{_g} IN ('m','f')")} AS gender_standardized_flag,
 CAST({BORN} AS VARCHAR) AS clean_date_of_birth, {yes(f"TRY_CAST({_sla(1)} AS INT) <= 12 AND TRY_CAST({_sla(2)} AS INT) <= 12 AND {BORN} IS NOT NULL")} AS dob_ambiguous_flag, {some(_DOB)} AND {BORN} IS NULL AS dob_parse_failed_flag,
 strftime({iso_instant('raw_processing_timestamp')}, '%Y-%m-%dT%H:%M:%SZ') AS clean_processing_timestamp, {nullif_blank('raw_applicant_zip_code')} AS clean_zip_code, {blank(_inc)} AND {some(_sal)} AS annual_income_from_salary_flag, CASE WHEN {blank(_inc)} THEN {number(_sal)} ELSE {number(_inc)} END AS clean_annual_income,
 {yes(f'{_m} < 0')} AS credit_history_nullified_flag, CASE WHEN {_m} >= 0 THEN CAST(round_even({_m}, 0) AS BIGINT) END AS clean_credit_history_months, {yes(f'{_dti} < 0 OR {_dti} > 1')} AS dti_nullified_flag, CASE WHEN {_dti} BETWEEN 0 AND 1 THEN {_dti} END AS clean_debt_to_income,
 {yes(f'{_sav} < 0')} AS savings_nullified_flag, CASE WHEN {_sav} >= 0 THEN {_sav} END AS clean_savings_balance, {_ok} AS clean_loan_approved, {_rate} AS clean_interest_rate, {_amt} AS clean_approved_amount, {_why} AS clean_rejection_reason,
 {yes(f'{_ok} AND ({_rate} IS NULL OR {_amt} IS NULL)')} AS approved_missing_terms_flag, {yes(f'NOT {_ok} AND {_why} IS NULL')} AS rejected_missing_reason_flag FROM {APPS}""",
    "clean_spending": f"""SELECT application_row_id, spending_index, raw_category, raw_amount, list_aggregate(list_transform(regexp_extract_all(lower({_cat}), '\\P{{L}}|\\p{{L}}+'), lambda x: upper(left(x, 1)) || substr(x, 2)), 'string_agg', '') AS category_clean, {_cat} IS NULL AS category_missing_flag, {some('raw_amount')} AND {number('raw_amount')} IS NULL AS amount_invalid_flag,
 {yes(f"{number('raw_amount')} < 0")} AS amount_negative_flag, CASE WHEN {number('raw_amount')} >= 0 THEN {number('raw_amount')} END AS amount_clean FROM {ITEMS}""",
    "rule_catalog": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rules.catalog_rows()) + ") t(stage, rule_id, issue_group, field_path, field_path_annotated, value_source, severity, description)",
    "rule_report_pre": f"WITH {flags_cte('pre', APPS, flag_sql('pre'))} {rule_rows_sql('pre', APPS, rules.APPLICATION_RULES)}",
    "rule_report_post": f"WITH {flags_cte('post', APPS, flag_sql('post'))} {rule_rows_sql('post', APPS, rules.APPLICATION_RULES)}",
    "quality_report": f"{ISSUES} SELECT * FROM issues",
    "issue_group_totals": f'{ISSUES} SELECT stage, issue_group, CAST(sum("count") AS BIGINT) AS issues FROM issues GROUP BY 1, 2',
    "before_after": f"""{ISSUES}, m AS (SELECT * FROM (VALUES {', '.join(f"({q(r)}, {q(t)})" for r, t in METRICS)}) t(rule_id, metric_label)), x AS (SELECT coalesce(a.issue_group, b.issue_group, '') AS issue_group, m.rule_id, m.metric_label, coalesce(a."count", 0) AS pre_count, coalesce(b."count", 0) AS post_count, coalesce(a.percent, 0.0) AS pre_percent, coalesce(b.percent, 0.0) AS post_percent FROM m LEFT JOIN issues a ON a.rule_id = m.rule_id AND a.stage = 'pre' LEFT JOIN issues b ON b.rule_id = m.rule_id AND b.stage = 'post'
 UNION ALL SELECT 'Uniqueness', 'R_DUP_001', 'Duplicate application_id rows', d, d, {percent('d', 'CAST(n AS BIGINT)')}, {percent('d', 'CAST(n AS BIGINT)')} FROM (SELECT CAST(coalesce(sum(dup_count) FILTER (dup_count > 1), 0) AS BIGINT) AS d, sum(dup_count) AS n FROM groups)
 UNION ALL SELECT 'Uniqueness', 'R_DUP_CONFLICT', 'Duplicate conflict IDs', d, d, {percent('d', 'CAST(n AS BIGINT)')}, {percent('d', 'CAST(n AS BIGINT)')} FROM (SELECT count(*) FILTER (classification = 'conflict') AS d, sum(dup_count) AS n FROM groups)
 UNION ALL SELECT 'Remediation', 'R_DUP_CANONICAL', 'Canonical rows retained for analysis', CAST(n AS BIGINT), k, 100.0, {percent('k', 'CAST(n AS BIGINT)')} FROM (SELECT count(*) AS k, sum(dup_count) AS n FROM groups))
 SELECT issue_group, rule_id, metric_label, pre_count, post_count, post_count - pre_count AS delta_count, pre_percent, post_percent, round(post_percent - pre_percent, 2) AS delta_percent FROM x""",
    "rule_deltas": f"{DELTAS} SELECT * FROM deltas",
    "top_improvements": f"{DELTAS} SELECT rule_id, severity, pre_percent, post_percent, delta_pp FROM deltas ORDER BY delta_pp ASC NULLS LAST, rule_id LIMIT 15",
    "residual_issues": f"{DELTAS} SELECT rule_id, severity, post_count, post_percent FROM deltas WHERE post_percent > 0 ORDER BY {_SEV}, post_percent DESC, rule_id LIMIT 20",
    "duplicate_groups": f"WITH {GROUPS} SELECT * FROM groups",
    "duplicate_report": f"WITH {GROUPS}, {REPORT} SELECT * FROM dup_report",
    "duplicate_metadata": f"WITH {GROUPS} SELECT a.application_row_id, a.application_id, g.dup_count > 1 AS is_duplicate_id, a.application_row_id = g.canonical_row_id AS is_canonical_for_analysis, g.classification = 'conflict' AS has_conflict FROM {APPS} a JOIN groups g ON g.application_id IS NOT DISTINCT FROM a.application_id",
    "duplicate_summary": f"WITH {GROUPS}, {REPORT} SELECT count(*) AS n_ids, count(*) FILTER (classification = 'exact') AS n_exact, count(*) FILTER (classification = 'versioned') AS n_versioned, count(*) FILTER (classification = 'conflict') AS n_conflict, coalesce((SELECT string_agg(c, '|' ORDER BY c) FROM (SELECT DISTINCT classification AS c FROM dup_report)), '') AS classes FROM dup_report",
    "repeated_ssn": f"WITH {NUMBERS} SELECT * FROM numbers",
    "analysis_table": f"WITH {ANALYSIS} SELECT {_OUT} FROM analysis",
    "pseudonym_metrics": f"WITH {ANALYSIS} SELECT count(*) AS n_rows, CAST({len(ANALYSIS_COLUMNS)} AS BIGINT) AS n_columns, count(*) FILTER (applicant_pseudo_id IS NULL) AS missing, count(DISTINCT applicant_pseudo_id) AS n_distinct, count(*) - count(DISTINCT applicant_pseudo_id) AS repeated, count(*) FILTER (pseudo_id_fallback_used_flag) AS fallback_count, round(avg(CASE WHEN pseudo_id_fallback_used_flag THEN 1.0 ELSE 0.0 END), 9) AS fallback_rate, (SELECT round(100 * avg(CAST(is_canonical_for_analysis AS DOUBLE)), 2) FROM {APPS}) AS canonical_rate_pct FROM analysis",
    "pseudonym_sources": f"WITH {ANALYSIS} SELECT coalesce(pseudo_id_source, 'MISSING') AS value, count(*) AS n, {percent('count(*)', 'CAST(sum(count(*)) OVER () AS BIGINT)')} AS percent FROM analysis GROUP BY 1",
    "pii_inventory": "SELECT * FROM (VALUES " + ", ".join(f"({q(p)}, {q(k)}, {str(r).lower()}, {str(bool(c)).lower()}, {str(bool(a)).lower()})" for p, k, r, c, a in INVENTORY) + ") t(field_path, classification, present_in_raw, present_in_curated, present_in_analysis)",
    "presence_matrix": "SELECT * FROM (VALUES " + ", ".join(f"({q(p)}, {q(k)}, {str(r).lower()}, {str(bool(c)).lower()}, {str(bool(a)).lower()})" for p, k, r, c, a in INVENTORY) + ") t(field_path, pii_class, present_in_raw, present_in_curated, present_in_analysis)",
    "masked_columns": f"SELECT application_row_id, {', '.join(f'{e} AS {c}' for c, e in _MASKED.items())}, {_MASK_DOB} AS {_DOB} FROM {APPS}",
    "preview_columns": f"SELECT application_row_id, {', '.join(f'{e} AS {c}' for c, e in _MASKED.items())}, {_MASK_YEAR} AS {_DOB}, CASE WHEN {blank('raw_applicant_zip_code')} THEN raw_applicant_zip_code ELSE '[REDACTED_ZIP]' END AS raw_applicant_zip_code FROM {APPS}",
    "safe_preview": f"SELECT application_row_id, {', '.join(f'{e} AS {c}' for c, e in _MASKED.items())}, {_MASK_DOB} AS {_DOB} FROM {APPS} ORDER BY application_row_id LIMIT 5",
    "curated_preview": f"SELECT application_row_id, {', '.join(f'{e} AS {c}' for c, e in _MASKED.items())}, {_MASK_YEAR} AS {_DOB}, CASE WHEN {blank('raw_applicant_zip_code')} THEN raw_applicant_zip_code ELSE '[REDACTED_ZIP]' END AS raw_applicant_zip_code FROM {APPS} ORDER BY application_row_id LIMIT 10",
    "pii_non_null": " UNION ALL ".join(f"SELECT {q(c)} AS \"column\", count({c}) AS non_null FROM {APPS}" for c in [*_MASKED, _DOB]),
    "evidence_card": f"""WITH {GROUPS}, {REPORT} SELECT 'total' AS part, 'Total duplicated application_ids: ' || count(*) AS line FROM dup_report
 UNION ALL SELECT 'classes', 'Conflict duplicates: ' || count(*) FILTER (classification = 'conflict') || '   |   Versioned duplicates: ' || count(*) FILTER (classification = 'versioned') FROM dup_report
 UNION ALL SELECT 'rule', 'Canonical selection rule observed: ' || coalesce((SELECT string_agg(r, ', ' ORDER BY r) FROM (SELECT DISTINCT canonical_reason AS r FROM dup_report)), 'n/a')
 UNION ALL SELECT 'note', 'Governance note: fallback selection indicates a provenance/auditability gap (missing/unparseable timestamps).'
 UNION ALL SELECT 'example', coalesce(application_id, 'None') || ': ' || classification || ' | diffs: ' || CASE WHEN length(example_differences) > 80 THEN left(example_differences, 77) || '...' ELSE example_differences END FROM dup_report""",
    "leak_scan": " UNION ALL ".join(f"SELECT {q(p)} AS pattern, {q(c)} AS \"column\", count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), {q(e)})) AS hits, count(*) AS n_rows FROM documents" for p, e in LEAKS.items() for c in _LEAK_COLS),
    "leak_summary": "SELECT pattern, max(n_rows) AS n_rows, count(*) AS columns_scanned, CAST(sum(hits) AS BIGINT) AS cell_hits, count(*) FILTER (hits > 0) AS columns_with_hits FROM (" + " UNION ALL ".join(f"SELECT {q(p)} AS pattern, count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), {q(e)})) AS hits, count(*) AS n_rows FROM documents" for p, e in LEAKS.items() for c in _LEAK_COLS) + ") GROUP BY 1",
    "approval_by_gender": f"WITH {ANALYSIS} SELECT clean_gender, {RATES} FROM gs GROUP BY 1",
    "approval_by_age": f"WITH {ANALYSIS} SELECT age_band, {RATES} FROM ags GROUP BY 1",
    "interaction": f"WITH {ANALYSIS} SELECT age_band, clean_gender, {RATES} FROM gs WHERE age_band IS NOT NULL GROUP BY 1, 2",
    "disparate_impact": f"WITH {ANALYSIS} " + impact_sql("SELECT 'Male' AS privileged_group, 'Female' AS unprivileged_group, count(*) FILTER (clean_gender = 'Male') AS privileged_n, count(*) FILTER (clean_gender = 'Female') AS unprivileged_n, avg(approved) FILTER (clean_gender = 'Male') AS privileged_rate, avg(approved) FILTER (clean_gender = 'Female') AS unprivileged_rate FROM gs"),
    "age_impact": f"WITH {ANALYSIS} " + impact_sql("SELECT '25-34' AS privileged_group, age_band AS unprivileged_group, (SELECT count(*) FROM ags WHERE age_band = '25-34') AS privileged_n, count(*) AS unprivileged_n, (SELECT avg(approved) FROM ags WHERE age_band = '25-34') AS privileged_rate, avg(approved) AS unprivileged_rate FROM ags WHERE age_band <> '25-34' GROUP BY age_band"),
    "chi2_gender": chi2_sql("gs", "clean_gender"),
    "chi2_age": chi2_sql("ags", "age_band"),
    "mann_whitney": f"WITH {ANALYSIS}, l AS ({_LONG}), k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, v) AS t FROM l) SELECT feature, count(*) FILTER (clean_gender = 'Male') AS n1, count(*) FILTER (clean_gender = 'Female') AS n2, sum(r) FILTER (clean_gender = 'Male') - count(*) FILTER (clean_gender = 'Male') * (count(*) FILTER (clean_gender = 'Male') + 1) / 2.0 AS u_stat, sum(t * 1.0 * t - 1) AS ties FROM k GROUP BY 1",
    "spearman": f"WITH {ANALYSIS}, d AS (SELECT {rank('age_band')} AS x, clean_credit_history_months AS y FROM ags WHERE clean_credit_history_months IS NOT NULL), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d) SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k",
    "interest_rates": f"WITH {ANALYSIS} SELECT " + ", ".join(f"count(clean_interest_rate) FILTER (clean_gender = '{s}') AS {s.lower()}_n, round(median(clean_interest_rate) FILTER (clean_gender = '{s}'), 6) AS {s.lower()}_median_rate, round(avg(clean_interest_rate) FILTER (clean_gender = '{s}'), 6) AS {s.lower()}_mean_rate" for s in ("Male", "Female")) + " FROM gs WHERE approved = 1",
    "rejection_reasons": f"WITH {ANALYSIS} SELECT clean_rejection_reason, count(*) FILTER (clean_gender = 'Female') AS \"Female\", count(*) FILTER (clean_gender = 'Male') AS \"Male\", count(*) AS total FROM gs WHERE approved = 0 AND clean_rejection_reason IS NOT NULL GROUP BY 1",
    "spending_by_gender": f"WITH {ANALYSIS}, j AS (SELECT s.category_clean, s.amount_clean, g.clean_gender FROM {ITEMS} s JOIN gs g ON g.application_id = s.application_id WHERE s.category_clean IS NOT NULL) SELECT category_clean, " + ", ".join(f"CASE WHEN count(*) FILTER (clean_gender = '{s}') = 0 THEN 0.0 ELSE round(CAST(sum(CAST(amount_clean AS DECIMAL(18,2))) FILTER (clean_gender = '{s}') AS DOUBLE) / count(amount_clean) FILTER (clean_gender = '{s}'), 6) END AS \"{s}\"" for s in ("Female", "Male")) + " FROM j GROUP BY 1",
    "heatmap": f"WITH {ANALYSIS}, b AS (SELECT unnest([{', '.join(map(q, AGE_BANDS))}]) AS age_band) SELECT b.age_band, " + ", ".join(f"round(avg(g.approved) FILTER (g.clean_gender = '{s}'), 9) AS {s.lower()}_rate, nullif(count(*) FILTER (g.clean_gender = '{s}'), 0) AS {s.lower()}_n" for s in ("Female", "Male")) + " FROM b LEFT JOIN gs g ON g.age_band = b.age_band GROUP BY 1",
    "boxes": f"WITH {ANALYSIS}, l AS ({_LONG}) SELECT feature, clean_gender, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, min(v) AS low, max(v) AS high FROM l GROUP BY 1, 2",
    "rate_marks": f"WITH {ANALYSIS} SELECT age_band, {RATES}, round((SELECT avg(approved) FROM ags WHERE age_band = '25-34'), 9) AS reference_rate, round((SELECT avg(approved) FROM ags WHERE age_band = '25-34') * 0.8, 9) AS four_fifths_line FROM ags GROUP BY 1",
    "interest_histogram": f"WITH {ANALYSIS}, d AS (SELECT clean_gender, clean_interest_rate AS v, min(clean_interest_rate) OVER (PARTITION BY clean_gender) AS low, max(clean_interest_rate) OVER (PARTITION BY clean_gender) AS high FROM gs WHERE approved = 1 AND clean_interest_rate IS NOT NULL), md AS (SELECT clean_gender, round(median(v), 9) AS group_median FROM d GROUP BY 1) SELECT d.clean_gender, CAST(CASE WHEN high = low THEN 1 ELSE least(floor((v - low) / ((high - low) / 15)) + 1, 15) END AS INT) AS bin, count(*) AS n, low, high, group_median FROM d JOIN md ON md.clean_gender = d.clean_gender GROUP BY 1, 2, 4, 5, 6",
    "timestamp_profile": _PROFILES,
    "provenance_bars": f"SELECT dataset, field, measure, round(pct * 100, 2) AS percent FROM (SELECT dataset, field, unnest(['missing', 'parse_failed', 'future_ts']) AS measure, unnest([missing_pct, parse_failed_pct, future_ts_pct]) AS pct FROM ({_PROFILES}) WHERE has_field = 1)",
    **{f"group_check_{n}": f"WITH {GROUPS}, {ANALYSIS} SELECT coalesce(a.{c}, 'missing') AS {c}, count(*) AS n_total, count(g.application_id) AS n_duplicated, count(*) FILTER (g.classification = 'conflict') AS n_conflict, round(count(g.application_id) * 1.0 / count(*), 9) AS dup_rate, round(count(*) FILTER (g.classification = 'conflict') * 1.0 / count(*), 9) AS conflict_rate FROM analysis a LEFT JOIN (SELECT * FROM groups WHERE dup_count > 1) g ON g.application_id = a.application_id GROUP BY 1" for n, c in (("gender", "clean_gender"), ("age", "age_band"))},
    "value_counts": f"SELECT raw_source_system, count(*) AS n FROM {APPS} GROUP BY 1",
    "flatten_records": "SELECT record_id AS application_row_id, " + ", ".join(f"p->>'{path}' AS {c}" for c, path in PATHS.items()) + f", p->>'$.notes' AS raw_notes, p->>'$.referral_code' AS raw_referral_code FROM {_OBJ}",
    "explode_items": f"SELECT application_row_id, application_id, spending_index, i->>'$.category' AS raw_category, i->>'$.amount' AS raw_amount FROM (SELECT record_id AS application_row_id, p->>'$._id' AS application_id, CAST(unnest(range(CAST(json_array_length(p->'$.spending_behavior') AS BIGINT))) AS INT) AS spending_index, unnest(CAST(p->'$.spending_behavior' AS JSON[])) AS i FROM {_OBJ} WHERE json_type(p->'$.spending_behavior') = 'ARRAY') WHERE json_type(i) = 'OBJECT'",
    "optional_keys": f"SELECT DISTINCT k AS key FROM (SELECT unnest(json_keys(p)) AS k FROM {_OBJ}) WHERE k NOT IN ('_id','processing_timestamp','applicant_info','financials','decision','spending_behavior')",
    "private_ip": f"SELECT raw_applicant_ip_address AS address, {private_address('raw_applicant_ip_address')} AS is_private, count(*) AS n FROM {APPS} GROUP BY 1, 2",
    "age_bands": f"SELECT {band('clean_date_of_birth')} AS age_band, count(*) AS n FROM {APPS} GROUP BY 1",
    "report_extremes": 'SELECT stage, severity, count(*) AS n, count(DISTINCT load_id) AS loads, CAST(sum("count") AS BIGINT) AS issues FROM data_quality_report GROUP BY 1, 2',
}
