"""Privacy: pseudonyms, minimised analysis table, redaction, inventory, leak scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaryn.functions import fields as X
from tessaryn.functions.text import blank, strip
from tessaryn.operators.report import percent_of

DIRECT_PII = ["raw_applicant_full_name", "raw_applicant_email", "clean_email", "raw_applicant_ssn", "raw_applicant_ip_address", "raw_applicant_date_of_birth", "clean_date_of_birth"]
ANALYSIS_COLUMNS = ["application_id", "applicant_pseudo_id", "pseudo_id_source", "pseudo_id_fallback_used_flag", "age_band", "age_band_missing_flag", "clean_gender", "clean_zip_code", "clean_annual_income", "clean_credit_history_months", "clean_debt_to_income", "clean_savings_balance", "clean_loan_approved", "clean_interest_rate", "clean_approved_amount", "clean_rejection_reason"]
LEAKS = {"email_like": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "ip_like": r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "ssn_like": r"\b\d{3}-\d{2}-\d{4}\b"}
# Field, class, its curated and its analysis column.
INVENTORY = [
    ("age_band", "Non-PII", False, None, "age_band"), ("applicant_info.date_of_birth", "PII", True, "raw_applicant_date_of_birth", None), ("applicant_info.email", "PII", True, "raw_applicant_email", None), ("applicant_info.full_name", "PII", True, "raw_applicant_full_name", None),
    ("applicant_info.gender", "Quasi-PII", True, "clean_gender", "clean_gender"), ("applicant_info.ip_address", "PII", True, "raw_applicant_ip_address", None), ("applicant_info.ssn", "PII", True, "raw_applicant_ssn", None), ("applicant_info.zip_code", "Quasi-PII", True, "clean_zip_code", "clean_zip_code"),
    ("applicant_pseudo_id", "Quasi-PII", False, None, "applicant_pseudo_id"), ("application_id", "Quasi-PII", True, "application_id", "application_id"),
]


def pseudonym(salt: str) -> tuple[Column, Column]:
    """(id, source): a salted hash of the number, else the e-mail, else name, birth date and zip, else application and row id."""
    c = lambda x: F.col(f"raw_applicant_{x}")
    ssn, email, name, born, zip_code = c("ssn"), c("email"), c("full_name"), c("date_of_birth"), c("zip_code")
    steps = [
        (~blank(ssn), F.concat(F.lit("ssn:"), strip(ssn)), "ssn"),
        (~blank(email), F.concat(F.lit("email:"), F.lower(strip(email))), "email_fallback"),
        (~(blank(name) & blank(born) & blank(zip_code)), F.concat(F.lit("name_dob_zip:"), F.coalesce(F.lower(strip(name)), F.lit("none")), F.lit("|"), F.coalesce(strip(born), F.lit("None")), F.lit("|"), F.coalesce(strip(zip_code), F.lit("None"))), "name_dob_zip_fallback"),
    ]
    seed = F.concat(F.lit("application:"), F.coalesce("application_id", F.lit("None")), F.lit("|row:"), F.col("application_row_id").cast("string"))
    source = F.lit("application_id_fallback")
    for when, text, label in reversed(steps):
        seed, source = F.when(when, text).otherwise(seed), F.when(when, label).otherwise(source)
    return X.stable_hash(seed, salt), source


def analysis_table(curated: DataFrame, salt: str, reference: str = "2026-01-01") -> DataFrame:
    """Canonical rows without direct identifiers, one per application id (the smallest row id of those kept)."""
    pid, source = pseudonym(salt)
    first = W.partitionBy("application_id").orderBy("application_row_id")
    rows = curated.where("is_canonical_for_analysis").withColumns({"applicant_pseudo_id": pid, "pseudo_id_source": source, "age_band": X.age_band(F.col("clean_date_of_birth").cast("date"), reference)})
    rows = rows.withColumns({"pseudo_id_fallback_used_flag": F.col("pseudo_id_source") != "ssn", "age_band_missing_flag": F.col("age_band").isNull(), "_r": F.row_number().over(first)})
    return rows.where("_r = 1").select(*[c for c in ANALYSIS_COLUMNS if c in rows.columns])


def pseudonym_metrics(analysis: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """One row on the pseudonyms; with ``curated`` also the percentage of its rows that are canonical, nulls left out."""
    out = analysis.agg(
        F.count("*").alias("n_rows"), F.lit(len(analysis.columns)).cast("bigint").alias("n_columns"), F.count_if(F.col("applicant_pseudo_id").isNull()).alias("missing"), F.count_distinct("applicant_pseudo_id").alias("n_distinct"),
        (F.count("*") - F.count_distinct("applicant_pseudo_id")).alias("repeated"), F.count_if("pseudo_id_fallback_used_flag").alias("fallback_count"), F.avg(F.col("pseudo_id_fallback_used_flag").cast("double")).alias("fallback_rate"),
    )
    if curated is None:
        return out
    return out.join(F.broadcast(curated.agg(F.round(100 * F.avg(F.col("is_canonical_for_analysis").cast("double")), 2).alias("canonical_rate_pct"))))  # one row each


def non_null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``non_null`` of the columns that are there: one pass."""
    here = [c for c in columns if c in df.columns]
    one = df.agg(*[F.count(c).alias(c) for c in here])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in here])).alias("x")).select("x.*")


def direct_columns(columns: list[str], direct: list[str]) -> tuple[list[str], list[str]]:
    """Columns named like a direct identifier: those equal to its path, and those equal to its last part whatever the case."""
    leaves = {f.split(".")[-1].lower() for f in direct}
    return [c for c in columns if c in set(direct)], [c for c in columns if c.lower() in leaves]


def source_distribution(df: DataFrame, col: str, null_name: str = "MISSING") -> DataFrame:
    """Counts and shares of a column's values, nulls under a name."""
    g = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(null_name)).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_total"))
    return g.join(F.broadcast(total)).select("value", "n", percent_of(F.col("n"), F.col("_total")).alias("percent"))  # one row


def pii_inventory(spark: SparkSession, curated_columns: list[str], analysis_columns: list[str]) -> DataFrame:
    rows = [(p, k, raw, c in curated_columns if c else False, a in analysis_columns if a else False) for p, k, raw, c, a in INVENTORY]
    return spark.createDataFrame(rows, "field_path string, classification string, present_in_raw boolean, present_in_curated boolean, present_in_analysis boolean")


def class_name(c: Column) -> Column:
    """PII, Quasi-PII or Non-PII in whatever spelling; Unknown for null; others as they are."""
    s = F.lower(strip(c))
    return F.when(c.isNull(), "Unknown").when(s == "pii", "PII").when(s.contains("quasi"), "Quasi-PII").when(s.contains("non"), "Non-PII").otherwise(strip(c))


def presence(c: Column, where: str) -> Column:
    """Whether a list separated by pipes, commas, semicolons or blanks names ``where``."""
    return F.coalesce(F.array_contains(F.split(F.lower(c), r"[|,; ]+"), where), F.lit(False))


def presence_matrix(inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matrix by class and path, and the sorted list of direct identifiers."""
    m = inventory.select("field_path", class_name(F.col("classification")).alias("pii_class"), "present_in_raw", "present_in_curated", "present_in_analysis")
    return m.orderBy("pii_class", "field_path"), m.where("pii_class = 'PII'").select("field_path").distinct().orderBy("field_path")


def best_inventory(frames: list[DataFrame]) -> DataFrame:
    """The most usable of several inventories by its columns: canonical ones 3, notes 1, processed ones 2; ties to the narrower (IO9)."""

    def score(df: DataFrame) -> int:
        cols = {c.strip() for c in df.columns}
        return 3 * ({"field_path", "classification", "present_in"} <= cols) + ("notes/purpose" in cols) + 2 * ({"present_in_raw", "present_in_curated", "present_in_analysis"} <= cols)

    best = max(frames, key=lambda f: (score(f), -len(f.columns)), default=None)
    if best is None or score(best) == 0:
        raise ValueError("no inventory has the needed columns")
    return best


def mask_for(name: str) -> Callable[[Column], Column] | None:
    """The mask for a field name: the first of ssn, email, ip (also in zip and description), name, date of birth."""
    k = name.lower()
    if "ssn" in k:
        return X.mask_ssn
    if "email" in k:
        return X.mask_email
    if "ip" in k:
        return X.mask_ip
    if "full_name" in k or k.endswith("name"):
        return lambda c: X.mask_text(c, "[REDACTED_NAME]")
    if "date_of_birth" in k:
        return X.mask_dob
    return None


def preview_mask_for(name: str) -> Callable[[Column], Column] | None:
    """The second policy: whole ``ip_address`` and ``zip_code``, dates by their year."""
    k = name.lower()
    if "ssn" in k or "email" in k:
        return mask_for(name)
    if "ip_address" in k:
        return X.mask_ip
    if "date_of_birth" in k:
        return X.mask_dob_year
    if "zip_code" in k:
        return X.mask_zip
    return (lambda c: X.mask_text(c, "[REDACTED_NAME]")) if k.endswith("name") else None


def redacted(df: DataFrame) -> DataFrame:
    """Every text leaf of a nested schema masked by its name; scalars inside arrays untouched."""

    def walk(c: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: walk(x, kind.elementType, ""))
        mask = mask_for(name) if isinstance(kind, (T.StringType, T.NumericType)) else None
        return mask(c.cast("string")) if mask else c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def masked_columns(df: DataFrame, columns: list[str], policy: Callable = mask_for) -> DataFrame:
    """The named columns masked; columns that are not there are passed over."""
    found = {c: policy(c)(F.col(c).cast("string")) for c in columns if c in df.columns and policy(c)}
    return df.withColumns(found) if found else df


def safe_preview(df: DataFrame, columns: list[str], order: str, n: int = 5, policy: Callable = mask_for) -> DataFrame:
    """The first ``n`` rows by ``order`` with the named columns masked (N3; N4 takes ten rows and the second policy)."""
    return masked_columns(df.orderBy(order).limit(n), columns, policy)


def leak_scan(df: DataFrame, columns: list[str], patterns: dict[str, str] = LEAKS) -> DataFrame:
    """``pattern``, ``column``, ``hits``, ``rows`` over all rows: one pass for all patterns and columns."""
    cells = [(p, c) for p in patterns for c in columns]
    one = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).cast("string").rlike(patterns[p])).alias(f"_{i}") for i, (p, c) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("column"), F.col(f"_{i}").alias("hits")) for i, (p, c) in enumerate(cells)])
    return one.select(F.explode(rows).alias("x"), "_rows").select("x.*", F.col("_rows").alias("n_rows"))


def leak_summary(scan: DataFrame) -> DataFrame:
    return scan.groupBy("pattern").agg(F.max("n_rows").alias("n_rows"), F.count("*").alias("columns_scanned"), F.sum("hits").alias("cell_hits"), F.count_if(F.col("hits") > 0).alias("columns_with_hits"))


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """A repeatable sample of ``n`` rows in the order of a hash of their keys."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)
