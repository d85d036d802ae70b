"""Files in and out: JSON arrays and lines, typed CSV, text, path resolution (IO1 to IO11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaryn.functions.text import number, truth

ANALYSIS_NUMBERS = ["clean_annual_income", "clean_credit_history_months", "clean_debt_to_income", "clean_savings_balance", "clean_interest_rate", "clean_approved_amount"]


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """``record_id`` (0-based place), ``payload`` of a file that is one JSON array; any other shape raises when read.

    One file is one task; ``read_json_lines`` is the way for large data.
    """
    v = F.try_parse_json(F.col("value"))
    whole = spark.read.text(path, wholetext=True).select(v.alias("_v"))
    items = F.try_variant_get("_v", "$", "array<variant>")
    checked = whole.select(F.when(F.schema_of_variant("_v").startswith("ARRAY"), items).otherwise(F.raise_error(F.lit("the file is not a JSON array"))).alias("_a"))
    return checked.select(F.posexplode("_a").alias("record_id", "_r")).select(F.col("record_id").cast("bigint"), F.to_json("_r").alias("payload"))


def read_json_lines(spark: SparkSession, path: str, id_path: str = "$.record_id") -> DataFrame:
    """``record_id`` (taken from ``id_path``), ``payload`` of JSON lines; splittable."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.try_variant_get(F.try_parse_json("value"), id_path, "bigint").alias("record_id"), F.col("value").alias("payload"))


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One value per line (IO10)."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet below ``folder``; other folders there are left alone (IO11)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def load_analysis(spark: SparkSession, path: str, null_outcome: str = "reject") -> DataFrame:
    """The analysis table from CSV: zip and pseudonym as text, numbers coerced, ``approved`` derived, ``age_band_rank`` the
    place of the band in age order (IO4)."""
    from tessaryn.functions.fields import band_rank
    from tessaryn.operators.fairness import with_outcome

    df = _csv(spark, path)
    df = df.withColumns({c: number(F.col(c)) for c in ANALYSIS_NUMBERS if c in df.columns})
    if "age_band" in df.columns:
        df = df.withColumn("age_band_rank", band_rank(F.col("age_band")))
    return with_outcome(df.withColumn("clean_loan_approved", truth(F.col("clean_loan_approved"))), null_outcome)


def load_spending(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path).withColumn("amount_clean", number(F.col("amount_clean")))


def first_readable(spark: SparkSession, paths: list[str]) -> str:
    """The first path (or glob) at which something lies, tried in order; raises if there is none (IO7, IO8)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).globStatus(at):
            return p
    raise FileNotFoundError(f"none of {paths}")


def harmonised(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Headers stripped, then renamed where the new name is not there yet."""
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and b not in df.columns})


def pick_column(df: DataFrame, exact: list[str], contains: list[str]) -> str | None:
    """The first column equal to one of ``exact``, else containing one of ``contains``, whatever the case."""
    by = {c.lower(): c for c in df.columns}
    for e in exact:
        if e.lower() in by:
            return by[e.lower()]
    return next((c for part in contains for c in df.columns if part.lower() in c.lower()), None)


def require_columns(df: DataFrame, columns: set[str]) -> DataFrame:
    """``df``, or an error naming what it lacks."""
    lacking = sorted(columns - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df
