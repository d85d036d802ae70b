"""Duplicates hidden by formatting (problem 5): an incremental ledger of canonical keys.

A record's canonical key is a 128-bit hash of its fields in bare form (lower case, no white space,
no punctuation; the entries of list fields sorted). The ledger holds, in buckets of the key, how
many rows had each key and the earliest of them. A new batch is aggregated first, so a hot key is
one row per task; it is full-outer-joined with just the buckets that it touches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaryn.functions.text import bare
from tessaryn.runtime import drop_path, names_in, read_text, scratch_path, write_text, written

#: Keys that a bucket holds about; there are as many buckets as the ledger needs.
BUCKET_ROWS = 500_000


def canonical_key(fields: list[str], entries: dict[str, str]) -> Column:
    """Hash of the bare fields. ``entries`` gives the separator of list fields, whose entry order is ignored.

    Null equals only null: it differs from empty texts, which equal texts of punctuation alone.
    """

    def one(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        if c in entries:
            parts = F.filter(F.transform(F.split(v, entries[c]), bare), lambda x: x != "")
            return F.array_join(F.array_sort(parts), "\x02")
        return bare(v)

    return F.unhex(F.md5(F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), one(c)), F.lit("0")) for c in fields])))


class CopyLedger:
    """Counts and earliest row of each canonical key, one Parquet folder per bucket, listed in a manifest.

    A ledger is opened again by its ``path``, in this session or a later one. Each batch writes the
    buckets that it touches to a new folder and then a manifest that names the current folders;
    whoever reads sees one manifest, and a batch that fails leaves the last one as it was. There are
    as many buckets as keep about ``bucket_rows`` keys in each: their number doubles as the ledger
    grows, so a small batch touches a small part of a large ledger. One writer at a time: the second
    of two that add at once finds its manifest there and fails.
    """

    SCHEMA = "key binary, n bigint, first_id bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path or scratch_path(spark, "ledger"), bucket_rows
        known = [x for x in names_in(spark, f"{self.path}/manifests") if x.endswith(".json")] if path else []
        state = json.loads(read_text(spark, f"{self.path}/manifests/{known[-1]}")) if known else {"version": 0, "buckets": 1, "rows": {}, "files": {}}
        self.version, self.buckets = state["version"], state["buckets"]
        self.rows, self.files = ({int(b): x for b, x in state[k].items()} for k in ("rows", "files"))

    def _placed(self, df: DataFrame, buckets: int) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))

    def add(self, batch: DataFrame) -> CopyLedger:
        """Count a batch (``key``, ``row_id``) in. Writes the touched buckets anew; the rest stay as they are."""
        fresh = written(batch.groupBy("key").agg(F.count("*").alias("n"), F.min("row_id").alias("first_id")), "batch_keys")
        buckets = self.buckets
        while (fresh.count() + sum(self.rows.values())) > buckets * self.bucket_rows:
            buckets *= 2
        touched = self.files  # all of them if their number changes
        if buckets == self.buckets and self.files:
            at = {r[0] for r in self._placed(fresh, buckets).select("bucket").distinct().collect()}  # at most one number per bucket
            touched = {b: f for b, f in self.files.items() if b in at}
        new = fresh
        if touched:
            before = self.spark.read.schema(self.SCHEMA).parquet(*touched.values()).select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("first_id").alias("_first"))
            new = fresh.join(before, F.col("key") == F.col("_key"), "full_outer").select(
                F.coalesce("key", "_key").alias("key"),
                (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"),
                F.least("first_id", "_first").alias("first_id"),
            )
        to = f"{self.path}/data/{uuid.uuid4().hex}"
        self._placed(new, buckets).repartition("bucket", F.pmod(F.hash("key"), F.lit(4))).write.partitionBy("bucket").parquet(to)
        sizes = {r[0]: r[1] for r in self.spark.read.parquet(to).groupBy("bucket").count().collect()} if new.head(1) else {}  # one row per bucket
        files = {b: f for b, f in self.files.items() if b not in touched} | {b: f"{to}/bucket={b}" for b in sizes}
        rows = {b: n for b, n in self.rows.items() if b in files} | sizes
        write_text(self.spark, f"{self.path}/manifests/{self.version + 1:09d}.json", json.dumps({"version": self.version + 1, "buckets": buckets, "rows": rows, "files": files}))
        self.version, self.buckets, self.rows, self.files = self.version + 1, buckets, rows, files
        for f in touched.values():
            drop_path(self.spark, f)
        return self

    def read(self) -> DataFrame:
        if not self.files:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*self.files.values())


def ledger_of(keys: DataFrame, batches: int = 3) -> CopyLedger:
    """The ledger of ``key``, ``row_id`` rows taken in as ``batches`` consecutive ranges of ``row_id``."""
    ledger = CopyLedger(keys.sparkSession)
    low, high = keys.agg(F.min("row_id"), F.max("row_id")).first()
    if low is None:
        return ledger
    width = (high - low) // batches + 1
    for b in range(batches):
        part = keys.where(F.col("row_id").between(low + b * width, low + (b + 1) * width - 1))
        ledger.add(part)
    return ledger


def keyed(df: DataFrame, id_col: str, fields: list[str], entries: dict[str, str]) -> DataFrame:
    """``row_id`` and canonical ``key`` of each row, written to the shared folder."""
    return written(df.select(F.col(id_col).cast("bigint").alias("row_id"), canonical_key(fields, entries).alias("key")), "copy_keys")


def surplus_copies(df: DataFrame, id_col: str, fields: list[str], entries: dict[str, str]) -> DataFrame:
    """``row_id_a`` (earliest of the group), ``row_id_b`` (the copy), one row per surplus copy.

    Empty tables give no rows; identical rows are copies; columns outside ``fields`` are ignored.
    Texts are compared whole. Rows sharing one id are one row.
    """
    keys = keyed(df, id_col, fields, entries)
    many = ledger_of(keys).read().where("n > 1").select(F.col("key").alias("_key"), "first_id")
    return keys.join(many, F.col("key") == F.col("_key")).where("row_id <> first_id").select(F.col("first_id").alias("row_id_a"), F.col("row_id").alias("row_id_b"))


def collapsed(df: DataFrame, id_col: str, fields: list[str], entries: dict[str, str]) -> DataFrame:
    """The earliest row of each group of copies and how many rows it stands for: ``row_id``, ``copies``."""
    return ledger_of(keyed(df, id_col, fields, entries)).read().select(F.col("first_id").alias("row_id"), F.col("n").alias("copies"))
