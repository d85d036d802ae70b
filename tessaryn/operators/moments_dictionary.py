"""Mixed timestamp formats and zones (problem 3): a dictionary of distinct raw values.

Raw strings are deduplicated with their field and source, parsed exhaustively once, kept in a table
in the shared folder that later loads only add to, and joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaryn.functions.moments import CANONICAL, with_date, with_instant
from tessaryn.functions.text import blank, strip
from tessaryn.runtime import scratch_path

KEYS = ["field_name", "raw_value", "source_name"]


class MomentDictionary:
    """Distinct (field, raw value, source) and the text of the moment that each names.

    ``path`` is a Parquet folder; ``update`` adds what is not in it yet, so a value is parsed once over
    all loads. ``kinds`` gives ``instant`` or ``date`` for each field. ``sources`` has ``source_system``,
    ``default_zone`` and ``day_order``; a source that it lacks counts as none.
    """

    def __init__(self, spark, sources: DataFrame, kinds: dict[str, str], path: str | None = None):
        self.spark, self.kinds = spark, kinds
        self.path = path or scratch_path(spark, "moments")
        self.sources = sources.select(F.col("source_system").alias("source_name"), "default_zone", "day_order").where("source_system IS NOT NULL").dropDuplicates(["source_name"])
        self._begun = path is not None and self._there()

    def _there(self) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.schema("field_name string, raw_value string, source_name string, normal_text string").parquet(self.path)

    def update(self, values: DataFrame) -> MomentDictionary:
        """Parse the distinct values that are new and append them. Writes a table."""
        new = values.select(*KEYS).where(F.col("raw_value").isNotNull()).distinct()
        if self._begun:
            seen = self.read().select(*[F.col(k).alias("_" + k) for k in KEYS])
            new = new.join(seen, [F.col(k).eqNullSafe(F.col("_" + k)) for k in KEYS], "left_anti")
        parsed = new.join(self.sources, "source_name", "left")
        instants = [k for k, v in self.kinds.items() if v == "instant"]
        raw = F.col("raw_value")
        is_instant = F.col("field_name").isin(instants)
        parsed = with_instant(parsed, "_instant", F.when(is_instant, raw), F.col("default_zone"), F.col("day_order"))
        parsed = with_date(parsed, "_day", F.when(~is_instant, raw), F.col("day_order"))
        text = F.coalesce(F.date_format("_instant", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.col("_day").cast("string"))
        parsed.select(*KEYS, text.alias("normal_text")).write.mode("append").parquet(self.path)
        self._begun = True
        return self


def field_values(df: DataFrame, id_col: str, fields: list[str], source_col: str) -> DataFrame:
    """One row per row of ``df`` and field: id, ``field_name``, ``raw_value``, ``source_name``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("raw_value")) for f in fields])
    return df.select(F.col(id_col), F.explode(pairs).alias("_v"), F.col(source_col).alias("source_name")).select(id_col, "_v.*", "source_name")


def normalised_moments(df: DataFrame, sources: DataFrame, kinds: dict[str, str], id_col: str, source_col: str, path: str | None = None) -> DataFrame:
    """``id_col``, ``field_name``, ``raw_value``, ``normal_text`` of each value that names exactly one moment and is not canonical yet.

    Null and blank values, values in the canonical form and values that name none or several moments
    have no row; repeated rows each have theirs; other columns of ``df`` are ignored. Dates are exact
    strings of any length. Hot values cost one dictionary row and are joined by the skew join of AQE.
    """
    values = field_values(df, id_col, list(kinds), source_col)
    values = values.where(~blank(F.col("raw_value")) & ~F.coalesce(strip(F.col("raw_value")).rlike(CANONICAL), F.lit(False)))
    d = MomentDictionary(df.sparkSession, sources, kinds, path).update(values).read().where("normal_text IS NOT NULL")
    d = d.select(*[F.col(k).alias("_" + k) for k in KEYS], "normal_text")
    same = [F.col("field_name") == F.col("_field_name"), F.col("raw_value") == F.col("_raw_value"), F.col("source_name").eqNullSafe(F.col("_source_name"))]
    return values.join(d, same).select(id_col, "field_name", "raw_value", "normal_text")
