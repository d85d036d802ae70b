"""Schemas that drift between files (problem 7): a catalogue of column lifespans.

Each file gets a footer: its fields with types, counts and a content profile, aggregated while the
payloads are parsed, so that only counts are shuffled. Lag and islands over a producer's files
turn presence into lifespans; starts and endings in one file are paired into renames by content and
name. An alias table from the renames gives every field its consistent column and cast.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaryn.operators.nested import clean, layouts, objects, plain_values, record, text_of
from tessaryn.runtime import written

FEATURES = 512
#: A pair is one field renamed if its profiles overlap at least so much and content and name together reach the score.
MIN_OVERLAP, MIN_SCORE, NAME_WEIGHT = 0.35, 0.55, 0.35


def feature(v) -> int:
    """The kind of content that a value is, whatever its JSON type: magnitude, first word, or shape."""
    if isinstance(v, list):
        v = " ".join(text_of(x) for x in v if x is not None)
    if isinstance(v, bool):
        v = int(v)
    s = v.strip() if isinstance(v, str) else v
    if isinstance(s, str):
        try:
            s = float(s) if re.fullmatch(r"[+-]?\d+(\.\d+)?", s) and not re.match(r"[+-]?0\d", s) else s
        except ValueError:
            pass
    if isinstance(s, (int, float)):
        key = f"n{s:.0f}" if s in (0, 1) else f"m{math.copysign(1, s):.0f}{round(2 * math.log2(abs(s))) if s else 0}" if abs(s) < 1e300 else "big"
    elif not any(c.isdigit() for c in s):
        key = "w" + s.lower().split(" ", 1)[0]
    else:
        key = "s" + re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: str(len(m[0])), s))
    return zlib.crc32(key.encode("utf-8", "replace")) % FEATURES


_FOOTER = pa.schema([("feed_id", pa.string()), ("source_file", pa.string()), ("file_seq", pa.int64()), ("template", pa.string()), ("leaf", pa.string()), ("kind", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: Counter = Counter()
        for feed, file, seq, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            root = record(text)
            if root is None:
                counts[feed, file, seq, "", None, None, None] += 0
                continue
            for t, _, o in objects(root):
                counts[feed, file, seq, t, None, None, None] += 1
                for k, kind, v in plain_values(o):
                    counts[feed, file, seq, t, k, kind, feature(v)] += 1
        cols = list(zip(*((*k[:3], clean(k[3]), clean(k[4]) if k[4] is not None else None, *k[5:], n) for k, n in counts.items()), strict=True)) or [[] for _ in _FOOTER]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOOTER, strict=True)], schema=_FOOTER)


def footers(df: DataFrame) -> DataFrame:
    """``feed_id``, ``source_file``, ``file_seq``, ``path``, ``kind``, ``feature``, ``n`` over ``df``'s payloads.

    ``path`` is null in a row that only says that the file is there. Writes intermediate counts.
    """
    raw = df.select("feed_id", "source_file", F.col("file_seq").cast("bigint"), "payload").mapInArrow(_footers, "feed_id string, source_file string, file_seq bigint, template string, leaf string, kind string, feature int, n bigint")
    keys = ["feed_id", "source_file", "file_seq", "template", "leaf", "kind", "feature"]
    counts = written(raw.groupBy(*keys).agg(F.sum("n").alias("n")), "footers")
    known = layouts(counts).select("template", "generic")
    path = F.when(F.col("leaf").isNotNull(), F.when(F.coalesce("generic", F.lit("")) == "", F.col("leaf")).otherwise(F.concat_ws(".", "generic", "leaf")))
    rows = counts.join(known, "template", "left").select("feed_id", "source_file", "file_seq", path.alias("path"), "kind", "feature", "n")
    return rows.groupBy("feed_id", "source_file", "file_seq", "path", "kind", "feature").agg(F.sum("n").alias("n"))


def fields(foot: DataFrame) -> DataFrame:
    """One row per file and field: its position ``idx`` in the feed, its type and the last position of the feed."""
    order = W.partitionBy("feed_id").orderBy("file_seq", "source_file")
    files = foot.select("feed_id", "source_file", "file_seq").distinct().withColumn("idx", F.row_number().over(order))
    files = files.withColumn("last_idx", F.max("idx").over(W.partitionBy("feed_id"))).drop("file_seq")
    kinds = foot.where("path IS NOT NULL").groupBy("feed_id", "source_file", "path", "kind").agg(F.sum("n").alias("n"))
    top = kinds.groupBy("feed_id", "source_file", "path").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.sum("n").alias("n"))
    return top.join(files, ["feed_id", "source_file"])


def lifespans(found: DataFrame) -> DataFrame:
    """Islands of presence: ``feed_id``, ``path``, ``kind``, first and last position and file, the last position of the
    feed, one row per unbroken run of one type."""
    w = W.partitionBy("feed_id", "path").orderBy("idx")
    new = F.coalesce((F.col("idx") - F.lag("idx").over(w) > 1) | (F.col("kind") != F.lag("kind").over(w)), F.lit(True))
    runs = found.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    at = F.col("idx")
    return runs.groupBy("feed_id", "path", "kind", "_run").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min_by("source_file", at).alias("first_file"), F.max_by("source_file", at).alias("last_file"), F.max("last_idx").alias("feed_last_idx"), F.sum("n").alias("values")
    ).drop("_run")


def events(spans: DataFrame, foot: DataFrame) -> DataFrame:
    """The log of the catalogue: ``feed_id``, ``change_file``, ``event`` (``start``, ``end`` or ``retype``), ``path``, ``kind``, ``at_file``.

    A span that begins after the feed's first file starts its field, or retypes it if another span of the
    field ended just before; one that ends before the last file without another after it ends the
    field in the file that follows. ``at_file`` is the span's own file at that end.
    """
    order = W.partitionBy("feed_id").orderBy("file_seq", "source_file")
    files = foot.select("feed_id", "source_file", "file_seq").distinct().withColumn("idx", F.row_number().over(order)).select("feed_id", "idx", F.col("source_file").alias("change_file"))
    w = W.partitionBy("feed_id", "path").orderBy("first_idx")
    ends = spans.withColumns({"_next": F.lead("first_idx").over(w), "_before": F.lag("last_idx").over(w)})
    kind = F.when(F.col("_before") == F.col("first_idx") - 1, "retype").otherwise("start")
    began = ends.where("first_idx > 1").select("feed_id", F.col("first_file").alias("change_file"), kind.alias("event"), "path", "kind", F.col("first_file").alias("at_file"))
    gone = ends.where("last_idx < feed_last_idx AND (_next IS NULL OR _next > last_idx + 1)").select("feed_id", (F.col("last_idx") + 1).alias("idx"), F.lit("end").alias("event"), "path", "kind", F.col("last_file").alias("at_file"))
    return began.union(gone.join(files, ["feed_id", "idx"]).select(began.columns))


def _words(path: str) -> list[str]:
    leaf = path.split("[]")[-1].strip(".") or path
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", leaf).lower()) if w]


def name_likeness(a: str, b: str) -> float:
    """Shared words of the last parts of two paths, or one being the initials of the other; same repeated ancestor counts."""
    x, y = _words(a), _words(b)
    home = 0.1 if a.rpartition("[]")[0] == b.rpartition("[]")[0] else -0.4
    last_x, last_y = x[len(_words(a.rpartition(".")[0])) :] or x, y[len(_words(b.rpartition(".")[0])) :] or y
    if "".join(w[0] for w in last_x) == "".join(last_y) or "".join(w[0] for w in last_y) == "".join(last_x):
        return 0.9 + home
    return 0.9 * max(len({*p} & {*q}) / max(1, len({*p} | {*q})) for p, q in ((x, y), (last_x, last_y), (last_x, y), (x, last_y))) + home


def _pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best matching of one file's ended and started fields: highest score first, each field once."""
    rows = {side: {} for side in ("old", "new")}
    for (side, path, kind), g in pdf.groupby(["side", "path", "kind"], sort=True):
        v = np.zeros(FEATURES)
        np.add.at(v, g["feature"].to_numpy(), g["n"].to_numpy())
        rows[side][path] = (kind, np.sqrt(v / v.sum()), v.sum())
    scored = []
    for a, (_, p, n) in rows["old"].items():
        for b, (_, q, m) in rows["new"].items():
            overlap = float(p @ q) / (1 if min(n, m) >= 60 else 0.6 + 0.4 * min(n, m) / 60)
            score = (1 - NAME_WEIGHT) * min(1, overlap) + NAME_WEIGHT * name_likeness(a, b)
            if overlap >= MIN_OVERLAP and score >= MIN_SCORE:
                scored.append((-score, a, b))
    file, used, out = pdf["source_file"].iloc[0], set(), []
    for s, a, b in sorted(scored):
        if ("o", a) not in used and ("n", b) not in used:
            used |= {("o", a), ("n", b)}
            out.append((file, a, b, rows["old"][a][0], rows["new"][b][0], -s))
    return pd.DataFrame(out, columns=["source_file", "old_path", "new_path", "old_kind", "new_kind", "score"])


def renames(foot: DataFrame, log: DataFrame) -> DataFrame:
    """``source_file``, ``old_path``, ``new_path``, ``old_kind``, ``new_kind``, ``score`` of fields renamed from the previous file.

    Only the fields that end or start between two files are compared, one file at a time: as many
    profiles of at most 512 counts as a file has changed fields.
    """
    ends = log.where("event <> 'retype'").select("feed_id", "change_file", F.when(F.col("event") == "end", "old").otherwise("new").alias("side"), F.col("at_file").alias("source_file"), "path", "kind")
    profile = foot.where("path IS NOT NULL").groupBy("feed_id", "source_file", "path", "feature").agg(F.sum("n").alias("n"))
    both = ends.join(profile, ["feed_id", "source_file", "path"]).select("feed_id", F.col("change_file").alias("source_file"), "side", "path", "kind", "feature", "n")
    return both.groupBy("feed_id", "source_file").applyInPandas(_pairs, "source_file string, old_path string, new_path string, old_kind string, new_kind string, score double")


def catalogue(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields by file, log of events, renames) of ``df``'s payloads. Writes tables."""
    foot = written(footers(df), "footer_rows")
    found = written(fields(foot), "fields")
    log = written(events(lifespans(found), foot), "events")
    return found, log, written(renames(foot, log), "renames")


def changes(df: DataFrame) -> DataFrame:
    """``source_file``, ``change_kind``, ``old_path``, ``new_path``: each change against the feed's previous file.

    Read off the log of the lifespans. Kinds: added, removed, renamed, retyped. A feed's first file has
    none. Files whose payloads are all null or incomplete count as files without fields. Of types used
    equally often the last by name counts. Empty tables give no rows.
    """
    _, log, pairs = catalogue(df)
    row = lambda d, kind, old, new: d.select(F.col("change_file").alias("source_file"), F.lit(kind).alias("change_kind"), old.alias("old_path"), new.alias("new_path"))
    empty, path = F.lit(""), F.col("path")
    start = log.where("event = 'start'").join(pairs.select(F.col("source_file").alias("change_file"), F.col("new_path").alias("path")), ["change_file", "path"], "left_anti")
    end = log.where("event = 'end'").join(pairs.select(F.col("source_file").alias("change_file"), F.col("old_path").alias("path")), ["change_file", "path"], "left_anti")
    named = pairs.select("source_file", F.lit("renamed").alias("change_kind"), "old_path", "new_path")
    both = pairs.where("old_kind <> new_kind").select("source_file", F.lit("retyped").alias("change_kind"), "old_path", "new_path")
    return row(start, "added", empty, path).union(row(end, "removed", path, empty)).union(row(log.where("event = 'retype'"), "retyped", path, path)).union(named).union(both)


def _followed(links: DataFrame) -> DataFrame:
    """``feed_id``, ``column``, ``_to``: where the chain of links from each name ends. Each round doubles what has been
    followed, until nothing changes."""
    at = written(links.select("feed_id", F.col("old_path").alias("column"), F.col("new_path").alias("_to")), "followed")
    for _ in range(at.count().bit_length() + 1):  # more are only needed by a circle
        step = at.select("feed_id", F.col("column").alias("_to"), F.col("_to").alias("_next"))
        new = written(at.join(step, ["feed_id", "_to"], "left").select("feed_id", "column", F.coalesce("_next", "_to").alias("_to"), F.col("_next").isNotNull().alias("_moved")), "followed")
        at = new.select("feed_id", "column", "_to")
        if new.where("_moved").isEmpty():
            return at
    raise ValueError("renames form a circle")


def alias_table(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``feed_id``, ``path``, ``column``, ``cast``: the consistent column of each field and the type it is read as.

    Renames are followed to the latest name within a feed, however many links a chain has; a name that
    a later rename brings back has no link, so names that alternate end under the one used last. A column
    is read as number where each field under it is number or boolean in most files and as text otherwise.
    """
    feeds = found.select("feed_id", "source_file", "idx").distinct()
    named = pairs.join(feeds, "source_file").where("old_path <> new_path")
    links = named.groupBy("feed_id", "old_path").agg(F.max_by("new_path", F.col("idx")).alias("new_path"), F.max("idx").alias("_at"))
    back = named.groupBy("feed_id", F.col("new_path").alias("old_path")).agg(F.max("idx").alias("_back"))
    links = written(links.join(back, ["feed_id", "old_path"], "left").where("_back IS NULL OR _back < _at"), "links")
    out = found.select("feed_id", "path").distinct().withColumn("column", F.col("path"))
    out = out.join(_followed(links), ["feed_id", "column"], "left").select("feed_id", "path", F.coalesce("_to", "column").alias("column"))
    votes = found.groupBy("feed_id", "path").agg(F.avg(F.col("kind").isin("number", "boolean").cast("double")).alias("_share"))
    w = W.partitionBy("column")
    out = out.join(votes, ["feed_id", "path"]).withColumn("_least", F.min("_share").over(w))
    return out.select("feed_id", "path", "column", F.when(F.col("_least") > 0.5, "double").otherwise("string").alias("cast"))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every plain value that is not null with its template and ordinals."""
    schema = pa.schema([("feed_id", pa.string()), ("source_file", pa.string()), ("record_id", pa.int64()), ("template", pa.string()), ("ords", pa.list_(pa.int32())), ("leaf", pa.string()), ("value", pa.string())])
    for b in batches:
        rows: list[tuple] = []
        for feed, file, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            root = record(text)
            for t, ords, o in objects(root) if root is not None else ():
                rows += [(feed, file, i, clean(t), ords, clean(k), text_of(v)) for k, _, v in plain_values(o)]
        cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def consistent(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """``feed_id``, ``source_file``, ``record_id``, ``ords``, ``path``, ``column``, ``text``, ``number``: every plain value of all
    payloads under its consistent column.

    One table for all files: one row per value, because each object of an array has its own (``ords``
    has a position per step of ``path``). A column that is read as number has its values in ``number``
    (booleans 1 and 0), and ``text`` keeps what is none; other columns have them in ``text``.
    """
    raw = df.select("feed_id", "source_file", F.col("record_id").cast("bigint"), "payload")
    rows = written(raw.mapInArrow(_values, "feed_id string, source_file string, record_id bigint, template string, ords array<int>, leaf string, value string"), "plain_values")
    known = layouts(rows).select("template", "generic")
    generic = F.coalesce("generic", F.lit(""))
    rows = rows.join(known, "template", "left").withColumn("path", F.when(generic == "", F.col("leaf")).otherwise(F.concat_ws(".", "generic", "leaf")))
    rows = rows.join(aliases, (rows["feed_id"].eqNullSafe(aliases["feed_id"])) & (rows["path"] == aliases["path"]), "left").drop(aliases["feed_id"]).drop(aliases["path"])
    low = F.lower(F.trim("value"))
    as_number = F.when(low == "true", 1.0).when(low == "false", 0.0).when(low.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), low.try_cast("double"))
    number = F.when(F.col("cast") == "double", as_number)
    return rows.select("feed_id", "source_file", "record_id", "ords", "path", F.coalesce("column", "path").alias("column"), F.when(number.isNull(), F.col("value")).alias("text"), number.alias("number"))
