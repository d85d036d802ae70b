"""Deeply nested records (problem 2): objects and values of JSON payloads as flat tables.

Each payload is parsed once into path, value and ordinal triples, those of one object in one row: its
template (the named steps to it), ordinals (one per step) and plain values by name. Templates are
few, so everything that depends on paths alone (which steps repeat, how a path is written, which
ancestor is the parent) is worked out on the distinct templates and joined back. Where some record
has an array of objects, a lone object at the same path counts as an array of one; JSON text counts
as the part that it holds. Objects are grouped by their innermost repeated ancestor into one table each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaryn.runtime import written

#: Marks in templates: between steps, after a plain object, after an array element; and before a mark that is part of a name.
STEP, PLAIN, ELEMENT, ESCAPE = "\x1f", "\x01", "\x02", "\x10"
_MARKS = {ESCAPE: ESCAPE + "0", STEP: ESCAPE + "1", PLAIN: ESCAPE + "2", ELEMENT: ESCAPE + "3"}
_ESCAPES = str.maketrans(_MARKS)
#: Names that a table has as columns at most; a table with more (names that are data) keeps them as one map.
MAX_COLUMNS = 2000

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _no_constant(_: str):
    raise ValueError("not JSON")


def _deep(s: str):
    """The JSON value of a text nested too deep for the recursive parser, by a stack."""
    stack: list = []
    keys: list[str] = []
    skip = lambda i: _SPACE.match(s, i).end()

    def key_at(i: int) -> int:
        if s[i : i + 1] != '"':
            raise ValueError(i)
        k, i = scanstring(s, i + 1, True)
        keys.append(k)
        i = skip(i)
        if s[i : i + 1] != ":":
            raise ValueError(i)
        return skip(i + 1)

    i = skip(0)
    while True:
        c = s[i : i + 1]
        if c in ("{", "["):
            v, i = {} if c == "{" else [], skip(i + 1)
            if s[i : i + 1] != ("}" if c == "{" else "]"):
                stack.append(v)
                i = key_at(i) if c == "{" else i
                continue
            i += 1
        elif c == '"':
            v, i = scanstring(s, i + 1, True)
        elif c in _WORDS and s.startswith(_WORDS[c][0], i):
            v, i = _WORDS[c][1], i + len(_WORDS[c][0])
        elif m := _NUMBER.match(s, i):
            v, i = json.loads(m[0]), m.end()
        else:
            raise ValueError(i)
        while True:
            i = skip(i)
            if not stack:
                if i < len(s):
                    raise ValueError(i)
                return v
            box, c = stack[-1], s[i : i + 1]
            if isinstance(box, dict):
                box[keys.pop()] = v
            else:
                box.append(v)
            if c == ",":
                i = key_at(skip(i + 1)) if isinstance(box, dict) else skip(i + 1)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(i)
            v, i = stack.pop(), i + 1


def parse(text: str | None):
    """The JSON value of a complete text of any depth, else None. NaN and infinities are not JSON."""
    if text is None:
        return None
    try:
        try:
            return json.loads(text, parse_constant=_no_constant)
        except RecursionError:
            return _deep(text)
    except ValueError:
        return None


def opened(v):
    """``v``, or the object or array that it holds as JSON text."""
    while isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
        inner = parse(v)
        if not isinstance(inner, (dict, list)):
            return v
        v = inner
    return v


def record(text: str | None) -> dict | None:
    """The record of a payload, or None if it is null, incomplete or no object."""
    v = parse(text)
    v = opened(v) if isinstance(v, str) else v
    return v if isinstance(v, dict) else None


def clean(s: str) -> str:
    """Without lone surrogates, which no column can hold."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def named(k: str) -> str:
    """A name as it stands in a template."""
    return k if k.isascii() and k.isprintable() else clean(k).translate(_ESCAPES)


def text_of(v) -> str:
    return clean(v) if isinstance(v, str) else json.dumps(v)


def objects(root: dict) -> Iterator[tuple[str, list[int], dict]]:
    """Each object of a record with its template and ordinals, the root first (template '')."""
    todo = [("", [], root)]
    while todo:
        tmpl, ords, o = todo.pop()
        yield tmpl, ords, o
        base = tmpl + STEP if tmpl else ""
        for k, v in o.items():
            v = opened(v)
            if isinstance(v, dict):
                todo.append((base + named(k) + PLAIN, [*ords, 0], v))
            elif isinstance(v, list):
                lists = [(base + named(k) + ELEMENT, ords, v)]
                while lists:
                    t, at, items = lists.pop()
                    for i, x in enumerate(items):
                        x = opened(x)
                        if isinstance(x, dict):
                            todo.append((t, [*at, i], x))
                        elif isinstance(x, list):
                            lists.append((t + STEP + ELEMENT, [*at, i], x))


def plain_values(o: dict) -> Iterator[tuple[str, str, object]]:
    """Name, type and value of an object's plain values and non-empty arrays of plain values."""
    for k, v in o.items():
        v = opened(v)
        if isinstance(v, bool):
            yield k, "boolean", v
        elif isinstance(v, (int, float)):
            yield k, "number", v
        elif isinstance(v, str):
            yield k, "string", v
        elif isinstance(v, list) and any(x is not None for x in v) and not any(isinstance(opened(x), (dict, list)) for x in v):
            yield k, "array", v


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.map_(pa.string(), pa.string())
    schema = pa.schema([("record_id", pa.int64()), ("template", pa.string()), ("ords", pa.list_(pa.int32())), ("values", kinds)])
    for b in batches:
        rows: list[list] = [[], [], [], []]
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            root = record(text)
            if root is None:
                continue
            for t, o, obj in objects(root):
                for column, x in zip(rows, (i, t, o, [(clean(k), text_of(v)) for k, _, v in plain_values(obj)]), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)


def triples(df: DataFrame, id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """``record_id``, ``template``, ``ords``, ``values`` (plain values by name) of each object in a payload, the record itself included."""
    return df.select(F.col(id_col).cast("bigint"), F.col(payload).cast("string")).mapInArrow(_triples, "record_id bigint, template string, ords array<int>, values map<string,string>")


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every step of a template with a hash of the names up to it, each worked out from the one before."""
    for pdf in batches:
        for t in pdf["template"]:
            own, at, rows = hashlib.md5(t.encode()).digest(), b"", []
            for i, step in enumerate(t.split(STEP) if t else ()):
                at = hashlib.md5(at + step[:-1].encode()).digest()
                rows.append((own, i, at, step[-1] == ELEMENT))
            yield pd.DataFrame(rows, columns=["id", "i", "path", "repeats"])


def layouts(templates: DataFrame) -> DataFrame:
    """How each distinct template is written. Writes the distinct templates.

    ``template``, ``pieces`` (name of each step with its dot), ``flags`` (whether the step has a
    position), ``steps`` (their number), ``parent_steps`` (up to the innermost repeated step before
    the last, 0 if none), ``generic`` (the dotted path with ``[]``), ``is_element``.
    """
    t = written(templates.select("template").distinct(), "templates")
    one = t.mapInPandas(_steps, "id binary, i int, path binary, repeats boolean")
    arrays = one.where("repeats").select("path").distinct()
    lone = one.where("NOT repeats").join(arrays, "path", "left_semi").groupBy("id").agg(F.collect_set("i").alias("_lone"))
    s = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split("template", STEP))
    g = t.select("template", F.unhex(F.md5("template")).alias("id"), s.alias("_s")).join(lone, "id", "left")

    def piece(step, i):
        name = F.substring(step, F.lit(1), F.length(step) - 1)
        for mark, escaped in reversed(_MARKS.items()):
            name = F.replace(name, F.lit(escaped), F.lit(mark))
        return F.when((i > 0) & (F.length(step) > 1), F.concat(F.lit("."), name)).otherwise(name)

    flag = lambda step, i: step.endswith(ELEMENT) | F.coalesce(F.array_contains("_lone", i), F.lit(False))
    g = g.select("template", F.transform("_s", piece).alias("pieces"), F.transform("_s", flag).alias("flags"), F.size("_s").alias("steps"))
    before = F.filter(F.transform("flags", lambda f, i: F.when(f & (i < F.col("steps") - 1), i + 1).otherwise(0)), lambda x: x > 0)
    return g.select(
        "*",
        F.coalesce(F.array_max(before), F.lit(0)).alias("parent_steps"),
        F.array_join(F.zip_with("pieces", "flags", lambda p, f: F.concat(p, F.when(f, "[]").otherwise(""))), "").alias("generic"),
        F.coalesce(F.try_element_at("flags", F.lit(-1)), F.lit(False)).alias("is_element"),
    )


def _path(steps: str) -> F.Column:
    at = F.sequence(F.lit(0), F.col(steps) - 1)
    one = F.transform(at, lambda i: F.concat(F.get(F.col("pieces"), i), F.when(F.get(F.col("flags"), i), F.concat(F.lit("["), F.get(F.col("ords"), i), F.lit("]"))).otherwise("")))
    return F.when(F.col(steps) > 0, F.array_join(one, "")).otherwise("")


def element_rows(df: DataFrame, id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """``record_id``, ``parent_path``, ``element_path``: one row per object that is an array element.

    Null, incomplete and non-object payloads have no rows; of equal keys in an object the last counts;
    records sharing an id keep their rows side by side; an empty table gives no rows; records may be
    nested to any depth. Parsed once: the triples are written to the shared folder.
    """
    found = written(triples(df, id_col, payload), "triples")
    known = layouts(found).where("is_element")
    return found.join(known, "template").select("record_id", _path("parent_steps").alias("parent_path"), _path("steps").alias("element_path"))


def table_rows(df: DataFrame, id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """All flat tables in one: ``table_path`` (the repeated ancestor, such as ``a.b[].c[]``, '' for records), ``record_id``,
    ``parent_path``, ``element_path``, ``values`` (by name) of each of their rows.

    Plain objects belong to the row that they lie in, their names dotted; a dot inside a name is written ``\\.``.
    """
    found = written(triples(df, id_col, payload), "triples")
    flags, own, n = F.col("flags"), F.col("own_steps"), F.size("flags")
    last = lambda test: F.coalesce(F.array_max(F.transform(flags, lambda f, i: F.when(f & test(i), i + 1).otherwise(0))), F.lit(0))
    known = layouts(found).withColumn("own_steps", last(lambda i: i >= 0)).withColumn("parent_steps", last(lambda i: i < own - 1))
    ancestor = F.array_join(F.zip_with(F.slice("pieces", F.lit(1), own), F.slice(flags, F.lit(1), own), lambda p, f: F.concat(p, F.when(f, "[]").otherwise(""))), "")
    names = F.transform(F.slice("pieces", own + 1, n - own), lambda p: F.replace(F.when(p.startswith("."), p.substr(F.lit(2), F.length(p))).otherwise(p), F.lit("."), F.lit("\\.")))
    known = known.select("template", "pieces", "flags", "own_steps", "parent_steps", ancestor.alias("table_path"), F.array_join(names, ".").alias("_below"))
    keys = ["table_path", "record_id", "_object", "parent_path", "element_path"]
    own_name = lambda k: F.replace(k, F.lit("."), F.lit("\\."))
    entries = F.transform(F.map_entries("values"), lambda e: F.struct(F.when(F.col("_below") == "", own_name(e["key"])).otherwise(F.concat_ws(".", "_below", own_name(e["key"]))).alias("key"), e["value"].alias("value")))
    rows = found.join(known, "template").select("table_path", "record_id", F.slice("ords", F.lit(1), own).alias("_object"), _path("parent_steps").alias("parent_path"), _path("own_steps").alias("element_path"), entries.alias("_e"))
    parts = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_e"))))  # of one object and the plain objects in it
    merged = rows.groupBy(*keys).agg(parts.alias("_e"))
    first = F.filter("_e", lambda e, i: (i == 0) | (F.get(F.col("_e"), i - 1)["key"] != e["key"]))  # records that share an id
    return merged.select("table_path", "record_id", "parent_path", "element_path", F.map_from_entries(first).alias("values"))


def pivoted(rows: DataFrame, table_path: str) -> DataFrame:
    """One flat table of ``table_rows``: its keys and a text column per name that occurs in it.

    A name like one of the three key columns has an underscore appended. A table of more than
    ``MAX_COLUMNS`` names keeps them in the map ``values``.
    """
    keys = ["record_id", "parent_path", "element_path"]
    own = rows.where(F.col("table_path") == table_path)
    names = [r[0] for r in own.select(F.explode(F.map_keys("values"))).distinct().limit(MAX_COLUMNS + 1).collect()]  # the schema, not the data
    if len(names) > MAX_COLUMNS:
        return own.select(*keys, "values")
    return own.select(*keys, *[F.col("values")[F.lit(c)].alias(c + "_" if c in keys else c) for c in sorted(names)])


def flat_tables(df: DataFrame, id_col: str = "record_id", payload: str = "payload") -> dict[str, DataFrame]:
    """One table per repeated ancestor ('' is the record itself), by generic path such as ``a.b[].c[]``."""
    rows = written(table_rows(df, id_col, payload), "rows")
    return {r[0]: pivoted(rows, r[0]) for r in rows.select("table_path").distinct().collect()}  # as many as the records have kinds of arrays
