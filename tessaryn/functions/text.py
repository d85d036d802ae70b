"""Text expressions, all JVM-side Columns.

White space is Unicode white space throughout (Spark's ``trim`` strips blanks only).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What people write for a missing value, lower-cased and without
# punctuation and white space.
PLACEHOLDERS = ["", "unknown", "notprovided", "tbd", "tba", "null", "none", "na", "nan", "nil", "missing", "notavailable", "notapplicable", "undefined", "notgiven", "refused", "pending"]


_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_EDGE, _EDGES = rf"^{_SPACE}|{_SPACE}\z", rf"^{_SPACE}+|{_SPACE}+\z"


def strip(c: Column) -> Column:
    return F.when(c.rlike(_EDGE), F.regexp_replace(c, _EDGES, "")).otherwise(c)


def blank(c: Column) -> Column:
    """True for null, empty and white-space values; never null."""
    return c.isNull() | ~F.coalesce(c.rlike(rf"[^{_SPACE[1:]}"), F.lit(False))


def bare(c: Column) -> Column:
    """Lower case, without white space, punctuation, symbols and format characters."""
    return F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{P}\p{S}\p{C}]+", "")


def missing_bare(c: Column) -> Column:
    """``missing`` of a value that is in bare form already."""
    return c.isNull() | c.isin(PLACEHOLDERS)


def missing(c: Column) -> Column:
    """True for null, blank or a placeholder for a missing value; never null."""
    return missing_bare(bare(c))


def nullif_blank(c: Column, lower: bool = False) -> Column:
    s = strip(c)
    s = F.lower(s) if lower else s
    return F.when(s != "", s)


def number(c: Column) -> Column:
    """Coercing cast: anything but a plain decimal, an exponent form or an infinity is null."""
    s = strip(c)
    ok = s.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$")
    return F.nanvl(F.when(ok, s.try_cast("double")), F.lit(None).cast("double"))


def truth(c: Column) -> Column:
    """true/1/yes/y and false/0/no/n, whatever the case; anything else is null."""
    s = F.lower(strip(c))
    return F.when(s.isin("true", "1", "yes", "y"), F.lit(True)).when(s.isin("false", "0", "no", "n"), F.lit(False))


def title(c: Column) -> Column:
    """A capital after every non-letter (``initcap`` knows blanks only)."""
    parts = F.split(F.lower(c), r"(?<=\P{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")
