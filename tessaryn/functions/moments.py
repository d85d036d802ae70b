"""Instants and calendar dates out of text, as JVM-side expressions (problem 3).

A value is rewritten once into ``kind|year|a|b|hour|minute|second|fraction|half|zone`` by a chain of
anchored patterns; every reading that the parts allow becomes a candidate, and a value names an
instant or a date if its candidates are exactly one.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaryn.functions.text import strip

#: Ages that a birth date may have on the reference date; decides the century of two-digit years.
ADULT, OLDEST = 18, 100
REFERENCE_DATE = "2026-01-01"

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(Z|[+-]\d{2}:?\d{2}|[A-Z]{1,5}|[A-Za-z]+(?:/[A-Za-z_+-]+[0-9]*){1,2})?"
# kind|year|a|b|hour|minute|second|fraction|half|zone; kinds: Y year first, D day and month in either order, M month by name
_TIME_FORMS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[T ]+{_CLOCK}() *\[?{_ZONE}\]?$", "Y|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?() *{_ZONE}$", "Y|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})[T ]+{_CLOCK} *([AaPp][Mm])? *{_ZONE}$", "D|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[A-Za-z]{{3,9}}, *)?(\d{{1,2}})[- ]([A-Za-z]{{3,9}})[- ](\d{{4}})[T ]+{_CLOCK} *([AaPp][Mm])? *{_ZONE}$", "M|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
]
_DATE_TAIL = r"(?:[T ]+\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)? *Z?"
_DATE_FORMS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_DATE_TAIL}$", "Y|$1|$2|$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "Y|$1|$2|$3"),
    (rf"^(\d{{1,2}})[-/. ](\d{{1,2}})[-/. ](\d{{4}}|\d{{2}}){_DATE_TAIL}$", "D|$3|$1|$2"),
    (r"^(\d{1,2})[- ]+([A-Za-z]{3,9})\.?[-, ]+(\d{4}|\d{2})$", "M|$3|$2|$1"),
    (r"^([A-Za-z]{3,9})\.? +(\d{1,2}),? +(\d{4}|\d{2})$", "M|$3|$1|$2"),
]
CANONICAL = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$"


def named_zones() -> list[str]:
    """IANA names of the form area/place, from the installed zone data."""
    areas = ("Africa/", "America/", "Antarctica/", "Arctic/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Indian/", "Pacific/")
    return sorted(z for z in zoneinfo.available_timezones() if z.startswith(areas))


def _rewritten(s: Column, forms: list[tuple[str, str]]) -> Column:
    for pattern, to in forms:
        s = F.regexp_replace(s, pattern, to)
    return F.when(s.rlike(r"^[YDM]\|"), F.split(s, r"\|", -1))


def _month(name: Column) -> Column:
    months = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    at = F.create_map(*[F.lit(x) for i, m in enumerate(months, 1) for x in (m, f"{i:02d}")])
    return F.try_element_at(at, F.lower(F.substring(name, 1, 3)))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def _days(p: Column, day_order: Column) -> Column:
    """Candidate dates ``yyyy-MM-dd`` as text, possibly invalid: one, or one for each order that ``day_order`` leaves open."""
    kind, year, a, b = p[0], p[1], p[2], p[3]
    dmy, mdy = _ymd(year, b, a), _ymd(year, a, b)
    return (
        F.when(kind == "Y", F.array(mdy))
        .when(kind == "M", F.array(_ymd(year, _month(a), b)))
        .when(a.try_cast("int") > 12, F.array(dmy))
        .when(b.try_cast("int") > 12, F.array(mdy))
        .when(day_order == "dmy", F.array(dmy))
        .when(day_order == "mdy", F.array(mdy))
        .otherwise(F.array(dmy, mdy))
    )


def _only(candidates: Column) -> Column:
    """The one distinct non-null candidate, else null."""
    d = F.array_distinct(F.array_compact(candidates))
    return F.when(F.size(d) == 1, d[0])


def _staged(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Each step sees the columns of those before; the optimiser keeps them apart, so nothing is computed twice."""
    for step in steps:
        df = df.withColumns(step)
    return df


def with_date(df: DataFrame, out: str, raw: Column, day_order: Column, reference: str = REFERENCE_DATE) -> DataFrame:
    """``df`` with the date that ``raw`` names in ``out``, null if it names none or more than one.

    Two-digit years are those of an adult under 100 on ``reference``. Where day and month could be
    swapped ``day_order`` (dmy, mdy or null) decides; both orders giving one date is no doubt.
    Null, blank, impossible and partial dates give null.
    """
    ref = F.lit(reference).cast("date")
    p, d = F.col("_p"), F.col("_d")

    def adult(century: str, i: int) -> Column:
        x = F.concat(F.lit(century), d[i]).try_cast("date")
        return F.when((x <= F.add_months(ref, -12 * ADULT)) & (x > F.add_months(ref, -12 * OLDEST)), x)

    def at(i: int) -> list[Column]:
        day = F.get(d, F.lit(i))
        short = day.rlike(r"^\d\d-")
        return [F.when(~short, day.try_cast("date")), *[F.when(short, adult(c, i)) for c in ("19", "20")]]

    plain = raw.rlike(r"^\d{4}-\d{2}-\d{2}\z")  # most values: one reading, nothing to rewrite
    return _staged(
        df,
        {"_p": F.when(~plain, _rewritten(strip(raw), _DATE_FORMS))},
        {"_d": F.when(p.isNotNull(), _days(p, day_order))},
        {"_c": F.when(d.isNotNull(), F.array(*at(0), *[F.when(F.size(d) > 1, x) for x in at(1)]))},
        {out: F.when(plain, raw.try_cast("date")).otherwise(_only(F.col("_c")))},
    ).drop("_p", "_d", "_c")


def with_instant(df: DataFrame, out: str, raw: Column, zone: Column, day_order: Column) -> DataFrame:
    """``df`` with the UTC instant (timestamp without zone) that ``raw`` names in ``out``, or null.

    ``zone`` and ``day_order`` are those of the row's source, null where it is unknown. Offsets, Z and
    named zones in the text count; abbreviations and missing zones are read in ``zone``. Wall times
    that the zone skips or has twice, dates without a time and impossible values name none.
    Fractions beyond microseconds are cut off. Whole numbers of 10 and 13 digits are seconds and
    milliseconds since 1970.
    """
    s, p, d, clock, told, where, wall, utc = (F.col(c) for c in ("_s", "_p", "_d", "_clock", "_told", "_where", "_wall", "_utc"))
    hour, half = p[4].try_cast("int"), F.lower(p[8])
    hour = (
        F.when(half == "", hour)
        .when((hour < 1) | (hour > 12), F.lit(None).cast("int"))
        .when(half == "am", hour % 12)
        .otherwise(hour % 12 + 12)
    )
    text = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), p[5], F.lit(":"), F.when(p[6] == "", "00").otherwise(p[6]), F.lit("."), F.rpad(F.substring(p[7], 1, 6), 6, "0"))
    offset = F.regexp_replace(p[9], r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    read_in = (
        F.when(told.isin("Z", "UTC"), F.lit("+00:00"))
        .when(told.rlike(r"^[+-](0\d|1[0-4]):[0-5]\d$"), told)
        .when(told.rlike("/"), F.when(told.isin(named_zones()), told))
        .when(told.rlike(r"^[A-Z]*$"), zone)
    )
    utc_zone = F.lit("UTC")
    shown = [F.convert_timezone(utc_zone, where, utc + F.expr(f"interval {m} minutes")) for m in (0, 30, 60, 120)]
    hours = F.expr("interval 3 hours")
    steady = (F.convert_timezone(where, utc_zone, wall + hours) - hours == utc) & (F.convert_timezone(where, utc_zone, wall - hours) + hours == utc)
    once = F.when(~where.rlike("/") | steady, True).otherwise((shown[0] == wall) & (shown[1] != wall) & (shown[2] != wall) & (shown[3] != wall))
    micros = F.when(s.rlike(r"^\d{10}$"), s.try_cast("bigint") * 1000000).when(s.rlike(r"^\d{13}$"), s.try_cast("bigint") * 1000)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("_micros") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return _staged(
        df,
        {"_s": strip(raw)},
        {"_p": _rewritten(s, _TIME_FORMS), "_micros": micros},
        {"_d": F.when(p.isNotNull(), _days(p, day_order)), "_clock": F.when(p.isNotNull(), text), "_told": F.when(p.isNotNull(), offset)},
        {"_wall": F.when(clock.isNotNull(), F.array(*[F.concat(F.get(d, F.lit(i)), F.lit(" "), clock).try_cast("timestamp_ntz") for i in (0, 1)])), "_where": read_in},
        {"_wall": _only(wall)},
        {"_utc": F.convert_timezone(where, utc_zone, wall)},
        {out: F.when(F.col("_micros").isNotNull(), epoch).when(once, utc)},
    ).drop("_s", "_p", "_micros", "_d", "_clock", "_told", "_wall", "_where", "_utc")
