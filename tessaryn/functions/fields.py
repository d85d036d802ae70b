"""Field expressions of decision records: dates, bands, addresses, masks, pseudonyms."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaryn.functions.text import blank, strip

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
AGE_BANDS = ["<25", "25-34", "35-44", "45-54", "55-64", "65+"]
AGE_LIMITS = [25, 35, 45, 55, 65]
#: (first address, last address) of the IPv4 blocks that are not globally reachable, as in the IANA registry.
PRIVATE_V4 = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32"]


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))


def birth_date(raw: Column) -> tuple[Column, Column, Column]:
    """(date, ambiguous, failed) of year-first dates with dashes or slashes and of ``NN/NN/YYYY``: month first
    unless the first number exceeds 12; ambiguous if both do not and the date is valid. Blank is neither."""
    s = strip(raw)
    part = lambda p, i: F.regexp_extract(s, p, i)
    iso, slash = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    a, b, y = (part(slash, i) for i in (1, 2, 3))
    first = F.coalesce(_date(part(iso, 1), part(iso, 2), part(iso, 3)), F.when(a.try_cast("int") > 12, _date(y, b, a)).otherwise(_date(y, a, b)))
    is_slash = s.rlike(slash)
    ambiguous = F.coalesce(is_slash & (a.try_cast("int") <= 12) & (b.try_cast("int") <= 12) & first.isNotNull(), F.lit(False))
    return first, ambiguous, ~blank(raw) & first.isNull()


def iso_instant(raw: Column) -> Column:
    """ISO-8601 timestamps and dates, naive ones as UTC; row by row, whatever the first row looks like."""
    s = strip(raw)
    ok = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?$")
    return F.when(ok, F.try_to_timestamp(s))


def age_band(born: Column, reference: str = "2026-01-01") -> Column:
    """Band of full years as days / 365.25; null for a null or future date."""
    years = F.datediff(F.lit(reference).cast("date"), born) / F.lit(365.25)
    out = F.when(years < 0, F.lit(None).cast("string"))
    for limit, name in zip(AGE_LIMITS, AGE_BANDS, strict=False):
        out = out.when(years < limit, name)
    return out.when(years >= AGE_LIMITS[-1], AGE_BANDS[-1])


def band_rank(band: Column) -> Column:
    """0-based place of a band in age order; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(b) for b in AGE_BANDS]), band), F.lit(0)) - 1


def _v4(text: Column) -> Column:
    o = [F.element_at(F.split(text, r"\."), i).try_cast("long") for i in (1, 2, 3, 4)]
    return o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]


@F.pandas_udf(T.BooleanType())
def _private_v6(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> bool:
        try:
            return ipaddress.ip_address(v).is_private
        except ValueError:
            return False

    return values.map(one)


def private_address(raw: Column, v6: bool = True) -> Column:
    """True for addresses of a private or reserved range; false for blank, malformed and public ones.

    IPv4 is arithmetic on the JVM; ``v6`` sends values with a colon to a vectorised function.
    """
    s = strip(raw)
    octet = r"(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    n = _v4(s)
    inside = F.lit(False)
    for block in PRIVATE_V4:
        net = ipaddress.ip_network(block)
        inside = inside | n.between(int(net[0]), int(net[-1]))
    four = F.coalesce(s.rlike(rf"^{octet}(\.{octet}){{3}}$") & inside, F.lit(False))
    return F.when(F.coalesce(s.contains(":"), F.lit(False)), _private_v6(s)).otherwise(four) if v6 else four


def _kept_blank(c: Column, masked: Column) -> Column:
    return F.when(blank(c), c).otherwise(masked)


def mask_text(c: Column, token: str = "[REDACTED]") -> Column:
    return _kept_blank(c, F.lit(token))


def mask_email(c: Column) -> Column:
    """First character and domain; a fixed token without an @."""
    s = strip(c)
    masked = F.concat(F.substring(F.substring_index(s, "@", 1), 1, 1), F.lit("***@"), F.regexp_replace(s, r"^[^@]*@", ""))
    return _kept_blank(c, F.when(s.contains("@"), masked).otherwise("[REDACTED_EMAIL]"))


def mask_ssn(c: Column) -> Column:
    return _kept_blank(c, F.concat(F.lit("***-**-"), F.right(strip(c), F.lit(4))))


def mask_ip(c: Column) -> Column:
    return mask_text(c, "[REDACTED_IP]")


def mask_dob(c: Column) -> Column:
    """The first four characters kept, so a slashed date shows its month and part of the day; see ``mask_dob_year``."""
    s = strip(c)
    return _kept_blank(c, F.concat(F.when(F.length(s) >= 4, F.left(s, F.lit(4))).otherwise("XXXX"), F.lit("-**-**")))


def mask_dob_year(c: Column) -> Column:
    """The first year of 1900 to 2099 found anywhere, else XXXX."""
    year = F.regexp_extract(c, r"((?:19|20)\d\d)", 1)
    return _kept_blank(c, F.concat(F.when(year != "", year).otherwise("XXXX"), F.lit("-**-**")))


def mask_zip(c: Column) -> Column:
    return mask_text(c, "[REDACTED_ZIP]")


def shortened(c: Column, length: int = 80) -> Column:
    return F.when(F.length(c) > length, F.concat(F.left(c, F.lit(length - 3)), F.lit("..."))).otherwise(c)


def stable_hash(seed: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + "|"), seed), 256)
