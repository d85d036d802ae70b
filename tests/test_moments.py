import pytest
from pyspark.sql import functions as F

from tessaryn.functions.moments import with_date, with_instant
from tessaryn.operators.moments_dictionary import MomentDictionary, normalised_moments

NY, LONDON = "America/New_York", "Europe/London"
TIMES = [
    ("2023-01-15T03:08:25 America/Los_Angeles", NY, "mdy", "2023-01-15T11:08:25.000000Z"),
    ("2023-01-18T17:44:59[America/New_York]", None, None, "2023-01-18T22:44:59.000000Z"),
    ("21/01/2023 09:20", "Europe/Berlin", "dmy", "2023-01-21T08:20:00.000000Z"),
    ("21/01/2023 09:20", None, None, None),  # no source
    ("11/01/2023 03:10", LONDON, "dmy", "2023-01-11T03:10:00.000000Z"),
    ("11/01/2023 03:10", NY, "mdy", "2023-11-01T07:10:00.000000Z"),
    ("2023-03-12 02:30:00", NY, "mdy", None),  # skipped
    ("2023-11-05 01:30:00", NY, "mdy", None),  # twice
    ("2023-11-05 01:30:00 EDT", NY, "mdy", None),  # an abbreviation is read by the zone, which has it twice
    ("2023-11-05T01:30:00-04:00", NY, "mdy", "2023-11-05T05:30:00.000000Z"),
    ("2023-11-05 03:30:00", NY, "mdy", "2023-11-05T08:30:00.000000Z"),
    ("2023-06-01 10:00:00 IST", "Asia/Kolkata", "dmy", "2023-06-01T04:30:00.000000Z"),
    ("2023-06-01 10:00:00 IST", None, None, None),
    ("1674243429", None, None, "2023-01-20T19:37:09.000000Z"),
    ("1674140147976", NY, "mdy", "2023-01-19T14:55:47.976000Z"),
    ("20230115T062155Z", None, None, "2023-01-15T06:21:55.000000Z"),
    ("2023-01-14T02:28:42.651266349Z", None, None, "2023-01-14T02:28:42.651266Z"),
    ("11-Jan-2023 12:32 AM", NY, "mdy", "2023-01-11T05:32:00.000000Z"),
    ("11-Jan-2023 12:32 PM", NY, "mdy", "2023-01-11T17:32:00.000000Z"),
    ("Wed, 11 Jan 2023 17:11:40 +1245", None, None, "2023-01-11T04:26:40.000000Z"),
    ("2024-02-30T08:15:00Z", NY, "mdy", None),
    ("0000-00-00 00:00:00", NY, "mdy", None),
    ("2024-13-40", NY, "mdy", None),
    ("2023-01-13", NY, "mdy", None),
    ("25:61", NY, "mdy", None),
    ("  2023-01-13T00:00:00Z ", None, None, "2023-01-13T00:00:00.000000Z"),
    ("2023-01-13 10:00 Mars/Olympus", NY, "mdy", None),
    ("x" * 5000, NY, "mdy", None),
    ("", NY, "mdy", None),
    (None, NY, "mdy", None),
]
DATES = [
    ("1976-9-25", None, "1976-09-25"), ("1976/09/25", None, "1976-09-25"), ("19760925", None, "1976-09-25"), ("05/16/1970", None, "1970-05-16"), ("16/05/1970", "mdy", "1970-05-16"),
    ("05/06/1970", "mdy", "1970-05-06"), ("05/06/1970", "dmy", "1970-06-05"), ("05/06/1970", None, None), ("05/05/1970", None, "1970-05-05"), ("02.10.1968", "dmy", "1968-10-02"),
    ("01-Sep-1961", None, "1961-09-01"), ("Feb 6, 1949", None, "1949-02-06"), ("05/24/58", "mdy", "1958-05-24"), ("08/09/05", "dmy", "2005-09-08"), ("08/09/15", "dmy", None), ("1980-08-27T00:00:00", None, "1980-08-27"),
    ("1990-02-30", None, None), ("1978", None, None), ("19880-01-01", None, None), ("refused", "dmy", None), (" ", "dmy", None), (None, "dmy", None), ("00/00/1985", "dmy", None), ("2015-03-01", None, "2015-03-01"),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, *t[:3]) for i, t in enumerate(TIMES)], "i int, r string, z string, o string")
    out = with_instant(df, "t", F.col("r"), F.col("z"), F.col("o")).select("i", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("t")).collect()
    got = {r.i: r.t for r in out}
    assert [(t[0], got[i]) for i, t in enumerate(TIMES)] == [(t[0], t[3]) for t in TIMES]


def test_dates(spark):
    df = spark.createDataFrame([(i, *t[:2]) for i, t in enumerate(DATES)], "i int, r string, o string")
    got = {r.i: r.t for r in with_date(df, "t", F.col("r"), F.col("o")).select("i", F.col("t").cast("string").alias("t")).collect()}
    assert [(t[0], got[i]) for i, t in enumerate(DATES)] == [(t[0], t[2]) for t in DATES]


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([("a", NY, "mdy", 1), ("b", LONDON, "dmy", 2)], "source_system string, default_zone string, day_order string, trust_rank int")


def test_rows_and_clashing_columns(spark, sources):
    rows = [(1, "2023/01/02 03:04:05", "a", "x"), (2, "2023/01/02 03:04:05", "a", "y"), (3, "2023-01-02T03:04:05Z", "a", "z"), (4, None, "a", "z"), (5, "2023/01/02 03:04:05", None, "z"), (6, "2023/01/02 03:04:05", "nowhere", "z")]
    df = spark.createDataFrame(rows, "id bigint, t string, s string, normal_text string").withColumn("raw_value", F.lit("clash"))
    out = normalised_moments(df, sources, {"t": "instant"}, "id", "s")
    assert sorted((r.id, r.normal_text) for r in out.collect()) == [(1, "2023-01-02T08:04:05.000000Z"), (2, "2023-01-02T08:04:05.000000Z")]
    assert normalised_moments(df.limit(0), sources, {"t": "instant"}, "id", "s").count() == 0


def test_dictionary_grows_by_new_values_only(spark, sources, tmp_path):
    one = spark.createDataFrame([("t", "2023/01/02 03:04:05", "a"), ("t", "bad", None)], "field_name string, raw_value string, source_name string")
    d = MomentDictionary(spark, sources, {"t": "instant"}, str(tmp_path / "d")).update(one)
    two = one.union(spark.createDataFrame([("t", "2023/01/02 03:04:05", "b")], one.schema))
    again = MomentDictionary(spark, sources, {"t": "instant"}, str(tmp_path / "d")).update(two)
    assert d.read().count() == again.read().count() == 3
