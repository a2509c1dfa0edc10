from datetime import datetime
from zoneinfo import ZoneInfo, available_timezones

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.instants import is_canonical, with_utc_micros

SCHEMA = "v string, z string"


def micros(spark, rows):
    return [r["us"] for r in with_utc_micros(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {SCHEMA}"), "v", "z", "us").orderBy("i").collect()]


def at(text, zone="UTC", us=0):
    return int(datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone)).timestamp()) * 1_000_000 + us


CASES = [
    ("2025-01-31T08:05:09Z", None, at("2025-01-31T08:05:09")),
    ("2025-01-31T08:05:09.123456789Z", "Asia/Tokyo", at("2025-01-31T08:05:09", us=123456)),
    ("2025-01-31T08:05Z", None, at("2025-01-31T08:05:00")),
    ("2024-259T16:58:22Z", None, at("2024-09-15T16:58:22")),
    ("20251108T000525Z", None, at("2025-11-08T00:05:25")),
    ("1735565865", "Asia/Tokyo", 1735565865_000000),
    ("1712425051164", None, 1712425051164_000),
    ("1736919795872706", None, 1736919795872706),
    ("1712145023615671655", None, 1712145023615671),
    ("1707142200.060", None, 1707142200_060000),
    ("10.03.2024 01:36", "Europe/Berlin", at("2024-03-10T01:36:00", "Europe/Berlin")),
    ("01/10/2025 12:17:10 AM", None, at("2025-01-10T00:17:10")),
    ("11/02/2025 12:26:51 PM", None, at("2025-11-02T12:26:51")),
    ("25/Oct/2024:05:14:15 +0900", "UTC", at("2024-10-25T05:14:15", "Asia/Tokyo")),
    ("Sun, 2 Nov 2025 01:31:32 EST", "Asia/Tokyo", at("2025-11-02T06:31:32")),
    ("Nov  3 2024 02:28:02", "America/New_York", at("2024-11-03T02:28:02", "America/New_York")),
    ("2025-10-05 06:44:52,805 +1100", None, at("2025-10-04T19:44:52", us=805000)),
    ("2025-04-06T01:14:29+11", None, at("2025-04-05T14:14:29")),
    ("2025-10-04T09:55:41+01:00[Europe/London]", "Asia/Tokyo", at("2025-10-04T08:55:41")),
    ("2024-10-16 14:19:26 Australia/Sydney", "UTC", at("2024-10-16T14:19:26", "Australia/Sydney")),
    ("01/10/2025 12:17:10 AM America/New_York", None, at("2025-01-10T00:17:10", "America/New_York")),
    ("01/10/2025 12:17 p.m. PST", None, at("2025-01-10T20:17:00")),
    ("2025-01-31 08:05:09 UTC+02:00", "Asia/Tokyo", at("2025-01-31T06:05:09")),
    ("2025-01-31T08:05:09GMT-3", "Asia/Tokyo", at("2025-01-31T11:05:09")),
    ("2025-01-31", None, None),
    ("2025-W05-5T08:05:09Z", None, None),
    # A wall time that occurred twice means the first one, one that was skipped none.
    ("2024-11-03 01:30:00", "America/New_York", at("2024-11-03T05:30:00")),
    ("2024-03-10 02:54:10", "America/New_York", None),
    ("2024-02-29T00:00:00Z", None, at("2024-02-29T00:00:00")),
    ("2025-02-29T00:00:00Z", None, None),
    ("2025-13-07T10:00:00Z", None, None),
    ("2025-01-07T24:00:00Z", None, None),
    ("2025-366T10:00:00Z", None, None),
    ("13/31/2025 01:00:00 PM", None, None),
    ("01/31/2025 13:00:00 PM", None, None),
    ("2025-01-01 00:00:00", "Mars/Olympus", None),
    ("2025-01-01 00:00:00 XYZ", None, None),
    ("2025-01-01T00:00:00+19:00", None, None),
    ("yesterday", None, None),
    ("now-15m", None, None),
    ("", None, None),
    (" ", "UTC", None),
    (None, None, None),
    ("12345", None, None),
]


def test_every_notation(spark):
    got = micros(spark, [(v, z) for v, z, _ in CASES])
    assert [(c[0], g) for c, g in zip(CASES, got)] == [(c[0], c[2]) for c in CASES]


def test_columns_are_kept_and_the_result_replaces_one_of_its_name(spark):
    df = spark.createDataFrame([("1735565865", None, 7, "x")], "v string, z string, utc_us int, `a.b` string")
    out = with_utc_micros(df, "v", "z")
    assert out.columns == ["v", "z", "a.b", "utc_us"]
    assert out.first()["utc_us"] == 1735565865_000000


def test_empty_table_and_long_text(spark):
    assert micros(spark, [("9" * 100_000, None)]) == [None]
    assert with_utc_micros(spark.createDataFrame([], SCHEMA), "v", "z").count() == 0


def test_plan_has_no_python_and_runs_the_pattern_once(spark):
    df = with_utc_micros(spark.createDataFrame([("x", None)], SCHEMA), "v", "z").where("utc_us is not null")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<y1>") == 1 and "Python" not in plan


def test_canonical(spark):
    df = spark.createDataFrame([("2025-01-31T08:05:09Z",), ("2025-01-31T08:05:09.0Z",)], "v string")
    assert [r[0] for r in df.select(is_canonical(F.col("v"))).collect()] == [True, False]


@pytest.mark.parametrize("form", ["{} {}", "{}[{}]", "{}{}"])
def test_a_bare_zone_of_every_region(spark, form):
    regions: dict[str, str] = {}
    for zone in sorted(available_timezones()):
        if "/" in zone and zone[0].isupper() and not zone.startswith(("Etc", "System")):
            regions.setdefault(zone.split("/")[0] + zone.split("/")[1][0], zone)
    wall = "2025-01-15 10:20:30"
    got = micros(spark, [(form.format(wall, z), None) for z in regions.values()])
    assert {z: g for z, g in zip(regions.values(), got)} == {z: at(wall, z) for z in regions.values()} and len(got) > 60


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.datetimes(datetime(1980, 1, 1), datetime(2060, 1, 1)), st.sampled_from(["Europe/Berlin", "Asia/Kolkata", "America/Sao_Paulo", "Australia/Sydney"])), min_size=50, max_size=50))
def test_zoned_walls_agree_with_the_library(spark, values):
    rows = [(d.replace(microsecond=0).isoformat(" "), z) for d, z in values]
    for (text, zone), got in zip(rows, micros(spark, rows)):
        wall = datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone))
        back = datetime.fromtimestamp(wall.timestamp(), ZoneInfo(zone)).replace(tzinfo=None)
        expected = int(wall.timestamp()) * 1_000_000 if back == wall.replace(tzinfo=None) else None
        assert got == expected, (text, zone)


@pytest.mark.parametrize("text", ["2024-01-01T00:00:00z", "2024-01-01t00:00:00Z", "2024-01-01 00:00:00Z"])
def test_case_of_letters(spark, text):
    assert micros(spark, [(text, "Asia/Tokyo")]) == [at("2024-01-01T00:00:00")]
