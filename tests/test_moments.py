from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quillrake.functions import zones
from quillrake.operators import moments as M

UTC = timezone.utc


def read(spark, rows):
    """rows: (text, zone, date order) -> list of (utc_ms, status)."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, z string, o string")
    spans = M.interval_table(spark, sorted({r[1] for r in rows if r[1]} | {"Europe/Berlin", "America/New_York"}))
    return [(r.utc_ms, r.moment_status) for r in M.to_utc(df, "raw", spans, "z", "o").orderBy("i").collect()]


def ms(*parts, off=0.0):
    return int((datetime(*parts, tzinfo=UTC) - timedelta(hours=off)).timestamp() * 1000)


CASES = [
    ("2025-06-01T10:00:00+02:00", "UTC", "dmy", ms(2025, 6, 1, 8)),
    ("2025-06-01 10:00:00.9999 +0200", "UTC", "dmy", ms(2025, 6, 1, 8) + 999),
    ("2025-06-01t10:00z", "UTC", "dmy", ms(2025, 6, 1, 10)),
    ("20250601T100000Z", "UTC", "dmy", ms(2025, 6, 1, 10)),
    ("03/04/2025 05:06:07", "Europe/London", "dmy", ms(2025, 4, 3, 4, 6, 7)),
    ("03/04/2025 05:06:07", "America/New_York", "mdy", ms(2025, 3, 4, 10, 6, 7)),
    ("13/04/2025 05:06", "America/New_York", "mdy", None),
    ("Jan 5, 2025 12:03:04 AM IST", "Asia/Kolkata", "dmy", ms(2025, 1, 5, 0, 3, 4, off=5.5)),
    ("Jan 5, 2025 12:03:04 PM IST", "Asia/Kolkata", "dmy", ms(2025, 1, 5, 12, 3, 4, off=5.5)),
    ("Sun, 05 Jan 2025 12:03:04 GMT", "Asia/Kolkata", "dmy", ms(2025, 1, 5, 12, 3, 4)),
    ("9. Juli 2025, 10:13 Uhr", "Europe/Berlin", "dmy", ms(2025, 7, 9, 8, 13)),
    ("8 octobre 2025 à 00:46", "Europe/Paris", "dmy", ms(2025, 10, 7, 22, 46)),
    ("3 de abril de 2025, 04:15", "Europe/Madrid", "dmy", ms(2025, 4, 3, 2, 15)),
    ("2025-10-26T02:30:00", "Europe/Berlin", "dmy", ms(2025, 10, 26, 0, 30)),
    ("Oct 26, 2025 2:30:00 AM CET", "Europe/Berlin", "dmy", ms(2025, 10, 26, 1, 30)),
    ("2025-03-30T02:30:00", "Europe/Berlin", "dmy", None),
    ("2025-01-10 08:00:00 America/New_York", "Europe/Berlin", "dmy", ms(2025, 1, 10, 13)),
    ("2025-01-10T08:00:00[America/New_York]", "Europe/Berlin", "dmy", ms(2025, 1, 10, 13)),
    ("Jan 5, 2025 1:03:04 AM BRT", "America/Sao_Paulo", "dmy", ms(2025, 1, 5, 4, 3, 4)),
    ("1737309925", None, None, 1737309925000),
    ("1737309925123", None, None, 1737309925123),
    ("1737309925123456", None, None, 1737309925123),
    (" 2025-06-01T10:00:00Z\n", None, None, ms(2025, 6, 1, 10)),
    ("2025-06-01", "UTC", "dmy", None),
    ("2025-02-30 10:00:00", "UTC", "dmy", None),
    ("2025-01-01T25:00:00Z", "UTC", "dmy", None),
    ("just now", "UTC", "dmy", None),
    ("2025-06-01 10:00:00", None, None, None),
    ("2025-06-01 10:00:00", "Nowhere/City", None, None),
    ("", "UTC", "dmy", None),
    (None, "UTC", "dmy", None),
    ("2025 " * 30_000, "UTC", "dmy", None),
]


def test_forms(spark):
    got = read(spark, [c[:3] for c in CASES])
    assert [g[0] for g in got] == [c[3] for c in CASES]


def test_statuses(spark):
    rows = [("2025-10-26T02:30:00", "Europe/Berlin", "dmy"), ("2025-03-30T02:30:00", "Europe/Berlin", "dmy"), ("2025-03-30T03:30:00", "Europe/Berlin", "dmy"), ("x", "UTC", "dmy"), ("2025-06-01 10:00", "Not/Known", "dmy"), ("2025-06-01 10:00Z", None, None)]
    assert [g[1] for g in read(spark, rows)] == ["ambiguous", "skipped", "local", "unreadable", "unknown_zone", "fixed"]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Australia/Lord_Howe", "Asia/Kolkata", "America/Sao_Paulo"])
def test_against_zoneinfo(spark, zone):
    """Every half hour around the changes of a year, against brute force over the zone's offsets."""
    z = ZoneInfo(zone)
    days = [datetime(2025, m, d) for m in (3, 4, 10, 11) for d in (1, 2, 5, 6, 9, 26, 30)]
    local = [d + timedelta(minutes=15 * k) for d in days for k in range(24)]
    want = []
    for t in local:
        hits = sorted({u for off in range(-14 * 4, 15 * 4) for u in [t.replace(tzinfo=UTC) - timedelta(minutes=15 * off)] if u.astimezone(z).replace(tzinfo=None) == t})
        want.append(int(hits[0].timestamp() * 1000) if hits else None)
    assert [g[0] for g in read(spark, [(t.isoformat(sep=" "), zone, "dmy") for t in local])] == want


def test_intervals_are_whole():
    for zone in ("Europe/Berlin", "Asia/Kolkata", "UTC"):
        spans = zones.utc_intervals(zone, (1970, 2030))
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_clashing_columns_empty_table_and_repeats(spark):
    spans = M.interval_table(spark, ["UTC"])
    df = spark.createDataFrame([("2025-06-01T10:00:00Z", "UTC", "dmy", "old", 1)] * 3, "raw string, zone string, o string, utc_ms string, year int")
    out = M.to_utc(df, "raw", spans, "zone", "o")
    assert out.columns == ["raw", "zone", "o", "year", "utc_ms", "moment_status"]
    assert [r.utc_ms for r in out.collect()] == [ms(2025, 6, 1, 10)] * 3
    assert M.to_utc(df.limit(0), "raw", spans, "zone", "o").count() == 0


def test_unknown_provider_has_no_zone(spark):
    p = spark.createDataFrame([("a", {"timezone": "Europe/Berlin", "date_order": "dmy"}), ("b", None)], "id string, config map<string,string>")
    df = spark.createDataFrame([("a", "2025-06-01 10:00:00"), ("b", "2025-06-01 10:00:00"), (None, "2025-06-01 10:00:00"), ("c", None)], "provider_id string, raw string")
    got = {(r.provider_id, r.moment_status) for r in M.with_instants(df, "raw", p).collect()}
    assert got == {("a", "local"), ("b", "unknown_zone"), (None, "unknown_zone"), ("c", "unreadable")}


def test_join_is_broadcast_and_reads_few_columns(spark):
    df = spark.createDataFrame([("2025-06-01 10:00:00", "UTC", "dmy")], "raw string, z string, o string")
    plan = M.to_utc(df, "raw", M.interval_table(spark, ["UTC"]), "z", "o")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    assert F is not None


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Africa/Casablanca", "Asia/Kolkata", "America/Santiago"])
def test_any_year_against_zoneinfo(spark, zone):
    z = ZoneInfo(zone)
    local = [datetime(y, m, d, h, 30) for y in (1, 1700, 1850, 1899, 1950, 2087, 2129, 2130, 2200, 2345, 2400, 3001, 9998) for m, d in ((1, 1), (3, 31), (7, 2), (10, 30), (12, 31)) for h in (0, 2, 23)]
    want = [int(t.replace(tzinfo=z).timestamp()) * 1000 for t in local]
    assert [g[0] for g in read(spark, [(t.isoformat(sep=" "), zone, "dmy") for t in local])] == want


def test_texts_with_the_mark_of_found_parts_are_unreadable(spark):
    assert read(spark, [("ymd|2025|1|1|1|1|1||||", "UTC", "dmy")]) == [(None, "unreadable")]
