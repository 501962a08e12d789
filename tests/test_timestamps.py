from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veldra.functions.zones import transitions, wall_to_utc
from veldra.operators.timestamps import normalize, to_utc

NONE = np.iinfo(np.int64).min


def one(value, zone=None, us=False):
    got = int(to_utc(pa.array([value]), np.array([zone], object), np.array([us]))[0])
    return None if got == NONE else datetime.fromtimestamp(got / 1e6, UTC).strftime("%Y-%m-%d %H:%M:%S.%f")[:23]


CASES = [
    ("Tue, 05 Jan 2024 18:08:31 GMT", None, False, "2024-01-05 18:08:31.000"), ("Fri, 05 Jan 2024 14:14:02 -0500", None, False, "2024-01-05 19:14:02.000"), ("2024-01-06T09:50:25Z", None, False, "2024-01-06 09:50:25.000"),
    ("2024-03-10t05:44:52z", None, False, "2024-03-10 05:44:52.000"), ("2024-01-07T16:07:31.755-07:00", None, False, "2024-01-07 23:07:31.755"), ("08/01/2024 05:42", "UTC", False, "2024-01-08 05:42:00.000"),
    ("01/05/2024 8:20 AM", "UTC", True, "2024-01-05 08:20:00.000"), ("1704435135", None, False, "2024-01-05 06:12:15.000"), ("1704493243458", None, False, "2024-01-05 22:20:43.458"), ("20240105T234805Z", None, False, "2024-01-05 23:48:05.000"),
    ("2024-01-07 02:08 America/Denver", "Asia/Tokyo", False, "2024-01-07 09:08:00.000"), ("January 10, 2024 2:04pm", "Europe/Paris", False, "2024-01-10 13:04:00.000"), ("Sat, 13 Jan 24 17:33:59 GMT", None, False, "2024-01-13 17:33:59.000"),
    ("January 10, 2024 at 2:44 PM PST", None, False, "2024-01-10 22:44:00.000"), ("2024/01/05 12:18:58 UTC+5", None, False, "2024-01-05 07:18:58.000"), ("2024-01-21T15:34:54+01:00[Europe/Paris]", None, False, "2024-01-21 14:34:54.000"),
    ("2024-01-07 05:51:08 -06", None, False, "2024-01-07 11:51:08.000"), ("2024-01-27 00:55:10 +0545", None, False, "2024-01-26 19:10:10.000"), ("06.01.2024 08:13", "Europe/Berlin", False, "2024-01-06 07:13:00.000"),
    ("15. März 2024, 16:34 Uhr", "Europe/Berlin", False, "2024-03-15 15:34:00.000"), ("24 de enero de 2024, 16:45", "Europe/Madrid", False, "2024-01-24 15:45:00.000"), ("21 janvier 2024 à 15h04", "Europe/Paris", False, "2024-01-21 14:04:00.000"),
    ("2024-01-06T04", "UTC", False, "2024-01-06 04:00:00.000"), ("20240106T0200", "UTC", False, "2024-01-06 02:00:00.000"), ("  2024-01-06\t10:00 \n", "UTC", False, "2024-01-06 10:00:00.000"), ("Thu,  31 Oct 2024 10:20:57 -0000", None, False, "2024-10-31 10:20:57.000"),
    ("2024-07-15T15:15:42.0044998Z", None, False, "2024-07-15 15:15:42.004"), ("January 26, 2024 12:54AM", "UTC", True, "2024-01-26 00:54:00.000"),
    ("2024-01-16", "UTC", False, None), ("yesterday", "UTC", False, None), ("", "UTC", False, None), (None, "UTC", False, None), ("31 Feb 2024 10:00:00 GMT", None, False, None), ("2024-13-07T21:47:20Z", None, False, None),
    ("0000-00-00 00:00:00", "UTC", False, None), ("2024-01-05 10:00", None, False, None), ("2024-01-05 10:00", "Nowhere/Land", False, None), ("T", "UTC", False, None), ("--", "UTC", False, None), ("5 hours ago", "UTC", False, None), ("2024-01-05T25:00Z", None, False, None), ("x" * 5000, "UTC", False, None),
]


LONG = [
    ("2024-09-11T19:45:40.123456789-03:00[America/Argentina/Buenos_Aires]", "2024-09-11 22:45:40.123"), ("2024-01-06" + " " * 300 + "10:00" + "\t" * 300 + "Z", "2024-01-06 10:00:00.000"),
    ("2024-01-06T10:00:00." + "5" * 60 + "Z", "2024-01-06 10:00:00.555"),
]


@pytest.mark.parametrize("value,want", LONG)
def test_long_values(value, want):
    assert one(value) == want


@pytest.mark.parametrize("value,zone,us,want", CASES)
def test_notations(value, zone, us, want):
    assert one(value, zone, us) == want


def test_clock_changes():
    assert one("2024-03-10T02:30", "America/New_York") == "2024-03-10 07:30:00.000"  # never: offset before
    assert one("2024-11-03T01:30", "America/New_York") == "2024-11-03 05:30:00.000"  # twice: offset before
    again = to_utc(pa.array(["2024-11-03T01:00", "2024-11-03T01:00", "2024-11-03 02:00", "2024-11-03T02:00"]), np.array(["America/New_York"] * 4, object), np.ones(4, bool), np.zeros(4, int))
    assert ((again - again[0]) // 3_600_000_000).tolist() == [0, 1, 2, 2]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["America/New_York", "Europe/London", "Australia/Adelaide", "Asia/Kathmandu", "America/St_Johns", "UTC"]), st.integers(0, 4_000_000_000))
def test_zones_agree_with_library(name, wall):
    naive = datetime(1970, 1, 1).fromtimestamp(wall, UTC).replace(tzinfo=None)
    want = int(naive.replace(tzinfo=ZoneInfo(name), fold=0).timestamp())
    assert wall_to_utc(name, np.array([wall]))[0][0] == want


def test_unknown_zone():
    assert transitions("Nowhere/Land") is None and transitions("") is None


def test_operator(spark):
    rows = [(1, ["2024-01-06T09:00Z", None, "x"], "UTC", None, "a"), (1, ["2024-01-06T09:00Z"], None, True, "a"), (2, None, "UTC", True, None), (3, [], "UTC", True, None), (4, ["2024-01-06T09:00"], None, True, None)]
    df = spark.createDataFrame(rows, "k bigint, v array<string>, z string, us boolean, pos string")
    got = sorted(map(tuple, normalize(df, "forecast", "k", "v", "z", "us").collect()))
    assert got == [("forecast", 1, 0, 1704531600000000)] * 2
    assert normalize(df.limit(0), "forecast", "k", "v", "z", "us").count() == 0


@pytest.mark.parametrize("digits", [6, 200, 300, 5000])
def test_long_values(digits, monkeypatch):
    """Values of any length are read, one or many at once; digits beyond microseconds are cut off."""
    for at_once in (4_000_000, 50):
        monkeypatch.setattr("veldra.operators.timestamps.AT_ONCE", at_once)
        value = "2024-01-06T09:00:00." + "123456" + "9" * (digits - 6) + "Z"
        assert one(value, None, True) == one("2024-01-06T09:00:00.123456Z", None, True)
    junk = ["at " * 20_000 + "9", "2024-01-06 " + "at " * 20_000, "x" * 100_000, "1" * 50_000, "2024-01-06 " + "at " * 3000 + "09:00Z"]
    got = to_utc(pa.array(junk), np.array([None] * 5, object), np.ones(5, bool))
    assert (got[:4] == np.iinfo(np.int64).min).all() and got[4] == 1704531600000000
