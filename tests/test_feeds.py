import math
import random

import numpy as np
from datetime import UTC, datetime
from email.utils import format_datetime

import pytest
from pyspark.sql import functions as F

from veldra.operators import feeds, forecast, ordered, quality


def test_mail_dates(spark):
    at = datetime(2024, 2, 29, 23, 5, 7, tzinfo=UTC)
    rows = [(format_datetime(at),), ("29 Feb 2024 18:05:07 -0500",), ("30 Feb 2024 18:05:07 GMT",), ("Thu, 29 Xyz 2024 18:05:07 GMT",), ("yesterday",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(feeds.mail_epoch(F.col("d"))).collect()]
    assert got == [int(at.timestamp())] * 2 + [None] * 4


def test_dedupe_order_matters(spark):
    rows = [(1, "a", "s", 10), (2, "a", "s", 99), (3, "b", "s", 99), (4, "", "s", 99), (5, None, "s", 99), (6, "c", None, None)]
    df = spark.createDataFrame(rows, "item bigint, title string, source string, epoch bigint")
    firsts = feeds.dedupe(df, ["title", "source"], ["item"])
    assert sorted(r["item"] for r in firsts.collect()) == [1, 3, 6]
    assert sorted(r["item"] for r in feeds.recent(firsts, F.col("epoch"), 100, 0).collect()) == [6]
    assert feeds.dedupe(df.limit(0), ["title"], ["item"]).count() == 0


def test_fallback(spark):
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert sorted(map(tuple, feeds.with_fallback(a, b, "k").collect())) == [("x", 1), ("y", 3)]


@pytest.mark.parametrize("lat,lon", [(0.0, 179.99), (10.0, -179.99), (85.0, 20.0), (-60.0, 0.0)])
def test_radius(spark, monkeypatch, lat, lon):
    rng = random.Random(7)
    places = [(i, lat + rng.uniform(-0.08, 0.08), (lon + rng.uniform(-0.8, 0.8) + 180) % 360 - 180) for i in range(3000)] + [(9999, None, 1.0)]
    df = spark.createDataFrame(places, "rec bigint, lat double, lon double")
    centres = spark.createDataFrame([(1, lat, lon), (2, None, None)], "centre bigint, clat double, clon double")

    def metres(a, b):
        h = math.sin(math.radians(a - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(a)) * math.sin(math.radians(b - lon) / 2) ** 2
        return 2 * feeds.EARTH_M * math.asin(math.sqrt(min(1, h)))

    want = sorted(i for i, a, b in places if a is not None and metres(a, b) <= 5000)
    assert want and sorted(r["rec"] for r in feeds.within(df, centres, 5000).collect()) == want
    monkeypatch.setattr(feeds, "HOT_PLACES", 40)  # cells are cut, with the same result
    assert sorted(r["rec"] for r in feeds.within(df, centres, 5000).collect()) == want


def test_forecast(spark):
    schema = "city string, fetched_at timestamp, recipient string, hourly struct<time array<string>, temperature_2m array<double>, precipitation_probability array<double>, precipitation array<double>>"
    now = datetime(2024, 5, 1, 13, 30)
    hours = ["2024-05-01T12:00", None, "2024-05-01T13:00"]
    rows = [
        ("rain", now, "a@b", (hours, [60.0, 61.0, 72.0], [0.0, 0.0, 80.0], [0.0, 0.0, 0.12])), ("dry", now, "a@b", (hours, [65.0], [10.0], [0.0])), ("other day", now, "", (["2024-05-02T00:00"], [0.0], None, [0.5])),
        ("none", now, "a@b", ([], None, None, None)), ("null", now, "a@b", None),
    ]
    got = {r["city"]: r for r in forecast.current_hour(spark.createDataFrame(rows, schema), F.col("fetched_at")).collect()}
    assert set(got) == {"rain", "dry", "other day"}
    assert (got["rain"]["temperature"], got["rain"]["probability"], got["rain"]["rain_likely"]) == (72.0, 80.0, True)
    assert (got["dry"]["temperature"], got["dry"]["probability"], got["dry"]["rain_likely"]) == (None, 0.0, False)
    assert (got["other day"]["time"], got["other day"]["rain_likely"]) == ("2024-05-02T00:00", True)
    sent = forecast.outbox(forecast.current_hour(spark.createDataFrame(rows, schema), F.col("fetched_at")), F.col("recipient")).collect()
    assert [r["city"] for r in sent] == ["rain"] and "Amount: 0.12 in" in sent[0]["body"]


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [(g, p, rng.randint(0, 3)) for g in "ab" for p in rng.sample(range(9000), 400)]
    got = {(r["g"], r["p"]): r["s"] for r in ordered.running_sum(spark.createDataFrame(rows, "g string, p bigint, v bigint"), "g", "p", F.col("v"), "s", span=500).collect()}
    assert all(got[g, p] == sum(v for h, q, v in rows if h == g and q <= p) for g, p, _ in rows)


def test_islands(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 20_000)) for g in "ab" for _ in range(150)] + [("a", 5), ("a", 5)]
    got = {}
    for r in ordered.islands(spark.createDataFrame(rows, "g string, p bigint"), "g", "p", 120, "i", span=300).collect():
        got.setdefault((r["g"], r["i"]), []).append(r["p"])
    want = []
    for g in "ab":
        last = None
        for p in sorted(p for h, p in rows if h == g):
            if last is None or p - last >= 120:
                want.append([])
            want[-1].append(p)
            last = p
    assert sorted(sorted(v) for v in got.values()) == sorted(want)


def test_calls_in_window(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randint(0, 2000)) for i in range(500)]
    got = {r["i"]: r["calls"] for r in quality.calls_in_window(spark.createDataFrame(rows, "i int, u string, s bigint"), "u", F.col("s"), 60).collect()}
    assert all(got[i] == sum(1 for _, v, t in rows if v == u and s - 59 <= t <= s) for i, u, s in rows)


def test_redact(spark):
    got = spark.createDataFrame([("Write to a.b@c.org or +1 (555) 123-4567, pay $1,200.50.",)], "t string").select(quality.redact(F.col("t"))).first()[0]
    assert got == "Write to [EMAIL] or [PHONE], pay [AMOUNT]."


def test_percentiles(spark):
    rng = random.Random(7)
    rows = [(g, rng.choice([rng.gauss(0, 1), 3.0, 3.0, -1.0]) if g != "one" else 4.0) for g in "ab" for _ in range(700)] + [("one", 4.0), ("b", None)]
    got = {r["g"]: r for r in quality.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p0": 0.0, "p37": 0.37, "p99": 0.99, "p100": 1.0}, spans=20).collect()}
    for g in ("a", "b", "one"):
        v = [x for h, x in rows if h == g and x is not None]
        assert got[g]["n"] == len(v) and all(abs(got[g][f"p{p}"] - np.quantile(v, p / 100)) < 1e-9 for p in (0, 37, 99, 100))
    assert quality.percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", {"p": 0.5}).count() == 0


def test_limits_by_kind(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 3.0), ("b", 5.0), (None, 9.0), ("a", None)], "k string, v double")
    got = sorted((r["k"] or "", r["v"], r["limit"], r["excess"]) for r in quality.over_limit(df, "k", F.col("v"), {"a": 4}, 6).collect())
    assert got == [("", 9.0, 6.0, 3.0), ("a", 5.0, 4.0, 1.0)] and quality.over_limit(df, "k", F.col("v"), {}, 4).count() == 3
    live = quality.live_by_kind(df, "k", F.col("v"), 7, {"a": 3}, 10)
    assert sorted((r["k"], r["v"]) for r in live.collect()) == [("a", 5.0), ("b", 5.0)]
