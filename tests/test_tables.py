import json

from veldra.functions import tables
from veldra.operators import chunking

RSS = "<rss><channel><item><title>a</title><link>l</link></item><item><title>b</title></item></channel></rss>"


def fetch(place="X"):
    def get(url):
        if "geocoding" in url:
            return json.dumps({"results": [{"name": place, "latitude": 1.0, "longitude": 2.0, "timezone": "UTC"}]} if "Paris" in url else {})
        if "forecast" in url:
            return json.dumps({"hourly": {"time": ["2024-05-01T00:00", "2024-05-01T01:00"], "temperature_2m": [60, None], "precipitation_probability": [10, 20], "precipitation": [0.0, 0.5]}})
        if "rss" in url:
            return RSS
        if "nominatim" in url:
            return json.dumps([{"lat": "1.5", "lon": "2.5"}] if "Paris" in url else [])
        return json.dumps({"elements": [{"id": 5, "type": "node", "lat": 1.0, "lon": 2.0, "tags": {"name": "Inn"}}, {"id": 6}]})

    return get


def test_chunks(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, text string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, c.* FROM texts, LATERAL chunk_text(text, 4, 1) c").collect()
    assert [(r["id"], r["chunk_id"], r["chunk"], r["token_start"], r["token_end"]) for r in rows] == [(1, 0, "abcd", 0, 1), (1, 1, "defg", 1, 2), (1, 2, "ghij", 2, 3), (1, 3, "j", 3, 3)]
    long = spark.createDataFrame([(1, "One two. Three é four.\n\nFive " * 9), (2, ""), (3, None)], "doc_id int, text string")
    long.createOrReplaceTempView("long")
    got = spark.sql("SELECT doc_id, c.* FROM long, LATERAL chunk_recursive(text, 30, 5) c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.chunk(long, size=30, overlap=5).collect()))
    assert [r["sentence"] for r in spark.sql("SELECT * FROM sentences('One. Two!  Three')").collect()] == ["One.", "Two!", "Three"]


def test_tools(spark):
    tables.register(spark, fetch())
    spark.createDataFrame([("Paris",), ("Atlantis",), (None,)], "city string").createOrReplaceTempView("cities")
    assert [tuple(r) for r in spark.sql("SELECT city, g.name, g.latitude FROM cities, LATERAL geocode(city) g").collect()] == [("Paris", "X", 1.0)]
    assert [tuple(r) for r in spark.sql("SELECT city, w.* FROM cities, LATERAL weather(city) w").collect()] == [("Paris", "2024-05-01T00:00", 60.0, 10.0, 0.0), ("Paris", "2024-05-01T01:00", None, 20.0, 0.5)]
    assert [r["title"] for r in spark.sql("SELECT * FROM news('flu')").collect()] == ["a", "b"]
    assert [(r["osm_id"], r["name"]) for r in spark.sql("SELECT f.* FROM cities, LATERAL food_near(city) f").collect()] == [(5, "Inn")]
