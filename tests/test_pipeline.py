import importlib
import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.functions.text import NO_ANSWER
from veldra.operators import embed, forecast, mail, rank, store
from veldra.pipeline import Pipeline, make_index
from veldra.sources import documents, http
from veldra.sources.config import Config, coerce, dotenv, load_given, over_stored, save_given
from veldra.streaming import live

TEXTS = {"graphs": "Small world graphs find near vectors by walking along links. " * 12, "weather": "Rain is likely in the north and wind grows in the evening. " * 12, "food": "The cook adds lime and pepper to the soup of the day. " * 12}


def docs(spark):
    return spark.createDataFrame([(k, v, {"kind": k}) for k, v in TEXTS.items()] + [("empty", "", {}), ("null", None, None)], "id string, text string, metadata map<string,string>")


@pytest.mark.parametrize("kind", ["exact", "ivf", "hnsw"])
def test_ingest_search_answer(spark, tmp_path, kind):
    config = Config(environ={"VELDRA_INDEX_KIND": kind, "VELDRA_INDEX_LISTS": "2", "VELDRA_INDEX_PROBES": "2"})
    p = Pipeline(spark, str(tmp_path / "store"), config)
    asked = spark.createDataFrame([(1, "which links do graphs walk along"), (2, "is rain likely in the evening"), (3, "what does the cook add to the soup")], "query_id bigint, query string")
    assert p.search(asked).count() == 0
    assert {r["answer"] for r in p.answer(asked).collect()} == {NO_ANSWER}
    first = p.ingest(docs(spark))
    again = p.ingest(docs(spark).filter("id = 'food'"))
    assert first["chunks"] == first["total_vectors"] and again["total_vectors"] == first["chunks"] + again["chunks"]
    table = p.stored()
    assert sorted(r["row_id"] for r in table.select("row_id").collect()) == list(range(again["total_vectors"]))
    top = {r["query_id"]: r["doc_id"] for r in p.rerank(p.search(asked, 5), 1).collect()}
    assert top == {1: "graphs", 2: "weather", 3: "food"}
    without = p.search(asked, 5, exclude=table.filter("doc_id = 'weather'").select("row_id"))
    assert without.filter("doc_id = 'weather'").count() == 0
    assert "links" in {r["query_id"]: r["answer"] for r in p.answer(asked).collect()}[1]
    assert p.ingest(docs(spark).limit(0))["chunks"] == 0


def test_ivf_defaults(spark):
    """The lists that follow from the size give every asked neighbour a place and nine of ten exact ones."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((2000, 32))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id bigint, embedding array<float>").cache()
    asked = df.filter("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    index = Config(environ={"VELDRA_INDEX_KIND": "ivf"}).values["index"]
    exact, found = ({tuple(r) for r in make_index(kind, 32, **{x: y for x, y in index.items() if x != "kind"})(asked, df, 50).select("query_id", "id").collect()} for kind in ("exact", "ivf"))
    assert len(found) == len(exact) == 40 * 50
    recall = len(found & exact) / len(exact)
    assert recall >= 0.9
    few = make_index("ivf", 32, lists=500, probes=1)(asked, df, 50)  # goes on until there are fifty
    assert few.count() == 40 * 50


@pytest.mark.parametrize("kind", ["exact", "ivf", "hnsw"])
def test_ingest_again_replaces(spark, tmp_path, kind):
    """A batch that comes twice under one name is in the store, and in the index, once."""
    p = Pipeline(spark, str(tmp_path / "store"), Config(environ={"VELDRA_INDEX_KIND": kind, "VELDRA_INDEX_LISTS": "2", "VELDRA_INDEX_PROBES": "2"}))
    p.ingest(docs(spark).filter("id = 'food'"), "a")
    first = p.ingest(docs(spark), "b")
    again = p.ingest(docs(spark), "b")
    assert again["total_vectors"] == first["total_vectors"] == p.stored().count() == p.stored().select("row_id").distinct().count()
    found = p.search(spark.createDataFrame([(1, "what does the cook add")], "query_id bigint, query string"), 100)
    assert found.count() == found.select("row_id").distinct().count() > 3
    assert set(first["stages"]) == {"chunk_and_embed", "write", "index"}


def test_store(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path / "store"))
    assert p.create().count() == 0 and p.create().count() == 0
    p.ingest(docs(spark))
    assert [r["row_id"] for r in p.vectors([0, 2]).orderBy("row_id").collect()] == [0, 2]
    with pytest.raises(IndexError):
        p.vectors([0, 10_000])
    rows = spark.createDataFrame([("d", 0, "t", 0, 1, {}, [3.0] + [0.0] * 63), ("d", 1, "u", 1, 2, {}, [0.0] * 64)], "doc_id string, chunk_id int, text string, token_start bigint, token_end bigint, metadata map<string,string>, embedding array<float>")
    before = p.stored().count()
    assert p.add_vectors(rows)["total_vectors"] == before + 2
    assert sorted(r["norm"] for r in p.stored().filter("doc_id = 'd'").collect()) == [0.0, 3.0]
    with pytest.raises(ValueError):
        p.add_vectors(rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        Pipeline(spark, str(tmp_path / "other")).stored()


def test_without_rerank_and_with_model(spark, tmp_path):
    """Passages as retrieved; answers of a model, and the offline one where the model fails."""
    config = Config(environ={"VELDRA_RERANKING_ENABLED": "false", "VELDRA_RETRIEVAL_FINAL_K": "2"})

    def call(prompt):
        if "rain" in prompt.split("Question:")[1]:
            raise OSError("down")
        return "model: " + prompt.split("Question: ")[1].split("\n")[0]

    p = Pipeline(spark, str(tmp_path / "store"), config, call)
    p.ingest(docs(spark))
    asked = spark.createDataFrame([(1, "which links do graphs walk along"), (2, "is rain likely in the evening")], "query_id bigint, query string")
    found = p.search(asked)
    kept = p.rerank(found).select("query_id", "row_id", "rank").collect()
    want = found.filter("retrieved_rank < 2").select("query_id", "row_id", "retrieved_rank").collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, want)) and len(kept) == 4
    told = []
    out, seconds = p.answer_timed(asked, lambda name, s: told.append(name))
    assert told == ["retrieve", "rerank", "generate"]
    got = {r["query_id"]: r["answer"] for r in out.collect()}
    assert got[1] == "model: which links do graphs walk along" and "Rain" in got[2]
    assert set(seconds) == {"retrieve", "rerank", "generate", "total"}


def test_scorers(spark):
    df = spark.createDataFrame([(1, 0, "a b", "a b c"), (1, 1, "a b", None), (1, 2, "a b", "x")], "query_id bigint, retrieved_rank int, query string, text string")
    rank.SCORERS["two columns"] = rank.pair_scorer(lambda: lambda pairs: np.array([[9.0, len(p)] for _, p in pairs]), "t")
    rank.SCORERS["one column"] = rank.pair_scorer(lambda: lambda pairs: [-len(p) for _, p in pairs], "o")
    try:
        for name, want in (("two columns", [0, 2, 1]), ("one column", [1, 2, 0]), ("overlap", [0, 1, 2])):
            score = rank.scorer_of(name)(F.col("query"), F.col("text"))
            got = rank.rerank(df, 3, F.coalesce(score, F.lit(0.0))).orderBy("rank").collect()
            assert [r["retrieved_rank"] for r in got] == want
    finally:
        del rank.SCORERS["two columns"], rank.SCORERS["one column"]
    with pytest.raises(ValueError):
        rank.scorer_of("no such")
    sent = []
    call = rank.chat("http://x/", "m", "k", post=lambda url, body, headers: sent.append((url, body["messages"][0]["content"], headers["Authorization"])) or {"choices": [{"message": {"content": "yes"}}]})
    assert call("p") == "yes" and sent == [("http://x/chat/completions", "p", "Bearer k")]


def test_providers(spark):
    calls = []

    def post(url, body, headers):
        calls.append((url, body, headers))
        if "prompt" in body:
            return {"embedding": [float(len(body["prompt"])), 1.0]}
        return {"data": [{"embedding": [3.0, 4.0]} for _ in body["input"]]}

    remote = embed.Remote(embed.Model("r", "openai", 2, source="m", batch=5000, options={"api_key": "k", "base_url": "http://h", "post": post}))
    assert np.allclose(remote.embed(["a"] * 2001), [[0.6, 0.8]] * 2001) and [len(c[1]["input"]) for c in calls] == [2000, 1] and calls[0][0] == "http://h/embeddings"
    local = embed.Local(embed.Model("l", "ollama", 2, source="m", options={"post": post}))
    assert np.allclose(local.embed_query("abc"), np.array([3, 1]) / 10**0.5) and local.embed([]).shape == (0, 2)
    with pytest.raises(ValueError):
        embed.Local(embed.Model("l3", "ollama", 3, source="m", options={"post": post})).embed(["a"])
    with pytest.raises(ValueError):
        embed.Remote(embed.Model("r", "openai", 2)).check()
    for name, library in (("miniLM-L6-v2", "sentence_transformers"), ("e5-base", "sentence_transformers")):
        if importlib.util.find_spec(library) is None:
            with pytest.raises(RuntimeError):
                embed.resolve(name)
    assert isinstance(embed.resolve("no such model"), embed.Hashing) and embed.resolve("hashing", dim=8).model.dim == 8

    @embed.provider("length")
    class Length(embed.Provider):
        def rows(self, loaded, texts):
            return [[len(t), 1] for t in texts]

    embed.register_model(embed.Model("e5-length", "length", 2, normalize=False))
    try:
        df = spark.createDataFrame([("abc",), (None,), ("query: x",)], "t string")
        assert [r["v"] for r in embed.embed(df, "e5-length", "t", "v").collect()] == [[12.0, 1.0], None, [8.0, 1.0]]
        assert embed.embed(df, "e5-length", "t", "v", query=True).first()["v"] == [10.0, 1.0]
    finally:
        del embed.PROVIDERS["length"], embed.MODELS["e5-length"]
    tokens, mask = np.array([[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]]]), np.array([[1, 0], [0, 0]])
    assert embed.masked_mean(tokens, mask).tolist() == [[1.0, 2.0], [0.0, 0.0]]


def test_unknown_index():
    with pytest.raises(ValueError):
        make_index("other", 4)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\n\n{"title": "t", "text": "y"}\n')
    (tmp_path / "b.json").write_text('[{"name": "n", "text": "z"}, {"text": "w"}]')
    (tmp_path / "c.json").write_text('{"id": "one"}')
    (tmp_path / "d.txt").write_text("whole\nfile")
    got = {r["id"]: r for r in documents.scan(spark, [str(tmp_path / n) for n in ("a.jsonl", "b.json", "c.json", "d.txt", "missing.txt", "e.pdf")]).collect()}
    assert {"1", "t", "n", "one", "d"} <= set(got) and len(got) == 6
    assert got["d"]["text"] == "whole\nfile" and got["d"]["metadata"]["source_file"].endswith("d.txt") and json.loads(got["one"]["text"]) == {"id": "one"}
    rows = spark.createDataFrame([("a", None, 3)], "id string, text string, n int")
    assert json.loads(documents.with_defaults(rows).first()["text"]) == {"id": "a", "text": None, "n": 3}
    assert documents.scan(spark, []).count() == 0


def test_json_round_trip(spark):
    df = spark.createDataFrame([(1, "d", 'te"x\nt', 0, 4, None, {"k": "v", "z": "1"}), (2, None, None, None, None, "f", None)], "chunk_id int, doc_id string, text string, token_start int, token_end int, source_file string, extra map<string,string>")
    line = df.select("*", store.encode_json({c: F.col(c) for c in store.KNOWN}, F.col("extra")).alias("line"))
    every, extra = store.decode_json(F.col("line"))
    a, b = line.select("line", extra.alias("e"), every.alias("a")).collect()
    assert json.loads(a["line"]) == {"chunk_id": 1, "doc_id": "d", "text": 'te"x\nt', "token_start": 0, "token_end": 4, "source_file": None, "k": "v", "z": "1"}
    assert a["e"] == {"k": "v", "z": "1"} and b["e"] == {} and a["a"]["text"] == 'te"x\nt'


def test_row_ids(spark):
    df = spark.createDataFrame([(f"d{i % 7}", i) for i in range(500)], "doc string, n bigint")
    rows = store.with_row_ids(df, ["doc", "n"], base=10).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(10, 510)) and [(r["doc"], r["n"]) for r in rows] == sorted((r["doc"], r["n"]) for r in rows)
    assert store.with_row_ids(df.limit(0), ["doc"]).count() == 0


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"index": {"lists": 8}, "own": {"x": 1}}')
    (tmp_path / ".env").write_text("# no\nA=1=2\nbad\n B = x \n")
    c = Config(str(tmp_path / "c.json"), environ={"VELDRA_INDEX_PROBES": "3", "VELDRA_OTHER": "1"})
    assert (c.get("index", "lists"), c.get("index", "probes"), c.get("own", "x"), c.get("no", "such", default=5), c.get("index", "rounds")) == (8, 3, 1, 5, 20)
    assert [coerce(x) for x in ("TRUE", "7", "7.5", "x")] == [True, 7, 7.5, "x"]
    assert dotenv(str(tmp_path / ".env")) == {"A": "1=2", "B": "x"} and dotenv(str(tmp_path / "none")) == {}
    assert over_stored({"a": 1, "b": 2}, {"a": None, "b": 3, "c": False}) == {"a": 1, "b": 3}
    save_given(str(tmp_path / "x" / "given.json"), {"k": 5})
    assert load_given(str(tmp_path / "x" / "given.json")) == {"k": 5} and load_given(str(tmp_path / "none")) == {}
    (tmp_path / "c.yaml").write_text("index:\n  lists: 9\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            Config(str(tmp_path / "c.yaml"), environ={})
    else:
        assert Config(str(tmp_path / "c.yaml"), environ={}).get("index", "lists") == 9


def test_web(spark):
    waits = []
    calls = iter([OSError(), OSError(), "ok"])

    def flaky():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert http.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    calls, waits[:] = iter([http.TooMany(), "ok"]), []
    assert http.with_retries(flaky, sleep=waits.append) == "ok" and waits == [60.0]
    with pytest.raises(KeyError):
        http.with_retries(lambda: {}["no"], sleep=lambda s: pytest.fail("an error that stays isn't tried again"))
    assert http.geocode(lambda u: json.dumps({"results": [{"name": "Paris"}]} if "name=Paris" in u and "TX" not in u else {}), "Paris, TX")["name"] == "Paris"
    assert http.geocode(lambda u: "{}", "x") is None
    assert http.forecast(lambda u: "{}", 1.0, 2.0, "UTC")["time"] is None
    rss = "<rss><channel><item><title>a</title><link>l</link></item><item><title>b</title></item></channel></rss>"
    spark.dataSource.register(http.news_source(lambda u: rss, 1))
    assert [r["title"] for r in spark.read.format("news").option("keys", '["q1", "q2"]').load().collect()] == ["a", "a"]


def test_places_and_results(spark):
    elements = {"elements": [{"id": 5, "type": "node", "lat": 1.0, "lon": 2.0, "tags": {"name": "Inn", "amenity": "cafe"}}, {"id": 6, "type": "way", "center": {"lat": 3.0, "lon": 4.0}, "tags": {"name": "Bar"}}, {"id": 7, "type": "node", "lat": 1.0, "lon": 2.0}]}
    asked = []

    def fetch(url):
        asked.append(url)
        if "nominatim" in url:
            return json.dumps([{"lat": "1.5", "lon": "2.5", "display_name": "X"}] if "here" in url else [])
        return json.dumps(elements)

    assert http.nominatim(fetch, "here") == {"lat": 1.5, "lon": 2.5, "display_name": "X"} and http.nominatim(fetch, "atlantis") is None
    spark.dataSource.register(http.places_source(fetch, metres=700, most=3))
    got = spark.read.format("places").option("keys", '["here", "atlantis"]').load().collect()
    assert [(r["query"], r["osm_id"], r["name"], r["lat"]) for r in got] == [("here", 5, "Inn", 1.0), ("here", 6, "Bar", 3.0)]
    wanted = http.place_query(1.5, 2.5, 700, most=3)
    assert "around:700,1.5,2.5" in wanted and wanted.endswith("out center 3;") and "restaurant|cafe" in wanted
    page = """<div><a class="result__a" href="//d.com/l/?uddg=https%3A%2F%2Fa.org%2Fx&rut=1">First <b>hit</b></a><a class="result__snippet" href="y">Some  text</a></div>
      <div><a class="result__a" href="https://b.org">Second</a></div><a class="result__a" href="">None</a><a class="result__a" href="https://c.org">Third</a><div class="result__snippet">last</div>"""
    assert http.result_rows(page) == [("First hit", "https://a.org/x", "Some text"), ("Second", "https://b.org", ""), ("Third", "https://c.org", "last")]
    assert len(http.result_rows(page, 1)) == 1 and http.result_rows("") == []
    spark.dataSource.register(http.results_source(lambda u: page, 2))
    assert spark.read.format("results").option("keys", '["q"]').load().count() == 2


def test_forecast_source(spark):
    def fetch(url):
        if "geocoding" in url:
            return json.dumps({"results": [{"name": "Paris", "latitude": 48.9, "longitude": 2.3, "timezone": "Europe/Paris"}]} if "Paris" in url or "Lyon" in url else {})
        if "broken" in url:
            raise ValueError("bad")
        return json.dumps({"hourly": {"time": ["2024-05-01T00:00"], "temperature_2m": [60.5], "precipitation_probability": [10], "precipitation": [0.0]}})

    spark.dataSource.register(http.forecast_source(fetch))
    rows = spark.read.format("forecast").option("keys", '["Paris, TX", "Atlantis"]').load()
    got = {r["query"]: r for r in rows.collect()}
    assert got["Paris, TX"]["hourly"]["temperature_2m"] == [60.5] and got["Paris, TX"]["timezone"] == "Europe/Paris"
    assert (got["Atlantis"]["status"], got["Atlantis"]["error"], got["Atlantis"]["hourly"]) == ("error", "unknown city", None)
    hours = forecast.current_hour(rows.filter("status = 'ok'"), F.lit(datetime(2024, 5, 1)))
    assert hours.first()["temperature"] == 60.5


def kept_in(folder):
    """Connection to a mail server that keeps what it is sent in a folder, and refuses one recipient."""

    class Server:
        def send_message(self, m):
            if m["To"] == "bad@x":
                raise OSError("refused")
            (folder / f"{m['To']}.eml").write_bytes(m.as_bytes())

        def quit(self):
            (folder / "quit").write_text("")

    return lambda sender: Server()


def test_mail(spark, tmp_path):
    (tmp_path / "a.txt").write_text("attached")
    rows = spark.createDataFrame([("a@x", "Hi", "<p>é</p>", [str(tmp_path / "a.txt"), str(tmp_path / "none")]), ("bad@x", "Hi", "b", None), ("c@x", None, "c", [])], "recipient string, subject string, html string, attachments array<string>").coalesce(1)
    assert {r["status"] for r in mail.send(rows, mail.Sender("me@x")).collect()} == {"dry_run"}
    sender = mail.Sender("me@x", "Me", dry_run=False, connect=kept_in(tmp_path))
    got = [tuple(r) for r in mail.send(rows, sender).collect()]
    assert got == [("sent", "a@x", "Hi", None), ("failed", "bad@x", "Hi", "refused"), ("sent", "c@x", "Weather Alert", None)]
    text = (tmp_path / "a@x.eml").read_text()
    assert "From: Me <me@x>" in text and "text/html" in text and 'filename="a.txt"' in text and "none" not in text and (tmp_path / "quit").exists()
    hour = spark.createDataFrame([("A<b>", 0.0, 80.0, 0.125, True)], "city string, temperature double, probability double, amount double, rain_likely boolean")
    body = hour.select(forecast.html_body("<i>x</i>").alias("h")).first()["h"]
    assert "A&lt;b&gt;" in body and "N/A °F" in body and "80.0%" in body and "0.13 in" in body and "<td>Yes</td>" in body and "<i>x</i>" in body


def test_cached_lookups(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", 0), ("a", 50), ("a", 100), ("b", 0), ("b", 5), ("a", 149), ("b", 20)]
    spark.createDataFrame([(k, start + timedelta(seconds=s)) for k, s in rows], "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "r"))

    def look(key):
        if key == "b":
            raise ValueError("no b")
        return "value of " + key

    stream = live.read_files(spark, str(tmp_path / "r"), "key string, ts timestamp")
    live.cached_lookups(stream, look, 100, 10).writeStream.format("memory").queryName("looked").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["key"], int((r["ts"] - start).total_seconds()), r["value"], r["error"], r["hit"]) for r in spark.table("looked").collect())
    v = "value of a"
    assert got == [("a", 0, v, None, False), ("a", 50, v, None, True), ("a", 100, v, None, False), ("a", 149, v, None, True), ("b", 0, None, "no b", False), ("b", 5, None, "no b", True), ("b", 20, None, "no b", False)]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    docs(spark).write.parquet(source)
    p = Pipeline(spark, str(tmp_path / "store"))
    schema = "id string, text string, metadata map<string,string>"
    for _ in range(2):  # the second run finds nothing new
        live.ingest(live.read_files(spark, source, schema), p, str(tmp_path / "cp")).awaitTermination()
    assert p.stored().select("doc_id").distinct().count() == 4 and p.stored().count() == p.stored().select("row_id").distinct().count()
    start = datetime(2024, 1, 1)
    events = str(tmp_path / "events")
    rows = [(i, start + timedelta(minutes=7 * i), i % 3, "click", 1.0) for i in range(200)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(events)
    stream = live.read_files(spark, events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    q = live.hourly_counts(stream).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.table("hours").agg(F.sum("n")).first()[0]
    assert 150 < closed <= 200
    q = live.first_in_ttl(stream, ["user_id"]).writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 3


def test_alert_stream(spark, tmp_path):
    schema = "city string, fetched_at timestamp, recipient string, hourly struct<time array<string>, temperature_2m array<double>, precipitation_probability array<double>, precipitation array<double>>"
    rows = [("wet", datetime(2024, 5, 1, 13), "a@b", (["2024-05-01T13:00"], [70.0], [90.0], [0.0])), ("dry", datetime(2024, 5, 1, 13), "a@b", (["2024-05-01T13:00"], [70.0], [0.0], [0.0]))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "f"))
    live.alerts(live.read_files(spark, str(tmp_path / "f"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["subject"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Weather alert for wet"]
    sender = mail.Sender("me@x", dry_run=False, connect=kept_in(tmp_path))
    live.send_alerts(live.read_files(spark, str(tmp_path / "f"), schema), sender, str(tmp_path / "sent"), str(tmp_path / "cp2")).awaitTermination()
    assert [(r["status"], r["recipient"]) for r in spark.read.parquet(str(tmp_path / "sent")).collect()] == [("sent", "a@b")] and (tmp_path / "a@b.eml").exists()
