"""Table functions for SQL callers: chunks of a text, and the web tools with a replaceable ``fetch``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from veldra.sources import http

CHUNKS = "chunk_id int, chunk string, token_start bigint, token_end bigint"


def _numbered(pieces: list[str]) -> Iterator[tuple]:
    at = 0
    for n, piece in enumerate(pieces):
        yield n, piece, at, at + len(piece) // 4
        at += len(piece) // 4


@udtf(returnType=CHUNKS)
class ChunkText:
    """Fixed windows of a text: ``SELECT * FROM docs, LATERAL chunk_text(text, 512, 50)``."""

    def eval(self, text: str, size: int, overlap: int):
        if not 0 <= overlap < size:
            raise ValueError("the overlap must be under the chunk size")
        yield from _numbered([text[i : i + size] for i in range(0, len(text or ""), size - overlap)])


@udtf(returnType=CHUNKS)
class ChunkRecursive:
    """Chunks at the strongest separators: ``LATERAL chunk_recursive(text, 512, 50)``."""

    def eval(self, text: str, size: int, overlap: int):
        import numpy as np

        from veldra.operators import chunking

        if not 0 <= overlap < size:
            raise ValueError("the overlap must be under the chunk size")
        if text:
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            span, _, of, bounds = chunking._cut(chars, np.zeros(1, np.int64), np.array([len(chars)]), chunking.SEPARATORS, size, overlap)
            pieces = [""] * len(span)
            for chunk, (a, b) in zip(of.tolist(), bounds.tolist()):
                pieces[chunk] += text[a:b]
            yield from _numbered(pieces)


@udtf(returnType="pos int, sentence string")
class Sentences:
    """Sentences of a text: ``LATERAL sentences(text)``."""

    def eval(self, text: str):
        import re

        for n, s in enumerate(s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text or "")) if s):
            yield n, s


def tools(fetch: Callable[[str], str] = http.default_fetch, news_most: int = 10) -> dict[str, type]:
    """The four web tools as table functions: ``geocode(city)``, ``weather(city)``, ``news(query)``, ``food_near(place)``; nothing found, or null, gives no row."""

    class Geocode:
        def eval(self, city: str):
            hit = http.geocode(fetch, city) if city else None
            if hit:
                yield tuple(hit[k] for k in ("name", "admin1", "country", "latitude", "longitude", "timezone"))

    class Weather:
        def eval(self, city: str):
            hit = http.geocode(fetch, city) if city else None
            hours = http.forecast(fetch, hit["latitude"], hit["longitude"], hit["timezone"] or "auto") if hit else {}
            for row in zip(*(hours.get(k) or [] for k in ("time", "temperature_2m", "precipitation_probability", "precipitation"))):
                yield (row[0], *(None if x is None else float(x) for x in row[1:]))

    class News:
        def eval(self, query: str):
            if query:
                xml = http.with_retries(lambda: fetch(http.NEWS.format(http.urllib.parse.quote(query))))
                for item in http.feed_items(xml, news_most):
                    yield tuple(item[k] for k in ("title", "source", "date", "snippet", "url"))

    class FoodNear:
        def eval(self, place: str):
            hit = http.nominatim(fetch, place) if place else None
            if hit:
                answer = http.with_retries(lambda: fetch(http.PLACES.format(http.urllib.parse.quote(http.place_query(hit["lat"], hit["lon"])))))
                yield from (row for row in http.place_rows(answer) if row[2])

    kinds = {
        "geocode": (Geocode, "name string, admin1 string, country string, latitude double, longitude double, timezone string"), "weather": (Weather, "time string, temperature double, probability double, amount double"),
        "news": (News, "title string, source string, date string, snippet string, url string"), "food_near": (FoodNear, http.PLACE),
    }
    return {name: udtf(kind, returnType=schema) for name, (kind, schema) in kinds.items()}


def register(spark: SparkSession, fetch: Callable[[str], str] = http.default_fetch) -> None:
    for name, function in {"chunk_text": ChunkText, "chunk_recursive": ChunkRecursive, "sentences": Sentences, **tools(fetch)}.items():
        spark.udtf.register(name, function)
