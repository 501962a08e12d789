"""Batch readers of web sources as Python data sources: requests with retries, one partition per request.

``fetch`` is any function from a URL to a text, so tests and closed networks give their own; the default uses the standard library.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Addresses and parameters of the public services.
GEOCODE = "https://geocoding-api.open-meteo.com/v1/search?count=1&name={}"
FORECAST = "https://api.open-meteo.com/v1/forecast?latitude={}&longitude={}&hourly=temperature_2m,precipitation_probability,precipitation&temperature_unit=fahrenheit&precipitation_unit=inch&timezone={}&forecast_days=1"
NEWS = "https://news.google.com/rss/search?q={}"
PLACES = "https://overpass-api.de/api/interpreter?data={}"
NOMINATIM = "https://nominatim.openstreetmap.org/search?format=json&limit=1&q={}"
RESULTS = "https://html.duckduckgo.com/html/?q={}"
FOOD = "restaurant|cafe|fast_food|food_court"
AGENT = "veldra/1.0"


class TooMany(OSError):
    """The service asked for a pause (status 429)."""


def _open(request: urllib.request.Request) -> str:
    try:
        with urllib.request.urlopen(request, timeout=30) as answer:  # noqa: S310 - https addresses above, or the caller's
            return answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        if e.code == 429:
            raise TooMany(str(e)) from e
        raise


def default_fetch(url: str) -> str:
    return _open(urllib.request.Request(url, headers={"User-Agent": AGENT}))


def post_json(url: str, body: dict, headers: dict[str, str]) -> dict:
    return json.loads(_open(urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "User-Agent": AGENT, **headers})))


#: What is worth another try; other errors are raised at once.
TRANSIENT = (OSError, TimeoutError)


def with_retries(call: Callable[[], Any], attempts: int = 3, pause: float = 1.0, cool: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls until it succeeds, waiting twice as long each time, or ``cool`` seconds where the service asked for a pause; the last error is raised."""
    for n in range(attempts):
        try:
            return call()
        except TRANSIENT as e:
            if n == attempts - 1:
                raise
            sleep(cool if isinstance(e, TooMany) or "429" in str(e) else pause * 2**n)
    raise ValueError("no attempts")


def geocode(fetch: Callable[[str], str], city: str) -> dict | None:
    """The first hit for a city as given, else for what stands before its comma."""
    for name in dict.fromkeys((city.strip(), city.split(",")[0].strip())):
        results = json.loads(with_retries(lambda n=name: fetch(GEOCODE.format(urllib.parse.quote(n))))).get("results")
        if results:
            return {k: results[0].get(k) for k in ("name", "admin1", "country", "latitude", "longitude", "timezone")}
    return None


def forecast(fetch: Callable[[str], str], latitude: float, longitude: float, zone: str) -> dict:
    hourly = json.loads(with_retries(lambda: fetch(FORECAST.format(latitude, longitude, urllib.parse.quote(zone))))).get("hourly") or {}
    return {k: hourly.get(k) for k in ("time", "temperature_2m", "precipitation_probability", "precipitation")}


def feed_items(xml: str, most: int | None = None) -> Iterator[dict]:
    """Items of an RSS text."""
    for n, item in enumerate(ElementTree.fromstring(xml).iter("item")):  # noqa: S314 - data of the caller's source
        if most is not None and n >= most:
            return
        yield {k: item.findtext(tag) or "" for k, tag in (("title", "title"), ("source", "source"), ("date", "pubDate"), ("snippet", "description"), ("url", "link"))}


class _Request(InputPartition):
    def __init__(self, key: str):
        super().__init__(key)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, rows: Callable[[str, Callable[[str], str]], Iterator[tuple]], fetch: Callable[[str], str]):
        self.keys, self.rows, self.fetch = json.loads(options["keys"]), rows, fetch

    def partitions(self):
        return [_Request(k) for k in self.keys]

    def read(self, partition):
        yield from self.rows(partition.value, self.fetch)


def source(kind: str, schema_text: str, rows: Callable, fetch: Callable[[str], str] = default_fetch) -> type[DataSource]:
    """A data source class to register; option ``keys`` is a JSON list of queries, one partition each."""

    class Web(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return schema_text

        def reader(self, schema):
            return _Reader(self.options, rows, fetch)

    return Web


def geocode_source(fetch: Callable[[str], str] = default_fetch) -> type[DataSource]:
    def rows(city: str, get: Callable[[str], str]) -> Iterator[tuple]:
        hit = geocode(get, city)
        yield (city, "ok" if hit else "error", *((hit or {}).get(k) for k in ("name", "admin1", "country", "latitude", "longitude", "timezone")))

    return source("geocode", "query string, status string, name string, admin1 string, country string, latitude double, longitude double, timezone string", rows, fetch)


def news_source(fetch: Callable[[str], str] = default_fetch, most: int | None = None) -> type[DataSource]:
    def rows(query: str, get: Callable[[str], str]) -> Iterator[tuple]:
        xml = with_retries(lambda: get(NEWS.format(urllib.parse.quote(query))))
        for item in feed_items(xml, most):
            yield (query, item["title"], item["source"], item["date"], item["snippet"], item["url"])

    return source("news", "query string, title string, source string, date string, snippet string, url string", rows, fetch)


def forecast_source(fetch: Callable[[str], str] = default_fetch) -> type[DataSource]:
    """City to coordinates to hours: a row for each city, with what went wrong if no hours came."""

    def rows(city: str, get: Callable[[str], str]) -> Iterator[tuple]:
        hit, hours, error = None, None, None
        try:
            hit = geocode(get, city)
            hours = forecast(get, hit["latitude"], hit["longitude"], hit["timezone"] or "auto") if hit else None
            error = None if hours and hours["time"] else "unknown city" if hit is None else "no hours"
        except (OSError, ValueError) as e:
            error = str(e)
        place = hit or {}
        values = None if error else tuple(hours[k] for k in ("time", "temperature_2m", "precipitation_probability", "precipitation"))
        yield (city, "error" if error else "ok", error, place.get("name"), place.get("latitude"), place.get("longitude"), place.get("timezone"), values)

    hourly = "struct<time:array<string>,temperature_2m:array<double>,precipitation_probability:array<double>,precipitation:array<double>>"
    return source("forecast", f"query string, status string, error string, city string, latitude double, longitude double, timezone string, hourly {hourly}", rows, fetch)


def place_query(lat: float, lon: float, metres: int = 5000, kinds: str = FOOD, most: int = 10) -> str:
    """Query text for nodes and ways of some kinds around a point; radius, kinds and limit are left to the service."""
    around = f'["amenity"~"{kinds}"](around:{metres},{lat},{lon});'
    return f"[out:json][timeout:15];(node{around}way{around});out center {most};"


def nominatim(fetch: Callable[[str], str], place: str) -> dict | None:
    hits = json.loads(with_retries(lambda: fetch(NOMINATIM.format(urllib.parse.quote(place)))))
    return {"lat": float(hits[0]["lat"]), "lon": float(hits[0]["lon"]), "display_name": hits[0].get("display_name", place)} if hits else None


def nominatim_source(fetch: Callable[[str], str] = default_fetch) -> type[DataSource]:
    def rows(place: str, get: Callable[[str], str]) -> Iterator[tuple]:
        hit = nominatim(get, place) or {}
        yield (place, "ok" if hit else "error", hit.get("display_name"), hit.get("lat"), hit.get("lon"))

    return source("nominatim", "query string, status string, display_name string, lat double, lon double", rows, fetch)


def place_rows(text: str) -> Iterator[tuple]:
    """Elements of an answer: id, type, name, tags, position (of a way, its centre)."""
    for e in json.loads(text).get("elements", []):
        at, tags = e.get("center") or e, e.get("tags") or {}
        yield (e.get("id"), e.get("type"), tags.get("name", ""), tags, at.get("lat"), at.get("lon"))


PLACE = "osm_id bigint, type string, name string, tags map<string,string>, lat double, lon double"


def places_source(fetch: Callable[[str], str] = default_fetch, metres: int = 5000, kinds: str = FOOD, most: int = 10) -> type[DataSource]:
    """Named places around each location: found by name, then asked for by radius, kinds and limit."""

    def rows(place: str, get: Callable[[str], str]) -> Iterator[tuple]:
        hit = nominatim(get, place)
        if hit:
            wanted = place_query(hit["lat"], hit["lon"], metres, kinds, most)
            for row in place_rows(with_retries(lambda: get(PLACES.format(urllib.parse.quote(wanted))))):
                if row[2]:
                    yield (place, *row)

    return source("places", f"query string, {PLACE}", rows, fetch)


class _Results(HTMLParser):
    """Links of class ``result__a`` with the snippet that follows each before the next."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict[str, str]] = []
        self.into: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = dict(attrs)
        kinds = (have.get("class") or "").split()
        if tag == "a" and "result__a" in kinds:
            self.found.append({"url": target(have.get("href") or ""), "title": "", "snippet": ""})
            self.into = "title"
        elif "result__snippet" in kinds and self.found:
            self.into = "snippet"

    def handle_data(self, data: str) -> None:
        if self.into and self.found:
            self.found[-1][self.into] += data

    def handle_endtag(self, tag: str) -> None:
        if tag in ("a", "div"):
            self.into = None


def target(href: str) -> str:
    """The address that a result link leads to, out of its redirection."""
    return urllib.parse.parse_qs(urllib.parse.urlsplit(href).query).get("uddg", [href])[0]


def result_rows(html: str, most: int = 5) -> list[tuple[str, str, str]]:
    """``(title, url, snippet)`` of a result page; links without a title or an address are left out."""
    page = _Results()
    page.feed(html)
    rows = [tuple(re.sub(r"\s+", " ", x[k]).strip() for k in ("title", "url", "snippet")) for x in page.found]
    return [r for r in rows if r[0] and r[1]][:most]


def results_source(fetch: Callable[[str], str] = default_fetch, most: int = 5) -> type[DataSource]:
    def rows(query: str, get: Callable[[str], str]) -> Iterator[tuple]:
        for row in result_rows(with_retries(lambda: get(RESULTS.format(urllib.parse.quote(query)))), most):
            yield (query, *row)

    return source("results", "query string, title string, url string, snippet string", rows, fetch)
