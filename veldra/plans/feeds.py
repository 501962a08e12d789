"""Queries over feeds, places, forecasts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.operators import feeds, forecast, ordered, quality
from veldra.runtime import broadcast_checked, read_table

NOW = 1_748_736_000  # 2025-06-01 00:00:00 UTC, the clock of the queries
RADIUS = 5000.0
#: Limits of the queries: days by priority, seconds by kind of event.
DAYS = {"1-URGENT": 60.0, "2-HIGH": 75.0, "3-MEDIUM": 90.0}
HOURS = {"error": 3 * 86_400, "click": 7200}


def _news(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "news_items")


def _dated(spark, d) -> DataFrame:
    return _news(spark, d).withColumn("epoch", feeds.mail_epoch(F.col("date")))


def _places(spark, d) -> DataFrame:
    return read_table(spark, d, "osm_places")


def _events(spark, d) -> DataFrame:
    return read_table(spark, d, "events").withColumn("second", F.unix_timestamp(F.col("ts").cast("timestamp")))


def rfc2822(spark, d):
    return _dated(spark, d).filter("epoch is not null").select("item_id", "epoch")


def feed_dedupe(spark, d):
    return feeds.dedupe(_news(spark, d), ["title", "url"], ["fetched_at", "item_id"]).select("item_id", "title", "url")


def feed_dedupe_then_filter(spark, d):
    """First of each title in its feed, then the recent ones: an old copy hides a newer one."""
    firsts = feeds.dedupe(_dated(spark, d), ["title", "source"], ["fetched_at", "item_id"])
    return feeds.recent(firsts, F.col("epoch"), NOW, 365).select("item_id", "title")


def recency_filter(spark, d):
    return feeds.recent(_dated(spark, d), F.col("epoch"), NOW, 180).select("item_id")


def latest_events(spark, d):
    """The fifteen latest items; those without a date come last."""
    return _dated(spark, d).select("item_id", F.coalesce("epoch", F.lit(0).cast("bigint")).alias("epoch")).orderBy(F.desc("epoch"), "item_id").limit(15)


def ci_dedupe(spark, d):
    return feeds.dedupe_name(_places(spark, d), "name", ["rec_id"]).select("rec_id", F.lower("name").alias("name"))


def fallback_source(spark, d):
    rows = _places(spark, d).filter("city is not null").select("city", "rec_id", "amenity")
    return feeds.with_fallback(rows.filter("amenity = 'fast_food'"), rows.filter("amenity = 'restaurant'"), "city")


def regex_filter(spark, d):
    return _places(spark, d).filter(F.col("amenity").rlike(feeds.FOOD)).select("rec_id", "amenity")


def geo_radius(spark, d):
    """Records within five kilometres of the places whose number is divisible by 20."""
    centres = _places(spark, d).filter("rec_id % 20 = 0").select(F.col("rec_id").alias("centre"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    return feeds.within(_places(spark, d).select("rec_id", "lat", "lon"), centres, RADIUS).select("centre", "rec_id", F.round("metres", 2).alias("metres"))


def geo_candidates(spark, d):
    """Names under which a city is looked up: as given, then without what follows the comma."""
    city = F.trim(F.concat_ws(", ", "city", "admin1"))
    rows = read_table(spark, d, "forecasts").filter("city is not null").select("forecast_id", F.array_distinct(F.array(city, F.trim(F.split(city, ",")[0]))).alias("names"))
    return rows.select("forecast_id", F.posexplode("names").alias("pos", "candidate")).withColumn("pos", F.col("pos").cast("bigint"))


def tag_projection(spark, d):
    cuisine = F.when(F.length("cuisine") > 0, F.replace("cuisine", F.lit(";"), F.lit(", "))).otherwise("unknown")
    return _places(spark, d).select("rec_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.element_at("tags", F.lit("amenity")), "amenity", F.lit("food")).alias("type"), cuisine.alias("cuisine"), F.coalesce(feeds.address(F.col("tags")), F.lit("")).alias("address"))


def html_snippet(spark, d):
    from veldra.functions.text import strip_html

    return _news(spark, d).filter("snippet is not null").select("item_id", F.substring(strip_html(F.col("snippet")), 1, 300).alias("text"))


def html_title(spark, d):
    return _news(spark, d).filter("snippet is not null").select("item_id", F.regexp_extract("snippet", "<[a-z]+[^>]*>([^<]*)</", 1).alias("title"))


def html_links(spark, d):
    links = F.regexp_extract_all("snippet", F.lit('href="([^"]*)"'), 1)
    return _news(spark, d).select("item_id", F.posexplode(links).alias("pos", "link")).withColumn("pos", F.col("pos").cast("bigint"))


def json_extract(spark, d):
    return _events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def json_unwrap(spark, d):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"forecast_response":{"data":'), "props", F.lit("}}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"data":'), "props", F.lit("}"))).otherwise(F.col("props"))
    return _events(spark, d).select("event_id", F.get_json_object(feeds.unwrap(wrapped, "forecast"), "$.k").cast("bigint").alias("k"))


def parse_result_blocks(spark, d):
    """Report lines folded into blocks: a header begins one, the text lines behind it are joined, log lines are skipped."""
    kind = F.col("event_type")
    line = F.when(kind == "error", F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("] score="), F.format_string("%.2f", F.abs("value")), F.lit(" | doc=user-"), F.col("user_id").cast("string"))).when(kind == "click", F.concat(F.lit("=== "), kind)).when(F.col("event_id") % 11 == 0, F.concat(F.lit("2026-01-01 "), kind)).otherwise(F.concat(F.lit("    "), kind, F.lit(" "), "props"))
    return feeds.report_blocks(_events(spark, d).select("user_id", "event_id", line.alias("line")), "user_id", "event_id")


def result_page(spark, d):
    """Items written as a search page of one result each, and read from it."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    page = F.concat(F.lit('<div><a class="result__a" href="'), safe("url"), F.lit('">'), safe("title"), F.lit('</a><div class="result__snippet">'), F.coalesce(safe("source"), F.lit("")), F.lit("</div></div>"))
    rows = _news(spark, d).filter("title is not null and url is not null").select("item_id", F.inline(feeds.result_links(page)))
    return rows.select("item_id", "title", "url", "snippet")


def _hours(spark, d) -> DataFrame:
    return forecast.current_hour(read_table(spark, d, "forecasts"), F.col("fetched_at"))


def current_hour(spark, d):
    return _hours(spark, d).select("forecast_id", "time", "temperature", "probability", "amount")


def alert_predicate(spark, d):
    return _hours(spark, d).select("forecast_id", "rain_likely")


def alert_outbox(spark, d):
    recipient = F.when(F.col("admin1").isNotNull(), F.concat(F.regexp_replace(F.lower("city"), "[^a-z]", ""), F.lit("@example.com"))).otherwise("")
    return forecast.outbox(_hours(spark, d), recipient).select("forecast_id", "recipient", "subject", "body")


def banding(spark, d):
    band = F.when(F.col("temperature") > 80, "hot").when(F.col("temperature") >= 60, "mild").when(F.col("temperature").isNotNull(), "cold").otherwise("unknown")
    return _hours(spark, d).select("forecast_id", band.alias("band"), F.when(F.col("probability") >= 50, "umbrella").otherwise("none").alias("advice"))


def ttl_cache(spark, d):
    """The newest entry of each city that hasn't expired at the query's clock, thirty days after it was made."""
    rows = read_table(spark, d, "forecasts").filter("city is not null").withColumn("made", F.unix_timestamp(F.col("fetched_at").cast("timestamp")))
    live = rows.filter((F.col("made") <= NOW) & (F.col("made") + 30 * 86_400 > NOW))
    return live.groupBy("city").agg(F.max_by("forecast_id", F.struct("made", "forecast_id")).alias("forecast_id"))


def secs_to_next_hour(spark, d):
    return _events(spark, d).select("event_id", (3600 - F.col("second") % 3600).alias("seconds"))


def tumbling_hourly(spark, d):
    hour = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return _events(spark, d).groupBy(hour.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n", "total")


def sessions(spark, d):
    """Events of a user less than twelve hours apart, as one session; busy users are cut into days."""
    marked = ordered.islands(_events(spark, d).select("user_id", "second"), "user_id", "second", 43_200, "session")
    return marked.groupBy("user_id", "session").agg(F.min("second").alias("start"), F.count("*").alias("n")).select("user_id", "start", "n")


def rate_limit(spark, d):
    """Events of a user that are over two within six hours."""
    return quality.calls_in_window(_events(spark, d), "user_id", F.col("second"), 21_600).filter("calls > 2").select("event_id", "user_id", "calls")


def last_turns(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("second"), F.desc("event_id"))
    return _events(spark, d).withColumn("back", F.row_number().over(w)).filter("back <= 10").select("user_id", F.col("back").cast("bigint").alias("back"), "event_id")


def latency_percentiles(spark, d):
    rows = quality.percentiles(_events(spark, d), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return rows.select("event_type", "n", *[F.round(name, 6).alias(name) for name in ("p50", "p95", "p99")])


def threshold_exceedance(spark, d):
    """Lines shipped later after their order than the days that the order's priority allows."""
    days = F.datediff("l_shipdate", "o_orderdate").cast("double")
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = quality.over_limit(rows, "o_orderpriority", days, DAYS, 110)
    return late.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "limit", "excess")


def ttl_by_kind(spark, d):
    """Newest live event of each user and kind at a clock, where kinds live unequally long."""
    clock = 1_705_320_000  # 2024-01-15 12:00:00 UTC
    live = quality.live_by_kind(_events(spark, d), "event_type", F.col("second"), clock, HOURS, 86_400)
    return live.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("second", "event_id")).alias("event_id"))


def alert_html(spark, d):
    hours = _hours(spark, d).filter("rain_likely and city is not null")
    return hours.select("forecast_id", F.md5(F.regexp_replace(forecast.html_body(), "Probability</th><td>[^<]*", "")).alias("digest"))


def eval_summary(spark, d):
    good = F.col("value") >= 10
    return _events(spark, d).groupBy("event_type").agg(F.count_if(good).alias("passed"), F.count_if(~good).alias("failed"), F.count("*").alias("total"), F.round(F.avg(good.cast("double")), 6).alias("accuracy"))


def eval_trend(spark, d):
    """Accuracy by day and its change against the day before."""
    days = _events(spark, d).groupBy(F.floor(F.col("second") / 86_400).alias("day")).agg(F.avg((F.col("value") >= 10).cast("double")).alias("a"))
    before = days.select((F.col("day") + 1).alias("day"), F.col("a").alias("b"))
    return days.join(before, "day", "left").select("day", F.round("a", 6).alias("accuracy"), F.round(F.col("a") - F.coalesce("b", "a"), 6).alias("delta"))


def canary(spark, d):
    return _events(spark, d).select("user_id").distinct().select("user_id", quality.share(F.col("user_id"), 5).alias("canary"))


def pii_redact(spark, d):
    docs = read_table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(quality.redact(F.col("text"))).alias("digest"), F.col("text").rlike(quality.INJECTIONS).alias("suspicious"))


def recurrence(spark, d):
    """Counts by type and part of day, with subtotals."""
    part = F.floor(F.col("second") % 86_400 / 21_600)
    rows = _events(spark, d).withColumn("part", part)
    out = rows.cube("event_type", "part").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return out.filter("level <> 1").select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("part", F.lit(-1)).cast("bigint").alias("part"), "n")


def first_deviation(spark, d):
    """The first line of each order that was shipped over ninety days after the order."""
    late = read_table(spark, d, "lineitem").join(read_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate > o_orderdate + interval 90 days")
    return late.groupBy("l_orderkey").agg(F.min(F.struct("l_shipdate", "l_linenumber")).alias("first")).select("l_orderkey", F.col("first.l_linenumber").cast("bigint").alias("line"))


def evidence_agreement(spark, d):
    """Cities by how many of the two sources know them."""
    left = read_table(spark, d, "forecasts").filter("city is not null").groupBy("city").agg(F.count("*").alias("forecasts"))
    right = _places(spark, d).filter("city is not null").groupBy("city").agg(F.count("*").alias("places"))
    both = left.join(right, "city", "full")
    confidence = F.when(F.col("forecasts").isNotNull() & F.col("places").isNotNull(), "HIGH").when(F.coalesce("forecasts", "places") >= 10, "MEDIUM").otherwise("LOW")
    return both.select("city", F.coalesce("forecasts", F.lit(0)).cast("bigint").alias("forecasts"), F.coalesce("places", F.lit(0)).cast("bigint").alias("places"), confidence.alias("confidence"))


def segment_bounds(spark, d):
    """Sources whose number of items lies within bounds, and whether every item of theirs has a title."""
    rows = _news(spark, d).filter("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length("title") > 0).alias("titled"))
    return rows.filter("n between 10 and 200").select("source", "n", (F.col("titled") == F.col("n")).alias("complete"))


def feed_volume(spark, d):
    """Items by feed with the feed's zone: a join to a fixed table whose size is checked."""
    zones = broadcast_checked(read_table(spark, d, "news_feeds").select("source", "feed_zone"))
    return _news(spark, d).groupBy("source").agg(F.count("*").alias("n")).join(zones, "source").select("source", "feed_zone", "n")


QUERIES = {
    f.__name__: f
    for f in (
        rfc2822, feed_dedupe, feed_dedupe_then_filter, recency_filter, latest_events, ci_dedupe, fallback_source, regex_filter, geo_radius, geo_candidates, tag_projection, html_snippet, html_title, html_links, result_page, json_extract, json_unwrap,
        parse_result_blocks, current_hour, alert_predicate, alert_outbox, banding, ttl_cache, secs_to_next_hour, tumbling_hourly, sessions, rate_limit, last_turns, latency_percentiles, threshold_exceedance, ttl_by_kind, alert_html, eval_summary, eval_trend, canary, pii_redact,
        recurrence, first_deviation, evidence_agreement, segment_bounds, feed_volume,
    )
}

_RE = r"'^\s*(?:[A-Za-z]{3},\s+)?(\d{1,2})\s+([A-Z][a-z]{2})\s+(\d{4})\s+(\d{2}:\d{2}:\d{2})\s+(GMT|UTC|UT|[+-]\d{4})\s*$'"


def _part(i: int) -> str:
    return f"regexp_extract(date, {_RE}, {i})"


_MONTH = f"lpad((((instr('{feeds.MONTHS}', {_part(2)}) + 2) // 3))::VARCHAR, 2, '0')"
_WALL = f"epoch(try_cast({_part(3)} || '-' || {_MONTH} || '-' || lpad({_part(1)}, 2, '0') || ' ' || {_part(4)} AS TIMESTAMP))::BIGINT"
_ZONE = _part(5)
_SHIFT = f"CASE WHEN substring({_ZONE}, 1, 1) IN ('+', '-') THEN (substring({_ZONE}, 2, 2)::BIGINT * 3600 + substring({_ZONE}, 4, 2)::BIGINT * 60) * CASE WHEN substring({_ZONE}, 1, 1) = '-' THEN -1 ELSE 1 END ELSE 0 END"
_DATED = f"(SELECT *, CASE WHEN regexp_matches(date, {_RE}) THEN {_WALL} - {_SHIFT} END AS epoch FROM news_items)"
_EV = "(SELECT *, floor(epoch(ts))::BIGINT AS second FROM events)"
_AT = "coalesce(nullif(list_position(list_transform(hourly.time, lambda t: coalesce(starts_with(t, strftime(fetched_at, '%Y-%m-%dT%H:')), false)), true), 0), 1)"
_HOURS = f"(SELECT forecast_id, city, admin1, hourly.time[i] AS time, hourly.temperature_2m[i] AS temperature, coalesce(hourly.precipitation_probability[i], 0.0) AS probability, coalesce(hourly.precipitation[i], 0.0) AS amount FROM (SELECT *, {_AT} AS i FROM forecasts WHERE len(hourly.time) > 0))"
_RAIN = "(probability >= 50 OR amount > 0)"
_HEADER = r"'^\[\d+\]\s+score=([\d.]+)\s*\|\s*doc=(.+)$'"
_LINES = f"(SELECT user_id, event_id, trim(CASE WHEN event_type = 'error' THEN '[' || event_id || '] score=' || printf('%.2f', abs(value)) || ' | doc=user-' || user_id WHEN event_type = 'click' THEN '=== ' || event_type WHEN event_id % 11 = 0 THEN '2026-01-01 ' || event_type ELSE '    ' || event_type || ' ' || props END) AS line FROM events)"
_METRES = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2))))"


def _first(table: str, keys: str, order: str, columns: str, where: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {table} WHERE {where}) WHERE n = 1"


def _redacted() -> str:
    out = "text"
    for pattern, mark in quality.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern}', '{mark}', 'g')"
    return out


ORACLES = {
    "rfc2822": f"SELECT item_id, epoch FROM {_DATED} WHERE epoch IS NOT NULL",
    "feed_dedupe": _first("news_items", "title, url", "fetched_at NULLS FIRST, item_id", "item_id, title, url", "len(title) > 0"),
    "feed_dedupe_then_filter": f"SELECT item_id, title FROM ({_first(_DATED, 'title, source', 'fetched_at NULLS FIRST, item_id', '*', 'len(title) > 0')}) WHERE epoch IS NULL OR epoch >= {NOW - 365 * 86400}",
    "recency_filter": f"SELECT item_id FROM {_DATED} WHERE epoch IS NULL OR epoch >= {NOW - 180 * 86400}",
    "latest_events": f"SELECT item_id, coalesce(epoch, 0) AS epoch FROM {_DATED} ORDER BY coalesce(epoch, 0) DESC, item_id LIMIT 15",
    "ci_dedupe": _first("osm_places", "lower(name)", "rec_id", "rec_id, lower(name) AS name", "len(name) > 0"),
    "fallback_source": "SELECT city, rec_id, amenity FROM osm_places WHERE city IS NOT NULL AND amenity = 'fast_food' UNION ALL SELECT city, rec_id, amenity FROM osm_places WHERE amenity = 'restaurant' AND city IS NOT NULL AND city NOT IN (SELECT city FROM osm_places WHERE amenity = 'fast_food' AND city IS NOT NULL)",
    "regex_filter": f"SELECT rec_id, amenity FROM osm_places WHERE regexp_matches(amenity, '{feeds.FOOD}')",
    "geo_radius": f"SELECT c.rec_id AS centre, p.rec_id, round({_METRES}, 2) AS metres FROM osm_places c JOIN osm_places p ON c.rec_id % 20 = 0 AND abs(p.lat - c.lat) < 0.05 WHERE {_METRES} <= {RADIUS}",
    "geo_candidates": "SELECT forecast_id, unnest(range(0, len(names))) AS pos, unnest(names) AS candidate FROM (SELECT forecast_id, CASE WHEN c = trim(split_part(c, ',', 1)) THEN [c] ELSE [c, trim(split_part(c, ',', 1))] END AS names FROM (SELECT forecast_id, trim(concat_ws(', ', city, admin1)) AS c FROM forecasts WHERE city IS NOT NULL))",
    "tag_projection": "SELECT rec_id, coalesce(name, '') AS name, coalesce(tags['amenity'], amenity, 'food') AS type, CASE WHEN len(cuisine) > 0 THEN replace(cuisine, ';', ', ') ELSE 'unknown' END AS cuisine, coalesce(concat_ws(', ', nullif(tags['addr:housenumber'], ''), nullif(tags['addr:street'], ''), nullif(tags['addr:city'], ''), nullif(tags['addr:state'], '')), '') AS address FROM osm_places",
    "html_snippet": "SELECT item_id, substring(regexp_replace(snippet, '<[^>]+>', '', 'g'), 1, 300) AS text FROM news_items WHERE snippet IS NOT NULL",
    "html_title": "SELECT item_id, regexp_extract(snippet, '<[a-z]+[^>]*>([^<]*)</', 1) AS title FROM news_items WHERE snippet IS NOT NULL",
    "html_links": "SELECT item_id, unnest(range(0, len(l))) AS pos, unnest(l) AS link FROM (SELECT item_id, regexp_extract_all(snippet, 'href=\"([^\"]*)\"', 1) AS l FROM news_items)",
    "result_page": "SELECT item_id, t AS title, u AS url, s AS snippet FROM (SELECT item_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(url, '\\s+', ' ', 'g')) AS u, trim(regexp_replace(coalesce(source, ''), '\\s+', ' ', 'g')) AS s FROM news_items) WHERE len(t) > 0 AND len(u) > 0",
    "json_extract": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "json_unwrap": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "parse_result_blocks": f"WITH l AS (SELECT *, regexp_matches(line, {_HEADER}) AS head FROM {_LINES}), b AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS block FROM l) SELECT user_id, block, regexp_extract(max(line) FILTER (WHERE head), {_HEADER}, 1)::DOUBLE AS score, trim(regexp_extract(max(line) FILTER (WHERE head), {_HEADER}, 2)) AS doc_id, coalesce(string_agg(line, ' ' ORDER BY event_id) FILTER (WHERE NOT head AND NOT starts_with(line, '===') AND NOT starts_with(line, '2026-')), '') AS text FROM b WHERE block > 0 GROUP BY user_id, block",
    "current_hour": f"SELECT forecast_id, time, temperature, probability, amount FROM {_HOURS}",
    "alert_predicate": f"SELECT forecast_id, {_RAIN} AS rain_likely FROM {_HOURS}",
    "alert_outbox": f"SELECT forecast_id, regexp_replace(lower(city), '[^a-z]', '', 'g') || '@example.com' AS recipient, 'Weather alert for ' || city AS subject, 'Temperature: ' || CASE WHEN temperature IS NULL OR temperature = 0 THEN 'N/A' ELSE printf('%.1f', round(temperature, 1)) END || chr(10) || printf('Probability: %.0f%%', round(probability, 0)) || chr(10) || printf('Amount: %.2f in', round(amount, 2)) || chr(10) || 'Rain likely: Yes' AS body FROM {_HOURS} WHERE {_RAIN} AND admin1 IS NOT NULL AND city IS NOT NULL",
    "banding": f"SELECT forecast_id, CASE WHEN temperature > 80 THEN 'hot' WHEN temperature >= 60 THEN 'mild' WHEN temperature IS NOT NULL THEN 'cold' ELSE 'unknown' END AS band, CASE WHEN probability >= 50 THEN 'umbrella' ELSE 'none' END AS advice FROM {_HOURS}",
    "ttl_cache": f"SELECT city, arg_max(forecast_id, (fetched_at, forecast_id)) AS forecast_id FROM forecasts WHERE city IS NOT NULL AND epoch(fetched_at) <= {NOW} AND floor(epoch(fetched_at)) + 30 * 86400 > {NOW} GROUP BY city",
    "secs_to_next_hour": f"SELECT event_id, 3600 - second % 3600 AS seconds FROM {_EV}",
    "tumbling_hourly": f"SELECT second // 3600 * 3600 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {_EV} GROUP BY 1, 2",
    "sessions": f"SELECT user_id, min(second) AS start, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY second, event_id) AS s FROM (SELECT *, CASE WHEN second - lag(second) OVER (PARTITION BY user_id ORDER BY second, event_id) < 43200 THEN 0 ELSE 1 END AS f FROM {_EV})) GROUP BY user_id, s",
    "rate_limit": f"SELECT event_id, user_id, calls FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS calls FROM {_EV}) WHERE calls > 2",
    "last_turns": f"SELECT user_id, back, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY second DESC, event_id DESC) AS back FROM {_EV}) WHERE back <= 10",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "threshold_exceedance": "SELECT l_orderkey, l_linenumber::BIGINT AS line, m AS \"limit\", days - m AS excess FROM (SELECT l_orderkey, l_linenumber, (l_shipdate::DATE - o_orderdate::DATE)::DOUBLE AS days, CASE o_orderpriority "
    + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in DAYS.items())
    + " ELSE 110.0::DOUBLE END AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE days > m",
    "ttl_by_kind": "SELECT user_id, event_type, arg_max(event_id, (second, event_id)) AS event_id FROM " + _EV + " WHERE second <= 1705320000 AND second + CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in HOURS.items()) + " ELSE 86400 END > 1705320000 GROUP BY user_id, event_type",
    "alert_html": f"SELECT forecast_id, md5('<html><body><h2>Weather Alert for ' || replace(replace(replace(city, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h2><table><tr><th>Temperature</th><td>' || CASE WHEN temperature IS NULL OR temperature = 0 THEN 'N/A' ELSE temperature::VARCHAR END || ' °F</td></tr><tr><th>Rain </td></tr><tr><th>Rain Amount</th><td>' || printf('%.2f in', round(amount, 2)) || '</td></tr><tr><th>Rain Likely</th><td>Yes</td></tr></table></body></html>') AS digest FROM {_HOURS} WHERE {_RAIN} AND city IS NOT NULL",
    "eval_summary": "SELECT event_type, count_if(value >= 10)::BIGINT AS passed, count_if(value < 10)::BIGINT AS failed, count(*) AS total, round(avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM events GROUP BY event_type",
    "eval_trend": f"WITH x AS (SELECT second // 86400 AS day, avg(CASE WHEN value >= 10 THEN 1.0::DOUBLE ELSE 0 END) AS a FROM {_EV} GROUP BY 1) SELECT x.day, round(x.a, 6) AS accuracy, round(x.a - coalesce(y.a, x.a), 6) AS delta FROM x LEFT JOIN x y ON y.day + 1 = x.day",
    "canary": "SELECT DISTINCT user_id, ('0x' || substring(md5(user_id::VARCHAR), 1, 8))::BIGINT % 100 < 5 AS canary FROM events",
    "pii_redact": f"SELECT doc_id, md5({_redacted()}) AS digest, regexp_matches(text, '{quality.INJECTIONS}') AS suspicious FROM documents WHERE text IS NOT NULL",
    "recurrence": f"SELECT coalesce(event_type, 'all') AS event_type, coalesce(part, -1)::BIGINT AS part, count(*) AS n FROM (SELECT *, second % 86400 // 21600 AS part FROM {_EV}) GROUP BY GROUPING SETS ((event_type, part), (part), ())",
    "first_deviation": "SELECT l_orderkey, arg_min(l_linenumber, (l_shipdate, l_linenumber))::BIGINT AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 90 DAY GROUP BY l_orderkey",
    "evidence_agreement": "WITH f AS (SELECT city, count(*) AS a FROM forecasts WHERE city IS NOT NULL GROUP BY city), p AS (SELECT city, count(*) AS b FROM osm_places WHERE city IS NOT NULL GROUP BY city) SELECT coalesce(f.city, p.city) AS city, coalesce(a, 0) AS forecasts, coalesce(b, 0) AS places, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'HIGH' WHEN coalesce(a, b) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM f FULL JOIN p ON f.city = p.city",
    "segment_bounds": "SELECT source, count(*) AS n, count_if(len(title) > 0) = count(*) AS complete FROM news_items WHERE source IS NOT NULL GROUP BY source HAVING count(*) BETWEEN 10 AND 200",
    "feed_volume": "SELECT source, feed_zone, count(*) AS n FROM news_items JOIN news_feeds USING (source) GROUP BY source, feed_zone",
}
