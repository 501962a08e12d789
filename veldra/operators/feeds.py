"""Feeds and places: dates, first-seen rows, recency, fallback sources, radius search, tags, outboxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.operators.ordered import first_seen, running_sum
from veldra.runtime import broadcast_checked, materialize
from veldra.sources.http import result_rows

EARTH_M = 6_371_000.0
#: Months of mail dates, kinds of eating places, parts of an address, beginnings of log lines, the header line of a report.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
FOOD = "restaurant|cafe|fast_food|food_court"
ADDRESS = ("addr:housenumber", "addr:street", "addr:city", "addr:state")
LOG_LINE = "^(===|2026-)"
REPORT_HEAD = r"^\[\d+\]\s+score=([\d.]+)\s*\|\s*doc=(.+)$"
MAIL_DATE = r"^\s*(?:[A-Za-z]{3},\s+)?(\d{1,2})\s+([A-Z][a-z]{2})\s+(\d{4})\s+(\d{2}:\d{2}:\d{2})\s+(GMT|UTC|UT|[+-]\d{4})\s*$"


def mail_epoch(text: Column) -> Column:
    """Epoch seconds of a mail date (RFC 2822), null if it isn't one."""
    part = lambda i: F.regexp_extract(text, MAIL_DATE, i)
    at = F.floor((F.call_function("locate", part(2), F.lit(MONTHS)) + 2) / 3)
    stamp = F.concat_ws("-", part(3), F.lpad(at.cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))
    wall = F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", stamp, part(4)), F.lit("yyyy-MM-dd HH:mm:ss")))
    zone = part(5)
    offset = F.when(zone.rlike(r"^[+-]"), (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    return F.when(text.rlike(MAIL_DATE), wall - offset)


def recent(df: DataFrame, epoch: Column, now: int, days: int = 30) -> DataFrame:
    """Rows not older than ``days`` before ``now`` (epoch seconds); rows without a date stay."""
    return df.filter(epoch.isNull() | (epoch >= now - days * 86_400))


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first arrival of each key, of rows whose first key isn't empty."""
    return first_seen(df.filter(F.length(keys[0]) > 0), [F.col(k) for k in keys], order)


def dedupe_name(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """First rows by name in any letter case."""
    return first_seen(df.filter(F.length(name) > 0), [F.lower(name)], order)


def with_fallback(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """All primary rows, and the secondary rows of keys that the primary source lacks."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti").select(primary.columns))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


HOT_PLACES = 1_000_000  # places of a cell that are joined at once


def within(places: DataFrame, centres: DataFrame, metres: float, cell: float = 0.1) -> DataFrame:
    """Centres (centre, clat, clon) with the places (lat, lon) around them and ``metres``: an equi-join over grid cells of degrees.

    A centre is sent to every cell that its radius can reach; cells of longitude widen towards the poles and wrap round. Cells of
    over ``HOT_PLACES`` places are cut by a hash of the position, and the centres sent to each cut.
    """
    reach = metres / EARTH_M * 57.29577951308232
    wide = F.least(F.lit(180.0), F.lit(reach) / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("clat")) + reach, F.lit(89.9)))), F.lit(1e-3)))
    turns = int(360 / cell)
    rows = F.sequence(F.floor((F.col("clat") - reach) / cell), F.floor((F.col("clat") + reach) / cell))
    columns = F.sequence(F.floor((F.col("clon") - wide) / cell), F.floor((F.col("clon") + wide) / cell))
    sent = centres.filter("clat is not null and clon is not null").select("*", F.explode(rows).alias("_y"), columns.alias("_xs"))
    sent = sent.select("centre", "clat", "clon", "_y", F.explode(F.array_distinct(F.transform("_xs", lambda x: F.pmod(x, F.lit(turns))))).alias("_x"))
    held = places.filter("lat is not null and lon is not null").withColumns({"_y": F.floor(F.col("lat") / cell), "_x": F.pmod(F.floor(F.col("lon") / cell), F.lit(turns))})
    hot = held.groupBy("_y", "_x").count().filter(F.col("count") > HOT_PLACES).select("_y", "_x", F.ceil(F.col("count") / HOT_PLACES).alias("_cuts"))
    if hot.limit(1).count():
        hot = broadcast_checked(materialize(hot, "cells"))
        cuts = F.coalesce("_cuts", F.lit(1).cast("bigint"))
        held = held.join(hot, ["_y", "_x"], "left").withColumn("_cut", F.pmod(F.xxhash64("lat", "lon"), cuts)).drop("_cuts")
        sent = sent.join(hot, ["_y", "_x"], "left").withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("bigint"), cuts - 1))).drop("_cuts")
    keys = [c for c in ("_y", "_x", "_cut") if c in held.columns]
    out = held.join(sent, keys).withColumn("metres", haversine(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon")))
    return out.filter(F.col("metres") <= metres).drop(*keys)


def address(tags: Column) -> Column:
    """Parts of an address that a tag map has, joined."""
    return F.concat_ws(", ", *[F.nullif(F.get(F.array(F.element_at(tags, F.lit(k))), F.lit(0)), F.lit("")) for k in ADDRESS])


def unwrap(envelope: Column, tool: str) -> Column:
    """The payload of a nested tool answer."""
    return F.coalesce(F.get_json_object(envelope, f"$.{tool}_response.data"), F.get_json_object(envelope, f"$.{tool}_response"), F.get_json_object(envelope, "$.data"), envelope)


def report_blocks(lines: DataFrame, group: str, position: str) -> DataFrame:
    """Lines (``group``, ``position``, line) of a report folded into blocks: ``(group, block, score, doc_id, text)``.

    A header begins a block, the text lines behind it are joined by blanks, log lines and what comes before the first header are left out.
    """
    marked = lines.withColumn("line", F.trim("line")).withColumn("head", F.col("line").rlike(REPORT_HEAD))
    marked = running_sum(marked, group, position, F.col("head").cast("bigint"), "block").filter("block > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head") & ~F.col("line").rlike(LOG_LINE), F.struct(position, "line")))), lambda x: x["line"]), " ")
    out = marked.groupBy(group, "block").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("h"), text.alias("text"))
    return out.select(group, "block", F.regexp_extract("h", REPORT_HEAD, 1).cast("double").alias("score"), F.trim(F.regexp_extract("h", REPORT_HEAD, 2)).alias("doc_id"), "text")


def result_links(html: Column, most: int = 5) -> Column:
    """Results of a search page as ARRAY<STRUCT<title, url, snippet>>."""

    @F.pandas_udf("array<struct<title:string,url:string,snippet:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: [dict(zip(("title", "url", "snippet"), r)) for r in result_rows(page or "", most)])

    return run(html)
