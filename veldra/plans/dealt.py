"""Queries of the general data problems: packed fields and mixed timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.operators import packed, timestamps
from veldra.runtime import broadcast_checked, read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(read_table(spark, d, "osm_places"), read_table(spark, d, "cuisine_terms"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    feeds = read_table(spark, d, "news_feeds").filter("source is not null").select("source", "feed_zone", "locale")
    news = read_table(spark, d, "news_items").select("item_id", "source", "date").join(broadcast_checked(feeds), "source", "left")
    news = news.select("item_id", F.array("date").alias("dates"), "feed_zone", (F.col("locale") == "en-US").alias("us"))
    hours = read_table(spark, d, "forecasts").select("forecast_id", F.col("hourly.time").alias("times"), "timezone", F.lit(True).alias("us"))
    return timestamps.normalize(news, "news", "item_id", "dates", "feed_zone", "us").unionAll(timestamps.normalize(hours, "forecast", "forecast_id", "times", "timezone", "us"))


QUERIES = {f.__name__: f for f in (p1_found, p5_found)}
