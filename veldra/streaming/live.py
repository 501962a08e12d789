"""Streams: ingest of files, rain alerts, event windows, first-seen keys within a time to live."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veldra.operators import forecast, mail
from veldra.pipeline import Pipeline


def read_files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", per_trigger).load(path)


def ingest(documents: DataFrame, pipeline: Pipeline, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch is chunked, embedded and added to the store; one run over what is there if ``every`` is None.

    A batch that is run again replaces itself: it is stored under the number it has in this checkpoint.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        pipeline.ingest(batch, f"{stream}-{number}")

    writer = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def alerts(forecasts: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Messages for rainy hours as they come, into an outbox table; nothing is sent."""
    hours = forecast.current_hour(forecasts, F.col("fetched_at"))
    rows = forecast.outbox(hours, F.coalesce("recipient", F.lit(""))).select("recipient", "subject", "body")
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def send_alerts(forecasts: DataFrame, sender: mail.Sender, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Messages for rainy hours, sent as HTML mail in each micro-batch; what became of each goes to ``out``, a folder per batch.

    A batch that is run again overwrites its folder; mail that had gone out before the failure may go out twice.
    """
    hours = forecast.current_hour(forecasts, F.col("fetched_at"))
    rows = forecast.outbox(hours, F.coalesce("recipient", F.lit("")))

    def send(batch: DataFrame, number: int) -> None:
        mail.send(batch.select("recipient", "subject", forecast.html_body().alias("html")), sender).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def cached_lookups(requests: DataFrame, look: Callable[[str], str | None], ttl_seconds: int = 3600, failed_seconds: int = 3600, key: str = "key", time: str = "ts") -> DataFrame:
    """``requests`` (key, ts) with the value that ``look`` gives for the key: ``(key, ts, value, error, hit)``.

    A value, or the error of a failed lookup, is kept in the state of its key and used until its time to live is over by the clock of
    the rows; then the key is looked up again. Rows of a batch are taken in order of time.
    """

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, error, until = state.get if state.exists else (None, None, None)
        rows = []
        for at in sorted(t for part in parts for t in part[time]):
            hit = until is not None and at.timestamp() < until
            if not hit:
                try:
                    value, error = look(keys[0]), None
                except Exception as e:  # noqa: BLE001 - the error is the result
                    value, error = None, str(e)
                until = at.timestamp() + (ttl_seconds if error is None else failed_seconds)
            rows.append((keys[0], at, value, error, hit))
        state.update((value, error, until))
        yield pd.DataFrame(rows, columns=["key", "ts", "value", "error", "hit"])

    rows = requests.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time))
    return rows.groupBy(key).applyInPandasWithState(run, "key string, ts timestamp, value string, error string, hit boolean", "value string, error string, until double", "append", GroupStateTimeout.NoTimeout)


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Closed one-hour windows of event types; events later than ``late`` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_in_ttl(rows: DataFrame, keys: list[str], time: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """First row of each key; the key is forgotten once ``ttl`` has passed: a cache of lookups."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)
