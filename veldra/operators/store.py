"""The chunk store: row numbers, JSON with an open tail, lookup of hits, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.runtime import materialize

KNOWN = ("chunk_id", "doc_id", "text", "token_start", "token_end", "source_file")


def with_row_ids(df: DataFrame, order: list[str], base: int = 0, out: str = "row_id") -> DataFrame:
    """Consecutive row numbers from ``base`` in the given order, without one task for all rows.

    Rows are sorted by range over the partitions and written once; the row count of each partition gives its offset.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordered")
    sizes = placed.groupBy("_part").count()
    before = F.sum("count").over(Window.orderBy("_part")) - F.col("count")  # one row per partition
    offsets = sizes.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_at") + base).drop("_part", "_at", "_before")


def encode_json(columns: dict[str, Column], extra: Column) -> Column:
    """One JSON object with the known fields first and the extra keys at the top level behind them."""
    known = F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "false"})
    more = F.to_json(extra)
    return F.when(extra.isNull() | (F.size(extra) == 0), known).otherwise(F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more) - 1)))


def decode_json(line: Column) -> tuple[Column, Column]:
    """All keys of a line as a map of strings, and those beyond the known fields."""
    every = F.from_json(line, "map<string,string>")
    return every, F.map_filter(every, lambda k, v: ~k.isin(*KNOWN))


def hydrate(hits: DataFrame, chunks: DataFrame, key: str = "row_id") -> DataFrame:
    """Hits with the metadata of their chunks; hits without a chunk are dropped."""
    return hits.join(chunks, key)


def envelope(total: Column, results: Column) -> Column:
    """Result object: status ok or empty, the number before any limit, the results."""
    return F.to_json(F.struct(F.when(total > 0, "ok").otherwise("empty").alias("status"), total.alias("total"), results.alias("results")))
