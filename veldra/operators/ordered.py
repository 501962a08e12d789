"""Ordered scans within groups of any size: gaps, islands and running sums without one task for a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: str, position: str, value: Column, out: str, span: int = 1024) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row of its group, by an integer ``position``; rows of one position share it.

    Groups are cut into spans of positions; a window runs in each span, and the sums of the spans before come from one row a span.
    """
    rows = df.withColumn("_span", F.floor(F.col(position) / span)).withColumn("_value", value)
    inner = Window.partitionBy(group, "_span").orderBy(position)
    sums = rows.groupBy(group, "_span").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy("_span")) - F.col("_sum")
    carried = sums.select(group, "_span", before.alias("_before"))
    return rows.withColumn("_within", F.sum("_value").over(inner)).join(carried, [group, "_span"]).withColumn(out, F.col("_before") + F.col("_within")).drop("_span", "_value", "_within", "_before")


def islands(df: DataFrame, group: str, position: str, gap: int, out: str, span: int = 86_400) -> DataFrame:
    """``df`` with the number of the island of each row: a row ``gap`` or more behind the one before it in its group begins one.

    The row before is looked for in the row's own span of positions, else it is the last of the latest earlier span that has rows.
    """
    rows = df.withColumn("_span", F.floor(F.col(position) / span))
    ends = rows.groupBy(group, "_span").agg(F.max(position).alias("_last"))
    carried = ends.select(group, "_span", F.max("_last").over(Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inner = Window.partitionBy(group, "_span").orderBy(position)
    marked = rows.withColumn("_own", F.lag(position).over(inner)).join(carried, [group, "_span"])
    fresh = F.coalesce((F.col(position) - F.coalesce("_own", "_carried") >= gap).cast("bigint"), F.lit(1).cast("bigint"))
    return running_sum(marked.withColumn("_fresh", fresh).drop("_own", "_carried", "_span"), group, position, F.col("_fresh"), out, span).drop("_fresh")


def first_seen(df: DataFrame, keys: list[Column], order: list) -> DataFrame:
    """The first row of each key in the given order; only the first of a key leaves a partition."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    w = Window.partitionBy(*named).orderBy(*order)
    return df.withColumns(named).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", *named)
