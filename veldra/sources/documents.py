"""Document sources: JSON lines, JSON files, whole text files; defaults of missing fields.

A record without a text has itself, as JSON, for one. JSON sources keep the whole record in ``record`` for that.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, title string, name string, text string, metadata map<string,string>"


#: Where the readers keep the whole record.
RECORD = "record"


def scan_json_lines(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """One row per line that isn't blank; without a schema the known fields and the whole ``record``."""
    if schema:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return _known(lines.select(F.col("value").alias(RECORD)))


def scan_json(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """A list gives a row per element, an object one row."""
    if schema:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    # elements stay as they are written: the parsed values are only looked at, never written again
    parts = F.when(F.col("value").startswith("["), F.transform(F.from_json("value", "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array("value"))
    return _known(whole.select(F.explode(parts).alias(RECORD)))


def _known(df: DataFrame) -> DataFrame:
    return df.select(F.from_json(RECORD, SCHEMA).alias("_r"), RECORD).select("_r.*", RECORD)


def scan_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A whole file is one document; its id is the file's name without suffix, its path goes into the metadata."""
    rows = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return rows.select(stem.alias("id"), F.col("value").alias("text"), F.create_map(F.lit("source_file"), F.col("_metadata.file_path")).alias("metadata"))


def scan(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Documents of all paths by suffix; missing files and unknown suffixes are left out."""
    from veldra.sources.config import warn

    kinds: dict[str, list[str]] = {"jsonl": [], "json": [], "txt": []}
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        suffix = path.rsplit(".", 1)[-1].lower()
        if suffix not in kinds:
            warn(f"unknown suffix, left out: {path}")
        elif not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            warn(f"missing, left out: {path}")
        else:
            kinds[suffix].append(path)
    parts = [with_defaults(read(spark, kinds[k])) for k, read in (("jsonl", scan_json_lines), ("json", scan_json)) if kinds[k]]
    if kinds["txt"]:
        parts.append(scan_text(spark, kinds["txt"]))
    out = spark.createDataFrame([], "id string, text string, metadata map<string,string>")
    for part in parts:
        out = out.unionByName(part.select("id", "text", "metadata"))
    return out


def default_id(text: Column) -> Column:
    """Stable id of a document without one, from the md5 of its first 50 characters."""
    return F.concat(F.lit("doc_"), (F.conv(F.substring(F.md5(F.substring(text, 1, 50)), 1, 8), 16, 10).cast("bigint") % 1_000_000).cast("string"))


def with_defaults(df: DataFrame) -> DataFrame:
    """id from title, name or the text; where the text is missing, the record as JSON (all columns if there is no ``record``); empty metadata."""
    whole = F.col(RECORD) if RECORD in df.columns else F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    text = F.coalesce("text", whole, F.lit(""))
    named = [F.col(c) for c in ("id", "title", "name") if c in df.columns]
    out = df.withColumns({"id": F.coalesce(*named, default_id(text)), "text": text})  # both from the record as it came
    empty = F.create_map().cast("map<string,string>")
    return out.withColumn("metadata", F.coalesce("metadata", empty) if "metadata" in df.columns else empty)
