"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of prompts and answers.
PASSAGE, QUERY = "passage: ", "query: "
NO_ANSWER = "Answer not available (LLM server offline). Passages were retrieved and re-ranked."


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def sentences(text: Column) -> Column:
    """Sentences behind ``.``, ``!`` or ``?`` and white space, trimmed, empty ones left out."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+", -1), trim), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of a-z and 0-9."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def prefixed(text: Column, prefix: str = PASSAGE) -> Column:
    """With the prefix of the model family, unless one is there."""
    return F.when(text.startswith(PASSAGE) | text.startswith(QUERY), text).otherwise(F.concat(F.lit(prefix), text))


def is_prefix_model(name: Column) -> Column:
    return F.lower(name).rlike("e5|intfloat")


def strip_html(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def fallback_answer(prompt: Column) -> Column:
    """The first document of a prompt, trimmed, at most 500 characters and dots; a fixed answer if it has none."""
    found = F.regexp_extract(prompt, r"(?s)Document \d+:\s*(.*?)(?:\n\nDocument|\z)", 1)
    body = F.regexp_replace(found, r"^\s+|\s+$", "")
    clipped = F.when(F.length(body) > 500, F.concat(F.substring(body, 1, 500), F.lit("..."))).otherwise(body)
    return F.when(prompt.rlike(r"Document \d+:"), clipped).otherwise(F.lit(NO_ANSWER))


def coerce_kind(value: Column) -> Column:
    """Type that a literal of the configuration has: bool, int, float or str."""
    return (
        F.when(F.lower(value).isin("true", "false"), "bool").when(value.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), "int").when(value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"), "float").otherwise("str")
    )


def coerced(value: Column) -> Column:
    """The value that a literal of the configuration has: STRUCT<kind, flag, whole, real, text>, of which the field of its kind is set."""
    kind = coerce_kind(value)
    bare = F.replace(F.trim(value), F.lit("_"), F.lit(""))
    return F.struct(
        kind.alias("kind"), F.when(kind == "bool", F.lower(value) == "true").alias("flag"), F.when(kind == "int", bare.try_cast("bigint")).alias("whole"), F.when(kind == "float", bare.try_cast("double")).alias("real"), F.when(kind == "str", value).alias("text")
    )
