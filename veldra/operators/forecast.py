"""Hourly forecasts held as parallel arrays: the current hour, rain, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rain is likely from this probability in percent, or with any amount.
LIKELY_PERCENT = 50


def current_hour(df: DataFrame, now: Column, hourly: str = "hourly") -> DataFrame:
    """Rows with hours, and of the first hour that begins with the hour of ``now`` (else the first): time, temperature, probability, amount, rain_likely."""
    times = F.col(f"{hourly}.time")
    prefix = F.date_format(now, "yyyy-MM-dd'T'HH:")
    hit = F.array_position(F.transform(times, lambda t: F.coalesce(t.startswith(prefix), F.lit(False))), True)
    rows = df.filter(F.size(times) > 0).withColumn("_at", F.greatest(hit.cast("int") - 1, F.lit(0)))
    value = lambda name: F.get(F.col(f"{hourly}.{name}"), F.col("_at"))
    out = rows.withColumns({"time": F.get(times, F.col("_at")), "temperature": value("temperature_2m"), "probability": F.coalesce(value("precipitation_probability"), F.lit(0.0)), "amount": F.coalesce(value("precipitation"), F.lit(0.0))})
    return out.withColumn("rain_likely", (F.col("probability") >= LIKELY_PERCENT) | (F.col("amount") > 0)).drop("_at")


def outbox(hours: DataFrame, recipient: Column) -> DataFrame:
    """One message per rainy hour with a recipient; adds recipient, subject and body. Nothing is sent."""
    temperature = F.when(F.col("temperature").isNull() | (F.col("temperature") == 0), "N/A").otherwise(F.format_string("%.1f", F.round("temperature", 1)))
    body = F.concat_ws("\n", F.concat(F.lit("Temperature: "), temperature), F.format_string("Probability: %.0f%%", F.round("probability", 0)), F.format_string("Amount: %.2f in", F.round("amount", 2)), F.lit("Rain likely: Yes"))
    rows = hours.withColumn("recipient", recipient).filter(F.col("rain_likely") & (F.length("recipient") > 0))
    return rows.withColumn("subject", F.concat(F.lit("Weather alert for "), F.col("city"))).withColumn("body", body)


def html_body(extra: str = "") -> Column:
    """HTML body of a message from the columns of ``current_hour`` and ``city``: a table of the four values. A temperature of null or 0 is N/A."""
    number = lambda c: F.col(c).cast("string")
    temperature = F.when(F.col("temperature").isNull() | (F.col("temperature") == 0), "N/A").otherwise(number("temperature"))
    rows = (("Temperature", F.concat(temperature, F.lit(" °F"))), ("Rain Probability", F.concat(number("probability"), F.lit("%"))), ("Rain Amount", F.format_string("%.2f in", F.round("amount", 2))), ("Rain Likely", F.when(F.col("rain_likely"), "Yes").otherwise("No")))
    table = F.concat(*[x for name, value in rows for x in (F.lit(f"<tr><th>{name}</th><td>"), value, F.lit("</td></tr>"))])
    city = F.coalesce("city", F.lit(""))
    for mark, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        city = F.replace(city, F.lit(mark), F.lit(safe))
    return F.concat(F.lit("<html><body><h2>Weather Alert for "), city, F.lit("</h2><table>"), table, F.lit(f"</table>{extra}</body></html>"))
