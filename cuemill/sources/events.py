"""Progress events as the text of a server-sent stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "sessionId STRING, state STRING, progress DOUBLE, message STRING"


def event_text(row: Column) -> Column:
    """``data: {json}`` and a blank line."""
    return F.concat(F.lit("data: "), F.to_json(row), F.lit("\n\n"))


def parse_events(texts: DataFrame, text: str = "body", schema: str = EVENT) -> DataFrame:
    """``texts`` with a row for each event: event_no and ``event``.

    Events are parted by blank lines, the last only counts if one closes it; the
    first ``data: `` line is read, and an event without one, or whose JSON can't
    be read, is passed over.
    """
    parts = F.split(text, "\n\n")
    rows = texts.select("*", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("event_no", "_part"))
    data = F.nullif(F.regexp_extract("_part", r"(?m)^data: (.*)$", 1), F.lit(""))
    parsed = F.from_json(data, f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("_e", parsed).where("_e is not null and _e._bad is null")
    return rows.withColumn("event", F.col("_e").dropFields("_bad")).drop("_part", "_e", text)
