"""Server-sent events: frames to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_frames(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row per frame with event, id and data; frames without valid JSON data go."""
    frames = texts.select(F.posexplode(F.split(F.col(column), r"\r?\n\r?\n")).alias("pos", "frame"))
    field = lambda name: F.nullif(F.regexp_extract("frame", rf"(?m)^{name}: ?(.*)$", 1), F.lit(""))
    rows = frames.select("pos", field("event").alias("event"), field("id").alias("id"), field("data").alias("data"))
    return rows.where(F.try_parse_json("data").isNotNull())


def frame(seq: Column, data: Column) -> Column:
    """One frame of a numbered event."""
    return F.concat(F.lit("id: "), seq.cast("string"), F.lit("\ndata: "), data, F.lit("\n\n"))
