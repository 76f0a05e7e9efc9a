"""Slot engagement counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slots import weekly_slot


def slot_counts(events: DataFrame, key: str, ts: str, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Events by window, key and weekly slot. Events that come later than `late` after the newest one are dropped, so that state stays bounded."""
    t = F.col(ts).cast("timestamp")
    slotted = events.withColumn("__t", t).withWatermark("__t", late).withColumn("slot", weekly_slot(F.col("__t"))).filter("slot is not null")
    return slotted.groupBy(F.window("__t", window).alias("w"), key, "slot").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "slot", "n")
