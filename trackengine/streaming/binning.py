"""Track bins from a stream of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_bins(signal: DataFrame, ts: str, seqname: Column, value: Column, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(seqname, start, n, total, high, low) of each bin of event time, once the watermark has passed it.

    The sums make every bin summary, and are those that bin_signal() takes.
    """
    rows = signal.withWatermark(ts, late).groupBy(F.window(ts, width), seqname.alias("seqname"))
    sums = rows.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("high"), F.min(value).alias("low"))
    return sums.select("seqname", F.col("window.start").alias("start"), "n", "total", "high", "low")
