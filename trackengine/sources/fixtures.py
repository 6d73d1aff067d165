"""Tracks, intervals and scores made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackengine.functions.arrays import NAN
from trackengine.operators.track import KEYS, Track, bin_signal, spine, tracks_of

#: Bins of the event and ship tracks at least; later rows lengthen all sequences alike.
HOURS, DAYS = 720, 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seqname, pos, value): events by type and whole hours since 2024."""
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("seqname"), hour.alias("pos"), "value")


def _genome(rows: DataFrame, place: str, least: int, bin_size: int = 1) -> DataFrame:
    """(seqname, nbins): all sequences as long as the last place of any, `least` positions at least."""
    last = rows.groupBy("seqname").agg(F.max(place).alias("last"))
    longest = F.greatest(F.lit(least), F.max("last").over(Window.partitionBy()) + 1)  # a row for each sequence
    return last.select("seqname", F.ceil(longest / bin_size).cast("int").alias("nbins")) if bin_size > 1 else last.select("seqname", longest.cast("int").alias("nbins"))


def event_track(spark: SparkSession, sf_dir: str, summary: str = "mean", overlap: int = 0, init: float = 0.0, bin_size: int = 1) -> Track:
    signal = event_signal(spark, sf_dir)
    genome = _genome(signal, "pos", HOURS, bin_size)
    return bin_signal(signal, genome, bin_size, summary, overlap, init, digits=6)


def event_masked(spark: SparkSession, sf_dir: str) -> Track:
    """The event track, NaN in every 17th bin from the third."""
    t = event_track(spark, sf_dir)
    return t.map_positions(lambda s, p, v: F.when(p % 17 == 3, NAN).otherwise(v))


def ship_tracks(spark: SparkSession, sf_dir: str) -> list[Track]:
    """Three aligned tracks, for return flags A, N and R: shipped lines for each line status and day since 1995.

    One table with a column for each: the lines are read, and shuffled, once.
    """
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("seqname"), day.alias("bin"), "l_returnflag")
    flags = [F.when(F.col("l_returnflag") == f, 1.0).otherwise(0.0).alias(f) for f in "ANR"]
    genome = _genome(rows, "bin", DAYS)
    both = rows.select(*KEYS, *flags, F.lit(0).alias("in")).unionByName(spine(genome).select(*KEYS, *(F.lit(0.0).alias(f) for f in "ANR"), F.lit(1).alias("in")))
    counts = both.groupBy(*KEYS).agg(*(F.sum(f).alias(f) for f in "ANR"), F.max("in").alias("in")).filter("in = 1").drop("in")
    return tracks_of(counts, list("ANR"), genome)


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seqname, from, to, test): orders as intervals of 10 days a position, from their day on."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    start = (day * 1000 + F.col("o_orderkey") % 1000).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("seqname"), start.alias("from"), (start + 1 + F.col("o_orderkey") % 90).cast("int").alias("to"), F.col("o_totalprice").alias("test"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gt, test): quality labels and text lengths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("test"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").alias("gt"), "test")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
