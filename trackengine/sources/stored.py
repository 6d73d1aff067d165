"""Tracks as Parquet: a folder for each sequence and stretch of bins, their sizes, and coarser levels beside them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.operators.track import KEYS, SUMS, Track, from_sums, sums_of

#: Bins of a folder. Reading regions opens the folders that they touch.
STRETCH = 1 << 20
#: Folders that a filter names at most; regions that touch more read their sequences whole.
FOLDERS = 65_536

_BINS = "bin int, value double, seqname string, blk long"
_LEVEL = "bin int, total double, n long, high double, low double, seqname string"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_track(df: DataFrame, path: str, genome: DataFrame | None = None, bin_size: int = 1, zoom_levels: Iterable[int] = ()) -> None:
    """Parquet with a folder for each sequence and STRETCH bins of it, so that reading some reads their files only.

    Ranges are over the bins too, so a long sequence is written by many tasks, and files are sorted. The genome, if given, and
    the bin size are kept in the folder _genome. zoom_levels: bin sizes, multiples of bin_size, of coarser levels in the
    folder _zoom: sums, counts and extremes of their bins, each level made of the coarsest one before it that divides it, so
    the track itself is read back once.
    """
    spark = df.sparkSession
    rows = df.select(F.col("seqname").cast("string").alias("seqname"), F.col("bin").cast("int").alias("bin"), F.col("value").cast("double").alias("value"), F.expr(f"bin div {STRETCH}").alias("blk"))
    rows.repartitionByRange("seqname", "bin").sortWithinPartitions("seqname", "bin").write.mode("overwrite").partitionBy("seqname", "blk").parquet(path)
    if genome is not None:
        genome.select("seqname", F.col("nbins").cast("int").alias("nbins"), F.lit(bin_size).alias("bin_size")).write.mode("overwrite").parquet(f"{path}/_genome")
    factors = sorted({level // bin_size for level in zoom_levels if level > bin_size})
    if bad := [level for level in zoom_levels if level < 1 or level % bin_size]:
        raise ValueError(f"zoom levels must be multiples of the bin size {bin_size}: {bad}")
    done = [1]
    for factor in factors:
        below = max(f for f in done if factor % f == 0)
        finer = sums_of(read_bins(spark, path)) if below == 1 else read_level(spark, path, below)
        sums = _coarser(finer, factor // below)
        sums.repartitionByRange("seqname", "bin").sortWithinPartitions("seqname", "bin").write.mode("overwrite").partitionBy("seqname").parquet(f"{path}/_zoom/bins={factor}")
        done.append(factor)


def _coarser(sums: DataFrame, factor: int) -> DataFrame:
    """Sums of `factor` bins each; added up in each task before they are shuffled."""
    return sums.groupBy("seqname", F.expr(f"bin div {factor}").cast("int").alias("bin")).agg(*SUMS("total", "n", "high", "low"))


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """(seqname, bin, value, blk) of a stored track; names of sequences are text whatever they look like."""
    return spark.read.schema(_BINS).parquet(path).select(*KEYS, "value", "blk")


def read_level(spark: SparkSession, path: str, factor: int) -> DataFrame:
    """(seqname, bin, total, n, high, low) of a stored level whose bins are `factor` of the track's."""
    return spark.read.schema(_LEVEL).parquet(f"{path}/_zoom/bins={factor}").select(*KEYS, "total", "n", "high", "low")


def stored_levels(spark: SparkSession, path: str) -> list[int]:
    """The factors of a track's levels, in order; its own bins are no level."""
    root = f"{path}/_zoom"
    if not _there(spark, root):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in found if "=" in f.getPath().getName())


def track_sizes(spark: SparkSession, path: str) -> DataFrame | None:
    """(seqname, nbins, bin_size) of a track that was written with its genome; None of another."""
    return spark.read.parquet(f"{path}/_genome") if _there(spark, f"{path}/_genome") else None


def open_track(spark: SparkSession, path: str, names: list[str] | None = None, init: float = 0.0) -> Track:
    """A stored track; some of its sequences if names are given. Nothing but its sizes is read before its bins are used."""
    df, sizes = read_bins(spark, path).drop("blk"), track_sizes(spark, path)
    if names:
        df, sizes = (x if x is None else x.filter(F.col("seqname").isin(names)) for x in (df, sizes))
    genome = df.groupBy("seqname").agg((F.max("bin") + 1).cast("int").alias("nbins")) if sizes is None else sizes.select("seqname", "nbins")
    own = 1 if sizes is None else (sizes.agg(F.max("bin_size")).first()[0] or 1)
    return Track(df, genome, own, init)


def read_zoomed(spark: SparkSession, path: str, width: int, summary: str = "mean", overlap: int = 0, names: list[str] | None = None, init: float = 0.0) -> Track:
    """A stored track in bins of `width` positions, made of the coarsest stored level that divides it, or of its own bins.

    Equal to rebinning the track itself, but for the rounding of sums.
    """
    track = open_track(spark, path, names, init)
    factor, left = divmod(width, track.bin_size)
    if left or not factor:
        raise ValueError(f"a track of bins of {track.bin_size} can't be read in bins of {width}")
    if factor == 1 and not overlap:
        return track
    below = max((f for f in stored_levels(spark, path) if factor % f == 0), default=1)
    finer = sums_of(track.df) if below == 1 else read_level(spark, path, below)
    if names and below > 1:
        finer = finer.filter(F.col("seqname").isin(names))
    genome = track.genome.select("seqname", F.ceil(F.col("nbins") / factor).cast("int").alias("nbins"))
    sums = finer if below == factor else _coarser(finer, factor // below)
    return from_sums(sums, genome, width, summary, overlap, init)


def read_regions(spark: SparkSession, path: str, regions: DataFrame) -> Track:
    """A stored track with the bins of the folders that regions (seqname, from, to) touch; others are not opened.

    The names of those folders, a row for each, are looked up first; regions that touch more than FOLDERS give the whole
    track between the first and the last of their bins.
    """
    track = open_track(spark, path)
    first, last = (F.expr(f"{x} div {track.bin_size} div {STRETCH}") for x in ("`from`", "(`to` - 1)"))
    touched = regions.filter((F.col("to") > F.col("from")) & (F.col("to") > 0)).select("seqname", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("blk")).distinct()
    folders = touched.limit(FOLDERS + 1).collect()
    rows = read_bins(spark, path)
    if len(folders) <= FOLDERS:
        rows = rows.filter(F.concat_ws("/", "seqname", F.col("blk").cast("string")).isin([f"{r.seqname}/{r.blk}" for r in folders]))
    ends = regions.filter("`to` > `from`").agg(F.min("from"), F.max("to")).first()
    if ends[0] is not None:
        rows = rows.filter(F.col("bin").between(ends[0] // track.bin_size, (ends[1] - 1) // track.bin_size))
    return replace(track, df=rows.drop("blk"))
