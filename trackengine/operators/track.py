"""Tracks: one double for each bin of each sequence, dense, NaN where masked."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackengine.functions.arrays import NAN

KEYS = ["seqname", "bin"]
SUMMARIES = {"mean": lambda s: s["total"] / s["n"], "discrete mean": lambda s: F.floor(s["total"] / s["n"] + 0.5).cast("double"), "max": lambda s: s["high"], "min": lambda s: s["low"]}


@dataclass(frozen=True)
class Track:
    """df: (seqname, bin, value); genome: (seqname, nbins), a row for each sequence. Operators return new tracks."""

    df: DataFrame
    genome: DataFrame
    bin_size: int = 1
    init: float = 0.0

    def map(self, f: Callable[[Column], Column]) -> "Track":
        new = replace(self, df=self.df.select(*KEYS, f(F.col("value")).alias("value")))
        return new if self.shared is None else new._sharing(self.shared[0], f(self.shared[1]))

    def map_positions(self, f: Callable[[Column, Column, Column], Column]) -> "Track":
        """f(seqname, position, value)."""
        position = F.col("bin") * self.bin_size
        new = replace(self, df=self.df.select(*KEYS, f(F.col("seqname"), position, F.col("value")).alias("value")))
        return new if self.shared is None else new._sharing(self.shared[0], f(F.col("seqname"), position, self.shared[1]))

    @property
    def shared(self) -> tuple[DataFrame, Column] | None:
        """The table of several tracks (seqname, bin, …) that this one is a column of, and that column; None of others."""
        return self.__dict__.get("_shared")

    def _sharing(self, table: DataFrame, value: Column) -> "Track":
        # no field, so that a track that replace() gives another df doesn't have it
        self.__dict__["_shared"] = (table, value)
        return self

    def filter_genome(self, names: Iterable[str]) -> "Track":
        keep = F.col("seqname").isin(list(names))
        return replace(self, df=self.df.filter(keep), genome=self.genome.filter(keep))


#: Bins that one row of the spine stands for before they are dealt out.
SPINE_BLOCK = 65_536


def spine(genome: DataFrame) -> DataFrame:
    """(seqname, bin): all bins of all sequences, by way of their blocks, so that no row holds a long sequence."""
    blocks = genome.filter("nbins > 0").select("seqname", "nbins", F.explode(F.sequence(F.lit(0), F.expr(f"cast((nbins - 1) div {SPINE_BLOCK} as int)"))).alias("blk"))
    first = F.col("blk") * SPINE_BLOCK
    return blocks.select("seqname", F.explode(F.sequence(first, F.least(first + SPINE_BLOCK, F.col("nbins").cast("int")) - 1)).alias("bin"))


def tracks_of(table: DataFrame, columns: list[str], genome: DataFrame, bin_size: int = 1, init: float = 0.0) -> list[Track]:
    """The columns of a dense table (seqname, bin, …) as aligned tracks; operators on several of them don't join them."""
    return [Track(table.select(*KEYS, F.col(c).alias("value")), genome, bin_size, init)._sharing(table, F.col(c)) for c in columns]


def SUMS(total: str, n: str, high: str, low: str) -> list[Column]:
    """Aggregates of sums, counts and extremes that are sums, counts and extremes again."""
    return [F.sum(total).alias("total"), F.sum(n).alias("n"), F.max(high).alias("high"), F.min(low).alias("low")]


def sums_of(df: DataFrame) -> DataFrame:
    """(seqname, bin, total, n, high, low) of bins (seqname, bin, value), one row for each; null values count as none."""
    value = F.col("value").cast("double")
    return df.select(*KEYS, value.alias("total"), F.when(value.isNotNull(), 1).otherwise(0).cast("long").alias("n"), value.alias("high"), value.alias("low"))


def from_sums(sums: DataFrame, genome: DataFrame, bin_size: int, summary: str = "mean", overlap: int = 0, init: float = 0.0, digits: int | None = None) -> "Track":
    """A track of the summaries of sums (seqname, bin, total, n, high, low); bins without any get init.

    overlap widens each bin's summary by as many bins on both sides. The spine of empty bins takes part in the same
    aggregation, so filling costs no join.
    """
    if summary not in SUMMARIES:
        raise ValueError(f"unknown bin summary {summary!r}")
    if overlap:
        near = F.explode(F.sequence(F.col("bin") - overlap, F.col("bin") + overlap)).alias("bin")
        sums = sums.select("seqname", near, "total", "n", "high", "low")
    empty = spine(genome).select(*KEYS, *(F.lit(None).cast(t).alias(c) for c, t in (("total", "double"), ("n", "long"), ("high", "double"), ("low", "double"))), F.lit(1).alias("in"))
    both = sums.select(*KEYS, "total", "n", "high", "low").withColumn("in", F.lit(0)).unionByName(empty).groupBy(*KEYS).agg(*SUMS("total", "n", "high", "low"), F.max("in").alias("in"))
    value = SUMMARIES[summary]({c: F.col(c) for c in ("total", "n", "high", "low")})
    value = F.round(value, digits) if digits is not None else value
    return Track(both.filter(F.col("in") == 1).select(*KEYS, F.when(F.col("n") > 0, value).otherwise(F.lit(float(init))).alias("value")), genome, bin_size, init)


def bin_signal(signal: DataFrame, genome: DataFrame, bin_size: int = 1, summary: str = "mean", overlap: int = 0, init: float = 0.0, digits: int | None = None) -> Track:
    """A track of the summaries of (seqname, pos, value) observations in each bin; bins without any get init.

    overlap widens each bin's summary by as many bins on both sides. Observations outside the genome and null values are
    left out; NaN ones are observations. Sums are made before the shuffle, and the spine joins the same aggregation, so
    filling costs no join. digits rounds the summaries.
    """
    if summary not in SUMMARIES:
        raise ValueError(f"unknown bin summary {summary!r}")
    if bin_size < 1 or overlap < 0:
        raise ValueError("bin_size must be positive and overlap not negative")
    own = signal.filter("value IS NOT NULL").select("seqname", F.floor(F.col("pos") / bin_size).cast("int").alias("bin"), F.col("value").cast("double").alias("value"))
    sums = sums_of(own)
    # with an overlap, bins are added up before they are copied to their neighbours
    return from_sums(sums.groupBy(*KEYS).agg(*SUMS("total", "n", "high", "low")) if overlap else sums, genome, bin_size, summary, overlap, init, digits)


def rebin(track: Track, factor: int, summary: str = "mean", overlap: int = 0) -> Track:
    """Bins of `factor` bins each (a zoom level), whose summaries take in `overlap` such bins on both sides."""
    genome = track.genome.select("seqname", F.ceil(F.col("nbins") / factor).cast("int").alias("nbins"))
    coarse = bin_signal(track.df.select("seqname", F.col("bin").alias("pos"), "value"), genome, factor, summary, overlap, init=track.init)
    return replace(coarse, bin_size=track.bin_size * factor)


def combine(tracks: list[Track], f: Callable[..., Column]) -> Track:
    """f of the aligned values of several tracks; sequences or bins that one lacks are left out."""
    df = wide(tracks)
    values = [F.get("v", F.lit(i)) for i in range(len(tracks))]
    return replace(tracks[0], df=df.select(*KEYS, f(*values).alias("value")))


def require_aligned(tracks: list[Track], every: bool = True) -> None:
    """An error where a sequence has different lengths in two tracks, or is not in all of them if every is set.

    Genomes have a row for each sequence, so this reads no bins, and nothing at all where all tracks have one genome.
    """
    if all(t.genome is tracks[0].genome for t in tracks):
        return
    lengths = None
    for i, t in enumerate(tracks):
        part = t.genome.select("seqname", F.col("nbins").alias("n"), F.lit(i).alias("i"))
        lengths = part if lengths is None else lengths.unionByName(part)
    found = lengths.groupBy("seqname").agg(F.count("*").alias("k"), F.countDistinct("n").alias("d"))
    bad = found.filter((F.col("d") > 1) | ((F.col("k") < len(tracks)) if every else F.lit(False))).orderBy("seqname").limit(5).collect()
    if bad:
        raise ValueError(f"sequences differ between tracks: {', '.join(r.seqname for r in bad)}")


def wide(tracks: list[Track]) -> DataFrame:
    """(seqname, bin, v): the values of all tracks as one array; columns of one table as they are, others by joins on the bin."""
    if len({t.bin_size for t in tracks}) > 1:
        raise ValueError("tracks have different bin sizes")
    if all(t.shared and t.shared[0] is tracks[0].shared[0] for t in tracks):
        return tracks[0].shared[0].select(*KEYS, F.array(*(t.shared[1] for t in tracks)).alias("v"))
    df = tracks[0].df.select(*KEYS, F.col("value").alias("v0"))
    for i, t in enumerate(tracks[1:], 1):
        df = df.join(t.df.select(*KEYS, F.col("value").alias(f"v{i}")), KEYS)
    return df.select(*KEYS, F.array(*(F.col(f"v{i}") for i in range(len(tracks)))).alias("v"))


def _bins(regions: DataFrame, bin_size: int, *keep: str) -> DataFrame:
    """Regions [from, to) as rows of the bins that they touch."""
    first, last = F.floor(F.col("from") / bin_size).cast("int"), F.floor((F.col("to") - 1) / bin_size).cast("int")
    return regions.filter(F.col("to") > F.col("from")).select(*keep, "seqname", F.explode(F.sequence(first, last)).alias("bin"))


def mask(track: Track, regions: DataFrame) -> Track:
    """NaN in every bin that a region touches."""
    hit = _bins(regions, track.bin_size).distinct().withColumn("hit", F.lit(True))
    return replace(track, df=track.df.join(hit, KEYS, "left").select(*KEYS, F.when(F.col("hit"), NAN).otherwise(F.col("value")).alias("value")))


def region_vectors(track: Track, regions: DataFrame, key: str = "region_id") -> DataFrame:
    """(key, v): the values of the bins of each region, in order; bins outside the track are left out."""
    rows = _bins(regions, track.bin_size, key).join(track.df, KEYS)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("b")).select(key, F.transform("b", lambda x: x["value"]).alias("v"))


def region_matrices(tracks: list[Track], regions: DataFrame, key: str = "region_id") -> DataFrame:
    """(key, m): a row for each track and a column for each bin of the region."""
    require_aligned(tracks, every=False)
    rows = _bins(regions, tracks[0].bin_size, key).join(wide(tracks), KEYS)
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("b"))
    row = lambda i: F.transform("b", lambda x: F.get(x["v"], F.lit(i)))
    return rows.select(key, F.array(*(row(i) for i in range(len(tracks)))).alias("m"))
