"""Peaks: runs of bins above a threshold, alone, together on several tracks, or where tracks intersect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackengine.functions.arrays import above, offsets

from .intervals import PIECE, intersect, ranked, without_overlapped
from .track import Track, require_aligned, wide
from .windows import BLOCK, passing, runs


def _extent(found: DataFrame, track: Track, wsize: int) -> DataFrame:
    """from and to of runs: a clipped window around the start of the best bin, or the run itself with its overhang."""
    o1, o2 = offsets(wsize)
    bs = track.bin_size
    if wsize > 0:
        start, limit = F.col("best_bin") * bs, F.col("nbins") * bs
        lo, hi = F.greatest(start - o1, F.lit(0)), F.least(start + o2 + 1, limit)
        found = found.join(track.genome, "seqname")
    else:
        lo, hi = F.col("first") * bs - o1, (F.col("last") + 1) * bs + o2 + 1
    return found.withColumns({"from": lo.cast("int"), "to": hi.cast("int"), "strand": F.lit("*")})


def peaks(track: Track, threshold: float, wsize: int = 0, block: int = BLOCK) -> DataFrame:
    """(seqname, from, to, strand, test): maximal runs above the threshold by their height, highest first.

    wsize > 0 gives a window of that many positions around the start of the first highest bin. Otherwise the whole run,
    which for wsize 0 reaches one position past its last bin, and for -1 is exact.
    """
    return _peaks(track, threshold, wsize, block).orderBy(F.desc("test"), "seqname", "from", "to")


def _peaks(track: Track, threshold: float, wsize: int, block: int) -> DataFrame:
    """The same in no order, for what goes on with them."""
    found = _extent(runs(passing(track, threshold), F.col("value"), block), track, wsize)
    return found.select("seqname", "from", "to", "strand", F.col("best").alias("test"))


def _sum(n: int) -> Column:
    return reduce(lambda a, b: a + b, (F.get("v", F.lit(i)) for i in range(n)))


def _all_above(thresholds: list[float]) -> Column:
    return reduce(lambda a, b: a & b, (above(F.get("v", F.lit(i)), t) for i, t in enumerate(thresholds)))


def joint_peaks(tracks: list[Track], thresholds: list[float], wsize: int = 0, block: int = BLOCK) -> DataFrame:
    """Runs in which every track is above its own threshold; test has all values at the first highest sum."""
    if len(tracks) != len(thresholds):
        raise ValueError("a threshold is needed for each track")
    require_aligned(tracks, every=False)
    found = runs(wide(tracks).filter(_all_above(thresholds)), _sum(len(tracks)), block)
    found = _extent(found, tracks[0], wsize)
    return ranked(found.select("seqname", "from", "to", "strand", F.col("best_row.v").alias("test")))


def intersecting_peaks(tracks: list[Track], thresholds: list[float], wsize: int = 0, block: int = BLOCK) -> DataFrame:
    """Intersections of the whole-run peaks of all tracks; wsize > 0 puts a window, not clipped, around their middles."""
    if len(tracks) != len(thresholds):
        raise ValueError("a threshold is needed for each track")
    single = lambda t, h: _peaks(t, h, 0, block).withColumn("test", F.array("test"))
    found = reduce(intersect, (single(t, h) for t, h in zip(tracks, thresholds)))
    if wsize > 0:
        o1, o2 = offsets(wsize)
        middle = F.expr("(`from` + `to` - 1) div 2").cast("int")
        found = found.withColumn("middle", middle).withColumns({"from": F.col("middle") - o1, "to": F.col("middle") + o2 + 1}).drop("middle")
    return ranked(found)


def predictions(tracks: list[Track], thresholds: list[float], wsize: int) -> DataFrame:
    """A clipped window at every bin where all tracks are above their thresholds, without those that an overlapping one
    reaches in the sum of its values."""
    if len(tracks) != len(thresholds):
        raise ValueError("a threshold is needed for each track")
    o1, o2 = offsets(wsize)
    bs = tracks[0].bin_size
    rows = wide(tracks).filter(_all_above(thresholds)).join(tracks[0].genome, "seqname")
    lo, hi = F.greatest(F.col("bin") * bs - o1, F.lit(0)), F.least(F.col("bin") * bs + o2 + 1, F.col("nbins") * bs)
    rows = rows.select("seqname", lo.cast("int").alias("from"), hi.cast("int").alias("to"), F.lit("*").alias("strand"), F.col("v").alias("test"), "bin")
    total = reduce(lambda a, b: a + b, (F.get("test", F.lit(i)) for i in range(len(tracks))))
    # windows have one width, so one level of pieces as wide is enough
    return ranked(without_overlapped(rows, total, ["seqname", "bin"], piece=max(PIECE, wsize), levels=1).drop("bin"))

