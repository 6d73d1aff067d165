"""Window frames over dense tracks, cut into blocks of bins so that one long sequence is many tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackengine.functions.arrays import NAN, above, offsets

from .scans import BLOCK, BlockScan, scan
from .track import KEYS, Track, require_aligned, wide


def halo(df: DataFrame, left: int, right: int, block: int = BLOCK) -> DataFrame:
    """df with a column blk: each row in its block, and again in those that look left or right at it."""
    left, right = max(left, 0), max(right, 0)
    block = max(block, left, right, 1)
    own, inside = F.expr(f"bin div {block}"), F.col("bin") % block
    also = F.array(own, F.when(inside < right, own - 1), F.when(inside >= block - left, own + 1))
    return df.withColumn("blk", F.explode(F.filter(also, lambda b: b.isNotNull()))).withColumn("home", own == F.col("blk"))


def frames(df: DataFrame, left: int, right: int, values: str = "value", block: int = BLOCK, keep_bins: bool = False) -> DataFrame:
    """df with win: the values of bins bin - left to bin + right, fewer at the ends of a sequence.

    keep_bins: win has pairs (bin, value), for tables that lack some bins.
    """
    over = Window.partitionBy("seqname", "blk").orderBy("bin").rowsBetween(-left, right)
    what = F.struct("bin", values) if keep_bins else values
    return halo(df, left, right, block).withColumn("win", F.collect_list(what).over(over)).filter("home").drop("blk", "home")


def centred(track: Track, n: int, block: int = BLOCK) -> DataFrame:
    """(seqname, bin, value, win) with the n bins around each bin; a window of one is a projection."""
    if n < 1:
        raise ValueError("windows need a fixed positive size")
    left, right = offsets(n)
    return track.df.withColumn("win", F.array("value")) if n == 1 else frames(track.df, left, right, block=block)


def sized(win: Column, size: int | None) -> Column:
    """An array as it is; an error where it hasn't the declared size."""
    if size is None:
        return win
    return F.when(F.size(win) == size, win).otherwise(F.raise_error(F.lit(f"a transform of a window doesn't give {size} values")).cast("array<double>"))


def classify(track: Track, n: int, score: Callable[[Column], Column], transform: Callable[[Column], Column] | None = None, block: int = BLOCK, size: int | None = None) -> Track:
    """The score of the n bins around each bin; NaN where the window leaves the sequence. NaN values are passed on.

    size: how many values the transform of a whole window gives; another number is an error.
    """
    win = sized(transform(F.col("win")) if transform else F.col("win"), size)
    value = F.when(F.size("win") == n, score(win)).otherwise(NAN)
    return replace(track, df=centred(track, n, block).select(*KEYS, value.alias("value")))


def sliding(df: DataFrame, n: int, what: str, value: Column | None = None, block: int = BLOCK) -> DataFrame:
    """df with out: the sum, mean, max or min of the n values around each bin, null where the window leaves the sequence.

    A row costs the same whatever n is: sums are differences of running sums (NaN and infinite values are counted apart, so that they
    don't spread), extremes are those of two parts of a window that chunks of n bins cut it into. df has every bin of its sequences.
    """
    if n < 1 or what not in ("sum", "mean", "max", "min"):
        raise ValueError("a window of at least one bin, and sum, mean, max or min are known")
    left, right = offsets(n)
    rows = halo(df.withColumn("x__", F.col("value") if value is None else value), left + 1, right, block)
    block_ = Window.partitionBy("seqname", "blk").orderBy("bin")
    # the first window deals rows out by blocks; those of chunks then stay where they are
    rows = rows.withColumn("size__", F.count("*").over(block_.rowsBetween(-left, right)))
    if what in ("sum", "mean"):
        upto = block_.rowsBetween(Window.unboundedPreceding, 0)
        finite = ~F.isnan("x__") & (F.abs("x__") < float("inf"))
        sums = {"s__": F.when(finite, F.col("x__")).otherwise(0.0), "nan__": F.isnan("x__").cast("int"), "up__": (F.col("x__") == float("inf")).cast("int"), "down__": (F.col("x__") == -float("inf")).cast("int")}
        rows = rows.withColumns(sums).withColumns({c: F.sum(c).over(upto) for c in sums})
        part = {c: F.lead(c, right).over(block_) - F.coalesce(F.lag(c, left + 1).over(block_), F.lit(0)) for c in sums}
        total = F.when((part["nan__"] > 0) | ((part["up__"] > 0) & (part["down__"] > 0)), NAN).when(part["up__"] > 0, float("inf")).when(part["down__"] > 0, -float("inf")).otherwise(part["s__"])
        out = total / n if what == "mean" else total
        spent = list(sums)
    else:
        pick = F.max if what == "max" else F.min
        chunk = Window.partitionBy("seqname", "blk", F.expr(f"bin div {n}"))
        bad, y = F.isnan("x__").cast("int"), F.when(~F.isnan("x__"), F.col("x__"))
        front, back = chunk.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), chunk.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        parts = {"f__": pick(y).over(front), "b__": pick(y).over(back), "fn__": F.max(bad).over(front), "bn__": F.max(bad).over(back)}
        rows = rows.withColumns(parts)
        ends = [F.lag(c, left).over(block_) if c.startswith("b") else F.lead(c, right).over(block_) for c in ("b__", "f__", "bn__", "fn__")]
        best = (F.greatest if what == "max" else F.least)(ends[0], ends[1])
        out = F.when(F.greatest(ends[2], ends[3]) > 0, NAN).otherwise(best)
        spent = list(parts)
    rows = rows.withColumn("out", out).filter("home")
    return rows.withColumn("out", F.when(F.col("size__") == n, F.col("out"))).drop("blk", "home", "x__", "size__", *spent)


def classify_wide(track: Track, n: int, what: str = "mean", value: Callable[[Column], Column] | None = None, block: int = BLOCK) -> Track:
    """The sum, mean, max or min of the n bins around each bin (of what `value` makes of them), at a cost that doesn't depend on n.

    NaN where the window leaves the sequence or holds a NaN.
    """
    rows = sliding(track.df, n, what, value(F.col("value")) if value else None, block)
    return replace(track, df=rows.select(*KEYS, F.coalesce("out", F.lit(NAN)).alias("value")))


def classify_wide_multi(tracks: list[Track], n: int, what: str, value: Callable[[Column], Column], block: int = BLOCK) -> Track:
    """As classify_wide(), of what `value` makes of the array of all tracks' values at a bin."""
    require_aligned(tracks, every=False)
    rows = sliding(wide(tracks), n, what, value(F.col("v")), block)
    return replace(tracks[0], df=rows.select(*KEYS, F.coalesce("out", F.lit(NAN)).alias("value")))


def classify_many(tracks: list[Track], n: int, scores: list[Callable[[Column], Column]]) -> Track:
    """Sum of each track's own scores."""
    parts = [classify(t, n, s) for t, s in zip(tracks, scores, strict=True)]
    total = F.get("v", F.lit(0))
    for i in range(1, len(parts)):
        total = total + F.get("v", F.lit(i))
    return replace(tracks[0], df=wide(parts).select(*KEYS, total.alias("value")))


def classify_matrices(df: DataFrame, score: Callable[[Column], Column], rows: int, columns: int, transform: Callable[[Column], Column] | None = None, m: str = "m", transposed: bool = False) -> DataFrame:
    """df with score: that of each matrix (an array of `rows` rows of `columns` numbers); another size is an error."""
    from trackengine.functions.arrays import transpose

    fits = (F.size(m) == rows) & F.forall(m, lambda r: F.size(r) == columns)
    checked = F.when(fits, F.col(m)).otherwise(F.raise_error(F.lit(f"a matrix is not {rows} by {columns}")).cast(df.schema[m].dataType))
    matrix = transpose(checked) if transposed else checked
    return df.withColumn("score", score(transform(matrix) if transform else matrix))


def classify_multi(tracks: list[Track], n: int, score: Callable[[Column], Column], transposed: bool = False, block: int = BLOCK) -> Track | None:
    """The score of each window over all tracks: a matrix of tracks by bins, or bins by tracks if transposed.

    Sequences that a track lacks are left out; one that has different lengths is an error.
    """
    from trackengine.functions.arrays import transpose

    if not tracks:
        return None
    require_aligned(tracks, every=False)
    left, right = offsets(n)
    rows = frames(wide(tracks), left, right, "v", block)
    matrix = F.col("win") if transposed else transpose(F.col("win"))
    return replace(tracks[0], df=rows.select(*KEYS, F.when(F.size("win") == n, score(matrix)).otherwise(NAN).alias("value")))


def hopping(track: Track, n: int, step: int = 0, block: int = BLOCK) -> DataFrame:
    """(seqname, bin, win): windows of n bins from each step-th bin on, for estimation: without NaN, and from bins
    before nbins - n only, so that the last possible window is never one. step <= 0 takes n."""
    step = step if step > 0 else n
    rows = frames(track.df, 0, n - 1, block=block) if n > 1 else track.df.withColumn("win", F.array("value"))
    rows = rows.join(track.genome, "seqname").filter((F.col("bin") % step == 0) & (F.col("bin") < F.col("nbins") - n))
    return rows.filter(~F.exists("win", F.isnan)).select(*KEYS, "win")


def hopping_multi(tracks: list[Track], n: int, step: int = 0, block: int = BLOCK) -> DataFrame:
    """(seqname, bin, win) over aligned tracks: centred windows at every step-th bin from the first whole one; NaN stays.

    A sequence that one of the tracks lacks, or has in another length, is an error.
    """
    require_aligned(tracks)
    step = step if step > 0 else n
    left, right = offsets(n)
    rows = frames(wide(tracks), left, right, "v", block).join(tracks[0].genome, "seqname")
    inside = (F.col("bin") >= left) & (F.col("bin") < F.col("nbins") - right)
    return rows.filter(inside & ((F.col("bin") - left) % step == 0)).select(*KEYS, "win")


def classify_sequences(track: Track, f: Callable | BlockScan, transform: Callable | None = None, block: int = BLOCK) -> Track:
    """f on the whole value vector of each sequence (a numpy array), giving one of equal length.

    A BlockScan sees blocks and what it summed the others up to, so a long sequence is many tasks (transform is then applied to
    blocks). A plain function may look at any bin, so a sequence is one task's.
    """
    if isinstance(f, BlockScan):
        change = (lambda g: lambda x, *ends: g(transform(x), *ends)) if transform else (lambda g: g)
        return replace(track, df=scan(track.df, BlockScan(change(f.summary), f.chain, change(f.finish)), block=block))

    def run(pdf):
        pdf = pdf.sort_values("bin")
        x = pdf["value"].to_numpy(float)
        out = f(transform(x) if transform else x)
        if len(out) != len(x):
            raise ValueError("a sequence classifier must keep the length")
        return pdf.assign(value=out)

    return replace(track, df=track.df.groupBy("seqname").applyInPandas(run, "seqname string, bin int, value double"))


def classify_sequences_multi(tracks: list[Track], f: Callable | BlockScan, transposed: bool = False, block: int = BLOCK) -> Track:
    """f on the matrix of whole sequences (tracks by bins, or bins by tracks if transposed), giving a value for each bin.

    A BlockScan gets the matrices of blocks.
    """
    import numpy as np

    require_aligned(tracks, every=False)
    if isinstance(f, BlockScan):
        turn = (lambda g: lambda x, *ends: g(x.T, *ends)) if transposed else (lambda g: g)
        return replace(tracks[0], df=scan(wide(tracks), BlockScan(turn(f.summary), f.chain, turn(f.finish)), "v", block))

    def run(pdf):
        pdf = pdf.sort_values("bin")
        m = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        out = f(m if transposed else m.T)
        if len(out) != len(pdf):
            raise ValueError("a sequence classifier must keep the length")
        return pdf[KEYS].assign(value=out)

    return replace(tracks[0], df=wide(tracks).groupBy("seqname").applyInPandas(run, "seqname string, bin int, value double"))


def runs(df: DataFrame, order: Column, block: int = BLOCK) -> DataFrame:
    """Runs of adjacent bins of df (seqname, bin, value, …): (seqname, first, last, best, best_bin, best_row).

    best: first largest `order` of a run. Runs are found in blocks; only those that touch a block's border are put
    together over the sequence, at most two of each block.
    """
    rows = df.withColumn("blk", F.expr(f"bin div {block}"))
    over = Window.partitionBy("seqname", "blk").orderBy("bin")
    rows = rows.withColumn("grp", F.col("bin") - F.row_number().over(over))
    best = F.max(F.struct(order.alias("best"), (-F.col("bin")).alias("minus"), *(F.col(c) for c in df.columns if c not in KEYS)))
    local = rows.groupBy("seqname", "blk", "grp").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), best.alias("top"))
    local = local.select("seqname", "first", "last", "top")
    border = (F.col("first") % block == 0) | ((F.col("last") + 1) % block == 0)
    seq = Window.partitionBy("seqname").orderBy("first")
    touching = local.filter(border).withColumn("new", F.when(F.lag("last").over(seq) + 1 == F.col("first"), 0).otherwise(1))
    touching = touching.withColumn("run", F.sum("new").over(seq)).groupBy("seqname", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("top").alias("top"))
    return local.filter(~border).unionByName(touching.drop("run")).select("seqname", "first", "last", "top.best", (-F.col("top.minus")).alias("best_bin"), F.col("top").alias("best_row"))


def passing(track: Track, threshold: float) -> DataFrame:
    return track.df.filter(above(F.col("value"), threshold))
