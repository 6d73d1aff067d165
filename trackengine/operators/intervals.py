"""Half-open intervals (seqname, from, to, …): overlaps, intersections, suppression, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackengine.functions.arrays import slice_sum

#: Width of the pieces by which intervals meet; an interval is in each piece that it touches.
PIECE = 4096
#: Pieces of a level are so many times as wide as those of the level below; levels.
GROWTH, LEVELS = 64, 3
#: Positions of a stretch in which abutting rows are put together by one task.
STRETCH = 1 << 24
#: Positions of a block in which one task adds up the ends of intervals from left to right.
BLOCK = 1 << 16


def _pieces(df: DataFrame, piece: int, levels: int) -> DataFrame:
    """Rows by the pieces that they touch: at the level of their own length (own), and at all coarser ones.

    Pieces of a level are GROWTH times as wide as those of the one below. A row is of the finest level whose pieces are as
    wide as it, so it touches two of them at most; at the coarsest level wider rows may touch more.
    """
    size = F.lit(piece) * F.pow(F.lit(GROWTH), F.col("at")).cast("long")
    length = (F.col("to") - F.col("from")).cast("long")
    level = sum(((length > piece * GROWTH**k).cast("int") for k in range(levels - 1)), F.lit(0))
    rows = df.filter(F.col("to") > F.col("from")).withColumn("level", level).withColumn("at", F.explode(F.sequence("level", F.lit(levels - 1))))
    first, last = F.floor(F.col("from") / size), F.floor((F.col("to") - 1) / size)
    return rows.withColumns({"own": F.col("level") == F.col("at"), "piece": F.explode(F.sequence(first, last))}).drop("level")


def _sides(spans: DataFrame, points: DataFrame, names: tuple[str, str], piece: int, levels: int) -> tuple[DataFrame, DataFrame, Column]:
    """Two sides and the condition of a join, which finds each pair of a span and a row that begins in it or at its start once.

    A span is in the pieces of its own level only, at most two but at the coarsest; the other row is in one piece of each
    level that any span is of, that of its start. names: what the columns of spans and points begin with.
    """
    s, p = names
    left = _pieces(spans, piece, levels).filter("own").drop("own")
    there = F.broadcast(left.select("at").distinct())  # a row for each level
    size = F.lit(piece) * F.pow(F.lit(GROWTH), F.col("at")).cast("long")
    right = points.filter(F.col("to") > F.col("from")).withColumn("at", F.explode(F.array(*map(F.lit, range(levels))))).join(there, "at", "left_semi")
    right = right.withColumn("piece", F.floor(F.col("from") / size))
    met = F.lit(True)
    for c in ("seqname", "at", "piece"):
        met = met & (F.col(f"{s}_{c}") == F.col(f"{p}_{c}"))
    named = (df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)) for side, df in ((s, left), (p, right)))
    return *named, met & (F.col(f"{s}_from") <= F.col(f"{p}_from")) & (F.col(f"{p}_from") < F.col(f"{s}_to"))


def overlaps(a: DataFrame, b: DataFrame, piece: int = PIECE, levels: int = LEVELS) -> DataFrame:
    """All pairs of overlapping rows, a's columns under a_ and b's under b_.

    Of two that overlap, one begins in the other or with it: rows of b that begin in one of a, or with it, and rows of a that begin
    later than one of b that they are in. Both are equi-joins on (seqname, level, piece). Rows without length meet nothing.
    levels=1 is enough where no row is wider than some pieces.
    """
    columns = [*(f"a_{c}" for c in a.columns), *(f"b_{c}" for c in b.columns)]
    left, right, met = _sides(a, b, ("a", "b"), piece, levels)
    inner, outer, later = _sides(b, a, ("b", "a"), piece, levels)
    return left.join(right, met).select(*columns).unionByName(outer.join(inner, later & (F.col("b_from") < F.col("a_from"))).select(*columns))


def overlapping_pairs(df: DataFrame, key: str, piece: int = PIECE, levels: int = LEVELS) -> DataFrame:
    """Each pair of overlapping rows of one table with different keys once, the columns of that with the smaller key under a_.

    One join does: the row that begins first is the span, of two that begin together that with the smaller key.
    """
    span, point, met = _sides(df, df, ("x", "y"), piece, levels)
    first, second = F.col(f"x_{key}"), F.col(f"y_{key}")
    once = (first < second) | ((first > second) & (F.col("x_from") < F.col("y_from")))
    pick = lambda x, y, side: [F.when(first < second, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{side}_{c}") for c in df.columns]
    return span.join(point, met & once).select(*pick("x", "y", "a"), *pick("y", "x", "b"))


def shared(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """a with n, how many rows of b overlap a row (0 for none), and shared, over how many positions in all.

    No pair is made. Those of b that begin before a row's end, less those that end by its start, overlap it; the positions that b
    covers before either end are sums as well. Starts and ends are counted by position first, so a block has at most as many
    rows as positions however many intervals meet there; running sums of blocks are chained over a sequence. Rows without
    length, or without a sequence, are left out.
    """
    there = (F.col("to") > F.col("from")) & F.col("seqname").isNotNull()
    left = a.filter(there)
    place = lambda end, *flags: F.struct(F.col(end).cast("long").alias("pos"), *(F.lit(v).alias(k) for k, v in zip(("start", "end", "asked"), flags)))
    ends, asked = F.array(place("from", 1, 0, 0), place("to", 0, 1, 0)), F.array(place("from", 0, 0, 1), place("to", 0, 0, 1))
    points = b.filter(there).select("seqname", F.inline(ends)).unionByName(left.select("seqname", F.inline(asked)))
    at = points.groupBy("seqname", "pos").agg(F.sum("start").alias("start"), F.sum("end").alias("end"), F.max("asked").alias("asked")).withColumn("block", F.floor(F.col("pos") / block))
    net = F.col("start") - F.col("end")
    sums = {"start": F.col("start"), "end": F.col("end"), "moment": net * F.col("pos")}

    blocks = at.groupBy("seqname", "block").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    earlier = Window.partitionBy("seqname").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("seqname", "block", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in sums))
    so_far = Window.partitionBy("seqname", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = at.select("seqname", "block", "pos", "asked", F.col("start").alias("own"), *(F.sum(v).over(so_far).alias(k) for k, v in sums.items()))
    total = {k: F.col(k) + F.col(f"{k}_before") for k in sums}
    covered = F.col("pos") * (total["start"] - total["end"]) - total["moment"]
    known = inside.filter("asked = 1").join(blocks, ["seqname", "block"]).select("seqname", "pos", (total["start"] - F.col("own")).alias("begun"), total["end"].alias("ended"), covered.alias("covered"))

    def side(end: str) -> DataFrame:
        return known.select(F.col("seqname").alias(f"{end}_seqname"), F.col("pos").alias(f"{end}_pos"), *(F.col(c).alias(f"{end}_{c}") for c in ("begun", "ended", "covered")))

    for end in ("from", "to"):
        left = left.join(side(f"{end}_"), (F.col("seqname") == F.col(f"{end}__seqname")) & (F.col(end) == F.col(f"{end}__pos")))
    return left.select(*a.columns, (F.col("to__begun") - F.col("from__ended")).alias("n"), (F.col("to__covered") - F.col("from__covered")).alias("shared"))


def intersect(a: DataFrame, b: DataFrame, piece: int = PIECE, levels: int = LEVELS) -> DataFrame:
    """Intersections of overlapping peaks: strand of a, test of a with that of b behind it."""
    pairs = overlaps(a, b, piece, levels)
    return pairs.select(F.col("a_seqname").alias("seqname"), F.greatest("a_from", "b_from").alias("from"), F.least("a_to", "b_to").alias("to"), F.col("a_strand").alias("strand"), F.concat("a_test", "b_test").alias("test"))


def without_overlapped(df: DataFrame, score: Column, key: list[str], piece: int = PIECE, levels: int = LEVELS) -> DataFrame:
    """Rows that no other overlapping row reaches in score; of equal ones none stays. key tells rows apart.

    Rows meet in the pieces where one of them begins, as in overlaps(). The search for a better one is a semi join, which ends at the first it finds.
    """
    rows = df.withColumn("score__", score)
    lean = rows.select("seqname", "from", "to", "score__", *(k for k in key if k not in ("seqname", "from", "to")))
    other = ~F.lit(True)
    for k in key:
        other = other | ~F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    better = other & (F.col("b_score__") >= F.col("a_score__"))
    a, b, met = _sides(lean, lean, ("a", "b"), piece, levels)
    outer, inner, inside = _sides(lean, lean, ("b", "a"), piece, levels)
    beaten = a.join(b, met & better, "left_semi").select(*(F.col(f"a_{k}").alias(k) for k in key))
    beaten = beaten.unionByName(inner.join(outer, inside & better, "left_semi").select(*(F.col(f"a_{k}").alias(k) for k in key))).distinct()
    return rows.join(beaten, key, "left_anti").drop("score__")


def ranked(df: DataFrame) -> DataFrame:
    """Peaks by the sum of their test arrays, largest first; ties by sequence and place."""
    return df.withColumn("sum__", slice_sum(F.col("test"))).orderBy(F.desc("sum__"), "seqname", "from", "to").drop("sum__")


def merge_runs(df: DataFrame, state: str = "state", stretch: int = STRETCH) -> DataFrame:
    """Neighbouring rows of one sequence that abut and share a state become one row.

    Rows are put together in stretches of a sequence; then only the first and last row of each stretch meet the others'.
    """
    rows = df.select("seqname", "from", "to", F.col(state).alias("state"), F.floor(F.col("from") / stretch).alias("at"))
    local = _joined(rows, ["seqname", "at"], ["from", "to", "state"])
    border = (F.col("nth") == 1) | (F.col("nth") == F.max("nth").over(Window.partitionBy("seqname", "at")))
    local = local.withColumn("border", border)
    ends = _joined(local.filter("border"), ["seqname"], ["at", "nth"], F.col("at") != F.lag("at").over(Window.partitionBy("seqname").orderBy("at", "nth")))
    same = ["seqname", "from", "to", "state"]
    return local.filter("NOT border").select(*same).unionByName(ends.select(*same)).withColumnRenamed("state", state)


def _joined(rows: DataFrame, by: list[str], order: list[str], may: Column | None = None) -> DataFrame:
    """(by…, nth, from, to, state): rows put together where each abuts the one before it in the order, and `may` holds."""
    over = Window.partitionBy(*by).orderBy(*order)
    same = (F.lag("to").over(over) == F.col("from")) & F.lag("state").over(over).eqNullSafe(F.col("state"))
    new = (~F.coalesce(same if may is None else same & may, F.lit(False))).cast("int")
    numbered = rows.withColumn("new", new).withColumn("run", F.sum("new").over(over))
    return numbered.groupBy(*by, F.col("run").alias("nth_")).agg(F.min("from").alias("from"), F.max("to").alias("to"), F.first("state").alias("state")).withColumnRenamed("nth_", "nth")


def remove(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return df.join(rows.select(*key).distinct(), key, "left_anti")
