"""Confusion counts over a grid of thresholds, and the curves and areas made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackengine.functions.arrays import ratio


def threshold_grid(low: float, high: float, n: int) -> list[float]:
    """From low by steps of (high - low) / n, added up, while below high; rounding may make it n + 1 values."""
    step, t, out = (high - low) / n, low, []
    while t < high:
        out.append(t)
        t += step
    return out


def performance(df: DataFrame, n: int, truth: str = "gt", test: str = "test") -> DataFrame:
    """(thr, tp, fp, tn, fn): a row is positive if its test is at least the threshold.

    Labels other than 0 and 1, and tests that are NaN or null, count nowhere. Each row is counted once, in the interval
    of its score; the n intervals are then added up from above. Equal scores everywhere give no rows.
    """
    rows = df.select(F.col(truth).cast("int").alias("gt"), F.col(test).cast("double").alias("test"))
    rows = rows.filter("test IS NOT NULL AND NOT isnan(test)")
    low, high = rows.agg(F.min("test"), F.max("test")).first()
    if low is None:
        raise ValueError("no scores")
    grid = threshold_grid(low, high, n)
    spark = df.sparkSession
    if not grid:
        return spark.createDataFrame([], "thr double, tp long, fp long, tn long, fn long")
    step = (high - low) / n

    guess = F.greatest(F.least(F.floor((F.col("test") - low) / step).cast("int"), F.lit(len(grid) - 1)), F.lit(0))
    marks = F.array(*(F.lit(t) for t in grid))
    at = lambda i: F.get(marks, i)
    # the accumulated grid may be a rounding away from the guess
    place = F.when(F.col("test") < at(F.col("guess")), F.col("guess") - 1).when(F.col("test") >= F.coalesce(at(F.col("guess") + 1), F.lit(float("inf"))), F.col("guess") + 1).otherwise(F.col("guess"))
    counts = rows.withColumn("guess", guess).withColumn("i", place).groupBy("i").agg(*(F.count(F.when(F.col("gt") == g, 1)).alias(c) for g, c in ((1, "p"), (0, "q"))))
    every = spark.createDataFrame(list(enumerate(grid)), "i int, thr double")
    up = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    both = every.join(counts, "i", "left")
    both = both.withColumns({"tp": F.sum(F.coalesce("p", F.lit(0))).over(up), "fp": F.sum(F.coalesce("q", F.lit(0))).over(up), "ps": F.sum(F.coalesce("p", F.lit(0))).over(whole), "qs": F.sum(F.coalesce("q", F.lit(0))).over(whole)})
    return both.select("thr", "tp", "fp", (F.col("qs") - F.col("fp")).alias("tn"), (F.col("ps") - F.col("tp")).alias("fn"))


def roc(df: DataFrame, n: int, **columns) -> DataFrame:
    """(thr, fpr, tpr); NaN where there is no negative or no positive."""
    return performance(df, n, **columns).select("thr", ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"))


def precision_recall(df: DataFrame, n: int, **columns) -> DataFrame:
    """(thr, tpr, ppv)."""
    return performance(df, n, **columns).select("thr", ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"))


def auc(curve: DataFrame, x: str, y: str, order: str = "thr") -> DataFrame:
    """(auc): trapezoids under the points in their order, each of positive width."""
    by = Window.orderBy(order)
    area: Column = F.abs(F.col(x) - F.lag(x).over(by)) * (F.col(y) + F.lag(y).over(by)) / 2
    return curve.select(area.alias("area")).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("auc"))

