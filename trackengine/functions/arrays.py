"""Column functions on numbers and arrays of doubles, with IEEE rules for NaN and infinities where Spark's differ."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def trunc_div(a: int, b: int) -> int:
    """Whole-number division towards zero."""
    return math.trunc(a / b) if abs(a) < 2**52 else (abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)


def div_int_down(a: int, b: int) -> int:
    return trunc_div(a, b)


def div_int_up(a: int, b: int) -> int:
    """Rounded up for a >= 0; for other a as the truncation gives it."""
    return trunc_div(a + b - 1, b)


def div_int_down_column(a: Column, b: int) -> Column:
    """trunc_div of a whole-number column by a positive number, exactly: the remainder has the sign of the column."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def div_int_up_column(a: Column, b: int) -> Column:
    """div_int_up of a whole-number column."""
    return div_int_down_column(a + (b - 1), b)


def offsets(n: int) -> tuple[int, int]:
    """Bins (or positions) to the left and right of the centre of a window of n."""
    return div_int_up(n - 1, 2), div_int_down(n - 1, 2)


def above(value: Column, threshold: float) -> Column:
    """value > threshold, false for NaN."""
    return ~F.isnan(value) & (value > F.lit(float(threshold)))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NaN for a zero denominator."""
    return F.when(den != 0, num.cast("double") / den).otherwise(NAN)


def safe_ln(x: Column) -> Column:
    """Natural logarithm: -inf at zero, NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).otherwise(NAN)


def rounded(x: Column, digits: int = 6) -> Column:
    """x to so many digits; what rounds to zero keeps its sign, as SQL's round() has it and Spark's, by way of decimals, has not."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)), safe where one or both are -inf."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(lo == -INF, hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def log_sub(a: Column, b: Column) -> Column:
    """log(exp(a) - exp(b)): -inf for equal arguments, NaN if b is larger."""
    return F.when(b == -INF, a).when(a == b, F.lit(-INF)).when(a > b, a + F.log1p(-F.exp(b - a))).otherwise(NAN)


def transpose(rows: Column) -> Column:
    """Rows and columns of an array of arrays of equal sizes exchanged."""
    return F.transform(F.sequence(F.lit(0), F.size(F.element_at(rows, 1)) - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def flatten(rows: Column) -> Column:
    return F.flatten(rows)


def shift_ring(a: Column, i: int) -> Column:
    """Rotate right by i, left by -i; longer shifts than the array are an error of the caller's."""
    if i == 0:
        return a
    n = F.size(a)
    if i > 0:
        return F.concat(F.slice(a, n - i + 1, F.lit(i)), F.slice(a, F.lit(1), n - i))
    return F.concat(F.slice(a, F.lit(1 - i), n + i), F.slice(a, F.lit(1), F.lit(-i)))


def _fold(a: Column, better) -> Column:
    """Fold from the first element; comparisons with NaN are false, so NaN stays if first and is passed over elsewhere."""
    return F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), lambda acc, x: F.when(~F.isnan(acc) & ~F.isnan(x) & better(x, acc), x).otherwise(acc))


def slice_max(a: Column) -> Column:
    """Largest element; null for an empty array."""
    return _fold(a, lambda x, acc: x > acc)


def slice_min(a: Column) -> Column:
    return _fold(a, lambda x, acc: x < acc)


def slice_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def slice_mean(a: Column) -> Column:
    """Mean from left to right; NaN for an empty array."""
    return ratio(slice_sum(a), F.size(a))


def argmax(a: Column) -> Column:
    """Index from 0 of the first largest element; 0 for an empty array."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    best = F.aggregate(F.slice(pairs, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.get(pairs, F.lit(0)), lambda acc, p: F.when(~F.isnan(acc["v"]) & ~F.isnan(p["v"]) & (p["v"] > acc["v"]), p).otherwise(acc))
    return F.coalesce(best["i"], F.lit(0))


def colours(n: int) -> list[str]:
    """n colours "r,g,b" on a cubic grid."""
    k = int(round(n ** (1 / 3), 9)) + 1
    d = 255 // k
    return [f"{i // k // k % k * d},{i // k % k * d},{i % k * d}" for i in range(n)]


def min_max_scaled(value: Column, over) -> Column:
    """(value - min) / (max - min) over a window."""
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    return ratio(value - lo, hi - lo)
