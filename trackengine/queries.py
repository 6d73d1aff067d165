"""Queries over the driver's tables for each operator, and SQL with the same results."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackengine.functions import arrays as A
from trackengine.functions.distributions import Distribution, delta, exponential, gamma, geometric, mixture, normal, poisson, product
from trackengine.functions.distributions import rows as matrix_rows
from trackengine.operators import estimate as E
from trackengine.operators import hmm as H
from trackengine.operators import intervals as I
from trackengine.operators import metrics as M
from trackengine.operators import peaks as P
from trackengine.operators import scans as S
from trackengine.operators import segmentation as Z
from trackengine.operators import track as T
from trackengine.operators import windows as W
from trackengine.plans import peakcaller as jobs
from trackengine.sources import fixtures as X
from trackengine.sources import stored
from trackengine.sources.work import shared_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The parameters of the example models, as published with them.
EXAMPLE = mixture([0.07776834636409959, 0.5628584759570356, 0.3404924292864112, 0.01888074839245464], [delta(0.0), poisson(3.6116836152091176), geometric(0.2203064154109904), geometric(0.026327349474668783)])


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Parts of the SQL -------------------------------------------------------------


def _ev(summary: str = "avg(value)", init: str = "0.0", extra: str = "") -> str:
    return f"""WITH obs AS (
  SELECT event_type AS seqname, CAST(floor((epoch(ts) - 1704067200) / 3600) AS INTEGER) AS bin, value FROM events),
seqs AS (SELECT DISTINCT seqname FROM obs),
sums AS (SELECT seqname, bin, {summary} AS value FROM obs GROUP BY seqname, bin),
ev AS (
  SELECT s.seqname, CAST(b.bin AS INTEGER) AS bin, coalesce(round(a.value, 6), {init}) AS value
  FROM seqs s CROSS JOIN (SELECT unnest(range((SELECT greatest(720, max(bin) + 1) FROM obs))) AS bin) b LEFT JOIN sums a ON a.seqname = s.seqname AND a.bin = b.bin){extra} """


_LI = """WITH c AS (
  SELECT l_linestatus AS seqname, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS bin, l_returnflag AS f, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3),
seqs AS (SELECT DISTINCT l_linestatus AS seqname FROM lineitem),
li AS (
  SELECT s.seqname, CAST(b.bin AS INTEGER) AS bin, CAST(coalesce(max(CASE WHEN f = 'A' THEN n END), 0) AS DOUBLE) AS a,
    CAST(coalesce(max(CASE WHEN f = 'N' THEN n END), 0) AS DOUBLE) AS n, CAST(coalesce(max(CASE WHEN f = 'R' THEN n END), 0) AS DOUBLE) AS r
  FROM seqs s CROSS JOIN (SELECT unnest(range((SELECT greatest(2500, max(bin) + 1) FROM c))) AS bin) b LEFT JOIN c ON c.seqname = s.seqname AND c.bin = b.bin GROUP BY 1, 2) """

_IV = """WITH iv AS (
  SELECT o_orderkey AS id, o_orderstatus AS seqname, o_totalprice AS test,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1000 + o_orderkey % 1000 AS INTEGER) AS "from",
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1000 + o_orderkey % 1000 + 1 + o_orderkey % 90 AS INTEGER) AS "to"
  FROM orders) """

_NAN = ", nn AS (SELECT seqname, bin, CASE WHEN bin % 17 = 3 THEN CAST('nan' AS DOUBLE) ELSE value END AS value FROM ev)"


def _whole(name: str, v: Column) -> Column:
    """An array of whole numbers as text, to compare."""
    return F.array_join(F.transform(v, lambda x: x.cast("long").cast("string")), ",").alias(name)


def _rounded(t: T.Track, digits: int = 6) -> DataFrame:
    return t.df.select("seqname", "bin", F.round("value", digits).alias("value"))


# Tracks -----------------------------------------------------------------------


@query(_ev() + "SELECT * FROM ev")
def track_import_mean(spark, d):
    return X.event_track(spark, d).df


@query(_ev("max(value)") + "SELECT * FROM ev")
def bin_max(spark, d):
    return X.event_track(spark, d, "max").df


@query(_ev("min(value)") + "SELECT * FROM ev")
def bin_min(spark, d):
    return X.event_track(spark, d, "min").df


@query(_ev("floor(avg(value) + 0.5)") + "SELECT * FROM ev")
def bin_discrete_mean(spark, d):
    return X.event_track(spark, d, "discrete mean").df


@query(
    _ev(extra=""", w AS (SELECT seqname, bin + k AS bin, value FROM obs CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) o),
m AS (SELECT seqname, bin, avg(value) AS value FROM w GROUP BY 1, 2)""")
    + "SELECT ev.seqname, ev.bin, coalesce(round(m.value, 6), 0.0) AS value FROM ev LEFT JOIN m ON m.seqname = ev.seqname AND m.bin = ev.bin"
)
def bin_overlap(spark, d):
    return X.event_track(spark, d, overlap=1).df


@query(_ev(init="-1.0") + "SELECT * FROM ev")
def track_init_fill(spark, d):
    return X.event_track(spark, d, init=-1.0).df


@query(_ev("max(value)") + "SELECT seqname, CAST(bin // 24 AS INTEGER) AS bin, max(value) AS value FROM ev GROUP BY 1, 2")
def zoom_level(spark, d):
    return T.rebin(X.event_track(spark, d, "max"), 24, "max").df


@query(_ev("max(value)") + "SELECT seqname, CAST(bin // 48 AS INTEGER) AS bin, max(value) AS value FROM ev GROUP BY 1, 2")
def zoom_pyramid(spark, d):
    """Bins of 48 read from a stored track's levels of 6, 24 and 120, of which that of 24 is the coarsest that divides them."""
    track, path = X.event_track(spark, d, "max"), shared_folder(spark, "zoom")
    stored.write_track(track.df, path, track.genome, zoom_levels=(6, 24, 120))
    return stored.read_zoomed(spark, path, 48, "max").df


@query(_ev() + "SELECT seqname, CAST(bin // 120 AS INTEGER) AS bin, round(avg(value), 9) AS value FROM ev GROUP BY 1, 2")
def zoom_pyramid_mean(spark, d):
    """The level of 120 itself, made of that of 24, which was made of that of 6."""
    track, path = X.event_track(spark, d), shared_folder(spark, "zoom")
    stored.write_track(track.df, path, track.genome, zoom_levels=(6, 24, 120))
    return _rounded(stored.read_zoomed(spark, path, 120), 9)


@query(_ev() + "SELECT seqname, bin, round(exp(value / 100), 6) AS value FROM ev")
def map_exp(spark, d):
    return _rounded(X.event_track(spark, d).map(lambda v: F.exp(v / 100)))


@query(_LI + "SELECT seqname, bin, a + n AS value FROM li")
def maplist_sum(spark, d):
    a, n, _ = X.ship_tracks(spark, d)
    return T.combine([a, n], lambda x, y: x + y).df


@query(_LI + "SELECT seqname, bin, round(exp(-a / 10) * (1 - exp(-n / 10)), 6) AS value FROM li")
def maplist_treat_control(spark, d):
    a, n, _ = X.ship_tracks(spark, d)
    return _rounded(T.combine([a.map(lambda v: -v / 10), n.map(lambda v: -v / 10)], lambda x, y: F.exp(x) * (1 - F.exp(y))))


@query(_ev() + "SELECT * FROM ev WHERE seqname IN ('click', 'view', 'purchase')")
def filter_genome(spark, d):
    return X.event_track(spark, d).filter_genome(["click", "view", "purchase"]).df


def _regions(spark, d) -> DataFrame:
    """Regions of the F and O sequences from orders of the first days, in days."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    rows = X.table(spark, d, "orders").filter("o_orderstatus IN ('F', 'O')")
    return rows.select(F.col("o_orderkey").alias("region_id"), F.col("o_orderstatus").alias("seqname"), day.alias("from"), (day + 1 + F.col("o_orderkey") % 9).cast("int").alias("to"))


_REGIONS = """, rg AS (
  SELECT o_orderkey AS region_id, o_orderstatus AS seqname, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS "from",
    date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 9 AS "to" FROM orders WHERE o_orderstatus IN ('F', 'O')),
rb AS (SELECT region_id, li.* FROM rg JOIN li ON li.seqname = rg.seqname AND li.bin >= rg."from" AND li.bin < rg."to") """


@query(_LI + _REGIONS + ", hit AS (SELECT DISTINCT seqname, bin FROM rb) SELECT li.seqname, li.bin, CASE WHEN hit.bin IS NULL THEN a ELSE CAST('nan' AS DOUBLE) END AS value FROM li LEFT JOIN hit ON hit.seqname = li.seqname AND hit.bin = li.bin")
def mask_regions(spark, d):
    return T.mask(X.ship_tracks(spark, d)[0], _regions(spark, d)).df


@query(_LI + _REGIONS + "SELECT region_id, string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR), ',' ORDER BY bin) AS v FROM rb GROUP BY 1")
def region_vectors(spark, d):
    return T.region_vectors(X.ship_tracks(spark, d)[0], _regions(spark, d)).select("region_id", _whole("v", F.col("v")))


@query(_LI + _REGIONS + "SELECT region_id, CAST(sum(a) AS BIGINT) AS total, CAST(max(a) AS BIGINT) AS high, count(*) AS bins FROM rb GROUP BY 1")
def region_counts(spark, d):
    rows = T.region_vectors(X.ship_tracks(spark, d)[0], _regions(spark, d))
    return rows.select("region_id", A.slice_sum(F.col("v")).cast("long").alias("total"), A.slice_max(F.col("v")).cast("long").alias("high"), F.size("v").cast("long").alias("bins"))


@query(_LI + _REGIONS + "SELECT region_id, CAST(sum(a) AS BIGINT) AS total, CAST(max(a) AS BIGINT) AS high, count(*) AS bins FROM rb GROUP BY 1")
def stored_regions(spark, d):
    """region_counts, from a stored track of which only the folders that regions touch are read."""
    track, path = X.ship_tracks(spark, d)[0], shared_folder(spark, "regions")
    stored.write_track(track.df, path, track.genome)
    rows = T.region_vectors(stored.read_regions(spark, path, _regions(spark, d)), _regions(spark, d))
    return rows.select("region_id", A.slice_sum(F.col("v")).cast("long").alias("total"), A.slice_max(F.col("v")).cast("long").alias("high"), F.size("v").cast("long").alias("bins"))


@query(_LI + _REGIONS + """SELECT region_id, string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR), ',' ORDER BY bin) || ';' || string_agg(CAST(CAST(n AS BIGINT) AS VARCHAR), ',' ORDER BY bin)
  || ';' || string_agg(CAST(CAST(r AS BIGINT) AS VARCHAR), ',' ORDER BY bin) AS m FROM rb GROUP BY 1""")
def region_matrices(spark, d):
    rows = T.region_matrices(X.ship_tracks(spark, d), _regions(spark, d))
    return rows.select("region_id", F.array_join(F.transform("m", lambda r: F.array_join(F.transform(r, lambda x: x.cast("long").cast("string")), ",")), ";").alias("m"))


# Windows, classification, estimation frames --------------------------------------


def _classify_sql(left: int, right: int) -> str:
    n = left + right + 1
    return _ev(extra=_NAN) + f"""SELECT seqname, bin, CASE WHEN count(*) OVER w < {n} THEN CAST('nan' AS DOUBLE)
  WHEN bool_or(isnan(value)) OVER w THEN CAST('nan' AS DOUBLE) ELSE round(avg(value) OVER w, 8) END AS value
FROM nn WINDOW w AS (PARTITION BY seqname ORDER BY bin ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)"""


def _mean_track(spark, d, n: int, block: int = W.BLOCK) -> DataFrame:
    return _rounded(W.classify(X.event_masked(spark, d), n, A.slice_mean, block=block), 8)


@query(_classify_sql(0, 0))
def classify_window_n1(spark, d):
    return _mean_track(spark, d, 1)


@query(_classify_sql(2, 1))
def classify_window_n4(spark, d):
    return _mean_track(spark, d, 4)


@query(_classify_sql(2, 2))
def classify_window_n5(spark, d):
    return _mean_track(spark, d, 5, block=100)


def _wide_sql(what: str, n: int) -> str:
    left, right = (n) // 2, (n - 1) // 2
    return _ev(extra=_NAN) + f"""SELECT seqname, bin, CASE WHEN count(*) OVER w < {n} OR bool_or(isnan(value)) OVER w THEN CAST('nan' AS DOUBLE) ELSE round({what}(value) OVER w, 8) END AS value
FROM (SELECT seqname, bin, CASE WHEN bin % 170 = 3 THEN value ELSE CASE WHEN isnan(value) THEN 0 ELSE value END END AS value FROM nn) WINDOW w AS (PARTITION BY seqname ORDER BY bin ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)"""


def _sparsely_masked(spark, d) -> T.Track:
    return X.event_masked(spark, d).map_positions(lambda s, p, v: F.when(F.isnan(v) & (p % 170 != 3), 0.0).otherwise(v))


@query(_wide_sql("avg", 60))
def classify_wide_mean(spark, d):
    return _rounded(W.classify_wide(_sparsely_masked(spark, d), 60, "mean", block=150), 8)


@query(_wide_sql("max", 61))
def classify_wide_max(spark, d):
    return _rounded(W.classify_wide(_sparsely_masked(spark, d), 61, "max", block=150), 8)


@query(_LI + """SELECT seqname, bin, CASE WHEN bin BETWEEN 50 AND 2449 THEN sum(4 * a + 2 * n + r) OVER (PARTITION BY seqname ORDER BY bin ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) ELSE CAST('nan' AS DOUBLE) END AS value FROM li""")
def classify_wide_multi(spark, d):
    weighted = lambda v: F.get(v, F.lit(0)) * 4 + F.get(v, F.lit(1)) * 2 + F.get(v, F.lit(2))
    return W.classify_wide_multi(X.ship_tracks(spark, d), 101, "sum", weighted, block=700).df


_WIN3 = "OVER (PARTITION BY seqname ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


@query(_LI + f"SELECT seqname, bin, CASE WHEN bin BETWEEN 1 AND 2498 THEN sum(a) {_WIN3} + max(n) {_WIN3} ELSE CAST('nan' AS DOUBLE) END AS value FROM li")
def classify_sum_tracks(spark, d):
    a, n, _ = X.ship_tracks(spark, d)
    return W.classify_many([a, n], 3, [A.slice_sum, A.slice_max]).df


@query(_LI + f"SELECT seqname, bin, CASE WHEN bin BETWEEN 1 AND 2498 THEN (sum(a) {_WIN3}) * 4 + (sum(n) {_WIN3}) * 2 + sum(r) {_WIN3} ELSE CAST('nan' AS DOUBLE) END AS value FROM li")
def classify_multi_window(spark, d):
    row = lambda m, i: A.slice_sum(F.get(m, F.lit(i)))
    return W.classify_multi(X.ship_tracks(spark, d), 3, lambda m: row(m, 0) * 4 + row(m, 1) * 2 + row(m, 2)).df


@query(_LI + f"SELECT seqname, bin, CASE WHEN bin BETWEEN 1 AND 2498 THEN greatest(max(a) {_WIN3}, max(n) {_WIN3}, max(r) {_WIN3}) ELSE CAST('nan' AS DOUBLE) END AS value FROM li")
def classify_multi_transposed(spark, d):
    return W.classify_multi(X.ship_tracks(spark, d), 3, lambda m: A.slice_max(A.flatten(m)), transposed=True).df


@query("""SELECT vec_id AS id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM embeddings""")
def classify_vector_data(spark, d):
    return X.vectors(spark, d).select("id", F.round(A.slice_mean(F.col("v")), 6).alias("score"))


@query(_LI + f"SELECT seqname, bin, CASE WHEN bin BETWEEN 1 AND 2498 THEN sum(a) {_WIN3} * 2 + 3 ELSE CAST('nan' AS DOUBLE) END AS value FROM li")
def transform_window(spark, d):
    return W.classify(X.ship_tracks(spark, d)[0], 3, A.slice_sum, transform=lambda w: F.transform(w, lambda x: x * 2 + 1)).df


def _hop_sql(n: int, step: int) -> str:
    return _ev(extra=_NAN) + f""", f AS (SELECT seqname, bin, bool_or(isnan(value)) OVER w AS bad, round(sum(value) OVER w, 8) AS total FROM nn
  WINDOW w AS (PARTITION BY seqname ORDER BY bin ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING))
SELECT seqname, bin, total FROM f WHERE NOT bad AND bin % {step} = 0 AND bin < 720 - {n}"""


def _hops(spark, d, n: int, step: int) -> DataFrame:
    return W.hopping(X.event_masked(spark, d), n, step).select("seqname", "bin", F.round(A.slice_sum(F.col("win")), 8).alias("total"))


@query(_hop_sql(3, 3))
def est_windows_tumbling(spark, d):
    return _hops(spark, d, 3, 0)


@query(_hop_sql(3, 2))
def est_windows_sliding(spark, d):
    return _hops(spark, d, 3, 2)


@query(_hop_sql(2, 5))
def est_windows_hopping(spark, d):
    return _hops(spark, d, 2, 5)


@query(_hop_sql(1, 1))
def est_windows_single(spark, d):
    return _hops(spark, d, 1, 1)


_WIN5 = "OVER (PARTITION BY seqname ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(_LI + f", f AS (SELECT seqname, bin, sum(a) {_WIN5} AS a, sum(n) {_WIN5} AS n, sum(r) {_WIN5} AS r FROM li) SELECT * FROM f WHERE bin >= 2 AND bin < 2498 AND (bin - 2) % 2 = 0")
def est_multi_windows(spark, d):
    rows = W.hopping_multi(X.ship_tracks(spark, d), 5, 2)
    col = lambda i: A.slice_sum(F.transform("win", lambda v: F.get(v, F.lit(i))))
    return rows.select("seqname", "bin", col(0).alias("a"), col(1).alias("n"), col(2).alias("r"))


# Histograms and densities ---------------------------------------------------------


@query(_LI + "SELECT a AS x, count(*) AS n FROM li GROUP BY 1")
def value_hist(spark, d):
    return E.value_histogram(X.ship_tracks(spark, d)[0].df)


@query(_LI + "SELECT a AS x, round(ln(sum(exp(-n / 50))), 6) AS log_n FROM li GROUP BY 1")
def weighted_hist(spark, d):
    a, n, _ = X.ship_tracks(spark, d)
    rows = T.wide([a, n]).select(F.get("v", F.lit(0)).alias("value"), (-F.get("v", F.lit(1)) / 50).alias("w"))
    return E.weighted_histogram(rows, "value", "w").select("x", A.rounded(F.col("log_n")).alias("log_n"))


_DENS = """, h AS (SELECT a AS x, count(*) AS n FROM li GROUP BY 1),
s AS (SELECT x, n, lead(x) OVER (ORDER BY x) - x AS step, sum(n) OVER () AS total FROM h),
dn AS (SELECT x, coalesce(step, lag(step) OVER (ORDER BY x), 1.0) AS delta, n, total FROM s),
de AS (SELECT x, delta, ln(n) - ln(total + 1) - ln(delta) AS log_density FROM dn) """


@query(_LI + _DENS + "SELECT x, delta, round(log_density, 6) AS log_density FROM de")
def nonparam_density(spark, d):
    return E.density(E.value_histogram(X.ship_tracks(spark, d)[0].df)).withColumn("log_density", A.rounded(F.col("log_density")))


@query(_LI + _DENS + """, q AS (SELECT seqname, bin, n + 0.5 AS y FROM li), top AS (SELECT max(x + delta) AS hi, min(x) AS lo FROM de)
SELECT seqname, bin, y, CASE WHEN y < lo OR y >= hi THEN CAST('-inf' AS DOUBLE) ELSE round((SELECT arg_max(log_density, x) FROM de WHERE x <= y), 6) END AS log_pdf FROM q, top""")
def nonparam_logpdf(spark, d):
    a, n, _ = X.ship_tracks(spark, d)
    rows = n.df.select("seqname", "bin", (F.col("value") + 0.5).alias("y"))
    out = E.step_log_pdf(rows, E.density(E.value_histogram(a.df)), "y")
    return out.select("seqname", "bin", "y", F.when(F.col("log_pdf") == -A.INF, F.col("log_pdf")).otherwise(A.rounded(F.col("log_pdf"))).alias("log_pdf"))


@query(_LI + _DENS + "SELECT round(ln(-sum(exp(log_density + ln(delta)) * (log_density + ln(delta)))), 6) AS log_entropy FROM de")
def nonparam_entropy(spark, d):
    return E.log_entropy(E.density(E.value_histogram(X.ship_tracks(spark, d)[0].df))).select(F.round("log_entropy", 6).alias("log_entropy"))


def _adaptive_sql(nbins: int, size: str, x: str) -> str:
    """Bins as a list of (from, to, count) in one row; each step merges the smallest with its smaller neighbour."""
    return f""", h AS (SELECT {x} AS x, count(*) AS n FROM ev GROUP BY 1),
e AS (SELECT x, n, coalesce(lead(x) OVER (ORDER BY x), x + coalesce((x - lag(x) OVER (ORDER BY x)) / 2, 1.0)) AS hi FROM h),
m(b) AS (
  SELECT list({{'lo': x, 'hi': hi, 'n': CAST(n AS DOUBLE)}} ORDER BY x) FROM e
  UNION ALL
  SELECT list_concat(b[:k - 1], [{{'lo': b[k].lo, 'hi': b[k + 1].hi, 'n': b[k].n + b[k + 1].n}}], b[k + 2:])
  FROM (SELECT b, CASE WHEN i = 1 THEN 1 WHEN i = len(b) THEN i - 1 WHEN s[i - 1] <= s[i + 1] THEN i - 1 ELSE i END AS k
    FROM (SELECT b, s, list_position(s, list_min(s)) AS i FROM (SELECT b, list_transform(b, lambda z: {size}) AS s FROM m WHERE len(b) > {nbins}) q) r) t),
f AS (SELECT unnest(b) AS z FROM m WHERE len(b) = (SELECT min(len(b)) FROM m)),
g AS (SELECT z.lo AS x, z.n AS n, lead(z.lo) OVER (ORDER BY z.lo) - z.lo AS step, sum(z.n) OVER () AS total FROM f)
SELECT x, coalesce(step, lag(step) OVER (ORDER BY x), 1.0) AS delta, round(ln(n) - ln(total + 1) - ln(coalesce(step, lag(step) OVER (ORDER BY x), 1.0)), 6) AS log_density FROM g"""


def _adaptive(track: T.Track, by_size: bool) -> DataFrame:
    spark = track.df.sparkSession
    hist = E.gridded(E.value_histogram(track.df)).toArrow().to_pandas()
    x, n = E.adaptive_bins(hist["x"].tolist(), hist["n"].tolist(), 50, by_size)
    return _digits(E.density(spark.createDataFrame(list(zip(x, map(float, n))), "x double, n double")), "log_density")


@query("WITH RECURSIVE " + _ev()[5:] + _adaptive_sql(50, "z.hi - z.lo", "value"))
def nonparam_adaptive(spark, d):
    """The event track's values in 50 bins, narrowest merged first."""
    return _adaptive(X.event_track(spark, d), True)


@query("WITH RECURSIVE " + _ev()[5:] + _adaptive_sql(50, "z.n", "round(value, 0)"))
def nonparam_adaptive_counts(spark, d):
    """The event track's values, rounded, in 50 bins, those of the smallest count merged first."""
    return _adaptive(X.event_track(spark, d).map(lambda v: F.round(v, 0)), False)


# Peaks and intervals ---------------------------------------------------------------


def _peaks_sql(lo: str, hi: str) -> str:
    return _ev(extra=_NAN) + f""", g AS (SELECT *, bin - row_number() OVER (PARTITION BY seqname ORDER BY bin) AS g FROM nn WHERE NOT isnan(value) AND value > 60),
p AS (SELECT seqname, min(bin) AS f, max(bin) AS l, max(value) AS test, -max({{'v': value, 'b': -bin}}).b AS b FROM g GROUP BY seqname, g)
SELECT seqname, CAST({lo} AS INTEGER) AS "from", CAST({hi} AS INTEGER) AS "to", '*' AS strand, test FROM p"""


@query(_peaks_sql("f", "l + 2"))
def peaks_full(spark, d):
    return P.peaks(X.event_masked(spark, d), 60, 0)


@query(_peaks_sql("f", "l + 1"))
def peaks_exact(spark, d):
    return P.peaks(X.event_masked(spark, d), 60, -1, block=64)


@query(_peaks_sql("greatest(b - 4, 0)", "least(b + 4, 720)"))
def peaks_window(spark, d):
    return P.peaks(X.event_masked(spark, d), 60, 8)


_JOINT = """, g AS (SELECT *, bin - row_number() OVER (PARTITION BY seqname ORDER BY bin) AS g FROM li WHERE a > 1 AND n > 0),
p AS (SELECT seqname, min(bin) AS f, max(bin) AS l, max({'s': a + n, 'b': -bin, 'a': a, 'n': n}) AS m FROM g GROUP BY seqname, g)
SELECT seqname, CAST(f AS INTEGER) AS "from", CAST(l + 2 AS INTEGER) AS "to", '*' AS strand,
  CAST(CAST(m.a AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(m.n AS BIGINT) AS VARCHAR) AS test FROM p"""


@query(_LI + _JOINT)
def joint_peaks(spark, d):
    a, n, _ = X.ship_tracks(spark, d)
    return P.joint_peaks([a, n], [1.0, 0.0]).withColumn("test", _whole("test", F.col("test")))


def _single(track: str, threshold: int) -> str:
    return f"""SELECT seqname, min(bin) AS f, max(bin) + 2 AS t, max({track}) AS test FROM
  (SELECT *, bin - row_number() OVER (PARTITION BY seqname ORDER BY bin) AS g FROM li WHERE {track} > {threshold}) GROUP BY seqname, g"""


@query(_LI + f""", pa AS ({_single('a', 2)}), pr AS ({_single('r', 2)}),
i AS (SELECT pa.seqname, greatest(pa.f, pr.f) AS f, least(pa.t, pr.t) AS t, pa.test AS a, pr.test AS r FROM pa JOIN pr ON pa.seqname = pr.seqname AND pa.f < pr.t AND pr.f < pa.t),
ctr AS (SELECT *, (f + t - 1) // 2 AS m FROM i)
SELECT seqname, CAST(m - 2 AS INTEGER) AS "from", CAST(m + 3 AS INTEGER) AS "to", '*' AS strand, CAST(CAST(a AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(r AS BIGINT) AS VARCHAR) AS test FROM ctr""")
def intersect_peaks(spark, d):
    a, _, r = X.ship_tracks(spark, d)
    return P.intersecting_peaks([a, r], [2.0, 2.0], 5).withColumn("test", _whole("test", F.col("test")))


@query(_LI + """, w AS (SELECT seqname, bin, greatest(bin - 1, 0) AS f, least(bin + 2, 2500) AS t, a, n, a + n AS s FROM li WHERE a > 2 AND n > 0)
SELECT seqname, CAST(f AS INTEGER) AS "from", CAST(t AS INTEGER) AS "to", '*' AS strand, CAST(CAST(a AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(n AS BIGINT) AS VARCHAR) AS test
FROM w WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.seqname = w.seqname AND o.bin <> w.bin AND o.f < w.t AND w.f < o.t AND o.s >= w.s)""")
def predictions_nms(spark, d):
    a, n, _ = X.ship_tracks(spark, d)
    return P.predictions([a, n], [2.0, 0.0], 3).withColumn("test", _whole("test", F.col("test")))


@query(_IV + """SELECT a.id AS a_id, b.id AS b_id, a.seqname, greatest(a."from", b."from") AS "from", least(a."to", b."to") AS "to" FROM iv a JOIN iv b
  ON a.seqname = b.seqname AND a."from" < b."to" AND b."from" < a."to" WHERE a.id < b.id""")
def overlap_pairs(spark, d):
    pairs = I.overlapping_pairs(X.order_intervals(spark, d).drop("test"), "id", piece=256)
    return pairs.select("a_id", "b_id", F.col("a_seqname").alias("seqname"), F.greatest("a_from", "b_from").alias("from"), F.least("a_to", "b_to").alias("to"))


@query(_IV + """SELECT * FROM iv a WHERE NOT EXISTS (SELECT 1 FROM iv b WHERE a.seqname = b.seqname AND a.id <> b.id AND a."from" < b."to" AND b."from" < a."to" AND b.test >= a.test)""")
def filter_overlaps(spark, d):
    return I.without_overlapped(X.order_intervals(spark, d), F.col("test"), ["id"], piece=256).select("id", "seqname", "from", "to", "test")


_LONG = """, lg AS (
  SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS seqname, CAST(c_custkey * 997 % 2400000 AS INTEGER) AS "from",
    CAST(c_custkey * 997 % 2400000 + 1 + (c_custkey % 41) * (c_custkey % 41) * (c_custkey % 41) AS INTEGER) AS "to" FROM customer) """


@query(_IV + _LONG + """SELECT lg.id, count(*) AS n, CAST(sum(least(iv."to", lg."to") - greatest(iv."from", lg."from")) AS BIGINT) AS shared
FROM lg JOIN iv ON iv.seqname = lg.seqname AND iv."from" < lg."to" AND lg."from" < iv."to" GROUP BY 1""")
def overlap_mixed(spark, d):
    """How many short intervals each of some of very different lengths meets, and over how many positions."""
    k, part = F.col("c_custkey"), F.col("c_custkey") % 41
    start = k * 997 % 2400000
    names = F.when(k % 3 == 0, "F").when(k % 3 == 1, "O").otherwise("P")
    long = X.table(spark, d, "customer").select(k.alias("id"), names.alias("seqname"), start.cast("int").alias("from"), (start + 1 + part * part * part).cast("int").alias("to"))
    found = I.shared(long, X.order_intervals(spark, d)).filter("n > 0")
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared"))


_STATES = ", st AS (SELECT seqname, bin, CAST(least(a, 3) AS INTEGER) AS state FROM li) "
_RUNS = """, rn AS (SELECT seqname, CAST(min(bin) AS INTEGER) AS "from", CAST(max(bin) + 1 AS INTEGER) AS "to", state FROM
  (SELECT *, bin - row_number() OVER (PARTITION BY seqname, state ORDER BY bin) AS g FROM st) GROUP BY seqname, state, g) """


def _states(spark, d) -> T.Track:
    return X.ship_tracks(spark, d)[0].map(lambda v: F.least(v, F.lit(3.0)))


@query(_LI + _STATES + _RUNS + "SELECT * FROM rn")
def run_merge(spark, d):
    single = _states(spark, d).df.select("seqname", F.col("bin").alias("from"), (F.col("bin") + 1).alias("to"), F.col("value").cast("int").alias("state"))
    return I.merge_runs(single)


# Evaluation ------------------------------------------------------------------------

_PERF = """WITH RECURSIVE sc AS (SELECT quality AS gt, CAST(n_chars AS DOUBLE) AS test FROM labels JOIN documents USING (doc_id)),
lim AS (SELECT min(test) AS lo, max(test) AS hi, (max(test) - min(test)) / 50 AS step FROM sc),
grid(thr) AS (SELECT lo FROM lim UNION ALL SELECT thr + step FROM grid, lim WHERE thr + step < hi),
pf AS (SELECT thr, count(*) FILTER (gt = 1 AND test >= thr) AS tp, count(*) FILTER (gt = 0 AND test >= thr) AS fp,
  count(*) FILTER (gt = 0 AND test < thr) AS tn, count(*) FILTER (gt = 1 AND test < thr) AS fn FROM grid, sc GROUP BY thr),
rt AS (SELECT thr, tp / CAST(tp + fn AS DOUBLE) AS tpr, fp / CAST(fp + tn AS DOUBLE) AS fpr, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END AS ppv FROM pf) """


@query(_PERF + "SELECT round(thr, 6) AS thr, tp, fp, tn, fn FROM pf")
def performance(spark, d):
    return M.performance(X.scores(spark, d), 50).withColumn("thr", F.round("thr", 6))


def _digits(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_PERF + "SELECT round(thr, 6) AS thr, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM rt")
def roc(spark, d):
    return _digits(M.roc(X.scores(spark, d), 50), "thr", "fpr", "tpr")


@query(_PERF + "SELECT round(thr, 6) AS thr, round(tpr, 6) AS tpr, round(ppv, 6) AS ppv FROM rt")
def pr_curve(spark, d):
    return _digits(M.precision_recall(X.scores(spark, d), 50), "thr", "tpr", "ppv")


def _auc_sql(x: str, y: str) -> str:
    return _PERF + f""", ar AS (SELECT abs({x} - lag({x}) OVER (ORDER BY thr)) * ({y} + lag({y}) OVER (ORDER BY thr)) / 2 AS a FROM rt)
SELECT round(sum(a), 6) AS auc FROM ar"""


@query(_auc_sql("fpr", "tpr"))
def auc_roc(spark, d):
    return _digits(M.auc(M.roc(X.scores(spark, d), 50), "fpr", "tpr"), "auc")


@query(_auc_sql("tpr", "ppv"))
def auc_pr(spark, d):
    return _digits(M.auc(M.precision_recall(X.scores(spark, d), 50), "tpr", "ppv"), "auc")


# Mixtures --------------------------------------------------------------------------


def _density_sql(x: str) -> str:
    w, parts = EXAMPLE.parameters, EXAMPLE.parts
    return f"""CASE WHEN {x} = 0 THEN {w[0]!r} ELSE 0 END AS f0, {w[1]!r} * exp({x} * ln({parts[1].parameters[0]!r}) - {parts[1].parameters[0]!r} - lgamma({x} + 1)) AS f1,
  {w[2]!r} * {parts[2].parameters[0]!r} * pow(1 - {parts[2].parameters[0]!r}, {x}) AS f2, {w[3]!r} * {parts[3].parameters[0]!r} * pow(1 - {parts[3].parameters[0]!r}, {x}) AS f3"""


_POST = f", fa AS (SELECT seqname, bin, a, {_density_sql('a')} FROM li), pa AS (SELECT seqname, bin, a, f3 / (f0 + f1 + f2 + f3) AS p, ln(f3 / (f0 + f1 + f2 + f3)) AS lp FROM fa) "
_POST_N = f", fn AS (SELECT seqname, bin, {_density_sql('n')} FROM li), pn AS (SELECT seqname, bin, f3 / (f0 + f1 + f2 + f3) AS p FROM fn) "


@query(_LI + _POST + "SELECT seqname, bin, round(lp, 6) AS log_posterior FROM pa")
def mixture_posterior(spark, d):
    return E.posterior(X.ship_tracks(spark, d)[0].df, EXAMPLE, [3]).select("seqname", "bin", A.rounded(F.col("log_posterior")).alias("log_posterior"))


@query(_LI + _POST + _POST_N + "SELECT pa.seqname, pa.bin, round(pa.p * (1 - pn.p), 6) AS value FROM pa JOIN pn ON pa.seqname = pn.seqname AND pa.bin = pn.bin")
def treat_control_score(spark, d):
    a, n, _ = X.ship_tracks(spark, d)
    return _rounded(jobs.treatment_against_control(jobs.score(a, EXAMPLE, [3]), jobs.score(n, EXAMPLE, [3])))


@query(_LI + _POST + """, g AS (SELECT *, bin - row_number() OVER (PARTITION BY seqname ORDER BY bin) AS g FROM pa WHERE p > 0.051)
SELECT seqname, CAST(min(bin) AS INTEGER) AS "from", CAST(max(bin) + 1 AS INTEGER) AS "to", '*' AS strand, round(max(p), 6) AS test FROM g GROUP BY seqname, g""")
def peakcaller_e2e(spark, d):
    return _digits(jobs.call_peaks(X.ship_tracks(spark, d)[0], EXAMPLE, [3], threshold=0.051), "test")


#: Steps of expectation-maximisation: h has the values' shares; a step that gains less than 1e-8 gives no row.
_EM = """, h AS (SELECT r AS x, count(*) / (SELECT count(*) FROM li) AS share FROM li GROUP BY 1),
em(steps, before, w0, w1, w2, w3, rate, p, q) AS (
  SELECT 0, CAST('-inf' AS DOUBLE), 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE, 2.0::DOUBLE, 0.3::DOUBLE, 0.05::DOUBLE
  UNION ALL
  SELECT steps + 1, now, m0 / m, m1 / m, m2 / m, m3 / m, CASE WHEN m1 > 0 THEN s1 / m1 ELSE rate END, CASE WHEN m2 > 0 THEN m2 / (m2 + s2) ELSE p END, CASE WHEN m3 > 0 THEN m3 / (m3 + s3) ELSE q END
  FROM (SELECT steps, before, rate, p, q, sum(share * ln(t)) AS now, sum(share * d0 / t) AS m0, sum(share * d1 / t) AS m1, sum(share * d2 / t) AS m2, sum(share * d3 / t) AS m3,
      sum(share) AS m, sum(share * x * d1 / t) AS s1, sum(share * x * d2 / t) AS s2, sum(share * x * d3 / t) AS s3
    FROM (SELECT *, d0 + d1 + d2 + d3 AS t
      FROM (SELECT *, CASE WHEN x = 0 THEN w0 ELSE 0 END AS d0, w1 * CASE WHEN x = 0 THEN exp(-rate) WHEN rate > 0 THEN exp(x * ln(rate) - rate - lgamma(x + 1)) ELSE 0 END AS d1,
          w2 * p * pow(1 - p, x) AS d2, w3 * q * pow(1 - q, x) AS d3 FROM em, h) a) b
    GROUP BY ALL) c
  WHERE now - before >= 1e-8),
fit AS (SELECT * FROM em ORDER BY steps DESC LIMIT 1),
parts AS (
  SELECT 0 AS kind, 'scalar:delta distribution' AS name, w0 AS weight, 0.0 AS parameter FROM fit UNION ALL SELECT 1, 'scalar:poisson distribution', w1, rate FROM fit
  UNION ALL SELECT 2, 'scalar:geometric distribution', w2, p FROM fit UNION ALL SELECT 2, 'scalar:geometric distribution', w3, q FROM fit)
SELECT CAST(row_number() OVER (ORDER BY kind, CASE WHEN kind = 2 THEN -parameter END) - 1 AS INTEGER) AS component, name, round(weight, 5) AS weight, round(parameter, 5) AS parameter FROM parts"""


@query("WITH RECURSIVE " + _LI[5:] + _EM)
def em_fit(spark, d):
    """The four-component mixture fitted to a track, a row for each component in canonical order."""
    fit = jobs.learn(X.ship_tracks(spark, d)[2], jobs.treatment_start())
    rows = [(i, p.name, round(float(w), 5), round(float(p.parameters[0]), 5)) for i, (w, p) in enumerate(zip(fit.model.parameters, fit.model.parts))]
    return spark.createDataFrame(rows, "component int, name string, weight double, parameter double")


# Components of other kinds, several tracks together, products ---------------------------


def _components(spark, fit: E.Fit, names: list[str]) -> DataFrame:
    rows = [(i, p.name, *(round(float(x), 4) for x in (w, *p.parameters, *[float("nan")] * len(names))[: len(names)])) for i, (w, p) in enumerate(zip(fit.model.parameters, fit.model.parts))]
    return spark.createDataFrame(rows, f"component int, name string, {', '.join(f'{n} double' for n in names)}")


_EM_NORMAL = """, pos AS (SELECT value AS x FROM ev WHERE value > 0), h AS (SELECT x, count(*) / (SELECT count(*) FROM pos) AS share FROM pos GROUP BY 1),
em(steps, before, w0, w1, m0, s0, m1, s1) AS (
  SELECT 0, CAST('-inf' AS DOUBLE), 0.5::DOUBLE, 0.5::DOUBLE, 20.0::DOUBLE, 20.0::DOUBLE, 60.0::DOUBLE, 20.0::DOUBLE
  UNION ALL
  SELECT steps + 1, now, r0, r1, x0 / r0, sqrt(q0 / r0 - (x0 / r0) * (x0 / r0)), x1 / r1, sqrt(q1 / r1 - (x1 / r1) * (x1 / r1))
  FROM (SELECT steps, before, sum(share * ln(d0 + d1)) AS now, sum(share * d0 / (d0 + d1)) AS r0, sum(share * d1 / (d0 + d1)) AS r1, sum(share * x * d0 / (d0 + d1)) AS x0,
      sum(share * x * d1 / (d0 + d1)) AS x1, sum(share * x * x * d0 / (d0 + d1)) AS q0, sum(share * x * x * d1 / (d0 + d1)) AS q1
    FROM (SELECT *, w0 / s0 * exp(-(x - m0) * (x - m0) / (2 * s0 * s0)) / sqrt(2 * pi()) AS d0, w1 / s1 * exp(-(x - m1) * (x - m1) / (2 * s1 * s1)) / sqrt(2 * pi()) AS d1 FROM em, h) a GROUP BY ALL) b
  WHERE now - before >= 1e-7),
fit AS (SELECT * FROM em ORDER BY steps DESC LIMIT 1),
parts AS (SELECT w0 AS weight, m0 AS mean, s0 AS deviation FROM fit UNION ALL SELECT w1, m1, s1 FROM fit)
SELECT CAST(row_number() OVER (ORDER BY mean) - 1 AS INTEGER) AS component, 'scalar:normal distribution' AS name, round(weight, 4) AS weight, round(mean, 4) AS mean, round(deviation, 4) AS deviation FROM parts"""


@query("WITH RECURSIVE " + _ev()[5:] + _EM_NORMAL)
def em_normal(spark, d):
    """Two normal components fitted to the positive hourly means (hours without events are 0, on which one would collapse)."""
    start = mixture([0.5, 0.5], [normal(20.0, 20.0), normal(60.0, 20.0)])
    return _components(spark, E.fit_track(X.event_track(spark, d).df.filter("value > 0"), start, eps=1e-7), ["weight", "mean", "deviation"])


def _digamma_sql(x: str) -> str:
    """By recurrence and its asymptotic series, as functions.likelihood has it."""
    z = f"({x} + 8)"
    return f"(ln({z}) - 0.5 / {z} - 1.0 / (12 * {z}**2) + 1.0 / (120 * {z}**4) - 1.0 / (252 * {z}**6) + 1.0 / (240 * {z}**8) - {' - '.join(f'1 / ({x} + {i})' for i in range(8))})"


def _trigamma_sql(x: str) -> str:
    z = f"({x} + 8)"
    return f"(1 / {z} + 0.5 / {z}**2 + 1.0 / (6 * {z}**3) - 1.0 / (30 * {z}**5) + 1.0 / (42 * {z}**7) - 1.0 / (30 * {z}**9) + {' + '.join(f'1 / ({x} + {i})**2' for i in range(8))})"


def _shape_sql(source: str, steps: int = 8) -> str:
    """`source` with k, the gamma shape for its column gap, by so many Newton steps."""
    out = f"(SELECT *, (3 - gap + sqrt((gap - 3) * (gap - 3) + 24 * gap)) / (12 * gap) AS k0 FROM {source})"
    for i in range(steps):
        k = f"k{i}"
        out = f"(SELECT * EXCLUDE ({k}), {k} * exp(-(ln({k}) - {_digamma_sql(k)} - gap) / (1 - {k} * {_trigamma_sql(k)})) AS k{i + 1} FROM {out})"
    return f"(SELECT * EXCLUDE (k{steps}), k{steps} AS k FROM {out})"


_GAMMA_SUMS = """(SELECT *, x0 / r0 AS mean, ln(x0 / r0) - l0 / r0 AS gap
    FROM (SELECT steps, before, sum(share * ln(d0 + d1)) AS now, sum(share * d0 / (d0 + d1)) AS r0, sum(share * d1 / (d0 + d1)) AS r1, sum(share * x * d0 / (d0 + d1)) AS x0,
        sum(share * ln(x) * d0 / (d0 + d1)) AS l0, sum(share * x * d1 / (d0 + d1)) AS x1
      FROM (SELECT *, w0 * exp(shape * ln(rate) - lgamma(shape) + (shape - 1) * ln(x) - rate * x) AS d0, w1 * other * exp(-other * x) AS d1 FROM em, h) a GROUP BY ALL) b
    WHERE now - before >= 1e-7)"""
_EM_GAMMA = f""", pos AS (SELECT value AS x FROM ev WHERE value > 0), h AS (SELECT x, count(*) / (SELECT count(*) FROM pos) AS share FROM pos GROUP BY 1),
em(steps, before, w0, w1, shape, rate, other) AS (
  SELECT 0, CAST('-inf' AS DOUBLE), 0.5::DOUBLE, 0.5::DOUBLE, 4.0::DOUBLE, 0.1::DOUBLE, 0.01::DOUBLE
  UNION ALL
  SELECT steps + 1, now, r0, r1, k, k / mean, r1 / x1 FROM {_shape_sql(_GAMMA_SUMS)} c),
fit AS (SELECT * FROM em ORDER BY steps DESC LIMIT 1)
SELECT 0 AS component, 'scalar:gamma distribution' AS name, round(w0, 4) AS weight, round(shape, 4) AS first, round(rate, 4) AS second FROM fit
UNION ALL SELECT 1, 'scalar:exponential distribution', round(w1, 4), round(other, 4), CAST('nan' AS DOUBLE) FROM fit"""


@query("WITH RECURSIVE " + _ev()[5:] + _EM_GAMMA)
def em_gamma(spark, d):
    """A gamma and an exponential component fitted to the positive hourly means."""
    start = mixture([0.5, 0.5], [gamma(4.0, 0.1), exponential(0.01)])
    return _components(spark, E.fit_track(X.event_track(spark, d).df.filter("value > 0"), start, eps=1e-7), ["weight", "first", "second"])


_EM_NONPARAM = """, g AS (SELECT a AS x, count(*) AS n FROM li GROUP BY 1),
g2 AS (SELECT x, n, lead(x) OVER (ORDER BY x) - x AS gap FROM g), g3 AS (SELECT x, n, coalesce(gap, lag(gap) OVER (ORDER BY x), 1.0) AS delta FROM g2),
h AS (SELECT list(x ORDER BY x) AS xs, list(CAST(n AS DOUBLE) ORDER BY x) AS ns, list(delta ORDER BY x) AS ds, CAST(sum(n) AS DOUBLE) AS total FROM g3),
em(steps, before, w0, w1, y) AS (
  SELECT 0, CAST('-inf' AS DOUBLE), 0.5::DOUBLE, 0.5::DOUBLE, list_transform(xs, lambda x: 0.01::DOUBLE) FROM h
  UNION ALL
  SELECT steps + 1, now, (total - mass) / total, mass / total, list_transform(list_zip(r, ds), lambda z: z[1] / (mass + 1) / z[2])
  FROM (SELECT *, list_sum(r) AS mass, list_sum(list_transform(list_zip(t, ns), lambda z: z[2] * ln(z[1]))) / total AS now
    FROM (SELECT *, list_transform(list_zip(t, y, ns), lambda z: z[3] * w1 * z[2] / z[1]) AS r
      FROM (SELECT *, list_transform(list_zip(xs, y), lambda z: w1 * z[2] + CASE WHEN z[1] = 0 THEN w0 ELSE 0 END) AS t FROM em, h) a) b) c
  WHERE now - before >= 1e-7),
fit AS (SELECT * FROM em ORDER BY steps DESC LIMIT 1)
SELECT unnest(xs) AS x, round(w0, 6) AS zeros, round(unnest(list_transform(y, lambda v: ln(v))), 6) AS log_density FROM fit, h"""


@query("WITH RECURSIVE " + _LI[5:] + _EM_NONPARAM)
def em_nonparam(spark, d):
    """Excess zeros and a density of any form, fitted together; a row for each step of the density."""
    steps = lambda x: Distribution("scalar:nonparametric distribution", {"X": x.tolist(), "Y": [-math.log(100)] * len(x)})
    fit = E.fit_track(X.ship_tracks(spark, d)[0].df, lambda x: mixture([0.5, 0.5], [delta(0.0), steps(x)]), eps=1e-7)
    found = fit.model.parts[1].parameters
    return spark.createDataFrame([(x, round(fit.model.parameters[0], 6), round(y, 6)) for x, y in zip(found["X"], found["Y"])], "x double, zeros double, log_density double")


_POISSON3 = lambda i: " * ".join(f"exp({t} * ln({t}{i}) - {t}{i} - lgamma({t} + 1))" for t in "anr")
_EM_JOINT = f""", h AS (SELECT a, n, r, count(*) / (SELECT count(*) FROM li) AS share FROM li GROUP BY 1, 2, 3),
em(steps, before, w0, w1, a0, n0, r0, a1, n1, r1) AS (
  SELECT 0, CAST('-inf' AS DOUBLE), 0.5::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE, 2.0::DOUBLE
  UNION ALL
  SELECT steps + 1, now, m0, m1, sa0 / m0, sn0 / m0, sr0 / m0, sa1 / m1, sn1 / m1, sr1 / m1
  FROM (SELECT steps, before, sum(share * ln(d0 + d1)) AS now, {", ".join(f"sum(share * d{i} / (d0 + d1)) AS m{i}, " + ", ".join(f"sum(share * {t} * d{i} / (d0 + d1)) AS s{t}{i}" for t in "anr") for i in (0, 1))}
    FROM (SELECT *, w0 * {_POISSON3(0)} AS d0, w1 * {_POISSON3(1)} AS d1 FROM em, h) a GROUP BY ALL) b
  WHERE now - before >= 1e-5),
fit AS (SELECT * FROM em ORDER BY steps DESC LIMIT 1),
parts AS (SELECT w0 AS weight, a0 AS a, n0 AS n, r0 AS r FROM fit UNION ALL SELECT w1, a1, n1, r1 FROM fit)
SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS INTEGER) AS component, round(weight, 4) AS weight, round(a, 4) AS a, round(n, 4) AS n, round(r, 4) AS r FROM parts"""


@query("WITH RECURSIVE " + _LI[5:] + _EM_JOINT)
def em_joint(spark, d):
    """One model of three tracks together: two components, each with a rate for each track."""
    start = Distribution("vector:mixture distribution", (0.5, 0.5), tuple(product([poisson(x) for x in rates]) for rates in ((0.5, 2.0, 0.5), (2.0, 0.5, 2.0))))
    fit = E.fit_joint(T.wide(X.ship_tracks(spark, d)), start, eps=1e-5)
    rows = [(i, round(w, 4), *(round(float(c.parameters[0]), 4) for c in p.parts)) for i, (w, p) in enumerate(zip(fit.model.parameters, fit.model.parts))]
    return spark.createDataFrame(rows, "component int, weight double, a double, n double, r double")


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT id, round(list_sum(list_transform(v, lambda x, i: -0.5 * ((x - (i - 1) / 100.0) / (0.5 + (i - 1) / 50.0))**2 - ln(0.5 + (i - 1) / 50.0) - 0.5 * ln(2 * pi()))), 6) AS log_pdf FROM v""")
def density_vectors(spark, d):
    model = product([normal(i / 100, 0.5 + i / 50) for i in range(64)])
    return E.vector_log_density(X.vectors(spark, d), model).select("id", A.rounded(F.col("log_pdf")).alias("log_pdf"))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
f AS (SELECT id, list_sum(list_transform(v, lambda x, i: -0.5 * (x - (i - 1) // 8 / 10.0)**2 - 0.5 * ln(2 * pi()))) AS f0,
  list_sum(list_transform(v, lambda x, i: -0.5 * ((x + (i - 1) % 8 / 10.0) / 2)**2 - ln(2) - 0.5 * ln(2 * pi()))) AS f1 FROM v)
SELECT id, round(greatest(ln(0.4) + f0, ln(0.6) + f1) + ln(1 + exp(least(ln(0.4) + f0, ln(0.6) + f1) - greatest(ln(0.4) + f0, ln(0.6) + f1))), 6) AS log_pdf FROM f""")
def density_matrices(spark, d):
    """The density of 8 by 8 matrices under a mixture of two products of rows."""
    near = matrix_rows([product([normal(i / 10, 1.0) for _ in range(8)]) for i in range(8)])
    far = matrix_rows([product([normal(-j / 10, 2.0) for j in range(8)]) for _ in range(8)])
    model = Distribution("matrix:mixture distribution", (0.4, 0.6), (near, far))
    return E.vector_log_density(_square(X.vectors(spark, d)), model, "m").select("id", A.rounded(F.col("log_pdf")).alias("log_pdf"))


def _square(vectors: DataFrame) -> DataFrame:
    """(id, m): vectors of 64 components as matrices of eight rows."""
    return vectors.select("id", F.array(*(F.slice("v", i * 8 + 1, 8) for i in range(8))).alias("m"))


# Segmentation ----------------------------------------------------------------------


@query(_LI + _STATES + _RUNS + """, x AS (SELECT seqname, state, "from" AS line, unnest(range("from", "to", 2)) // 2 AS bin FROM rn),
y AS (SELECT seqname, bin, arg_max(state, line) AS state FROM x GROUP BY 1, 2)
SELECT s.seqname, CAST(b.bin AS INTEGER) AS bin, CAST(coalesce(y.state, 0) AS DOUBLE) AS value FROM seqs s CROSS JOIN (SELECT unnest(range(1250)) AS bin) b LEFT JOIN y ON y.seqname = s.seqname AND y.bin = b.bin""")
def seg_import(spark, d):
    track = _states(spark, d)
    segments = Z.state_runs(track, block=128).select("seqname", "from", "to", F.concat(F.lit("s"), "state").alias("name"), F.col("from").alias("line"))
    return Z.import_segmentation(segments, track.genome.withColumn("nbins", F.lit(1250)), 2).df


@query(_LI + _STATES + """SELECT t.track, st.state, t.value, count(*) AS count FROM st JOIN
  (SELECT seqname, bin, 0 AS track, n AS value FROM li UNION ALL SELECT seqname, bin, 1, r FROM li) t ON t.seqname = st.seqname AND t.bin = st.bin GROUP BY 1, 2, 3""")
def seg_histogram(spark, d):
    return Z.histogram_by_state(_states(spark, d), X.ship_tracks(spark, d)[1:], 4)


@query(_LI + _STATES + """, h AS (SELECT 0 AS track, st.state, n AS value, count(*) AS c FROM st JOIN li ON li.seqname = st.seqname AND li.bin = st.bin GROUP BY 1, 2, 3)
SELECT track, state, value, printf('%10d %10d %20s %15d', track, state, CAST(CAST(value AS BIGINT) AS VARCHAR), c) AS text FROM h""")
def seg_histogram_text(spark, d):
    return Z.histogram_text(Z.histogram_by_state(_states(spark, d), X.ship_tracks(spark, d)[1:2], 4))


TREE = Z.StateTree(0, 4, (Z.StateTree(0, 1), Z.StateTree(1, 4, (Z.StateTree(1, 3), Z.StateTree(3, 4)))))


@query(_LI + """, st AS (SELECT seqname, bin, CASE WHEN a < 1 THEN 0 ELSE 1 END AS state FROM li) """ + _RUNS + "SELECT * FROM rn")
def seg_hierarchical(spark, d):
    return Z.hierarchical_runs(_states(spark, d), TREE, 0)


@query(_LI + _STATES + _RUNS + """SELECT seqname, "from", "to", 's' || state AS name, 0 AS score, '.' AS strand, "from" AS "thickStart", "to" AS "thickEnd",
  CAST(state // 4 % 2 * 127 AS VARCHAR) || ',' || CAST(state // 2 % 2 * 127 AS VARCHAR) || ',' || CAST(state % 2 * 127 AS VARCHAR) AS "itemRgb" FROM rn""")
def seg_bed9(spark, d):
    return Z.bed9(Z.state_runs(_states(spark, d)), n=4)


# Functions -------------------------------------------------------------------------


@query("""SELECT event_id, round(greatest(value, user_id) + ln(1 + exp(least(value, user_id) - greatest(value, user_id))), 6) AS y FROM events""")
def logadd(spark, d):
    return X.table(spark, d, "events").select("event_id", A.rounded(A.log_add(F.col("value"), F.col("user_id").cast("double"))).alias("y"))


@query("""SELECT event_id, CASE WHEN value > user_id THEN round(value + ln(1 - exp(user_id - value)), 6) WHEN value = user_id THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END AS y FROM events""")
def logsub(spark, d):
    y = A.log_sub(F.col("value"), F.col("user_id").cast("double"))
    y = F.when(F.abs(y) <= 2.0**-54, 0.0).otherwise(y)  # where the SQL's 1 - exp(…) is 1
    return X.table(spark, d, "events").select("event_id", F.when(F.abs(y) < A.INF, A.rounded(y)).otherwise(y).alias("y"))


_V = "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS DOUBLE)) AS v FROM embeddings) "


def _thousandths(spark, d) -> DataFrame:
    return X.vectors(spark, d).select("id", F.transform("v", lambda x: F.floor(x * 1000).cast("double")).alias("v"))


def _text(sql: str) -> str:
    return f"array_to_string(list_transform({sql}, lambda x: CAST(x AS BIGINT)), ',')"


@query(_V + f"SELECT id, {_text('list_concat(v[-2:], v[:-3])')} AS v FROM v")
def shift_ring(spark, d):
    return _thousandths(spark, d).select("id", _whole("v", A.shift_ring(F.col("v"), 2)))


@query(_V + f"SELECT id, {_text('list_concat(v[4:], v[:3])')} AS v FROM v")
def shift_ring_left(spark, d):
    return _thousandths(spark, d).select("id", _whole("v", A.shift_ring(F.col("v"), -3)))


@query(_V + "SELECT id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS i FROM v")
def argmax(spark, d):
    return _thousandths(spark, d).select("id", A.argmax(F.col("v")).alias("i"))


@query(_V + "SELECT id, list_max(v) AS high, list_min(v) AS low, round(list_avg(v), 6) AS mean FROM v")
def slice_stats(spark, d):
    v = F.col("v")
    return _thousandths(spark, d).select("id", A.slice_max(v).alias("high"), A.slice_min(v).alias("low"), F.round(A.slice_mean(v), 6).alias("mean"))


@query(_V + f"SELECT id, {_text('v')} AS v FROM v")
def flatten(spark, d):
    return _square(_thousandths(spark, d)).select("id", _whole("v", A.flatten(F.col("m"))))


@query(_V + f"SELECT id, {_text('flatten(list_transform(range(1, 9), lambda j: list_transform(range(8), lambda i: v[i * 8 + j])))')} AS v FROM v")
def transpose(spark, d):
    return _square(_thousandths(spark, d)).select("id", _whole("v", A.flatten(A.transpose(F.col("m")))))


@query("""SELECT event_id, CAST(trunc((user_id - 500) / 7.0) AS BIGINT) AS down, CAST(trunc((user_id - 500 + 6) / 7.0) AS BIGINT) AS up FROM events""")
def divint(spark, d):
    a = F.col("user_id") - 500
    return X.table(spark, d, "events").select("event_id", A.div_int_down_column(a, 7).alias("down"), A.div_int_up_column(a, 7).alias("up"))


@query(_LI + "SELECT seqname, bin, CASE WHEN max(a) OVER w > min(a) OVER w THEN round((a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w), 6) ELSE CAST('nan' AS DOUBLE) END AS value FROM li WINDOW w AS (PARTITION BY seqname)")
def normalize(spark, d):
    df = X.ship_tracks(spark, d)[0].df
    return df.select("seqname", "bin", F.round(A.min_max_scaled(F.col("value"), Window.partitionBy("seqname")), 6).alias("value"))


@query(_V + ", e AS (SELECT unnest(v) AS x FROM v) SELECT x, count(*) AS n FROM e GROUP BY 1")
def est_vector_data(spark, d):
    return E.value_histogram(E.vector_values(_thousandths(spark, d)))


@query(_V + ", e AS (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM v) SELECT CAST(i AS INTEGER) AS i, x, count(*) AS n FROM e GROUP BY 1, 2")
def est_vector_coordinates(spark, d):
    return E.coordinate_histograms(_thousandths(spark, d))


@query(_V + ", e AS (SELECT unnest(v) AS x FROM v), l AS (SELECT (max(x) - min(x)) / 100 AS step FROM e) SELECT round(floor(x / step) * step, 6) AS x, count(*) AS n FROM e, l GROUP BY 1")
def hist_gridded(spark, d):
    hist = E.gridded(E.value_histogram(E.vector_values(_thousandths(spark, d))), 100)
    return hist.select(F.round("x", 6).alias("x"), F.col("n").cast("long").alias("n"))


@query(_LI + f", h AS (SELECT a, count(*) AS n FROM li GROUP BY 1), cv AS (SELECT a, n, {_density_sql('a')} FROM h) SELECT a AS x, n, round(f0 + f1 + f2, 6) AS background, round(f3, 6) AS foreground FROM cv")
def model_curves(spark, d):
    return _digits(E.model_curves(E.value_histogram(X.ship_tracks(spark, d)[0].df), EXAMPLE, [3]), "background", "foreground")


@query(_LI + "SELECT seqname, bin, value FROM (SELECT seqname, bin, sum(a + 2 * n) OVER (PARTITION BY seqname ORDER BY bin) AS value FROM li)")
def classify_sequence_multi(spark, d):
    import numpy as np

    a, n, _ = X.ship_tracks(spark, d)
    return W.classify_sequences_multi([a, n], S.running(np.add, lambda m: m[0] + 2 * m[1]), block=500).df


@query(_LI + "SELECT seqname, bin, value FROM (SELECT seqname, bin, max(a) OVER (PARTITION BY seqname ORDER BY bin) AS value FROM li)")
def classify_sequence(spark, d):
    import numpy as np

    return W.classify_sequences(X.ship_tracks(spark, d)[0], S.running(np.maximum), block=500).df


@query(_LI + "SELECT seqname, bin, round(a - avg(a) OVER (PARTITION BY seqname), 6) AS value FROM li")
def classify_sequence_centred(spark, d):
    """Values less their sequence's mean: a classifier that needs what comes before a block and after it."""
    import numpy as np

    def finish(x, before, after):
        total, n = sum((e for e in (before, after) if e is not None), np.array([x.sum(), len(x)]))
        return x - total / n

    mean = S.BlockScan(lambda x: np.array([x.sum(), len(x)]), S.two_sided(np.add), finish)
    return _rounded(W.classify_sequences(X.ship_tracks(spark, d)[0], mean, block=500))


@query(_V + "SELECT id, list_max(v) - list_min(v) AS score FROM v")
def classify_matrix_data(spark, d):
    spread = lambda m: A.slice_max(A.flatten(m)) - A.slice_min(A.flatten(m))
    return W.classify_matrices(_square(_thousandths(spark, d)), spread, 8, 8).select("id", "score")


@query(_V + ", e AS (SELECT unnest(v) AS x FROM v) SELECT x, count(*) AS n FROM e GROUP BY 1")
def est_matrix_data(spark, d):
    return E.value_histogram(E.matrix_values(_square(_thousandths(spark, d))))


@query(_V + ", e AS (SELECT unnest(v) AS x, unnest(range(64)) AS k FROM v) SELECT CAST(k // 8 AS INTEGER) AS i, x, count(*) AS n FROM e GROUP BY 1, 2")
def est_matrix_rows(spark, d):
    return E.matrix_row_histograms(_square(_thousandths(spark, d)))


# Hidden Markov models ----------------------------------------------------------------


def _hmm() -> H.Hmm:
    import numpy as np

    return H.Hmm(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), (poisson(1.0), poisson(5.0)))


#: Forward and backward steps of the two states, scaled: q has the emissions' shares at each bin, j what each move weighs.
_HMM = """, q AS (SELECT seqname, bin, a, 1 / (1 + exp(a * ln(5) - 4)) AS q0, 1 / (1 + exp(4 - a * ln(5))) AS q1 FROM li),
f(seqname, bin, f0, f1) AS (
  SELECT seqname, bin, 0.6 * q0 / (0.6 * q0 + 0.4 * q1), 0.4 * q1 / (0.6 * q0 + 0.4 * q1) FROM q WHERE bin = 0
  UNION ALL
  SELECT seqname, bin, x / (x + y), y / (x + y)
  FROM (SELECT q.seqname, q.bin, (0.9 * f0 + 0.2 * f1) * q0 AS x, (0.1 * f0 + 0.8 * f1) * q1 AS y FROM f JOIN q ON q.seqname = f.seqname AND q.bin = f.bin + 1) s),
b(seqname, bin, b0, b1) AS (
  SELECT seqname, max(bin), 0.5::DOUBLE, 0.5::DOUBLE FROM q GROUP BY 1
  UNION ALL
  SELECT seqname, bin, x / (x + y), y / (x + y)
  FROM (SELECT b.seqname, b.bin - 1 AS bin, 0.9 * q0 * b0 + 0.1 * q1 * b1 AS x, 0.2 * q0 * b0 + 0.8 * q1 * b1 AS y FROM b JOIN q ON q.seqname = b.seqname AND q.bin = b.bin WHERE b.bin > 0) s),
post AS (SELECT seqname, bin, a, f0 * b0 / (f0 * b0 + f1 * b1) AS p0, f1 * b1 / (f0 * b0 + f1 * b1) AS p1 FROM f JOIN b USING (seqname, bin) JOIN q USING (seqname, bin)) """


@query("WITH RECURSIVE " + _LI[5:] + _HMM + "SELECT seqname, bin, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM post")
def hmm_posterior(spark, d):
    rows = H.posteriors(X.ship_tracks(spark, d)[0], _hmm(), block=500)
    return rows.select("seqname", "bin", F.round(F.get("p", F.lit(0)), 6).alias("p0"), F.round(F.get("p", F.lit(1)), 6).alias("p1"))


@query(
    "WITH RECURSIVE " + _LI[5:] + _HMM + """, j AS (
  SELECT f0 * 0.9 * q0 * b0 AS j00, f0 * 0.1 * q1 * b1 AS j01, f1 * 0.2 * q0 * b0 AS j10, f1 * 0.8 * q1 * b1 AS j11
  FROM f JOIN b ON b.seqname = f.seqname AND b.bin = f.bin + 1 JOIN q ON q.seqname = b.seqname AND q.bin = b.bin),
m AS (SELECT sum(j00 / t) AS m00, sum(j01 / t) AS m01, sum(j10 / t) AS m10, sum(j11 / t) AS m11 FROM (SELECT *, j00 + j01 + j10 + j11 AS t FROM j) s),
e AS (SELECT avg(p0) FILTER (bin = 0) AS s0, avg(p1) FILTER (bin = 0) AS s1, sum(a * p0) / sum(p0) AS r0, sum(a * p1) / sum(p1) AS r1 FROM post)
SELECT 0 AS state, round(s0, 6) AS pi, round(m00 / (m00 + m01), 6) AS to0, round(m01 / (m00 + m01), 6) AS to1, round(r0, 6) AS rate FROM m, e
UNION ALL SELECT 1, round(s1, 6), round(m10 / (m10 + m11), 6), round(m11 / (m10 + m11), 6), round(r1, 6) FROM m, e"""
)
def hmm_train(spark, d):
    h = H.train_step(X.ship_tracks(spark, d)[0], _hmm(), block=500)
    numbers = lambda i: [round(float(x), 6) for x in (h.pi[i], *h.tr[i], h.emissions[i].parameters[0])]
    return spark.createDataFrame([(i, *numbers(i)) for i in range(2)], "state int, pi double, to0 double, to1 double, rate double")


#: The best path: scores of both states in whole units of 1e-9 and the states they came from, then back from the last bin.
_PATH = """, u AS (
  SELECT seqname, bin, CASE WHEN bin % 17 = 3 THEN 0 ELSE CAST(round((-1 - lgamma(a + 1)) * 1e9) AS BIGINT) END AS e0,
    CASE WHEN bin % 17 = 3 THEN 0 ELSE CAST(round((a * ln(5) - 5 - lgamma(a + 1)) * 1e9) AS BIGINT) END AS e1 FROM li),
cost AS (SELECT CAST(round(ln(0.9) * 1e9) AS BIGINT) AS t00, CAST(round(ln(0.1) * 1e9) AS BIGINT) AS t01, CAST(round(ln(0.2) * 1e9) AS BIGINT) AS t10, CAST(round(ln(0.8) * 1e9) AS BIGINT) AS t11),
v(seqname, bin, s0, s1, b0, b1) AS (
  SELECT seqname, bin, CAST(round(ln(0.6) * 1e9) AS BIGINT) + e0, CAST(round(ln(0.4) * 1e9) AS BIGINT) + e1, 0, 0 FROM u WHERE bin = 0
  UNION ALL
  SELECT u.seqname, u.bin, greatest(s0 + t00, s1 + t10) + e0, greatest(s0 + t01, s1 + t11) + e1, CASE WHEN s1 + t10 > s0 + t00 THEN 1 ELSE 0 END, CASE WHEN s1 + t11 > s0 + t01 THEN 1 ELSE 0 END
  FROM v JOIN u ON u.seqname = v.seqname AND u.bin = v.bin + 1, cost),
w(seqname, bin, state) AS (
  SELECT seqname, bin, CASE WHEN s1 > s0 THEN 1 ELSE 0 END FROM v WHERE bin = 2499
  UNION ALL
  SELECT v.seqname, v.bin - 1, CASE WHEN w.state = 0 THEN b0 ELSE b1 END FROM w JOIN v ON v.seqname = w.seqname AND v.bin = w.bin WHERE v.bin > 0)
SELECT seqname, CAST(bin AS INTEGER) AS bin, CAST(state AS INTEGER) AS state FROM w"""


@query("WITH RECURSIVE " + _LI[5:] + _PATH)
def hmm_path(spark, d):
    masked = X.ship_tracks(spark, d)[0].map_positions(lambda s, p, v: F.when(p % 17 == 3, A.NAN).otherwise(v))
    model = H.Hmm.from_json(_hmm().to_json())
    return H.paths(masked, model, block=500)


@query(
    "WITH RECURSIVE " + _LI[5:] + """, s AS (SELECT seqname, bin, CAST(CASE WHEN a = 0 THEN 0 WHEN a < 3 THEN 1 ELSE 2 END AS INTEGER) AS state FROM li),
m AS (SELECT x.state AS i, y.state AS j, count(*) AS n FROM s x JOIN s y ON x.seqname = y.seqname AND y.bin = x.bin + 1 GROUP BY 1, 2),
tr AS (SELECT i, j, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER (PARTITION BY i)) AS p FROM (SELECT a.i, b.j FROM range(3) a(i), range(3) b(j)) k LEFT JOIN m USING (i, j)),
w AS (SELECT list(p ORDER BY j) FILTER (i = 0) AS r0, list(p ORDER BY j) FILTER (i = 1) AS r1, list(p ORDER BY j) FILTER (i = 2) AS r2 FROM tr),
it(k, p) AS (
  SELECT 0, [1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE]
  UNION ALL SELECT k + 1, list_transform(range(1, 4), lambda j: p[1] * r0[j] + p[2] * r1[j] + p[3] * r2[j]) FROM it, w WHERE k < 2000)
SELECT CAST(i AS INTEGER) AS state, round(p[i + 1], 6) AS p FROM it, range(3) t(i) WHERE k = 2000"""
)
def hmm_stationary(spark, d):
    """The distribution that the moves between levels of a track keep, from their counts over the whole track."""
    import numpy as np

    levels = X.ship_tracks(spark, d)[0].map(lambda v: F.when(v == 0, 0.0).when(v < 3, 1.0).otherwise(2.0))
    rows = H.moves(levels, 3).collect()
    counts = np.ones((3, 3))
    for r in rows:
        counts[r.i, r.j] += r.n
    p = H.stationary(counts / counts.sum(axis=1, keepdims=True))
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(p)], "state int, p double")
