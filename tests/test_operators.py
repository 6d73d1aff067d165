"""Operators against plain loops on small random tracks with masked bins, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackengine.functions import arrays as A
from trackengine.functions.distributions import Distribution, delta, geometric, log_density, mean, mixture, poisson, translation
from trackengine.operators import estimate as E
from trackengine.operators import hmm as H
from trackengine.operators import intervals as I
from trackengine.operators import metrics as M
from trackengine.operators import peaks as P
from trackengine.operators import segmentation as Z
from trackengine.operators import track as T
from trackengine.operators import windows as W

NAN = float("nan")


def track(spark, values: dict, bin_size=1):
    rows = [(s, i, float(v)) for s, x in values.items() for i, v in enumerate(x)]
    genome = spark.createDataFrame([(s, len(x)) for s, x in values.items()], "seqname string, nbins int")
    return T.Track(spark.createDataFrame(rows, "seqname string, bin int, value double"), genome, bin_size)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    x = {s: np.round(rng.random(n) * 10, 2) for s, n in (("a", 57), ("b", 23), ("c", 3))}
    x["a"][[4, 5, 30]] = NAN
    return x, track(spark, x, 10)


def loop_peaks(x, threshold, wsize, bs):
    out = []
    o1, o2 = A.offsets(wsize)
    for s, v in x.items():
        i = 0
        while i < len(v):
            if v[i] > threshold:
                start = best = i
                while i < len(v) and v[i] > threshold:
                    best = i if v[i] > v[best] else best
                    i += 1
                if wsize > 0:
                    out.append((s, max(best * bs - o1, 0), min(best * bs + o2 + 1, len(v) * bs), v[best]))
                else:
                    out.append((s, start * bs - o1, i * bs + o2 + 1, v[best]))
            i += 1
    return sorted(out)


@pytest.mark.parametrize("wsize", [0, -1, -2, 1, 8, 25])
@pytest.mark.parametrize("block", [4, 65_536])
def test_peaks(spark, noisy, wsize, block):
    x, t = noisy
    got = sorted((r["seqname"], r["from"], r["to"], r["test"]) for r in P.peaks(t, 4, wsize, block).collect())
    assert got == loop_peaks(x, 4, wsize, 10)


def test_peak_edges(spark):
    t = track(spark, {"s": [5, 5, 1, NAN, 7, 7, 5.0]})
    got = [(r["from"], r["to"], r["test"]) for r in P.peaks(t, 5, -1, block=3).collect()]
    assert got == [(4, 6, 7.0)]  # equal to the threshold is no peak
    assert [(r["from"], r["to"]) for r in P.peaks(t, 6, 1).collect()] == [(4, 5)]  # first of equal heights
    assert P.peaks(t, 100, 0).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 30])
@pytest.mark.parametrize("block", [7, 65_536])
def test_centred_windows(spark, noisy, n, block):
    x, t = noisy
    got = {(r.seqname, r.bin): r.value for r in W.classify(t, n, A.slice_sum, block=block).df.collect()}
    o1, o2 = A.offsets(n)
    for s, v in x.items():
        for i in range(len(v)):
            want = sum(v[i - o1 : i + o2 + 1]) if i >= o1 and i < len(v) - o2 else NAN
            assert got[s, i] == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize("n, step", [(1, 0), (3, 0), (3, 2), (2, 5), (40, 1)])
def test_hopping_windows(spark, noisy, n, step):
    x, t = noisy
    got = sorted((r.seqname, r.bin, r.win) for r in W.hopping(t, n, step, block=8).collect())
    want = [(s, i, list(v[i : i + n])) for s, v in x.items() for i in range(0, len(v) - n, step or n) if not any(map(math.isnan, v[i : i + n]))]
    assert got == sorted(want)


def test_intersections_may_begin_below_zero(spark):
    a, b = track(spark, {"s": [9, 0, 0, 9, 9]}), track(spark, {"s": [9, 0, 0, 0, 9]})
    got = {(r["from"], r["to"], *r["test"]) for r in P.intersecting_peaks([a, b], [1, 1], 6).collect()}
    # whole runs reach one position too far, so [0, 2) and [3, 6) meet [0, 2) and [4, 6)
    assert got == {(-3, 3, 9.0, 9.0), (1, 7, 9.0, 9.0)}


def test_equal_overlapping_windows_both_go(spark):
    df = spark.createDataFrame([(1, "s", 0, 5, 2.0), (2, "s", 4, 9, 2.0), (3, "s", 9, 12, 1.0), (4, "t", 0, 5, 0.0)], "id int, seqname string, from int, to int, test double")
    assert sorted(r.id for r in I.without_overlapped(df, df.test, ["id"], piece=3).collect()) == [3, 4]


def test_regions_and_mask(spark):
    t = track(spark, {"s": [0, 1, 2, 3, 4, 5]}, 10)
    regions = spark.createDataFrame([(1, "s", 5, 21), (2, "s", 59, 90), (3, "x", 0, 5), (4, "s", 7, 7)], "region_id int, seqname string, from int, to int")
    assert {r.region_id: r.v for r in T.region_vectors(t, regions).collect()} == {1: [0.0, 1.0, 2.0], 2: [5.0]}
    masked = [r.value for r in T.mask(t, regions).df.orderBy("bin").collect()]
    assert [math.isnan(v) for v in masked] == [True, True, True, False, False, True]


def test_binning(spark):
    genome = spark.createDataFrame([("s", 4)], "seqname string, nbins int")
    signal = spark.createDataFrame([("s", 0, 1.0), ("s", 9, 2.0), ("s", 25, 7.0), ("s", 40, 9.0), ("s", 12, None), ("u", 1, 1.0)], "seqname string, pos int, value double")
    of = lambda **k: [r.value for r in T.bin_signal(signal, genome, 10, **k).df.orderBy("bin").collect()]
    assert of() == [1.5, 0, 7, 0] and of(summary="discrete mean") == [2, 0, 7, 0] and of(summary="min", init=-1) == [1, -1, 7, -1]
    assert of(overlap=1, summary="max") == [2, 7, 7, 9]
    with pytest.raises(ValueError):
        of(summary="median")


def test_arrays(spark):
    v = lambda *xs: spark.createDataFrame([(list(map(float, xs)),)], "v array<double>")
    one = lambda df, c: df.select(c.alias("x")).first().x
    df = v(3, 1, 4, 1)
    assert one(df, A.shift_ring(df.v, 1)) == [1, 3, 1, 4] and one(df, A.shift_ring(df.v, -1)) == [1, 4, 1, 3] and one(df, A.shift_ring(df.v, 0)) == [3, 1, 4, 1]
    assert one(df, A.argmax(df.v)) == 2 and one(v(NAN, 1), A.argmax(F.col("v"))) == 0 and math.isnan(one(v(NAN, 1), A.slice_max(F.col("v"))))
    assert one(v(1, NAN, 2), A.slice_max(F.col("v"))) == 2 and one(v(), A.argmax(F.col("v"))) == 0 and math.isnan(one(v(), A.slice_mean(F.col("v"))))
    two = spark.createDataFrame([(-math.inf, -math.inf), (1.0, 1.0), (0.0, 1.0), (2.0, -math.inf), (2.0, 1.0)], "a double, b double")
    add, sub = zip(*two.select(A.log_add(two.a, two.b), A.log_sub(two.a, two.b)).collect())
    assert add[0] == -math.inf and add[4] == pytest.approx(math.log(math.e**2 + math.e)) and add[3] == 2
    assert sub[0] == sub[1] == -math.inf and math.isnan(sub[2]) and sub[3] == 2 and sub[4] == pytest.approx(math.log(math.e**2 - math.e))
    assert [A.offsets(w) for w in (0, -1, -2, 1, 4, 5)] == [(0, 0), (0, -1), (-1, -1), (0, 0), (2, 1), (2, 2)]
    assert A.colours(4) == ["0,0,0", "0,0,127", "0,127,0", "0,127,127"]


def test_confusion_counts(spark):
    rng = np.random.default_rng(1)
    gt, test = rng.integers(0, 3, 300), np.round(rng.random(300), 2)
    test[:4] = NAN
    df = spark.createDataFrame([(int(g), float(x)) for g, x in zip(gt, test)], "gt int, test double")
    for n in (3, 10, 37):
        rows = M.performance(df, n).orderBy("thr").collect()
        grid = M.threshold_grid(float(np.nanmin(test)), float(np.nanmax(test)), n)
        assert [r.thr for r in rows] == grid
        for r in rows:
            want = [int(((gt == g) & f).sum()) for g, f in ((1, test >= r.thr), (0, test >= r.thr), (0, test < r.thr), (1, test < r.thr))]
            assert [r.tp, r.fp, r.tn, r.fn] == want
    same = spark.createDataFrame([(1, 2.0), (0, 2.0)], "gt int, test double")
    assert M.performance(same, 5).count() == 0
    none = spark.createDataFrame([(0, 1.0), (0, 2.0)], "gt int, test double")
    assert all(math.isnan(r.tpr) for r in M.roc(none, 4).collect())
    curve = spark.createDataFrame([(0.0, 1.0, 1.0), (1.0, 0.0, 0.0)], "thr double, fpr double, tpr double")
    assert M.auc(curve, "fpr", "tpr").first().auc == 0.5


def test_mixture_recovers_published_parameters():
    """The published four-component parameters must be what EM finds on the counts that they imply."""
    from trackengine.queries import EXAMPLE

    x = np.arange(400.0)
    n = np.exp(log_density(EXAMPLE)(x)) * 5_461_644
    fit = E.fit_mixture(x, n, mixture([0.25] * 4, [delta(0.0), poisson(2.0), geometric(0.05), geometric(0.4)]), eps=1e-12)
    assert np.allclose(fit.model.parameters, EXAMPLE.parameters, atol=2e-3)
    got, want = [p.parameters[0] for p in fit.model.parts], [p.parameters[0] for p in EXAMPLE.parts]
    assert np.allclose(got, want, rtol=1e-2)  # the geometric ones in canonical order


def test_distributions():
    assert log_density(translation(poisson(3.0), -5.0))([5.0])[0] == pytest.approx(-3)
    assert log_density(geometric(0.3))([0.0, -1.0, 0.5]).tolist() == [pytest.approx(math.log(0.3)), -math.inf, -math.inf]
    doc = mixture([0.5, 0.5], [delta(0.0), poisson(2.0)]).to_json()
    assert Distribution.from_json(doc).to_json() == doc and mean(Distribution.from_json(doc)) == [None, 2.0]


def test_density_of_histograms(spark):
    one = E.density(spark.createDataFrame([(3.0, 5.0)], "x double, n double")).first()
    assert (one.delta, one.log_density) == (1.0, pytest.approx(math.log(5 / 6)))
    dens = E.density(spark.createDataFrame([(0.0, 4), (1.0, 3), (3.0, 2)], "x double, n long"))
    rows = dens.orderBy("x").collect()
    assert sum(math.exp(r.log_density) * r.delta for r in rows) == pytest.approx(9 / 10)
    asked = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 0.9, 1.0, 2.9, 3.0, 4.9, 5.0, NAN)], "value double")
    got = [r.log_pdf for r in E.step_log_pdf(asked, dens).collect()]
    d = [r.log_density for r in rows]
    assert got == [-math.inf, d[0], d[0], d[1], d[1], d[2], d[2], -math.inf, None]


def test_adaptive_bins():
    low, n = E.adaptive_bins([0.0, 1.0, 1.1, 5.0, 9.0], [1, 2, 3, 4, 5], 3)
    assert sum(n) == 15 and len(low) == 3 and low[0] == 0.0
    assert E.adaptive_bins([2.0], [7], 5) == ([2.0], [7.0])


def loop_posterior(hmm, x):
    e = np.array([np.exp(log_density(d)(x)) for d in hmm.emissions]).T
    e[np.isnan(x)] = 1
    a, b = np.zeros_like(e), np.ones_like(e)
    a[0] = hmm.pi * e[0]
    for i in range(1, len(x)):
        a[i] = (a[i - 1] @ hmm.tr) * e[i]
    for i in range(len(x) - 2, -1, -1):
        b[i] = hmm.tr @ (e[i + 1] * b[i + 1])
    p = a * b
    return p / p.sum(axis=1, keepdims=True)


def test_hmm_blocks(spark):
    rng = np.random.default_rng(2)
    hmm = H.Hmm(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), (poisson(1.0), poisson(5.0)))
    x = rng.poisson(3, 40).astype(float)
    x[7] = NAN
    t = track(spark, {"s": x})
    for block in (6, 1000):
        got = np.array([r.p for r in H.posteriors(t, hmm, block).orderBy("bin").collect()])
        assert np.allclose(got, loop_posterior(hmm, x))
    one, many = H.train_step(t, hmm, 1000), H.train_step(t, hmm, 6)
    assert np.allclose(one.tr, many.tr) and np.allclose(one.pi, many.pi) and one.emissions[0].parameters == pytest.approx(many.emissions[0].parameters)
    assert np.allclose(H.stationary(hmm.tr) @ hmm.tr, H.stationary(hmm.tr))


def test_segmentation(spark):
    genome = spark.createDataFrame([("s", 4)], "seqname string, nbins int")
    seg = lambda *rows: spark.createDataFrame(rows, "seqname string, from int, to int, name string, line int")
    t = Z.import_segmentation(seg(("s", 5, 15, "s7", 0), ("s", 20, 40, "s2", 1), ("s", 30, 40, "s3", 2)), genome, 10)
    assert [r.value for r in t.df.orderBy("bin").collect()] == [7, 0, 2, 3]
    with pytest.raises(Exception, match="no state"):
        Z.import_segmentation(seg(("s", 0, 10, "s", 0)), genome, 10).df.collect()
    runs = sorted((r["from"], r["to"], r["state"]) for r in Z.state_runs(track(spark, {"s": [1, 1, 2, 2, 2, 1]}, 10), block=2).collect())
    assert runs == [(0, 20, 1), (20, 50, 2), (50, 60, 1)]
    tree = Z.StateTree.from_json({"States": [0, 4], "Children": [{"States": [0, 1]}, {"States": [1, 4], "Children": [{"States": [1, 3]}, {"States": [3, 4]}]}]})
    assert Z.state_groups(tree, 0) == {0: 0, 1: 1, 2: 1, 3: 1} and Z.state_groups(tree, 1) == {0: 0, 1: 1, 2: 1, 3: 2}
    assert [r["state"] for r in Z.tree_levels(tree)] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="whole numbers"):
        Z.state_runs(track(spark, {"s": [0.5]})).collect()


@pytest.mark.parametrize("stretch", [1, 7, 1 << 24])
def test_merge_runs(spark, stretch):
    rng = np.random.default_rng(3)
    rows = []
    for s in "ab":
        at = 0
        for _ in range(80):
            to = at + int(rng.integers(1, 5))
            rows.append((s, at, to, None if rng.random() < 0.1 else int(rng.integers(0, 2))))
            at = to + int(rng.random() < 0.2) - int(rng.random() < 0.1)
    rows = list({r[:3]: r for r in rows}.values())
    want = []
    for s, lo, hi, state in sorted(rows, key=lambda r: r[:3]):
        if want and want[-1][0] == s and want[-1][4] == lo and want[-1][3] == state:
            want[-1][2] = max(want[-1][2], hi)
            want[-1][4] = hi
        else:
            want.append([s, lo, hi, state, hi])
    df = spark.createDataFrame(rows, "seqname string, from int, to int, mark int")
    got = I.merge_runs(df, "mark", stretch)
    assert got.columns == ["seqname", "from", "to", "mark"]
    key = lambda r: (r[0], r[1], r[2], -1 if r[3] is None else r[3])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(w[:4]) for w in want), key=key)
    assert I.merge_runs(df.limit(0), "mark", stretch).count() == 0
