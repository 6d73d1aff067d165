"""Densities against plain formulas, models that degenerate, sizes of stored tracks, alignment of several tracks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackengine.config import SessionConfig
from trackengine.functions import distributions as D
from trackengine.operators import estimate as E
from trackengine.operators import peaks as P
from trackengine.operators import track as T
from trackengine.operators import windows as W
from trackengine.plans import commands
from trackengine.sources import bed


def node(name, p, *parts):
    return D.Distribution(f"scalar:{name} distribution" if "pdf" not in name else f"scalar:{name}", p, parts)


def test_densities_equal_plain_formulas():
    x = np.array([0.0, 1.0, 2.0, 0.5, -1.0, 7.0, math.nan])
    inf = math.inf
    fact = lambda v: math.lgamma(v + 1)
    plain = {
        node("delta", (2.0,)): lambda v: 0.0 if v == 2 else -inf,
        node("poisson", (1.5,)): lambda v: v * math.log(1.5) - 1.5 - fact(v) if v >= 0 and v == int(v) else -inf,
        node("poisson", (0.0,)): lambda v: 0.0 if v == 0 else -inf,
        node("geometric", (0.3,)): lambda v: math.log(0.3) + v * math.log(0.7) if v >= 0 and v == int(v) else -inf,
        node("geometric", (1.0,)): lambda v: 0.0 if v == 0 else -inf,
        node("exponential", (2.0,)): lambda v: math.log(2) - 2 * v if v >= 0 else -inf,
        node("gamma", (2.0, 3.0)): lambda v: 2 * math.log(3) + math.log(v) - 3 * v if v > 0 else -inf,
        node("beta", (2.0, 2.0)): lambda v: math.log(6 * v * (1 - v)) if 0 < v < 1 else -inf,
        node("normal", (1.0, 2.0)): lambda v: -((v - 1) ** 2) / 8 - math.log(2) - 0.5 * math.log(2 * math.pi),
        node("categorical", (0.2, 0.8)): lambda v: math.log((0.2, 0.8)[int(v) - 1]) if v in (1, 2) else -inf,
        node("negative binomial", (3.0, 0.4)): lambda v: math.log(math.comb(round(v) + 2, round(v))) + 3 * math.log(0.6) + round(v) * math.log(0.4) if round(v) >= 0 else -inf,
        node("pdf translation", (1.0,), node("exponential", (2.0,))): lambda v: math.log(2) - 2 * (v + 1) if v + 1 >= 0 else -inf,
        node("pdf log transform", (1.0,), node("exponential", (2.0,))): lambda v: math.log(2) - 3 * math.log(v + 1) if v >= 0 else -inf,
    }
    for d, f in plain.items():
        got = D.log_density(d)(x)
        assert np.isnan(got[-1]) and got[:-1] == pytest.approx([f(v) for v in x[:-1].tolist()]), d
    steps = D.Distribution("scalar:nonparametric distribution", {"X": [0.0, 1.0, 3.0], "Y": [-1.0, -2.0, -3.0]})
    assert D.log_density(steps)(np.array([-0.1, 0, 0.9, 1, 4.9, 5])).tolist() == [-inf, -1, -1, -2, -3, -inf]
    assert D.log_density(D.Distribution("scalar:nonparametric distribution", {"X": [2.0], "Y": [0.0]}))(np.array([2.5, 3.0])).tolist() == [0, -inf]
    pair = D.negative_binomial_r_log_density(D.Distribution("x", (0.4, 0.0)))([(2.0, 3.0)])
    assert pair[0] == pytest.approx(math.log(math.comb(4, 2)) + 3 * math.log(0.6) + 2 * math.log(0.4))


def test_a_rate_that_falls_to_zero_is_a_model():
    fit = E.fit_mixture([0.0, 5.0, 9.0], [100, 1, 1], D.mixture([0.5, 0.5], [D.poisson(0.01), D.geometric(0.1)]), max_steps=500)
    assert math.isfinite(fit.log_likelihood) and sum(fit.model.parameters) == pytest.approx(1)
    with pytest.raises(ValueError):
        E.fit_mixture([0.0, 1.0], [1, 1], D.mixture([0.5, 0.5], [D.poisson(math.nan), D.geometric(0.1)]))


def test_posterior_of_a_saved_density(spark):
    steps = D.Distribution("scalar:nonparametric distribution", {"X": [0.0, 1.0], "Y": [math.log(0.75), math.log(0.25)]})
    df = spark.createDataFrame([(0.5,), (1.5,), (math.nan,), (None,), (9.0,)], "value double")
    got = [r.log_posterior for r in E.posterior(df, D.mixture([0.5, 0.5], [steps, node("exponential", (1.0,))]), [0]).collect()]
    for g, (v, y) in zip(got, ((0.5, 0.75), (1.5, 0.25))):
        assert g == pytest.approx(math.log(y / (y + math.exp(-v))))
    assert math.isnan(got[2]) and math.isnan(got[3]) and got[4] == -math.inf


def tracks(spark, *sizes):
    out = []
    for n in sizes:
        df = spark.createDataFrame([("a", i, float(i)) for i in range(n)], "seqname string, bin int, value double")
        out.append(T.Track(df, spark.createDataFrame([("a", n)], "seqname string, nbins int")))
    return out


def test_tracks_of_different_lengths_are_an_error(spark):
    two = tracks(spark, 5, 3)
    for f in (lambda: W.classify_multi(two, 3, lambda m: F.lit(0.0)), lambda: P.joint_peaks(two, [0, 0]), lambda: W.hopping_multi(two, 2), lambda: W.classify_sequences_multi(two, lambda m: m[0]), lambda: T.region_matrices(two, two[0].df)):
        with pytest.raises(ValueError, match="differ"):
            f()
    assert P.joint_peaks(tracks(spark, 4, 4), [0, 0], -1).count() == 1


def test_stored_tracks_keep_their_sizes(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(6)], "seqname string, bin int, value double")
    genome = spark.createDataFrame([("a", 8), ("b", 2)], "seqname string, nbins int")
    bed.write_track(df, str(tmp_path / "t"), genome, 10)
    t = commands.read_track(SessionConfig(), str(tmp_path / "t"))
    assert t.bin_size == 10 and sorted(map(tuple, t.genome.collect())) == [("a", 8), ("b", 2)] and t.df.count() == 6
    wide, near = (commands.read_track(SessionConfig(bin_size=20, bin_overlap=k), str(tmp_path / "t")) for k in (0, 1))
    assert wide.bin_size == 20 and [r.value for r in wide.df.filter("seqname = 'a'").orderBy("bin").collect()] == [0.5, 2.5, 4.5, 0.0]
    assert [r.value for r in near.df.filter("seqname = 'a'").orderBy("bin").collect()] == [1.5, 2.5, 3.5, 4.5]
    with pytest.raises(ValueError):
        commands.read_track(SessionConfig(bin_size=15), str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        commands.read_tracks(SessionConfig(), [str(tmp_path / "t"), str(tmp_path / "none")])


def test_spine_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "SPINE_BLOCK", 4)
    genome = spark.createDataFrame([("a", 9), ("b", 4), ("c", 0), ("d", 1)], "seqname string, nbins int")
    assert sorted(map(tuple, T.spine(genome).collect())) == [("a", i) for i in range(9)] + [("b", i) for i in range(4)] + [("d", 0)]


def test_gzip_under_another_name(spark, tmp_path):
    import gzip

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.bed").write_bytes(gzip.compress(b"a\t0\t5\n"))
    with pytest.raises(ValueError, match="gz"):
        bed.read_bed3(spark, str(tmp_path / "x"))
    (tmp_path / "x" / "a.bed").rename(tmp_path / "x" / "a.bed.gz")
    assert bed.read_bed3(spark, str(tmp_path / "x")).count() == 1


def test_histogram_text_is_written_in_order(spark, tmp_path):
    from trackengine.operators import segmentation as Z

    hist = spark.createDataFrame([(0, 1, 2.5, 3), (0, 0, 1.0, 7)], "track int, state int, value double, count long")
    bed.write_histogram_text(Z.histogram_text(hist), Z.HISTOGRAM_HEADER, str(tmp_path / "h"))
    lines = [x for f in sorted((tmp_path / "h").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0].split() == ["track", "state", "value", "count"] and [x.split() for x in lines[1:]] == [["0", "0", "1", "7"], ["0", "1", "2.5", "3"]]


def test_matrices_of_another_size(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "m array<array<double>>")
    assert W.classify_matrices(df, lambda m: F.get(F.get(m, F.lit(0)), F.lit(1)), 2, 2, transposed=True).first().score == 3
    with pytest.raises(Exception, match="2 by 3"):
        W.classify_matrices(df, lambda m: F.get(F.get(m, F.lit(0)), F.lit(1)), 2, 3).collect()


def test_coordinates_are_fitted_where_their_histograms_are(spark):
    rng = np.random.default_rng(5)
    v = np.stack([rng.poisson(2.0, 400), rng.poisson(9.0, 400)], axis=1).astype(float)
    df = spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>")
    start = D.mixture([0.5, 0.5], [D.poisson(1.0), D.geometric(0.2)])
    for i, got in enumerate(E.fit_coordinates(df, start)):
        x, n = np.unique(v[:, i], return_counts=True)
        want = E.fit_mixture(x, n, start)
        assert got.model == want.model and got.steps == want.steps
        assert got.log_likelihood == pytest.approx(want.log_likelihood)
    few = E.fit_coordinates(df, start, max_bins=4)
    for i, got in enumerate(few):
        step = (v[:, i].max() - v[:, i].min()) / 4
        x, n = np.unique(np.floor(v[:, i] / step) * step, return_counts=True)
        assert got.model == E.fit_mixture(x, n, start).model


def test_density_of_too_many_bins_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(E, "MAX_BINS", 3)
    dens = E.density(spark.createDataFrame([(float(i), 1) for i in range(6)], "x double, n long"))
    with pytest.raises(ValueError):
        E.step_log_pdf(spark.createDataFrame([(1.0,)], "value double"), dens)


def test_values_that_no_component_has_take_no_part():
    start = D.mixture([0.5, 0.5], [D.poisson(1.0), D.geometric(0.2)])
    got, want = E.fit_mixture([0, 0.5, 1, 4], [5, 9, 7, 2], start), E.fit_mixture([0, 1, 4], [5, 7, 2], start, eps=1e-8 * 23 / 14)
    assert got.log_likelihood == -math.inf
    assert np.allclose(got.model.parameters, want.model.parameters, atol=1e-6)
    with pytest.raises(ValueError):
        E.fit_mixture([0.5], [3], start)
