"""Block scans, state paths, estimates of every kind, joint models, product densities, lookups and grids against plain code."""

from __future__ import annotations

import json
import math
import random
from itertools import product as every

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackengine.functions import distributions as D
from trackengine.functions import likelihood as L
from trackengine.operators import estimate as E
from trackengine.operators import hmm as H
from trackengine.operators import scans as S
from trackengine.operators import track as T
from trackengine.operators import windows as W


def track_of(spark, sequences, bin_size=1):
    rows = [(s, i, float(v)) for s, values in sequences.items() for i, v in enumerate(values)]
    genome = spark.createDataFrame([(s, len(v)) for s, v in sequences.items()], "seqname string, nbins int")
    return T.Track(spark.createDataFrame(rows, "seqname string, bin int, value double").repartition(3), genome, bin_size)


def by_sequence(df, column="value"):
    out = {}
    for r in df.orderBy("seqname", "bin").collect():
        out.setdefault(r.seqname, []).append(r[column])
    return out


SEQUENCES = {"a": [random.Random(1).randint(0, 9) for _ in range(57)], "b": [3.0], "c": [random.Random(2).randint(0, 9) for _ in range(20)]}


@pytest.mark.parametrize("block", [1, 7, 20, 1000])
def test_scans_equal_whole_sequences(spark, block):
    track = track_of(spark, SEQUENCES)
    for f, plain in ((np.add, np.cumsum), (np.maximum, np.maximum.accumulate)):
        assert by_sequence(W.classify_sequences(track, S.running(f), block=block).df) == {s: plain(np.array(v, float)).tolist() for s, v in SEQUENCES.items()}
        back = W.classify_sequences(track, S.running(f, reverse=True), block=block)
        assert by_sequence(back.df) == {s: plain(np.array(v, float)[::-1])[::-1].tolist() for s, v in SEQUENCES.items()}
    doubled = W.classify_sequences(track, S.running(np.add), transform=lambda x: 2 * x, block=block)
    assert by_sequence(doubled.df) == {s: np.cumsum(2.0 * np.array(v)).tolist() for s, v in SEQUENCES.items()}
    for transposed in (False, True):
        both = W.classify_sequences_multi([track, track.map(lambda v: v * v)], S.running(np.add, (lambda m: m[:, 0] + m[:, 1]) if transposed else (lambda m: m[0] + m[1])), transposed, block)
        assert by_sequence(both.df) == {s: np.cumsum([float(x + x * x) for x in v]).tolist() for s, v in SEQUENCES.items()}


def test_scan_must_keep_the_length(spark):
    bad = S.BlockScan(lambda x: np.zeros(1), S.two_sided(np.add), lambda x, before, after: x[1:])
    with pytest.raises(Exception, match="keep the length"):
        W.classify_sequences(track_of(spark, SEQUENCES), bad).df.collect()


def model(k, seed):
    r = np.random.default_rng(seed)
    tr = r.dirichlet(np.ones(k), k)
    if k == 3:
        tr[0] = [0.5, 0.5, 0]
    return H.Hmm(r.dirichlet(np.ones(k)), tr, tuple(D.poisson(float(x)) for x in r.uniform(0.5, 8, k)), tuple("xyz"[:k]))


def best_path(h, x):
    """Step by step, with exact whole numbers; the smaller state of equal ones, from the end."""
    tr, pi = H._units(h.tr).tolist(), H._units(h.pi).tolist()
    e = H._emission_units(h, np.array(x, float)).tolist()
    k, score, back = len(pi), [p + v for p, v in zip(pi, e[0])], []
    for row in e[1:]:
        reach = [[score[i] + tr[i][j] for i in range(k)] for j in range(k)]
        back.append([c.index(max(c)) for c in reach])
        score = [max(c) + v for c, v in zip(reach, row)]
    path = [score.index(max(score))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("k,block", [(2, 5), (3, 1), (3, 11), (2, 1000)])
def test_state_paths(spark, k, block):
    h, rng = model(k, k + block), random.Random(block)
    data = {"a": [rng.choice([0, 1, 3, 9, math.nan]) for _ in range(60)], "b": [2], "c": [0.5, 1, 1, 1] * 6, "d": [4] * 33}
    got = by_sequence(H.paths(track_of(spark, data), h, block), "state")
    assert got == {s: best_path(h, v) for s, v in data.items()}


def test_equal_paths_take_the_smaller_state(spark):
    even = H.Hmm(np.array([0.5, 0.5]), np.full((2, 2), 0.5), (D.poisson(2.0), D.poisson(2.0)))
    assert by_sequence(H.paths(track_of(spark, {"a": [1] * 9}), even, 4), "state") == {"a": [0] * 9}


def test_short_paths_are_the_best_of_all(spark):
    h, x = model(2, 9), [0, 7, 1, 1, 6, 0, 3]
    tr, pi, e = H._units(h.tr), H._units(h.pi), H._emission_units(h, np.array(x, float))
    score = lambda p: pi[p[0]] + sum(tr[a, b] for a, b in zip(p, p[1:])) + sum(e[i, s] for i, s in enumerate(p))
    got = by_sequence(H.paths(track_of(spark, {"a": x}), h, 3), "state")["a"]
    assert score(got) == max(score(p) for p in every(range(2), repeat=len(x)))


def plain_posteriors(h, x):
    e = np.exp(H._emit(h, np.array(x, float)))
    a, b = [h.pi * e[0]], [np.ones(len(h.pi))]
    for row in e[1:]:
        a.append(a[-1] @ h.tr * row)
    for row in e[:0:-1]:
        b.append(h.tr @ (row * b[-1]))
    p = np.array(a) * np.array(b[::-1])
    moves = sum((np.outer(a[i], e[i + 1] * b[::-1][i + 1]) * h.tr) / p[i].sum() for i in range(len(x) - 1))
    return p / p.sum(axis=1, keepdims=True), moves


@pytest.mark.parametrize("block", [1, 6, 1000])
def test_posteriors_and_training_by_lanes(spark, block):
    rng = random.Random(5)
    h, x = model(3, 4), [float(rng.randint(0, 9)) if i % 11 else math.nan for i in range(40)]
    post, moves = plain_posteriors(h, x)
    got = by_sequence(H.posteriors(track_of(spark, {"a": x}), h, block), "p")["a"]
    assert np.array(got) == pytest.approx(post, abs=1e-9)
    new = H.train_step(track_of(spark, {"a": x}), h, block)
    assert new.tr == pytest.approx(moves / moves.sum(axis=1, keepdims=True), abs=1e-8) and new.pi == pytest.approx(post[0], abs=1e-9)
    seen = ~np.isnan(x)
    for i, d in enumerate(new.emissions):
        assert d.parameters[0] == pytest.approx((post[seen, i] * np.array(x)[seen]).sum() / post[seen, i].sum())
    wide = H.Hmm(h.pi, h.tr, tuple(D.normal(m, 2.0) for m in (0.0, 4.0, 8.0)))
    post, _ = plain_posteriors(wide, x)
    for i, d in enumerate(H.train_step(track_of(spark, {"a": x}), wide, block).emissions):
        w, v = post[seen, i], np.array(x)[seen]
        m = (w * v).sum() / w.sum()
        assert d.parameters == pytest.approx((m, math.sqrt((w * (v - m) ** 2).sum() / w.sum())))


def test_models_from_documents(spark, tmp_path):
    h = model(3, 1)
    path = tmp_path / "hmm.json"
    path.write_text("# states\n" + json.dumps(h.to_json()))
    from trackengine.config import parse_json

    again = H.Hmm.from_json(parse_json(path.read_text()))
    assert again.names == h.names and again.emissions == h.emissions and (again.tr == h.tr).all() and (again.pi == h.pi).all()
    p = H.as_mixture(again).tr
    assert p[0] == pytest.approx(p[0] @ h.tr)


def test_moves_are_counted_across_blocks(spark):
    x = [0, 1, 1, math.nan, 2, 2, 0, 7, 1, 0]
    track = track_of(spark, {"a": x, "b": [1, 0]})
    got = {(r.i, r.j): r.n for r in H.moves(track, 3).collect()}
    plain = {}
    for v in (x, [1, 0]):
        for a, b in zip(v, v[1:]):
            if a in (0, 1, 2) and b in (0, 1, 2):
                plain[a, b] = plain.get((a, b), 0) + 1
    assert got == plain


KINDS = {
    "gamma distribution": ((1.0, 1.0), lambda r: r.gamma(2.5, 1 / 3, 3000)), "beta distribution": ((1.0, 1.0), lambda r: r.beta(0.7, 3, 3000)), "normal distribution": ((0.0, 1.0), lambda r: r.normal(3, 2, 3000)),
    "exponential distribution": ((1.0,), lambda r: r.exponential(0.25, 3000)), "negative binomial distribution": ((1.0, 0.5), lambda r: r.negative_binomial(3, 0.4, 3000)),
    "poisson distribution": ((1.0,), lambda r: r.poisson(4, 3000)), "geometric distribution": ((0.5,), lambda r: r.geometric(0.3, 3000) - 1),
}


@pytest.mark.parametrize("kind", KINDS)
def test_estimates_have_the_greatest_likelihood(kind):
    start, draw = KINDS[kind]
    r = np.random.default_rng(3)
    x, n = np.unique(draw(r), return_counts=True)
    w = n * r.uniform(0.5, 1.5, len(n))
    total = lambda p: float((w * D.log_density(D.Distribution("scalar:" + kind, tuple(p)))(x)).sum())
    found = L.estimated(D.Distribution("scalar:" + kind, start), x, w).parameters
    for i in range(len(found)):
        for by in (0.99, 0.999, 1.001, 1.01):
            other = list(found)
            other[i] *= by
            assert total(other) <= total(found)


def test_estimates_of_parts_and_errors():
    x, w = np.array([1.0, 2.0, 3.0]), np.array([1.0, 1.0, 2.0])
    shifted = L.estimated(D.translation(D.poisson(1.0), -1.0), x, w)
    assert shifted.parts[0].parameters[0] == pytest.approx(1.25)
    logs = L.estimated(D.Distribution("scalar:pdf log transform", (1.0,), (D.normal(0.0, 1.0),)), x, w)
    assert logs.parts[0].parameters[0] == pytest.approx((math.log(2) + math.log(3) + 2 * math.log(4)) / 4)
    assert L.estimated(D.Distribution("scalar:categorical distribution", (0.5, 0.3, 0.2)), x, w).parameters == pytest.approx((0.25, 0.25, 0.5))
    assert L.estimated(D.delta(2.0), x, w) == D.delta(2.0) and L.estimated(D.poisson(9.0), x, 0 * w) == D.poisson(9.0)
    both = L.estimated(D.product([D.poisson(1.0), D.normal(0.0, 1.0)]), np.array([[1.0, 5.0], [3.0, 7.0]]), np.ones(2))
    assert both.parts[0].parameters == (2.0,) and both.parts[1].parameters == (6.0, 1.0)
    with pytest.raises(ValueError, match="no estimate"):
        L.estimated(D.Distribution("scalar:negative binomial r distribution", (0.5, 0.0)), x, w)
    equal = L.estimated(D.gamma(1.0, 1.0), np.array([2.0]), np.array([5.0])).parameters
    assert equal[0] / equal[1] == pytest.approx(2.0)
    assert D.unknown_names(D.mixture([1.0], [D.translation(D.Distribution("scalar:no such", ()), 1.0)])) == {"scalar:no such"}
    assert D.unknown_names(D.mixture([1.0], [D.Distribution("scalar:negative binomial r distribution", (0.5, 0.0))]))


def test_digamma_and_trigamma():
    for x in (1e-3, 0.3, 1.0, 4.5, 30.0):
        e = 1e-4 * x
        assert float(L.digamma(x)) == pytest.approx((math.lgamma(x + e) - math.lgamma(x - e)) / (2 * e), rel=1e-6)
        assert float(L.trigamma(x)) == pytest.approx(float(L.digamma(x + e) - L.digamma(x - e)) / (2 * e), rel=1e-6)


def test_mixtures_of_other_kinds_are_learned():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, 4000), r.normal(8, 2, 2000)]).round(2)
    v, n = np.unique(x, return_counts=True)
    fit = E.fit_mixture(v, n, D.mixture([0.5, 0.5], [D.normal(1.0, 3.0), D.normal(5.0, 3.0)]))
    assert fit.model.parts[0].parameters == pytest.approx((0, 1), abs=0.1) and fit.model.parts[1].parameters == pytest.approx((8, 2), abs=0.2)
    nested = D.mixture([0.5, 0.5], [D.delta(0.0), D.mixture([0.5, 0.5], [D.poisson(1.0), D.poisson(6.0)])])
    v, n = np.unique(np.concatenate([np.zeros(500), r.poisson(2, 2000), r.poisson(9, 2000)]), return_counts=True)
    assert E.fit_mixture(v, n, nested, 1e-6).model.parts[1].parts[0].parameters[0] == pytest.approx(2, abs=0.4)
    steps = D.Distribution("scalar:nonparametric distribution", {"X": [0.0, 1.0, 2.0, 3.0], "Y": [math.log(0.25)] * 4})
    fit = E.fit_mixture([0.0, 1.0, 2.0, 3.0, 4.0, 5.0], [900, 10, 20, 30, 20, 10], D.mixture([0.5, 0.5], [D.delta(0.0), steps]), 1e-6)
    found = fit.model.parts[1].parameters
    assert len(found["X"]) == 4 and sum(fit.model.parameters) == pytest.approx(1) and fit.model.parts[0] == D.delta(0.0)


def test_seeded_starts_find_what_a_bad_start_does_not():
    r = np.random.default_rng(1)
    v, n = np.unique(np.concatenate([r.poisson(2, 3000), r.poisson(40, 300)]), return_counts=True)
    bad = D.mixture([0.5, 0.5], [D.poisson(1000.0), D.poisson(1001.0)])
    alone, best = E.fit_mixture(v, n, bad), E.best_fit(v, n, bad, tries=8)
    assert best.log_likelihood > alone.log_likelihood + 0.5 or best.log_likelihood >= alone.log_likelihood
    assert [p.parameters[0] for p in best.model.parts] == pytest.approx([2, 40], rel=0.1)
    assert E.best_fit(v, n, bad, tries=8) == best


@pytest.mark.parametrize("few", [0, 1 << 21])
def test_joint_models(spark, monkeypatch, few):
    monkeypatch.setattr(E, "FEW", few)
    r = np.random.default_rng(2)
    x = np.concatenate([r.poisson([1, 6, 2], (400, 3)), r.poisson([7, 1, 9], (200, 3))]).astype(float)
    rows = [(v.tolist(),) for v in x] + [([1.0, math.nan, 2.0],), (None,), ([1.0, None, 2.0],)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(3)
    start = D.Distribution("vector:mixture distribution", (0.5, 0.5), (D.product([D.poisson(2.0)] * 2 + [D.normal(3.0, 2.0)]), D.product([D.poisson(4.0)] * 2 + [D.normal(6.0, 2.0)])))
    fit = E.fit_joint(df, start, eps=1e-5)
    values, n = np.unique(x, axis=0, return_counts=True)
    plain = E.fit_mixture(values, n, start, eps=1e-5)
    assert fit.steps == plain.steps and fit.log_likelihood == pytest.approx(plain.log_likelihood)
    assert fit.model.parameters == pytest.approx(plain.model.parameters)
    for a, b in zip(fit.model.parts, plain.model.parts):
        assert [c.parameters for c in a.parts] == [pytest.approx(c.parameters) for c in b.parts]
    assert sorted(fit.model.parameters) == pytest.approx([1 / 3, 2 / 3], abs=0.03)
    with pytest.raises(Exception, match="is of 3 numbers"):
        E.fit_joint(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), start)
    with pytest.raises(ValueError, match="no vectors"):
        E.fit_joint(df.filter("false"), start)


def test_product_densities(spark):
    two = D.product([D.poisson(2.0), D.normal(1.0, 3.0)])
    whole = D.rows([two, D.product([D.delta(0.0), D.exponential(1.0)])])
    f, g = D.log_density(two), lambda a, b: math.log(2.0) * a - 2.0 - math.lgamma(a + 1) - ((b - 1) / 3) ** 2 / 2 - math.log(3) - 0.5 * math.log(2 * math.pi)
    assert f(np.array([[1.0, 2.0], [3.0, -1.0]])) == pytest.approx([g(1, 2), g(3, -1)])
    df = spark.createDataFrame([(0, [[1.0, 2.0], [0.0, 0.5]]), (1, [[1.0, 2.0], [1.0, 0.5]]), (2, None), (3, [[math.nan, 2.0], [0.0, 1.0]])], "i int, m array<array<double>>")
    got = [r.log_pdf for r in E.vector_log_density(df, whole, "m").orderBy("i").collect()]
    assert got[0] == pytest.approx(g(1, 2) - 0.5) and got[1] == -math.inf and math.isnan(got[2]) and math.isnan(got[3])
    flat = spark.createDataFrame([(0, [1.0, 2.0])], "i int, v array<float>")
    assert E.vector_log_density(flat, two).first().log_pdf == pytest.approx(g(1, 2))
    with pytest.raises(Exception, match="is of 2 numbers"):
        E.vector_log_density(flat.select(F.array(F.lit(1.0)).alias("v")), two).collect()
    with pytest.raises(Exception, match="has not 2 rows"):
        E.vector_log_density(spark.createDataFrame([([[1.0, 2.0, 0.0, 0.5]],)], "m array<array<double>>"), whole, "m").collect()
    assert D.Distribution.from_json(whole.to_json()) == whole and D.unknown_names(whole) == set()


def test_densities_at_their_ends():
    x = np.array([0.0, 1.0])
    assert D.log_density(D.gamma(1.0, 3.0))(x)[0] == pytest.approx(math.log(3)) and D.log_density(D.gamma(0.5, 1.0))(x)[0] == math.inf and D.log_density(D.gamma(2.0, 1.0))(x)[0] == -math.inf
    beta = lambda a, b: D.log_density(D.Distribution("scalar:beta distribution", (a, b)))(x)
    assert beta(1.0, 1.0) == pytest.approx([0, 0]) and beta(1.0, 3.0)[0] == pytest.approx(math.log(3)) and beta(1.0, 3.0)[1] == -math.inf


def test_summaries_of_all_kinds():
    s = lambda name, *p: D.Distribution("scalar:" + name, p)
    expected = [
        (s("beta distribution", 1.0, 3.0), 0.25), (D.poisson(2.0), 2.0), (s("categorical distribution", 0.3, 0.7), 0.3), (D.exponential(4.0), 4.0), (D.gamma(3.0, 2.0), 1.5), (D.geometric(0.25), 3.0),
        (s("negative binomial distribution", 5.0, 0.5), 5.0), (s("negative binomial r distribution", 0.4, 0.0), 0.4), (D.normal(1.5, 2.0), 1.5), (D.translation(D.poisson(3.0), 1.0), 3.0),
        (D.Distribution("scalar:pdf log transform", (1.0,), (D.normal(2.0, 1.0),)), 2.0), (D.delta(3.0), None), (D.product([D.poisson(1.0), D.normal(2.0, 1.0)]), [1.0, 2.0]), (D.rows([D.product([D.poisson(1.0)])]), [[1.0]]),
    ]
    for d, m in expected:
        assert D.mean(d) == m


def test_lookup_by_search(spark):
    dens = spark.createDataFrame([(0.0, 1.0, -1.0), (3.0, 2.0, -3.0), (1.0, 2.0, -2.0)], "x double, delta double, log_density double")
    rows = [-0.1, 0.0, 0.99, 1.0, 2.9, 3.0, 4.99, 5.0, math.nan, None, math.inf]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, value double")
    inf = math.inf
    assert [r.log_pdf for r in E.step_log_pdf(df, dens).orderBy("i").collect()] == [-inf, -1, -1, -2, -2, -3, -3, -inf, None, None, -inf]
    assert {r.log_pdf for r in E.step_log_pdf(df, dens.filter("false")).collect()} == {-inf, None}


def test_grid_with_infinite_values(spark):
    hist = spark.createDataFrame([(i / 10, 1) for i in range(5000)] + [(math.inf, 4), (-math.inf, 2)], "x double, n long")
    got = {r.x: r.n for r in E.gridded(hist, 100).collect()}
    assert len(got) in (102, 103) and got[math.inf] == 4 and got[-math.inf] == 2 and sum(got.values()) == 5006


def test_weights_of_any_size(spark):
    r = random.Random(4)
    rows = [(float(r.randint(0, 3)), r.choice([-math.inf, r.uniform(-5000, 5000), r.uniform(-2, 2)])) for _ in range(300)] + [(9.0, -math.inf), (math.nan, 1.0)]
    got = {x.x: x.log_n for x in E.weighted_histogram(spark.createDataFrame(rows, "v double, w double"), "v", "w").collect()}
    for value in (0.0, 1.0, 2.0, 3.0):
        assert got[value] == pytest.approx(np.logaddexp.reduce([w for v, w in rows if v == value]))
    assert got[9.0] == -math.inf and set(got) == {0.0, 1.0, 2.0, 3.0, 9.0}


def test_a_sequence_that_a_track_lacks_is_an_error(spark):
    a, b = track_of(spark, SEQUENCES), track_of(spark, {k: v for k, v in SEQUENCES.items() if k != "c"})
    with pytest.raises(ValueError, match="differ"):
        W.hopping_multi([a, b], 3)




def test_declared_sizes_of_transforms(spark):
    track = track_of(spark, SEQUENCES)
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.get(w, i) + F.get(w, i + 1))
    first = lambda w: F.get(w, F.lit(0))
    assert by_sequence(W.classify(track, 3, first, pairs, size=2).df)["a"][1] == SEQUENCES["a"][0] + SEQUENCES["a"][1]
    with pytest.raises(Exception, match="doesn't give 3 values"):
        W.classify(track, 3, first, pairs, size=3).df.collect()
