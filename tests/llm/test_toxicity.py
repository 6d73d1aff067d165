"""The toxicity network: gradients by differences, windows, scores by a plain loop, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from trackengine.llm import toxicity
from trackengine.llm.toxicity import WINDOW, Network


def test_gradients_are_differences():
    net, r = Network(1), np.random.default_rng(0)
    for k in net.inner:
        net.inner[k] = net.inner[k].astype(np.float64)
    x, ids = r.standard_normal((7, 2 * toxicity.DIM)) * 0.5, r.integers(0, 7, (4, 9))
    mask = np.arange(9) < np.array([9, 5, 1, 0])[:, None]
    y = np.array([1.0, 0, 1, 0])

    def loss(x):
        out, _ = net.states(x, ids, mask.astype(float))
        logit, _ = net.pooled(out, mask)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    g, dx = net.gradients(x, ids, mask, y)
    for k, p in net.inner.items():
        for _ in range(4):
            at, e = tuple(r.integers(0, s) for s in p.shape), 1e-3
            old = p[at]
            p[at] = old + e
            up = loss(x)
            p[at] = old - e
            down = loss(x)
            p[at] = old
            assert (up - down) / (2 * e) == pytest.approx(float(g[k][at]), abs=2e-6)
    for at in ((0, 0), (3, 20), (6, 31)):
        a, b = x.copy(), x.copy()
        a[at] += 1e-3
        b[at] -= 1e-3
        assert (loss(a) - loss(b)) / 2e-3 == pytest.approx(float(dx[at]), abs=2e-6)


def test_windows_cover_all_words_and_overlap():
    for n in [*range(0, 300), 1000]:
        text, at = toxicity.window_starts(np.array([n]), 64, 48)
        assert (text == 0).all() and at[0] == 0
        covered = {i for a in at for i in range(a, min(a + 64, n))}
        assert covered == set(range(n))
        assert (np.diff(at) <= 48).all() and (n < 64 or at[-1] == n - 64)
    text, at = toxicity.window_starts(np.array([0, 70, 3]), 64, 48)
    assert list(zip(text.tolist(), at.tolist())) == [(0, 0), (1, 0), (1, 6), (2, 0)]


def buffers(texts):
    enc = [t.encode() for t in texts]
    return np.frombuffer(b"".join(enc), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in enc])]).astype(np.int64)


def plain_score(net, text):
    """Word by word and window by window, with the network's numbers."""
    words = ["".join(c for c in w) for w in "".join(c.lower() if c.isascii() else c for c in text).translate({c: 32 for c in range(128) if not chr(c).isalnum()}).split()]
    soft = lambda x: x / (1 + np.abs(x))
    h, p = toxicity.HIDDEN, {k: v.astype(float) for k, v in net.inner.items()}

    def vector(w):
        part = toxicity.Lexicon(*(lambda b: (b, np.array([0]), np.array([len(b)])))(np.frombuffer(w.encode(), np.uint8)))
        return np.concatenate([net.words[part.word[0]] * net.common[part.word[0]], net.grams[part.grams].mean(axis=0)])

    def states(xs, d):
        s, out = np.zeros(h), []
        for x in xs:
            g = (x @ p["wx"] + p["b"])[d * 3 * h : (d + 1) * 3 * h]
            u = s @ p["u"][d]
            z, r = np.split(0.5 + 0.5 * soft(g[: 2 * h] + u[: 2 * h]), 2)
            s = z * s + (1 - z) * soft(g[2 * h :] + r * u[2 * h :])
            out.append(s)
        return out

    best = -np.inf
    for at in toxicity.window_starts(np.array([len(words)]))[1]:
        xs = [vector(w) for w in words[at : at + WINDOW]]
        out = np.array([np.concatenate(s) for s in zip(states(xs, 0), states(xs[::-1], 1)[::-1])]).reshape(-1, 2 * h)
        weight = np.exp(soft(out @ p["a"]) @ p["v"])
        c = (weight[:, None] * out).sum(axis=0) / weight.sum() if len(out) else np.zeros(2 * h)
        best = max(best, float(c @ p["w"] + p["c"][0]))
    return float(net(np.array([best]))[0])


def test_scores_are_those_of_a_plain_loop():
    net, rng = Network(3), random.Random(2)
    net.common = np.random.default_rng(1).random(toxicity.SLOTS) < 0.5
    net.scale = np.array([0.7, -0.3])
    texts = ["", "  ?!", "One", "Été déjà-vu 日本 ñ", " ".join("".join(rng.choices("abcdéñ", k=rng.randint(1, 9))) for _ in range(200)), "same " * 70]
    got = toxicity.score_texts(net, *buffers(texts))
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def test_calibration_minimises_its_cost():
    r = np.random.default_rng(4)
    y = (r.random(400) < 0.5).astype(float)
    logit = 3 * (y - 0.5) + r.standard_normal(400)
    slope, offset = toxicity._calibrated(logit, y, 0.1)
    p = 1 / (1 + np.exp(-(slope * logit + offset)))
    weight = np.where(y == 1, 0.1 / y.sum(), 0.9 / (1 - y).sum()) * len(y)
    assert (weight * p).sum() / weight.sum() == pytest.approx(0.1, abs=0.01)
    apart = toxicity._calibrated(np.array([-9.0] * 50 + [9.0] * 50), np.array([0.0] * 50 + [1.0] * 50), 0.1)
    assert np.isfinite(apart).all() and apart[0] > 0


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of invented words; toxic ones have words with stems of their own, in some places only."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.choice([5, 30, 90, 200]))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["vexqu", "zorbk"]) + rng.choice(["", "a", "lor", "ent", "ik"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(planted, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 5)
    docs, labels = planted
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == 900
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    toxic = [r for r in held if r.doc_id % 5 == 0]
    clean = [r for r in held if r.doc_id % 5]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    rows = [(1, None), (None, "a b"), (2, ""), (2, ""), (3, "bad bad"), (3, "bad bad"), (4, "x" * 100_000), (5, "w " * 20_000), (6, " \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, "n"), (3, 0, "n"), (1, 0, "n"), (2, None, "n"), (None, 1, "n"), (4, 7, "n"), (5, 0, "n")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 6)}) == 1
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    alone = toxicity.toxicity_scores(docs, labels.filter("false")).collect()
    assert {round(r.score, 6) for r in alone} == {0.001}
    assert toxicity.toxicity_scores(docs.filter("false"), labels).count() == 0
    only = toxicity.toxicity_scores(docs, labels.filter("toxic = 0")).collect()
    assert {round(r.score, 6) for r in only} == {0.001}
