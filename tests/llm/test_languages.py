"""Language mixtures against plain loops: EM, the choice of the set, many languages."""

import math
import zlib
from collections import Counter

import numpy as np

from trackengine.llm import langid

from .test_others import docs_of


def plain_em(counts, model, allowed, steps=3000):
    share = {i: 1 / len(allowed) for i in allowed}
    n = sum(counts.values())
    for _ in range(steps):
        new = dict.fromkeys(allowed, 0.0)
        for f, c in counts.items():
            mixed = sum(share[i] * model[i][f] for i in allowed)
            for i in allowed:
                new[i] += c * share[i] * model[i][f] / mixed / n
        share = new
    return share, sum(c * math.log(sum(share[i] * model[i][f] for i in allowed)) for f, c in counts.items())


def plain_choice(counts, model, penalty, steps=3000):
    k, cost = len(model), penalty * math.log(sum(counts.values()) + 1)
    singles = [sum(c * math.log(model[i][f]) for f, c in counts.items()) for i in range(k)]
    best, share = max(singles) - cost, {singles.index(max(singles)): 1.0}
    full, top = plain_em(counts, model, list(range(k)), steps)
    order = sorted(range(k), key=lambda i: -full[i])
    for size in range(2, k + 1):
        if top - size * cost <= best:
            break
        part, fit = plain_em(counts, model, order[:size], steps)
        if fit - size * cost > best:
            best, share = fit - size * cost, part
    return [share.get(i, 0.0) for i in range(k)]


def test_mixtures_equal_plain_loops():
    rng = np.random.default_rng(7)
    model = rng.dirichlet(np.full(40, 0.4), 4) + 1e-4
    model /= model.sum(axis=1, keepdims=True)
    features, counts = [], []
    for true in ([1, 0, 0, 0], [0.5, 0.5, 0, 0], [0.3, 0.3, 0.4, 0], [0.9, 0.1, 0, 0], [0.25] * 4, [0, 0, 0, 1]) * 3:
        drawn = np.bincount(rng.choice(40, int(rng.integers(5, 600)), p=np.array(true) @ model), minlength=40)
        features.append(np.flatnonzero(drawn))
        counts.append(drawn[features[-1]])
    got = langid._mixtures(features, counts, model, 0.5)
    want = np.array([plain_choice(dict(zip(f.tolist(), c.tolist())), model.tolist(), 0.5) for f, c in zip(features, counts)])
    assert ((got > 0) == (want > 0)).all() and (got > 0).sum(axis=1).max() > 1
    assert np.abs(got - want).max() < 0.01


def test_giving_up_loses_nothing():
    """A document is given up only where its greatest likelihood isn't above what it needs."""
    rng = np.random.default_rng(8)
    p = rng.random((300, 3)) + 0.01
    weight, sizes = rng.integers(1, 9, 300).astype(float), np.full(30, 10)
    _, free = langid._proportions(weight, p, sizes, np.ones((30, 3)), steps=400, tol=1e-9)
    need = free + rng.normal(0, 0.5, 30)
    _, bound = langid._proportions(weight, p, sizes, np.ones((30, 3)), need, steps=400, tol=1e-9)
    assert (free[np.isneginf(bound)] <= need[np.isneginf(bound)] + 1e-6).all() and np.isneginf(bound).any() and np.isfinite(bound).any()


def test_more_languages_than_one_task_holds(spark):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 9)) for _ in range(320)]
    rows = [(i, f"{w} {w} {w}", f"l{i:03d}") for i, w in enumerate(words)]
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, rows)).collect()}
    learned = [i for i in got if not got[i].held_out]
    assert len(got) == 320 and len(learned) > 250 and all(got[i].lang_pred == f"l{i:03d}" for i in learned)


def plain_trigrams(text):
    """Trigrams of lower-case letters, all else one space between and around words; hashed one by one."""
    low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    words = " ".join(low.split(" ")).split()
    line = " " + " ".join(words) + " "
    out = []
    for i in range(len(line) - 2 if words else 0):
        h = ord(line[i]) << 42 | ord(line[i + 1]) << 21 | ord(line[i + 2])
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * times % 2**64
        out.append((h ^ h >> 31) % langid.FEATURES)
    return out


ODD = ["", None, "123 45!", "a", "ÀÉ  ßtraße", "İstanbul-x9y", "日本語 テキスト", "one\ttwo\n\nthree", "ok퟿", "x" * 5000]


def test_features_equal_plain_trigrams():
    for text in ODD:
        assert langid.trigram_features(text).tolist() == plain_trigrams(text)


def test_query_equals_plain_model(spark):
    """op7 as a whole: fold, counts, smoothed model, EM, choice of the set, prediction, all by plain loops."""
    rng = np.random.default_rng(11)
    tongues = {"xx": "alba mora tiru sanel", "yy": "krog zwist hunf drapt", "zz": "mora hunf oolu ieea"}
    rows = []
    for i in range(90):
        lang = ["xx", "yy", "zz"][i % 3]
        words = rng.choice(tongues[lang].split(), int(rng.integers(1, 30))).tolist()
        if i % 7 == 0:
            words += rng.choice(tongues["yy"].split(), 9).tolist()
        rows.append((i, " ".join(words), None if i % 11 == 0 else lang))
    rows += [(100 + i, t, "xx") for i, t in enumerate(ODD)] + [(7, rows[7][1], "yy"), (None, "krog zwist", "yy"), (200, "alba", "qq"), (201, "", "nn")]

    def held(key):
        return zlib.crc32(b"" if key is None else str(key).encode()) % 5 == 0

    counts = {}
    for key, text, lang in rows:
        if lang is not None and not held(key) and plain_trigrams(text):
            counts.setdefault(lang, Counter()).update(plain_trigrams(text))
    names = sorted(counts)
    sums = {x: sum(counts[x].values()) for x in names}
    model = [{f: (counts[x][f] + 0.5) / (sums[x] + 0.5 * langid.FEATURES) for f in range(langid.FEATURES)} for x in names]
    want = []
    for key, text, _ in rows:
        found = Counter(plain_trigrams(text))
        share = plain_choice(found, model, 0.5, steps=300) if found else None
        want.append((key, held(key), names[share.index(max(share))] if found else "und", max(share) if found else 0.0))
    got = langid.identify(docs_of(spark, rows)).collect()
    order = lambda r: (str(r[0]), r[3])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 0.02
