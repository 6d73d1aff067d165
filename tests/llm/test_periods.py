"""Periodic runs against a search through every period, and the query against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from trackengine.llm import periods
from trackengine.llm.queries import op13_periodic_runs

from ..conftest import SMALL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def every_period(x, times=4, shortest=6):
    """Runs by going through all periods and all places."""
    out = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            w = x[s : s + q]
            if i - s + q >= max(shortest, times * q) and not any(q % d == 0 and w == w[:d] * (q // d) for d in range(1, q)):
                out.append((s, i - s + q, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, planted=True):
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = every_period(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(kept))


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_every_period(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        x = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 50))]
        at = rng.randint(0, len(x))
        x[at:at] = [rng.randint(1, 3) for _ in range(rng.randint(0, 6))] * rng.randint(1, 9)
        expected = every_period(x)
        assert periods.lyndon_runs(np.array(x, int)) == expected
        parts = periods.stretches(np.array(x, int), np.zeros(len(x), int))
        got = [(lo + s, n, q) for lo, hi in parts for s, n, q in periods.lyndon_runs(np.array(x[lo:hi]))]
        assert sorted(got, key=lambda r: (r[0], r[2])) == expected


def test_nested_and_long_runs():
    for x in ([1] * 3000, [1, 2, 1, 3] * 900, (([1] * 20 + [2]) * 30 + [3]) * 5, [*range(100)] * 5):
        assert periods.lyndon_runs(np.array(x)) == every_period(x)
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert periods.lyndon_runs(np.array(b), periods=4) == every_period(b)
    assert periods.lyndon_runs(np.array(b), periods=3) == every_period(b, 3)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", "  \t\n", "a", "x " * 4000, "a b " * 60 + "c", "é ü é ü\té ü\né ü", "a b a b a b a b a b a b a b", " ".join(map(str, range(300))) + " end"]
    texts += [" ".join(rng.choice("abc" * 2 + "defghij") for _ in range(rng.randint(0, 120))) for _ in range(150)]
    rows = [(i if i % 29 else None, t, "w", 1) for i, t in enumerate([*texts, texts[5], texts[5]])]
    rows += [(3, "q q q q q q q", "w", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((plain(r[0], r[1]) for r in rows), key=repr)
    none = docs.filter("false")
    assert periods.periodic_runs(none).count() == 0
    kept = {r.doc_id: r.collapsed for r in periods.periodic_runs(docs.filter("doc_id = 5").limit(1)).collect()}
    assert kept == {5: "a b c"}


def test_query_on_the_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(rows)
    assert any(r[1] for r in got.values())
    for r in rows:
        if len(r.text.split()) < 1500:
            assert got[r.doc_id] == plain(r.doc_id, r.text)
