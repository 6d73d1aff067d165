"""Source divergence against plain Python whole-number arithmetic."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trackengine.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, top=200):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = TERM.findall(text.translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        mine = [s for g, s in groups if g == lang]

        def p(counts):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // size for t in kept}

        own, whole = p(count[lang, source]), p(sum((count[lang, s] for s in mine), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        pairs = []
        for other in mine:
            if other != source:
                q = p(count[lang, other])
                pairs.append((sum(f(own[t], q[t]) for t in kept), other))
        terms = [(f(own[t], whole[t]), t) for t in kept if count[lang, source][t] > 0 and own[t] > whole[t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(ranked[:limit], 1)]
    return out


def rows_of(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,chunk,cells", [(0, 8192, 1 << 21), (1, 3, 7), (2, 40, 1 << 21)])
def test_divergence_is_the_plain_one(spark, monkeypatch, seed, chunk, cells):
    rng = random.Random(seed)
    monkeypatch.setattr(divergence, "CELLS", cells)
    words = ["Ab", "ab", "É", "é", "zz", "Z-y", "日本", "x1y", "ｱ", "𝒳", "q"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(rng.choice(["en", "fr", None, "x"]), rng.choice(["a", "b", None, "é", "zz"]), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(150)]
    rows += [("en", "only null", None), ("en", "no letters", "12 34 -- \x00"), ("one", "alone", "a b"), ("none", "s", "rare words"), ("none", "t", None), *[("en", "a", "Same same SAME row")] * 4]
    docs = spark.createDataFrame([(*r, 5, "y") for r in rows], "lang string, source string, text string, n long, term string").repartition(4)
    assert rows_of(divergence.source_divergence(docs, chunk=chunk)) == sorted(plain(rows))


def test_few_ranks_and_empty_tables(spark):
    rows = [("l", s, " ".join(f"t{chr(97 + i)}" for i in range(26)) + f" {s} {s}") for s in ("a", "b", "c") for _ in range(3)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(divergence.source_divergence(docs, top=2)) == sorted(plain(rows, 2))
    assert divergence.source_divergence(docs.filter("false")).count() == 0


def test_probabilities_are_exact_for_large_counts():
    rng = random.Random(1)
    sizes = [rng.randint(1, 2**52) for _ in range(200)] + [1, 7, 2**53 - 1]
    for size in sizes:
        count = [rng.randint(0, size - 1) for _ in range(20)] + [0, size - 1]
        assert divergence.probabilities(np.array(count), size).tolist() == [1 + 10**9 * (c + 1) // size for c in count]


def test_counting_task_passes_on_what_it_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MERGE_ROWS", 20)
    monkeypatch.setattr(divergence, "HELD_ROWS", 10)
    rows = [("l", "s", f"a{chr(97 + i % 26)} b") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = {r.term: (r.n, r.docs) for r in divergence.term_counts(docs).collect()}
    assert got["b"] == (300, 300) and got["aa"] == (12, 12) and len(got) == 27
