"""The pipeline's near-copy stage on planted edits, against brute force of five-word shingles."""

import numpy as np

import corpus_pipeline
from trackengine.llm import common, nearcopies

from ..conftest import SMALL
from .test_copies import closure, docs_of


def plain_jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").encode().lower().split() for t in (a, b)))
    return len(x & y) / len(x | y) if x or y else 1.0


def test_planted_edits_from_0_8_are_dropped_and_others_stay(spark):
    rng = np.random.default_rng(12)
    rows, want, near = [], set(), 0
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 110)]
        edited = list(words)
        for p in rng.choice(110, int(rng.integers(1, 5)), replace=False):
            edited[p] = f"x{rng.integers(0, 10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
        close = plain_jaccard(rows[-2][1], rows[-1][1]) >= 0.8
        near += close
        want |= {2 * i} if close else {2 * i, 2 * i + 1}
    assert 50 < near < 140
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs_of(spark, rows), "").collect()} == want


def test_groups_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), (10**6 + 3, "One"), (10**6 + 4, "one"), (10**6 + 5, "a b C")]
    links = [(i, j) for i, (_, a) in enumerate(rows) for j, (_, b) in enumerate(rows[:i]) if plain_jaccard(a, b) >= 0.8]
    comp = closure(len(rows), links)
    low = {}
    for (i, _), g in zip(rows, comp):
        low[g] = min(i, low.get(g, i))
    got = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(docs_of(spark, rows)).collect()}
    assert got == {i: low[g] for (i, _), g in zip(rows, comp)}


def test_chain_whose_first_text_is_far_from_the_others(spark):
    """Only pairs that the first comparison leaves open join these: neighbours are near, ends are not."""
    words = [f"w{x}" for x in range(200)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(20)]
    assert {r.component_id for r in nearcopies.near_copy_groups(docs_of(spark, rows)).collect()} == {0}


def test_large_group_of_edits_in_tiles(spark, monkeypatch):
    """Edits of one text at similarities around 0.8 share bands; tiles join what brute force joins."""
    monkeypatch.setattr(nearcopies, "TILE_TEXTS", 7)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for p in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            words[p] = f"x{rng.integers(0, 4)}"
        rows.append((i, " ".join(words)))
    comp = closure(90, [(i, j) for i in range(90) for j in range(i) if plain_jaccard(rows[i][1], rows[j][1]) >= 0.8])
    low = {g: min(i for i in range(90) if comp[i] == g) for g in set(comp)}
    assert len(low) > 3
    for few in (2, 10**6):
        monkeypatch.setattr(nearcopies, "FEW", few)
        got = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(docs_of(spark, rows)).collect()}
        assert got == {i: low[comp[i]] for i in range(90)}


def test_odd_tables(spark):
    assert nearcopies.near_copy_groups(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, "e")])
    kept = nearcopies.drop_near_copies(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]


def test_one_row_of_a_repeated_document_stays(spark):
    long = " ".join(f"w{x}" for x in range(50))
    rows = docs_of(spark, [(1, long), (1, long), (1, long + " x"), (1, "other words"), (3, long), (4, None), (4, None), (None, long)])
    clash = rows.withColumnsRenamed({"lang": "of", "source": "text_id"}).withColumn("_of", common.F.lit(1))
    kept = nearcopies.drop_near_copies(clash)
    assert kept.columns == clash.columns
    got = sorted((r.doc_id or 0, len((r.text or "").split())) for r in kept.collect())
    assert got in ([(0, 50), (1, 2), (1, 50), (4, 0)], [(0, 50), (1, 2), (1, 51), (4, 0)])


def test_simhash_alone_finds_what_fingerprints_join_and_confirms_it(spark, monkeypatch):
    """Without bands, candidates are the groups of fingerprints at three bits; those that aren't similar stay apart."""
    monkeypatch.setattr(nearcopies, "band_keys", lambda grams: np.full(nearcopies.BANDS, grams.sum(dtype=np.uint64)))
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 600)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    rows += [(100 + i, f"one{i} a b c d") for i in range(3)]
    prints = {i: nearcopies.fingerprint_of(t.encode(), nearcopies.SHINGLE) for i, t in rows}
    links = [(i, j) for i, (a, x) in enumerate(rows) for j, (b, y) in enumerate(rows[:i]) if (prints[a] ^ prints[b]).bit_count() <= 3 and plain_jaccard(x, y) >= 0.8]
    assert len(links) > 20
    comp, low = closure(len(rows), links), {}
    for (i, _), g in zip(rows, comp):
        low[g] = min(i, low.get(g, i))
    got = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(docs_of(spark, rows)).collect()}
    assert got == {i: low[g] for (i, _), g in zip(rows, comp)}
