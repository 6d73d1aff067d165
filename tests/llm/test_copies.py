"""SimHash, repeated passages, embeddings and components against brute force, with odd inputs."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash

from trackengine.llm import common, components, embed, simhash, suffix

from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def closure(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [16_384, 20])
def test_simhash_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), (10**6 + 3, "One"), (10**6 + 4, "one"), (10**6 + 5, "a\u00a0b C"), (-3, "\u00c4B c d")]
    prints = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None]) <= 3)
    group = defaultdict(list)
    for i, g in enumerate(closure(len(rows), near)):
        group[g].append(rows[i][0])
    want = {i: min(g) for g in group.values() for i in g}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(docs_of(spark, rows)).collect()}
    assert got == {i: (int(p), want[i]) for (i, _), p in zip(rows, prints)}


def test_fingerprint_links_are_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, k, replace=False)) for b in base for k in (1, 2, 3, 4)]
    fps = sorted({*map(int, base), *near})
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    at = {f: i for i, f in enumerate(fps)}
    pairs = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3]
    assert closure(len(fps), [(at[r.u], at[r.v]) for r in links.collect()]) == closure(len(fps), pairs)


def test_simhash_odd_tables(spark):
    assert simhash.simhash_groups(docs_of(spark, [])).count() == 0
    twice = docs_of(spark, [(1, "a b c d"), (1, "a b c d"), (None, "x y z"), (2, "a b c d")])
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.simhash_groups(twice).collect()) == [(0, None), (1, 1), (1, 1), (2, 1)]
    clash = twice.withColumnsRenamed({"lang": "fp", "source": "component_id"})
    kept = simhash.simhash_dedup(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]


def plain_spans(rows, n):
    at, cover, first = defaultdict(list), defaultdict(set), defaultdict(set)
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - n + 1):
            at[tuple(words[k : k + n])].append((i, k))
    for places in at.values():
        places = sorted(places)
        if len(places) > 1:
            for m, (i, k) in enumerate(places):
                cover[i] |= set(range(k, k + n))
                first[i] |= set(range(k, k + n)) if m == 0 else set()
    return dict(cover), {i: s for i, s in first.items() if s}


def got_spans(df):
    cover, kept = defaultdict(set), defaultdict(set)
    for r in df.collect():
        cover[r.doc_id] |= set(range(r.first_word, r.last_word))
        if r.kept:
            kept[r.doc_id] |= set(range(r.first_word, r.last_word))
    return dict(cover), dict(kept)


@pytest.mark.parametrize("n, seed", [(50, 32), (8, 4), (5, 5), (3, 1)])
def test_repeated_spans_equal_brute_force(spark, n, seed):
    rng = np.random.default_rng(n)
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 60, k))
    passages = [word(n + 3), word(n), word(2 * n), "la " * (2 * n)]
    texts = []
    for i in range(60):
        parts = [word(int(rng.integers(0, 40)))]
        for p in rng.permutation(4)[: int(rng.integers(0, 3))]:
            cut = passages[p].split()
            parts += [" ".join(cut[int(rng.integers(0, 4)) :]), word(int(rng.integers(0, 9)))]
        texts.append((i, "\n".join(parts)))
    texts += [(100, None), (101, ""), (102, texts[0][1]), (103, texts[0][1])]
    assert got_spans(suffix.repeated_spans(docs_of(spark, texts), n, seed)) == plain_spans(texts, n)


def test_repeated_spans_over_whole_documents(spark):
    docs = common.table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got_spans(suffix.repeated_spans(docs)) == plain_spans(rows, 50)


def test_suffix_dedup_cuts_all_but_the_first(spark):
    rng = np.random.default_rng(9)
    word = lambda k: " ".join(f"v{x}" for x in rng.integers(0, 10**6, k))
    shared = word(60)
    texts = [(5, f"{word(20)} {shared}\n{word(10)}"), (2, f"{word(5)}\n\n{shared}"), (7, shared), (8, word(70)), (9, None), (None, shared), (11, "")]
    out = {r.doc_id: r for r in suffix.suffix_dedup(docs_of(spark, texts)).collect()}
    assert set(out) == {5, 2, 8, 9, None, 11}  # nothing is left of 7; a null id takes no part
    assert out[2].text == texts[1][1] and out[8].text == texts[3][1] and out[None].text == shared
    assert out[5].text.split() == texts[0][1].split()[:20] + texts[0][1].split()[-10:] and out[5].n_chars == len(out[5].text)
    assert suffix.suffix_dedup(docs_of(spark, [])).count() == 0
    again = docs_of(spark, [(1, shared), (1, shared)])
    assert suffix.repeated_spans(again).count() == 0  # one row twice is one text


def test_very_long_text(spark):
    rng = np.random.default_rng(4)
    text = " ".join(f"u{x}" for x in rng.integers(0, 10**9, 300_000))
    rows = [(1, text), (2, "start " + text[-2000:])]
    cover, kept = got_spans(suffix.repeated_spans(docs_of(spark, rows)))
    n = len(rows[1][1].split())
    assert len(cover[2]) in (n - 2, n - 1) and len(cover[1]) == len(cover[2]) and set(kept) == {1}
    assert simhash.simhash_groups(docs_of(spark, rows)).count() == 2


def test_components(spark):
    rng = np.random.default_rng(6)
    chain = [(i, i + 1) for i in range(0, 120)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    random = [tuple(map(int, rng.integers(2000, 2100, 2))) for _ in range(70)]
    pairs = chain + star + random + [(5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    want = closure(len(nodes), [(at[a], at[b]) for a, b in pairs if a != b])
    assert got == {x: nodes[g] for x, g in zip(nodes, want)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_groups(rows, threshold):
    ids, links = [r[0] for r in rows], []
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i < j and a is not None and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y >= threshold * np.linalg.norm(x) * np.linalg.norm(y):
                    links.append((i, j))
    comp = closure(len(rows), links)
    low = {g: min(ids[i] for i in range(len(rows)) if comp[i] == g) for g in comp}
    return sorted((ids[i], sum(i in p for p in links), low[comp[i]], ids[i] == low[comp[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("cell, block", [(8192, 4096), (25, 7)])
def test_embedding_groups_equal_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(150):
        v = rng.normal(size=8) if i % 3 == 0 else np.array(rows[-1][1]) + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.3])
        rows.append((int(1000 - i), [float(np.float32(x)) for x in v], int(i // 30)))
    rows += [(7, rows[0][1], rows[0][2]), (8, [1.0, 0.0], 0), (9, [1.0, 0.1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embed.embedding_groups(df, cell_rows=cell).collect()))
    assert got == plain_groups(rows, 0.93)


def test_embedding_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (9, [], 1), (10, [1e200, 1e200], 2), (11, [1e200, 1e200], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnsRenamed({}).selectExpr("*", "1 AS rep", "2 AS cell")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.embedding_groups(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True), 10: (1, 10, True), 11: (1, 10, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)}
    assert embed.embedding_groups(df.limit(0)).count() == 0
    assert sorted(r.vec_id or 0 for r in embed.embedding_dedup(df).collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10]


def test_texts_of_one_id_are_apart(spark):
    rng = np.random.default_rng(11)
    word = lambda k: " ".join(f"v{x}" for x in rng.integers(0, 10**6, k))
    shared, lone = word(60), word(90)
    docs = docs_of(spark, [(1, f"{shared} {word(5)}"), (2, f"{word(3)} {shared}"), (2, lone), (2, None)])
    out = sorted((r.doc_id, len((r.text or "").split())) for r in suffix.suffix_dedup(docs).collect())
    assert out == [(1, 65), (2, 0), (2, 3), (2, 90)]
    clash = docs.withColumnsRenamed({"lang": "_of", "source": "_cuts"}).withColumns({"of": common.F.lit(1), "_now": common.F.lit(2), "text_id": common.F.lit(3)})
    again = suffix.suffix_dedup(clash)
    assert again.columns == clash.columns and again.count() == 4 and {(r._of, r._cuts, r.of, r._now, r.text_id) for r in again.collect()} == {("en", "s", 1, 2, 3)}


def test_sorted_rows_in_chunks(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 40, 300))
    place = np.sort(rng.integers(0, 3, 300))
    rows = sorted({*zip(keys.tolist(), place.tolist())})
    batches = lambda: (pa.RecordBatch.from_pylist([{"k": k, "p": p} for k, p in sorted(zip(keys.tolist(), place.tolist()))[i : i + 7]]) for i in range(0, 300, 7))
    for chunk in (1, 10, 10**6):
        monkeypatch.setattr(suffix, "CHUNK", chunk)
        got = [(k, p, bool(b), bool(a), bool(e)) for t, before, after, edge in suffix._beside(batches(), ["k"], ["p"]) for k, p, b, a, e in zip(t["k"].to_pylist(), t["p"].to_pylist(), before, after, edge)]
        assert [g[:2] for g in got] == rows
        assert [g[2] for g in got] == [i > 0 and rows[i - 1][0] == r[0] for i, r in enumerate(rows)]
        assert [g[3] for g in got] == [i + 1 < len(rows) and rows[i + 1][0] == r[0] for i, r in enumerate(rows)]
        assert [i for i, g in enumerate(got) if g[4]] == [0, len(rows) - 1]
    assert list(suffix._beside(iter(()), ["k"], [])) == []


def test_vectors_that_share_an_id_are_apart(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("_lost", common.F.lit(0))
    got = sorted(tuple(r) for r in embed.embedding_groups(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
    kept = embed.embedding_dedup(df)
    assert kept.columns == df.columns and sorted(r.vec_id for r in kept.collect()) == [1, 1, 4]
