"""Mixing, packing, chat, Merkle audit, language ID, top-k and class bigrams: brute force, round trips, accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackengine.llm import brown, chat, common, langid, mixing, packing, queries, topk, warc

from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)


@given(st.lists(st.integers(1, 60), min_size=1, max_size=12), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_pfair_lag_is_below_one_block(whole, periods):
    total, done = sum(whole), Counter()
    for i, k, slot, release, due in mixing.exact_schedule(whole, [w * periods for w in whole]):
        assert k == done[i] and release <= slot < due and slot == sum(done.values())
        done[i] += 1
        assert all(abs(done[x] * total - w * (slot + 1)) < total for x, w in enumerate(whole))
    assert done == {i: w * periods for i, w in enumerate(whole)}


def test_mix_numbers_every_row(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None, None, str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1]))) for i in range(700)] + [(800, "x", None, None), (800, "x", None, None)]
    df = docs_of(spark, rows)
    got = mixing.mix(df, {"a": 1, "b": 2, "c": 1, None: 1}, block_docs=4, slots=10).orderBy("position").collect()
    assert [r.position for r in got] == list(range(702)) and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        assert [r["rank"] for r in own] == list(range(len(own))) and all(r.block == r["rank"] // 4 and r.release <= r.slot < r.deadline for r in own)
    names, shares = [None, "a", "b", "c"], {None: 2, "a": 2, "b": 4, "c": 2}
    pattern = {(names[i], k): slot for i, k, slot, _, _ in mixing.exact_schedule([2, 2, 4, 2], [2, 2, 4, 2])}
    assert all(r.slot == r.block // shares[r.source] * 10 + pattern[r.source, r.block % shares[r.source]] for r in got)
    assert [(r.slot, r["rank"]) for r in got] == sorted((r.slot, r["rank"]) for r in got)
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 1})
    assert mixing.mix(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in mixing.mixed(df).collect()) == sorted(r[0] for r in rows)


def test_mixed_rows_lie_in_order(spark):
    docs = common.table(spark, SMALL, "documents")
    place = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    got = [place[r.doc_id] for r in mixing.mixed(docs).collect()]
    assert got == sorted(place.values())


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
@settings(max_examples=150, deadline=None)
def test_plan_uses_every_piece_once(counts):
    plan = packing.packing_plan(counts, 64)
    used = Counter()
    for pattern, times in plan:
        assert times > 0 and sum(pattern) <= 64
        for n in pattern:
            used[n] += times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(t for _, t in plan) <= max(2 * total / 64, 0) + 1


def test_exact_complements_come_first():
    assert sum(t for _, t in packing.packing_plan({10: 3, 54: 3, 20: 2, 24: 1, 40: 1, 64: 2}, 64)) == 2 + 3 + 2


def test_pack_equals_plain_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect()]
    odd = [None, "", " ", "\n\n", "  two   spaces \n", "tab\tand\rreturn\x0bx\x1cy\u2003z", "e\u0301 \u0301x \u00c9", "<|endoftext|> a<|startoftext|>b", "<|EndOfText|> A<|B <|endoftext|>. C", "it's 12,5 \U0001f600\u200d!!", "\u03a3\u03a3 \u03a3", "a " * 9000]
    rows += [(10**6 + i, t) for i, t in enumerate(odd)]
    got = packing.pack(docs_of(spark, rows)).toPandas()
    want = []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) + 2
    assert packing.pack(docs_of(spark, [])).count() == 0
    assert packing.pack(docs_of(spark, [(1, "a"), (1, "a"), (None, "b")])).count() == 3


@given(st.text(alphabet="\\#<: /turn>\nab", max_size=30), st.text(alphabet="\\#<: /turn>\nab", max_size=12))
@settings(max_examples=500, deadline=None)
def test_turns_read_back(text, role):
    one = chat.render_turn(role, text)
    assert chat.parse_turns(one + chat.render_turn("user", "x") + one) == [(role, text), ("user", "x"), (role, text)]


def test_plain_turns_are_not_escaped():
    assert chat.render_turn("user", "C:\\dir #1 <b> </turn> a") == "### user: C:\\dir #1 <b> </turn> a </turn>\n"
    with pytest.raises(ValueError):
        chat.parse_turns("### user: no end")


def test_conversation_digests(spark):
    rows = [(1, 1, "assistant", "B</turn>"), (1, 0, "user", "A"), (2, 0, None, None), (None, 0, "assistant", "x"), (3, 5, "assistant", "\u00e9\U0001f600"), (3, 5, "assistant", "\u00e9\U0001f600"), (3, None, "system", ""), (1, 2, "### ", "### ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS n_turns")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nA\nassistant\nB</turn>\n### \n### \n") and got[1].loss_sha256 == sha("B</turn>") and got[1].loss_chars == 8
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0 and got[2].loss_sha256 == sha("")
    assert got[3].n_turns == 3 and got[3].loss_chars == 4 and got[None].n_turns == 1
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


def test_audit_finds_just_the_damage(spark):
    pages = common.table(spark, SMALL, "pages")
    records = warc.warc_records(pages, file_records=20).cache()
    assert records.count() == pages.count()
    for rows in [sorted(((r.offset, r.length, bytes(r.record)) for r in records.collect() if r.file == f)) for f in {r.file for r in records.select("file").collect()}]:
        end = 0
        for offset, length, record in rows:
            assert (offset, length) == (end, len(record)) and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            end += length
    ours = warc.merkle_tree(records, 4)
    bad = warc.damaged(records, one_in=9).cache()
    hurt = {(r.file, r.offset) for r in bad.filter("hurt").collect()}
    found = {(r.file, r.lo): r.fault for r in warc.audit(ours, warc.merkle_tree(bad, 4), 4).collect()}
    assert hurt and found == {k: "changed" for k in hurt}
    assert warc.audit(ours, warc.merkle_tree(records, 4), 4).count() == 0
    short = warc.audit(ours, warc.merkle_tree(records.filter("offset < 20000"), 4), 4).collect()
    assert {r.fault for r in short} == {"missing"}
    assert warc.corpus_root(ours, 4) == warc.corpus_root(warc.merkle_tree(records, 4), 4) != warc.corpus_root(warc.merkle_tree(bad, 4), 4)


def test_merkle_odd_pages(spark):
    odd = spark.createDataFrame([(None, None, None), (1, "u\r\nv", ""), (1, "u", "x"), (1, "u", "x"), (2, "w", "y" * 10**6)], "page_id long, url string, html string").selectExpr("*", "1 AS file", "2 AS digest")
    rows = warc.fixity_drill(odd).collect()
    assert len(rows) == 5 and all(r.hurt == r.found for r in rows)
    assert warc.fixity_drill(odd.limit(0)).count() == 0


def test_languages_on_held_out_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    assert got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0).all()


def test_language_mixtures(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    names, model = langid.fit_languages(docs)
    long = {r.lang: r.text for r in docs.filter("n_chars BETWEEN 2000 AND 4000").collect()}
    share, has = langid.infer([long["en"] + "\n" + long["de"], long["fr"], "12 !?", None], model)
    assert has.tolist() == [True, True, False, False] and share[2:].sum() == 0
    assert share[0][names.index("en")] > 0.2 and share[0][names.index("de")] > 0.2 and (share[0] > 0).sum() == 2
    assert share[1][names.index("fr")] == 1 and np.allclose(share[:2].sum(axis=1), 1)


def test_language_odd_tables(spark):
    texts = [None, "", "123", "\ud7ff", "the end", "x" * 300_000]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(20 + i, "the cat and the dog", "en") for i in range(9)] + [(40 + i, "der Hund und die Katze", "de") for i in range(9)] + [(None, "und der", None)]
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, rows)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[4].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out
    assert langid.identify(docs_of(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs_of(spark, [(1, "abc", None)])).collect()} == {"und"}
    kept = langid.keep_identified(docs_of(spark, rows).withColumn("lang_pred", F.lit(1)))
    assert kept.columns[-1] == "lang_pred" and {0, 1, 2}.isdisjoint(r.doc_id for r in kept.collect())


@pytest.mark.parametrize("size", [1, 10**5])
def test_top_k_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(size)
    rows = [(int(i), [float(np.float32(x)) for x in np.round(rng.normal(size=6) * (rng.random(6) < 0.4), 1) * size]) for i in range(90)]
    rows += [(200, None), (201, [float("nan")] * 6), (202, [None] * 6), (203, [1e300] * 6), (204, [3e6, 0.0]), (205, [-1e7, 1e7]), (260, [2e7, 1.0]), (280, [1e12] * 6), (220, [0.5]), (240, []), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS terms", "2 AS c")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect()))
    ok = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v is not None and i not in (201, 202)}
    most, want = 2**63 - 1, []
    for q in (i for i in ok if i % 20 == 0):
        all_ = sorted(((-min(most, max(-most, sum(a * b for a, b in zip(ok[q], v)))), i) for i, v in ok.items() if i != q))[:7]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(all_, 1)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_exchange_gain_is_exact():
    rng = np.random.default_rng(0)
    m = 70  # words, then the endings and the end, as the symbols of a text are
    size = m + brown.ENDINGS + 1
    classes = np.concatenate([np.arange(m) % brown.MOVABLE, brown.MOVABLE + np.arange(brown.ENDINGS), [brown.END]])
    n = rng.poisson(0.05, (size, size)) + (rng.random((size, size)) < 0.01) * rng.integers(1, 30, (size, size))
    n[:, -1] += np.maximum(n.sum(1).max() + 1 - n.sum(1), 0) * 0

    def grid(c):
        g = np.zeros((brown.CLASSES,) * 2, np.int64)
        np.add.at(g, (np.repeat(c, size), np.tile(c, size)), n.ravel())
        return g

    w, g = 5, grid(classes)
    sums = np.bincount(classes, n.sum(0), brown.CLASSES).astype(np.int64)
    left, right = np.bincount(classes, n[:, w], brown.CLASSES).astype(np.int64), np.bincount(classes, n[w], brown.CLASSES).astype(np.int64)
    to, gain = brown.best_class(int(classes[w]), left, right, int(n[w, w]), int(n[:, w].sum()), g, sums)
    after = classes.copy()
    after[w] = to
    moved, moved_sums = g.copy(), sums.copy()
    brown.move(int(classes[w]), to, left, right, int(n[w, w]), int(n[:, w].sum()), moved, moved_sums)
    assert (moved == grid(after)).all()
    f = lambda g, s: brown._f(g.astype(float)).sum() - 2 * brown._f(s.astype(float)).sum()
    assert gain == pytest.approx(f(moved, moved_sums) - f(g, sums))


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "Zzz zzz unseen\u00c9"), (None, "the of")]
    return rows, {r.doc_id: r for r in brown.score(docs_of(spark, rows)).collect()}


def test_base_scores_equal_brute_force(scored):
    rows, got = scored
    key = lambda i: b"" if i is None else str(i).encode()
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter(w for i, t in rows if zlib.crc32(key(i)) % 7 != 2 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, t in rows:
        r, w = got[i], words(t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(key(i)) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))


def test_classes_help_held_out_texts(scored):
    held = [r for r in scored[1].values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_model_is_a_distribution(spark):
    rows = [(i, t) for i, t in enumerate(["a b a c", "b a d a", "a b c d e", "", "f a b"])]
    model, _, _ = brown.learned(docs_of(spark, rows), held_fold=-1)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    mass = Counter()
    for w, c in model.word_class.items():
        mass[c] += 10 ** (model.log_count[w] - model.mass[c])
    for c, m in mass.items():
        assert m + 10 ** -model.mass[c] == pytest.approx(1)  # known words and one unknown word
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in brown.score(docs_of(spark, [(0, "a b")] * 2 + [(1, "c")])).collect())
    assert [x[:2] for x in got] == [(0, 3), (0, 3), (1, 2)] and got[0][2] == pytest.approx(got[1][2])
    assert brown.score(docs_of(spark, [])).count() == 0


def test_queries_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SMALL).toPandas(), con.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols and [str(t) for t in got[cols].dtypes] == [str(t) for t in want[cols].dtypes]
        assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist())), name


def test_class_scores_equal_plain_loops(spark):
    """Class bigrams counted and scored word by word; the classes are the model's, all else is counted anew."""
    rows = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").limit(60).collect()] + [(10**6, None), (10**6 + 1, "never seen Words")]
    model, _, _ = brown.learned(docs_of(spark, rows))
    got = {r.doc_id: r.score for r in brown.score(docs_of(spark, rows)).collect()}
    words = lambda t: (t or "").encode().lower().split()
    of = lambda w: model.word_class.get(w, brown.MOVABLE + zlib.crc32(w[-3:]) % brown.ENDINGS)
    train = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, grid = Counter(w for t in train for w in t), Counter()
    for t in train:
        path = [brown.END, *map(of, t), brown.END]
        grid.update(zip(path, path[1:]))
    total, types = Counter({brown.END: len(train)}), Counter()
    for w, n in counts.items():
        total[of(w)] += n
        types[of(w)] += 1
    before = Counter()
    for (a, _), n in grid.items():
        before[a] += n
    all_mass = sum(total[c] + 1 for c in range(brown.CLASSES))
    assert len({model.word_class[w] for w in model.word_class}) > 20
    for i, t in rows:
        path, want = [brown.END, *map(of, words(t)), brown.END], 0.0
        for a, b in zip(path, path[1:]):
            want += math.log10((grid[a, b] + brown.PRIOR * (total[b] + 1) / all_mass) / (before[a] + brown.PRIOR))
        for w in words(t):
            want += math.log10((counts[w] + 1) / (total[of(w)] + types[of(w)] + 1))
        assert got[i] == pytest.approx(want), i


def test_exchange_gains_likelihood(spark):
    """The counts that it returns are those of its classes, and its classes are better than those it began with."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 70, 80) * 2 + np.arange(80) % 2 for _ in range(60)]  # even and odd words alternate
    pairs = Counter(p for t in texts for p in zip([brown.LAST, *t.tolist()], [*t.tolist(), brown.LAST]))
    df = common.materialize(brown.symbol_pairs(spark.createDataFrame([(bytearray(t.astype("<u2").tobytes()),) for t in texts], "symbols binary").repartition(3)), "test")
    first = brown.first_classes([b"%d" % i for i in range(150)], 140)
    classes, grid = brown.exchange(df, first, 140)
    assert (classes[140:] == first[140:]).all()

    def counted(c):
        g = np.zeros((brown.CLASSES,) * 2, np.int64)
        for (a, b), n in pairs.items():
            g[c[a], c[b]] += n
        return g

    assert (grid == counted(classes)).all() and brown.likelihood(grid) > brown.likelihood(counted(first)) + 10


def test_top_k_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 4)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 3)]) for i in rng.integers(18, 24, 40)] + [(20, [1.0, 2.0, 3.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    expected = []
    for q, (i, v) in enumerate(rows):
        if i % 20 == 0:
            found = sorted((-sum(64 * 64 * a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(rows) if c != q)[:4]
            expected += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=4).collect()))
    assert got == sorted(expected)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, and columns that are called like the stages' own."""
    import corpus_pipeline

    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("aeinrst", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 80)))
    rows = [(i, text(), "en" if i % 2 else "xx", f"s{i % 3}") for i in range(40)]
    rows += [(None, text(), None, None), (50, None, "en", "s1"), (51, "", "en", None), (52, " \t", None, "s1"), (3, text(), "en", "s0"), rows[5], rows[5], (53, "long " * 3000, "en", "s2")]
    rows = [(*r, 0 if r[1] is None else len(r[1]), i, "f", "p", "m") for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row long, _file string, position string, _metadata string"
    docs = spark.createDataFrame(rows, schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    ids = {r.doc_id for r in out}
    assert {50, 51, 52} & ids == set() and len(ids & set(range(40))) > 30
    docs.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SMALL, "documents")
    now, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = common.materialize(stage(spark, now, SMALL), "test")
        seen.append(now.count())
        if name != "best-fit packing":
            assert now.columns == docs.columns
    assert seen[0] >= seen[1] > seen[2] >= seen[3] == seen[4] > 0
    again = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, again.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, now.select("doc_id", "piece", "length", "ids_crc32").collect()))
