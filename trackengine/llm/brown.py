"""Class-based bigram scores: exchange clustering of words, smoothed class transitions and word emissions."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, discard, giving_back, materialize, text_bytes

#: Classes that words are exchanged between; the classes of other words are told by their endings.
MOVABLE, ENDINGS = 64, 192
#: Words (the most frequent ones) that every task holds, and exchanges; other words meet their counts in a join.
#: With the endings and the end of a text behind them, the symbols of a text are 16-bit numbers.
HELD = (1 << 16) - ENDINGS - 1
LAST = HELD + ENDINGS
#: Held words that occur so often at least are exchanged; of fewer neighbours a class would only be learned by heart.
OFTEN = 10
#: Sweeps of exchanges, in each of which half of the words may move; weight of the class frequencies in transitions.
SWEEPS, PRIOR = 5, 20.0
#: Words that one task of a sweep goes through, about; buckets of words whose neighbours are packed together.
TASK_WORDS, BUCKETS = 4096, 256
#: Pairs of a bucket that a task holds before it adds them up, about 12 bytes each.
HELD_PAIRS = 4 << 20
END = MOVABLE + ENDINGS
CLASSES = END + 1


def words_of(body: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs without ASCII white space, A-Z lower-cased."""
    return body.lower().split()


def ending_class(word: bytes) -> int:
    return MOVABLE + zlib.crc32(word[-3:]) % ENDINGS


def word_counts(bodies: DataFrame) -> DataFrame:
    """(word, n) of all texts (column body); each task adds up its own before the shuffle."""

    @giving_back
    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for body in b.column(0).to_pylist():
                counts.update(words_of(body))
            if len(counts) > 400_000:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return bodies.select("body").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


_CODED = "doc_id long, text_id long, train boolean, tokens long, symbols binary, rare array<struct<word:binary,times:long>>"


def coded(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """(doc_id, text_id, train, tokens, symbols, rare) of rows (doc_id, body, train): the only pass over texts but the counts.

    symbols: a 16-bit number for each word, its number among the held words or HELD and that of its ending; rare: the words
    that aren't held, and how often they occur in the text.
    """
    index = {w: i for i, w in enumerate(words)}

    @giving_back
    def run(batches):
        get = index.get
        for b in batches:
            tokens, ids, symbols, sizes, rare, times = [], [], [], [], [], []
            for body in b.column(1).to_pylist():
                found = words_of(body)
                at = np.array([get(w, HELD) for w in found], np.int64)
                others = [found[i] for i in np.flatnonzero(at == HELD)]
                at[at == HELD] = [HELD - MOVABLE + ending_class(w) for w in others]
                few = Counter(others)
                tokens.append(len(found) + 1)
                ids.append(xxhash.xxh64_intdigest(body) - (1 << 63))
                symbols.append(at.astype("<u2").tobytes())
                sizes.append(len(few))
                rare.extend(few.keys())
                times.extend(few.values())
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), b.column(2), pa.array(tokens, pa.int64()), pa.array(symbols, pa.binary()), lists], ["doc_id", "text_id", "train", "tokens", "symbols", "rare"])

    return rows.select("doc_id", "body", "train").mapInArrow(run, _CODED)


_PACKED = "bucket int, side int, codes binary, n binary"


def symbol_pairs(texts: DataFrame) -> DataFrame:
    """(bucket, side, codes, n): neighbouring symbols of all texts (column symbols) and their counts, packed in arrays.

    LAST stands before and after each text. On side 0 a code is the symbol in its upper and the next one in its lower 16
    bits, on side 1 the symbol and the one before it; a row has all pairs whose upper symbol is in its bucket, in order.
    Tasks add their own pairs up before they are shuffled, and a row for each task and bucket is.
    """

    @giving_back
    def count(batches):
        held, n = [], 0
        for b in batches:
            for symbols in b.column(0).to_pylist():
                s = np.concatenate([[LAST], np.frombuffer(symbols, "<u2"), [LAST]]).astype(np.uint32)
                held.append(s[:-1] << np.uint32(16) | s[1:])
                n += len(s)
            if n > 4_000_000:
                yield from dealt(*np.unique(np.concatenate(held), return_counts=True))
                held, n = [], 0
        if held:
            yield from dealt(*np.unique(np.concatenate(held), return_counts=True))

    def dealt(code, n):
        for side, codes in ((0, code), (1, code << np.uint32(16) | code >> np.uint32(16))):
            of = (codes >> np.uint32(16)) % np.uint32(BUCKETS)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(BUCKETS + 1))
            for bucket, (a, b) in enumerate(zip(ends, ends[1:])):
                if b > a:
                    yield packed(bucket, side, codes[order[a:b]], n[order[a:b]])

    def packed(bucket, side, codes, n):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([side], pa.int32()), pa.array([codes.astype("<u4").tobytes()]), pa.array([n.astype("<i8").tobytes()])], ["bucket", "side", "codes", "n"])

    @giving_back
    def together(batches):
        now, codes, n, held, limit = None, [], [], 0, HELD_PAIRS
        for b in batches:
            for bucket, side, c, k in zip(*(x.to_pylist() for x in b.columns)):
                if now not in (None, (bucket, side)):
                    yield packed(*now, *added(codes, n))
                    codes, n, held, limit = [], [], 0, HELD_PAIRS
                now = bucket, side
                codes.append(np.frombuffer(c, "<u4"))
                n.append(np.frombuffer(k, "<i8"))
                held += len(codes[-1])
                if held > limit:  # different pairs of a bucket are bounded by the symbols, whatever the texts
                    codes, n = ([x] for x in added(codes, n))
                    held = len(codes[0])
                    limit = max(HELD_PAIRS, 2 * held)
        if now:
            yield packed(*now, *added(codes, n))

    def added(codes, n):
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(at, np.concatenate(n))

    parts = texts.select("symbols").mapInArrow(count, _PACKED)
    return parts.repartition("bucket", "side").sortWithinPartitions("bucket", "side").mapInArrow(together, _PACKED)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(now: int, left: np.ndarray, right: np.ndarray, twice: int, total: int, grid: np.ndarray, size: np.ndarray) -> tuple[int, float]:
    """The movable class in which a word makes the class bigrams' likelihood greatest, and the gain over its own.

    left, right: how often the word follows and precedes each class; twice: how often itself; grid: class bigram counts.
    """
    r, l, s = right.astype(float), left.astype(float), size.astype(float)
    r[now] -= twice
    l[now] -= twice
    s[now] -= total
    t = np.arange(MOVABLE)
    after, before = np.flatnonzero(r), np.flatnonzero(l)  # other cells of the grid don't change
    rows, cols, diag = grid[:MOVABLE, after].astype(float), grid[before, :MOVABLE].T.astype(float), grid[t, t].astype(float)
    rows[now] -= r[after]  # the counts without the word
    cols[now] -= l[before]
    rows[:, after == now] -= l[:MOVABLE, None] * (t[:, None] != now)
    cols[:, before == now] -= r[:MOVABLE, None] * (t[:, None] != now)
    own = r[now] + l[now] + twice
    rows[now, after == now] = cols[now, before == now] = diag[now] = diag[now] - own
    gain = (_f(rows + r[after]) - _f(rows)).sum(axis=1) + (_f(cols + l[before]) - _f(cols)).sum(axis=1)
    gain -= _f(diag + r[t]) + _f(diag + l[t]) - 2 * _f(diag)
    gain += _f(diag + r[t] + l[t] + twice) - _f(diag)
    gain -= 2 * (_f(s[:MOVABLE] + total) - _f(s[:MOVABLE]))
    best = int(gain.argmax())
    return best, float(gain[best] - gain[now])


@dataclass(frozen=True)
class ClassModel:
    """What scoring needs, of a size that the parameters bound: nothing in it grows with the corpus."""

    word_class: dict  # of the held words
    log_count: dict  # log10(count + 1) of the held words
    transition: np.ndarray  # log10 p(class | class before)
    mass: np.ndarray  # log10 of each class's emission denominator
    train_tokens: int
    types: int
    texts: int


def _class_grid(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes: each task adds its own up and gives their number's square of rows at most."""

    @giving_back
    def run(batches):
        grid = np.zeros(CLASSES * CLASSES)
        for b in batches:
            for codes, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                code = np.frombuffer(codes, "<u4")
                grid += np.bincount(classes[code >> 16] * CLASSES + classes[code & 0xFFFF], np.frombuffer(n, "<i8"), CLASSES * CLASSES)
        at = np.flatnonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array((at // CLASSES).astype(np.int32)), pa.array((at % CLASSES).astype(np.int32)), pa.array(grid[at].astype(np.int64))], ["c", "d", "n"])

    grid = np.zeros((CLASSES, CLASSES), np.int64)
    got = pairs.filter("side = 0").select("codes", "n").mapInArrow(run, "c int, d int, n long").groupBy("c", "d").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    grid[got.c.to_numpy(int), got.d.to_numpy(int)] = got.n.to_numpy(int)
    return grid


def move(now: int, to: int, left: np.ndarray, right: np.ndarray, twice: int, total: int, grid: np.ndarray, size: np.ndarray) -> None:
    """Take a word's counts from one class to another, in place."""
    r, l = right.copy(), left.copy()
    r[now] -= twice
    l[now] -= twice
    for c, sign in ((now, -1), (to, 1)):
        grid[c] += sign * r
        grid[:, c] += sign * l
        grid[c, c] += sign * twice
        size[c] += sign * total


def likelihood(grid: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, but for what no exchange changes."""
    return float(_f(grid.astype(float)).sum() - _f(grid.sum(axis=0).astype(float)).sum() - _f(grid.sum(axis=1).astype(float)).sum())


def first_classes(words: list[bytes], m: int) -> np.ndarray:
    """Classes of all symbols to begin with: the first m words by rank, all others by their endings."""
    by_ending = [ending_class(w) for w in words[m:]]
    return np.concatenate([np.arange(m) % MOVABLE, np.array(by_ending, np.int64), np.zeros(HELD - len(words), np.int64), MOVABLE + np.arange(ENDINGS), [END]]).astype(np.int64)


def exchange(pairs: DataFrame, classes: np.ndarray, m: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all symbols, and the class bigram counts; the first m words move while it gains, the others stay.

    A sweep is one job. Each task holds some words with their neighbours' counts (bounded by the number of symbols), goes
    through half of them in turn, and moves each to its best class on its own copy of the counts; then the moves of all
    tasks are put together. A sweep after which the likelihood is no greater is undone; two in a row end the exchange.
    """
    sides = (pairs.filter(F.col("side") == i).select("bucket", F.col("codes").alias(f"codes_{i}"), F.col("n").alias(f"n_{i}")) for i in (0, 1))
    around = materialize(next(sides).join(next(sides), "bucket", "full").repartition(-(-m // TASK_WORDS), "bucket"), "neighbours") if m else None
    grid = _class_grid(pairs, classes)
    idle = 0
    for sweep in range(sweeps if m else 0):

        def run(batches, old=classes, grid=grid, half=sweep % 2):
            classes, grid, size = old.copy(), grid.copy(), grid.sum(axis=0)
            for b in batches:
                out = []
                for row in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                    codes, counts = ([np.frombuffer(x or b"", t) for x in row[i::2]] for i, t in ((0, "<u4"), (1, "<i8")))
                    words = np.unique(np.concatenate([c >> 16 for c in codes]))
                    words = words[words < m]
                    first, last = ([np.searchsorted(c >> 16, words, side=s).tolist() for c in codes] for s in ("left", "right"))
                    for k, w in enumerate(words.tolist()):
                        if zlib.crc32(b"%d" % w) % 2 != half:
                            continue
                        near = [(codes[i][first[i][k] : last[i][k]] & 0xFFFF, counts[i][first[i][k] : last[i][k]]) for i in (1, 0)]
                        left, right = (np.bincount(classes[s], n, CLASSES).astype(np.int64) for s, n in near)
                        twice, total = int(near[1][1][near[1][0] == w].sum()), max(int(n.sum()) for _, n in near)
                        now = int(classes[w])
                        to, gain = best_class(now, left, right, twice, total, grid, size)
                        if gain > 1e-6:
                            move(now, to, left, right, twice, total, grid, size)
                            classes[w] = to
                            out.append((w, to))
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.int32()), pa.array([t for _, t in out], pa.int32())], ["w", "to"])

        moves = around.select("bucket", "codes_0", "n_0", "codes_1", "n_1").mapInArrow(run, "w int, to int").toArrow().to_pandas()  # a row for a held word at most
        after = classes.copy()
        after[moves["w"].to_numpy(int)] = moves["to"].to_numpy(int)
        moved = _class_grid(pairs, after)
        better = likelihood(moved) > likelihood(grid)
        classes, grid, idle = (after, moved, 0) if better else (classes, grid, idle + 1)
        if idle == 2:  # neither half of the words gains
            break
    if m:
        discard(around)
    return classes, grid


def held_words(counts: DataFrame) -> tuple[list[bytes], list[int]]:
    """The most frequent words and how often they occur, HELD at most."""
    held = counts.orderBy(F.desc("n"), "word").limit(HELD).toArrow().to_pandas()
    return [bytes(w) for w in held["word"]], held["n"].astype(int).tolist()


def fit(texts: DataFrame, counts: DataFrame, words: list[bytes], often: list[int], n_texts: int) -> ClassModel:
    """Learn from the symbols of training texts, their words' counts and the held words."""
    pairs = materialize(symbol_pairs(texts), "pairs")
    m = sum(n >= OFTEN for n in often)
    classes, grid = exchange(pairs, first_classes(words, m), m)
    discard(pairs)
    ending = (F.crc32(F.substring("word", -3, 3)) % ENDINGS).alias("e")
    total, types = np.zeros(CLASSES), np.zeros(CLASSES)
    all_tokens = all_types = 0
    for r in counts.groupBy(ending).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        total[MOVABLE + r.e], types[MOVABLE + r.e] = r.n, r.v
        all_tokens, all_types = all_tokens + r.n, all_types + r.v
    for i, (w, n) in enumerate(zip(words, often)):
        for table, x in ((total, n), (types, 1)):
            table[ending_class(w)] -= x
            table[classes[i]] += x
    total[END], tokens = n_texts, all_tokens + n_texts
    share = (total + 1) / (total + 1).sum()
    before = grid.sum(axis=1, keepdims=True)
    transition = np.log10((grid + PRIOR * share[None]) / (before + PRIOR))
    mass = np.log10(total + types + 1)
    mass[END] = 0.0  # the end is all that its class emits
    word_class = dict(zip(words, classes[: len(words)].tolist()))
    return ClassModel(word_class, dict(zip(words, np.log10(np.array(often, float) + 1).tolist())), transition, mass, tokens, all_types + (n_texts > 0), n_texts)


def _scored(texts: DataFrame, model: ClassModel) -> DataFrame:
    """(doc_id, text_id, texts, tokens, known, base, model) of each text: what its held words and transitions give."""
    n = len(model.word_class)
    symbol_class = np.concatenate([np.array([*model.word_class.values()], np.int64), np.zeros(HELD - n, np.int64), MOVABLE + np.arange(ENDINGS)])
    log_count = np.concatenate([np.array([*model.log_count.values()], float), np.zeros(HELD + ENDINGS - n)])
    end_log, transition, mass, ends_known = float(np.log10(model.texts + 1)), model.transition, model.mass, int(model.texts > 0)

    @giving_back
    def run(batches):
        for b in batches:
            known, base, path = [], [], []
            for symbols in b.column(3).to_pylist():
                at = np.frombuffer(symbols, "<u2")
                cls = np.concatenate([[END], symbol_class[at], [END]])
                logs = float(log_count[at].sum())
                known.append(int((at < HELD).sum()) + ends_known)
                base.append(logs + end_log)
                path.append(logs + float(transition[cls[:-1], cls[1:]].sum() - mass[cls[1:-1]].sum()))
            ones = np.ones(len(known), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ones), b.column(2), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(path, pa.float64())], ["doc_id", "text_id", "texts", "tokens", "known", "base", "model"])

    return texts.select("doc_id", "text_id", "tokens", "symbols").mapInArrow(run, "doc_id long, text_id long, texts long, tokens long, known long, base double, model double")


def learned(docs: DataFrame, folds: int = 7, held_fold: int = 2) -> tuple[ClassModel, DataFrame, DataFrame]:
    """The model of the documents that aren't held out, all texts as coded() gives them, and the training words' counts."""
    bounded_batches(docs.sparkSession)
    train = crc_mod(F.col("doc_id"), folds) != held_fold
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"), train.alias("train"))
    counts = materialize(word_counts(rows.filter("train").select("body")), "words")
    words, often = held_words(counts)
    texts = materialize(coded(rows, words), "coded")
    own = texts.filter("train")
    return fit(own, counts, words, often, own.count()), texts, counts


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    The model is learned from the documents that aren't held out (crc32 of doc_id as text, modulo folds, is held_fold).
    A word's probability is that of its class after the class before, times (count + 1) / (tokens + words + 1) in its
    class; base_score takes (count + 1) / (N + V + 1). One unknown word has count 0, in either; the end of the text is a
    token of its own class. Null texts are empty, and have the end only. Rows that repeat doc_id and text are scored each; a
    null doc_id counts as empty text in the hash. An empty table gives no rows; with nothing to learn, all is unknown.
    """
    model, texts, counts = learned(docs, folds, held_fold)
    words = texts.select("doc_id", "text_id", F.explode("rare").alias("r")).select("doc_id", "text_id", "r.word", "r.times")
    met = words.join(counts.select("word", "n"), "word").select("doc_id", "text_id", (F.col("times") * F.log10(F.col("n") + 1)).alias("gain"), F.col("times").alias("met"))
    nothing = {"texts": "long", "tokens": "long", "known": "long", "base": "double", "model": "double"}
    own = _scored(texts, model).withColumns({"gain": F.lit(0.0), "met": F.lit(0).cast("long")})
    every = own.unionByName(met.withColumns({c: F.lit(0).cast(t) for c, t in nothing.items()}))
    sums = every.groupBy("doc_id", "text_id").agg(*(F.sum(x).alias(x) for x in (*nothing, "gain", "met")))
    one = {x: (F.col(x) / F.col("texts")) for x in ("tokens", "known", "base", "model", "gain", "met")}
    whole = {x: one[x].cast("long") for x in ("tokens", "known", "met")}
    floor = float(np.log10(model.train_tokens + model.types + 1))
    each = sums.select("*", F.explode(F.array_repeat(F.lit(0), F.col("texts").cast("int"))))  # rows that are repeated come back
    return each.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held_fold).alias("held_out"), whole["tokens"].alias("n_tokens"), (whole["known"] + whole["met"]).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), (one["base"] + one["gain"] - whole["tokens"] * floor).alias("base_score"), (one["model"] + one["gain"]).alias("score"))
