"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling, over words and their characters."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, giving_back, mix, word_hashes

#: Words of a window, and from one window to the next.
WINDOW, STEP = 64, 48
#: Rows of the embeddings of words and of character trigrams (both hashed), numbers in each; states of a direction; attention.
SLOTS, DIM, HIDDEN, ATTEND = 1 << 14, 16, 16, 16
#: Labelled documents of each label that the network is fitted on at most, windows of each, bytes of a word in those.
SAMPLE, SAMPLE_WINDOWS, SAMPLE_WORD = 2000, 16, 64
#: A word has an embedding of its own if so many documents of the sample have it; others come by their trigrams alone.
COMMON = 5
#: Passes over the sample, the first ones over windows at random; documents of a step.
EPOCHS, RANDOM_EPOCHS, TOGETHER, RATE = 8, 2, 64, 0.004
#: Share of a window's words that a step doesn't see; decay of parameters.
DROPPED, DECAY = 0.2, 0.05
#: Share of the sample that scores are calibrated on instead.
CALIBRATION = 6
#: Windows whose states are computed at once.
CHUNK = 2048
#: Scores from here on are predicted as toxic.
THRESHOLD = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case buffer, and start, end and text of each word: runs of letters, digits and characters beyond ASCII."""
    low = _LOWER[buf]
    inside = np.concatenate([[False], _LETTER[low], [False]])
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True  # a word ends with its text
    begins = inside[1:] & (~inside[:-1] | cut)
    ends = inside[:-1] & (~inside[1:] | cut)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return low, start, end, np.searchsorted(offsets, start, side="right") - 1


def window_starts(sizes: np.ndarray, window: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all windows of texts of so many words: every `step` words, the last one up to the end.

    A text of fewer words than a window has one; so has one without words.
    """
    count = 1 + np.maximum(0, -(-(sizes - window) // step))
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, np.maximum(0, np.minimum(nth * step, sizes[text] - window))


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place of the hyperbolic tangent: a few times cheaper, with the slope (1 - |s|)**2."""
    return x / (1 + np.abs(x))


class Lexicon:
    """Distinct words of a batch: the embedding rows of each, and of each one's character trigrams."""

    def __init__(self, low: np.ndarray, start: np.ndarray, end: np.ndarray):
        hashes = word_hashes(low, start, end)
        distinct, first, self.ids = np.unique(hashes, return_index=True, return_inverse=True)
        s, size = start[first], end[first] - start[first]
        self.word = (distinct % np.uint64(SLOTS)).astype(np.int64)
        # each word between two marks that no UTF-8 text has
        to = np.concatenate([[0], np.cumsum(size + 2)])
        at = np.repeat(s - 1 - to[:-1], size + 2) + np.arange(to[-1])
        marked = low[np.clip(at, 0, max(0, len(low) - 1))] if len(at) else np.empty(0, np.uint8)
        marked[to[:-1]] = 254
        marked[to[1:] - 1] = 255
        wide = marked.astype(np.uint64)
        grams = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:] if len(wide) > 2 else np.empty(0, np.uint64)
        grams = (mix(grams + np.uint64(1 << 24)) % np.uint64(SLOTS)).astype(np.int64)
        self.size = size  # a word has as many trigrams as bytes
        keep = np.repeat(to[:-1], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.grams = grams[keep] if len(keep) else np.empty(0, np.int64)
        self.first = np.cumsum(size) - size

    def part(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, trigram rows and trigram counts of some of the words."""
        size = self.size[words]
        at = np.repeat(self.first[words] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.word[words], self.grams[at], size


class Network:
    """Embeddings of words and trigrams, two gated recurrent layers (left to right, right to left), attention, one logit."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        normal = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        h, d = HIDDEN, 2 * DIM
        self.words, self.grams = normal(0.05, SLOTS, DIM), normal(0.1, SLOTS, DIM)
        self.inner = {"wx": normal(d**-0.5, d, 6 * h), "b": np.zeros(6 * h, np.float32), "u": normal(h**-0.5, 2, h, 3 * h), "a": normal((2 * h) ** -0.5, 2 * h, ATTEND), "v": normal(0.3, ATTEND), "w": normal(0.3, 2 * h), "c": np.zeros(1, np.float32)}
        self.common = np.ones(SLOTS, bool)
        self.scale = np.array([1.0, 0.0], np.float64)  # calibration of the logit

    def inputs(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The input of each word: its own embedding, and the mean of its trigrams'."""
        word, grams, size = rows
        out = np.empty((len(word), 2 * DIM), np.float32)
        out[:, :DIM] = self.words[word] * self.common[word, None]
        if len(word):
            out[:, DIM:] = np.add.reduceat(self.grams[grams], np.cumsum(size) - size) / size[:, None].astype(np.float32)
        return out

    def states(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States (positions, windows, 2 HIDDEN) of windows of word numbers; mask says where a window has a word."""
        h, (n, t) = HIDDEN, ids.shape
        gate = (x @ self.inner["wx"] + self.inner["b"]).reshape(-1, 2, 3 * h).transpose(1, 0, 2)
        gate = np.ascontiguousarray(gate)
        u, state, out, trail = self.inner["u"], np.zeros((2, n, h), np.float32), np.empty((t, n, 2 * h), np.float32), []
        for i in range(t):
            j = t - 1 - i
            g = np.stack([gate[0].take(ids[:, i], axis=0), gate[1].take(ids[:, j], axis=0)])
            m = np.stack([mask[:, i], mask[:, j]])[:, :, None]
            s = np.matmul(state, u)
            zr = 0.5 + 0.5 * _soft(g[:, :, : 2 * h] + s[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            new = _soft(g[:, :, 2 * h :] + r * s[:, :, 2 * h :])
            step = m * (1 - z)
            if keep:
                trail.append((state, s[:, :, 2 * h :], z, r, new, m))
            state = state + step * (new - state)
            out[i, :, :h], out[j, :, h:] = state[0], state[1]
        return out, trail

    def pooled(self, out: np.ndarray, mask: np.ndarray):
        """Attention over the positions of each window: (logits, what the gradient needs)."""
        p = self.inner
        u = _soft(out @ p["a"])
        s = np.where(mask.T, u @ p["v"], -1e9)
        weight = np.exp(s - s.max(axis=0)) * mask.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        c = (weight[:, :, None] * out).sum(axis=0)
        return c @ p["w"] + p["c"], (u, weight, c)

    def logits(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(ids), CHUNK):
            m = mask[at : at + CHUNK].astype(np.float32)
            out, _ = self.states(x, ids[at : at + CHUNK], m)
            parts.append(self.pooled(out, m > 0)[0])
        return np.concatenate(parts) if parts else np.empty(0, np.float32)

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Gradients of the mean cross-entropy of the windows: by parameter, and by word input."""
        h, p, n = HIDDEN, self.inner, len(ids)
        out, trail = self.states(x, ids, mask.astype(np.float32), True)
        logit, (u, weight, c) = self.pooled(out, mask)
        d = ((1 / (1 + np.exp(-logit)) - y) / n).astype(np.float32)
        g = {"w": c.T @ d, "c": d.sum(keepdims=True)}
        dc = d[:, None] * p["w"]
        dweight = (out * dc[None]).sum(axis=2)
        ds = weight * (dweight - (weight * dweight).sum(axis=0))
        du = ds[:, :, None] * p["v"] * (1 - np.abs(u)) ** 2
        g["v"] = np.einsum("tna,tn->a", u, ds)
        g["a"] = np.einsum("tnh,tna->ha", out, du)
        dout = weight[:, :, None] * dc[None] + du @ p["a"].T
        t = ids.shape[1]
        dgate, dstate = np.zeros((2, len(x), 3 * h), np.float32), np.zeros((2, n, h), np.float32)
        du_ = np.zeros_like(p["u"])
        for i in range(t - 1, -1, -1):
            j = t - 1 - i
            state, sn, z, r, new, m = trail[i]
            dstate = dstate + np.stack([dout[i, :, :h], dout[j, :, h:]])
            dnew = dstate * m * (1 - z) * (1 - np.abs(new)) ** 2
            dz = -dstate * m * (new - state) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dnew * sn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            pre = np.concatenate([dz, dr, dnew * r], axis=2)
            du_ += np.matmul(state.transpose(0, 2, 1), pre)
            dstate = dstate * (1 - m * (1 - z)) + np.matmul(pre, p["u"].transpose(0, 2, 1))
            dg = np.concatenate([dz, dr, dnew], axis=2)
            np.add.at(dgate[0], ids[:, i], dg[0])
            np.add.at(dgate[1], ids[:, j], dg[1])
        flat = dgate.transpose(1, 0, 2).reshape(len(x), 6 * h)
        g |= {"u": du_, "wx": x.T @ flat, "b": flat.sum(axis=0)}
        return g, flat @ p["wx"].T

    def __call__(self, logit: np.ndarray) -> np.ndarray:
        """Probabilities of calibrated logits."""
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit + self.scale[1], -40, 40)))


class _Adam:
    """Adam steps; of the embeddings, rows that a step didn't touch stay as they are."""

    def __init__(self, net: Network):
        self.net, self.t = net, 0
        whole = {**net.inner, "words": net.words, "grams": net.grams}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in whole.items()} for _ in range(2))
        self.whole = whole

    def _move(self, k: str, at, g: np.ndarray, rate: float) -> None:
        m, v = self.m[k], self.v[k]
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        self.whole[k][at] -= rate * DECAY * self.whole[k][at] + rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-6)

    def step(self, g: dict[str, np.ndarray], dx: np.ndarray, rows, rate: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        shrink = min(1.0, 5.0 / max(norm, 1e-9))
        for k, x in g.items():
            self._move(k, ..., x * shrink, rate)
        word, grams, size = rows
        known = self.net.common[word]
        for k, at, d in (("words", word[known], dx[known, :DIM]), ("grams", grams, np.repeat(dx[:, DIM:] / size[:, None], size, axis=0))):
            order = np.argsort(at, kind="stable")
            touched, first = np.unique(at[order], return_index=True)  # sums for each row, in a fixed order
            if len(touched):
                self._move(k, touched, np.add.reduceat(d[order], first) * shrink, rate)


def _grid(first: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of windows (their text's first word + start), and where they have one."""
    place = np.arange(WINDOW)
    mask = start[:, None] + place < size[:, None]
    if not len(ids):
        return np.zeros(mask.shape, np.int64), mask
    return ids[np.where(mask, (first + start)[:, None] + place, 0)], mask


def fit(windows: list[list[str]], labels: list[int], prior: float, seed: int = 5) -> Network:
    """A network from documents, each a list of windows of space-joined words, and their labels.

    Toxic words may be in some windows only: after passes over windows at random, a document is learned by the window with
    the highest logit. Every CALIBRATION-th document is kept for the calibration of the highest logits, with classes weighted to
    the prior. Without documents of both labels every score is the prior.
    """
    net, y = Network(seed), np.array(labels, np.float32)
    base = min(max(prior, 1e-3), 1 - 1e-3)
    if len(set(labels)) < 2:
        net.scale = np.array([0.0, np.log(base / (1 - base))])
        return net
    texts = [w.encode() for doc in windows for w in doc]
    owner = np.repeat(np.arange(len(windows)), [len(d) for d in windows])
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    low, start, end, text = words_of(np.frombuffer(b" ".join([*texts, b""]), np.uint8), offsets)
    lexicon = Lexicon(low, start, end)
    size = np.bincount(text, minlength=len(texts))
    ids, mask = _grid(np.cumsum(size) - size, np.zeros(len(texts), np.int64), size, lexicon.ids)
    bounds = np.searchsorted(owner, np.arange(len(windows) + 1))
    pairs = np.unique(owner[text] * SLOTS + lexicon.word[lexicon.ids])
    net.common = np.bincount(pairs % SLOTS, minlength=SLOTS) >= COMMON
    r, adam = np.random.default_rng(seed), _Adam(net)
    kept = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    classes = [np.flatnonzero((y == c) & ~kept) for c in (0, 1)]
    if min(map(len, classes)) == 0:
        kept[:] = False
        classes = [np.flatnonzero(y == c) for c in (0, 1)]

    def logits(rows: np.ndarray) -> np.ndarray:
        some, at = np.unique(ids[rows], return_inverse=True)
        return net.logits(net.inputs(lexicon.part(some)), at.reshape(len(rows), -1), mask[rows])

    half, steps = TOGETHER // 2, max(6, -(-max(map(len, classes)) // (TOGETHER // 2)))
    for epoch in range(EPOCHS):
        deals = [np.concatenate([r.permutation(c) for _ in range(-(-steps * half // len(c)))])[: steps * half].reshape(steps, half) for c in classes]
        rate = RATE * (1 - epoch / EPOCHS) + RATE / 20
        for pair in zip(*deals):
            docs = np.concatenate(pair)
            if epoch < RANDOM_EPOCHS:
                rows = bounds[docs] + (r.random(len(docs)) * (bounds[docs + 1] - bounds[docs])).astype(np.int64)
            else:
                count = bounds[docs + 1] - bounds[docs]
                every = np.repeat(bounds[docs] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                found = logits(every)
                which = np.repeat(np.arange(len(docs)), count)
                order = np.lexsort((-found, which))
                rows = every[order[np.concatenate([[0], np.cumsum(count)[:-1]])]]
            some, at = np.unique(ids[rows], return_inverse=True)
            part = lexicon.part(some)
            seen = mask[rows] & (r.random((len(rows), WINDOW)) >= DROPPED)
            g, dx = net.gradients(net.inputs(part), at.reshape(len(rows), -1), seen, y[docs])
            adam.step(g, dx, part, rate)
    docs = np.flatnonzero(kept) if kept.any() else np.arange(len(y))
    best = np.maximum.reduceat(logits(np.arange(len(texts))), bounds[:-1])[docs].astype(float)
    net.scale = _calibrated(best, y[docs].astype(float), base)
    return net


def _calibrated(logit: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Slope and offset of a logistic regression on the logits, classes weighted to the prior, by Newton's method."""
    weight = np.where(y == 1, prior / max(1.0, y.sum()), (1 - prior) / max(1.0, (1 - y).sum())) * len(y)
    design = np.stack([logit, np.ones_like(logit)], axis=1)
    # a weak pull towards the logits as they are holds where the classes are apart
    pull, to = np.array([2.0, 0.2]), np.array([1.0, 0.0])

    def cost(at: np.ndarray) -> float:
        x = design @ at
        return float((weight * (np.logaddexp(0, x) - y * x)).sum() + 0.5 * (pull * (at - to) ** 2).sum())

    at = to
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (weight * (p - y)) + pull * (at - to)
        move = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(pull), slope)
        size = 1.0
        while size > 1e-6 and cost(at - size * move) > cost(at):
            size /= 2
        at = at - size * move
        if np.abs(size * move).max() < 1e-8 or size <= 1e-6:
            break
    return np.array([max(at[0], 0.05), at[1]])


def score_texts(net: Network, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the highest probability over all of its overlapping windows."""
    low, start, end, text = words_of(buf, offsets)
    size = np.bincount(text, minlength=len(offsets) - 1)
    owner, at = window_starts(size)
    lexicon = Lexicon(low, start, end)
    x = net.inputs((lexicon.word, lexicon.grams, lexicon.size)) if len(start) else np.zeros((1, 2 * DIM), np.float32)
    first, logit = np.cumsum(size) - size, np.empty(len(owner), np.float32)
    for lo in range(0, len(owner), CHUNK * 8):
        some = slice(lo, lo + CHUNK * 8)
        ids, mask = _grid(first[owner[some]], at[some], size[owner[some]], lexicon.ids)
        logit[some] = net.logits(x, ids, mask)
    return net(np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(len(offsets) - 1))).astype(float))


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def training_windows(docs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(y, h, windows) of at most SAMPLE labelled documents of each label, those of the smallest hashes."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    some = [marked.filter(F.col("y") == c).orderBy(F.xxhash64("k"), "k").limit(SAMPLE) for c in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 SAMPLE rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = _buffer(b.column(2))
            low, start, end, text = words_of(buf, offsets)
            first = np.searchsorted(text, np.arange(len(offsets)))
            out = []
            for i in range(b.num_rows):
                _, at = window_starts(np.array([first[i + 1] - first[i]]))
                at = at[np.unique(np.linspace(0, len(at) - 1, min(len(at), SAMPLE_WINDOWS)).round().astype(int))] + first[i]
                out.append([" ".join(low[start[w] : min(end[w], start[w] + SAMPLE_WORD)].tobytes().decode("utf-8", "ignore") for w in range(a, min(a + WINDOW, first[i + 1]))) for a in at])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], ["y", "h", "windows"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    joined = docs.select(F.col("doc_id").alias("k"), text).join(chosen, "k").select("y", F.xxhash64("k", "text").alias("h"), "text")
    # ids may repeat, so rows are bounded again
    return joined.mapInArrow(run, "y int, h long, windows array<string>").orderBy("h", "windows").limit(2 * SAMPLE)


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, from a network that learned rows which aren't held out.

    held_out: crc32 of doc_id as text, modulo folds, is `held` (a null doc_id counts as empty text). A score is the highest
    calibrated probability over all windows of WINDOW words, STEP words apart, of the whole text; it depends on the text alone. Null,
    empty and wordless texts are one window without words. Labels that are null or neither 0 nor 1 are left out, of several for one
    doc_id the largest counts; without labels of both kinds all scores are the share of toxic ones (0.001 at least). An empty table
    gives no rows; repeated rows get equal scores, other columns take no part.

    The network is fitted in one task on at most SAMPLE documents of each label and SAMPLE_WINDOWS windows of each; its size is
    fixed, about 2 MB. Scoring shuffles nothing.
    """
    bounded_batches(docs.sparkSession)
    open_ = labels.filter(crc_mod(F.col("doc_id"), folds) != held)
    prior = open_.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        model = fit([r["windows"] for r in rows], [r["y"] for r in rows], prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fitted = training_windows(docs, open_, "doc_id", label).mapInArrow(learn, "model binary").collect()
    net = pickle.loads(fitted[0].model) if fitted else fit([], [], prior)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = score_texts(net, *_buffer(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
