"""Hidden Markov models over tracks: posteriors and state paths by blocks, training, stationary distributions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackengine.functions.distributions import Distribution, log_density

from .estimate import gridded, updated
from .scans import BLOCK, blocked, by_blocks, chained
from .track import Track
from .windows import frames

#: State paths are compared in whole units of log probability, so many for one; what is impossible costs FAR units.
UNITS, FAR = 1e9, -(1 << 60)


@dataclass(frozen=True)
class Hmm:
    """Start and transition probabilities (rows to columns), an emission for each state, names of the states if any."""

    pi: np.ndarray
    tr: np.ndarray
    emissions: tuple[Distribution, ...]
    names: tuple[str, ...] = ()

    @classmethod
    def from_json(cls, doc: dict) -> "Hmm":
        p = doc["Parameters"]
        n = int(p["N"])
        return cls(np.array(p["Pi"], float), np.array(p["Tr"], float).reshape(n, n), tuple(Distribution.from_json(d) for d in doc["Distributions"]), tuple(map(str, p.get("StateMap") or ())))

    def to_json(self) -> dict:
        """The document that from_json() reads."""
        p = {"N": len(self.pi), "Pi": self.pi.tolist(), "Tr": self.tr.ravel().tolist(), "StateMap": list(self.names)}
        return {"Name": "vector:hidden markov model", "Parameters": p, "Distributions": [d.to_json() for d in self.emissions]}


def stationary(tr: np.ndarray) -> np.ndarray:
    """The distribution that the transitions keep, from the eigenvector of eigenvalue one."""
    values, vectors = np.linalg.eig(np.asarray(tr, float).T)
    near = np.abs(values - 1) < 1e-9
    if not near.any():
        raise ValueError("no eigenvalue of one")
    v = np.real(vectors[:, np.flatnonzero(near)[0]])
    return v / v.sum()


def moves(track: Track, n: int) -> DataFrame:
    """(i, j, n): how often a bin of state i is followed by one of state j, for a track of the states 0 to n - 1.

    Neighbours meet by blocks; only a block's first bin looks into the block before it. Masked bins and other values have no part.
    """
    ok = ~F.isnan("value") & F.col("value").isin([float(i) for i in range(n)])
    rows = frames(track.df.filter(ok), 1, 0, values="value", keep_bins=True)
    pairs = rows.filter((F.size("win") == 2) & (F.get("win", F.lit(0))["bin"] == F.col("bin") - 1))
    state = lambda k: F.get("win", F.lit(k))["value"].cast("int")
    return pairs.groupBy(state(0).alias("i"), state(1).alias("j")).agg(F.count("*").alias("n"))


def as_mixture(hmm: Hmm) -> Hmm:
    """The model with the stationary distribution as start and as every row of the transitions."""
    p = stationary(hmm.tr)
    return Hmm(p, np.tile(p, (len(p), 1)), hmm.emissions, hmm.names)


def _emit(hmm: Hmm, x: np.ndarray) -> np.ndarray:
    """Log emissions, bins by states; a masked bin says nothing."""
    values, inverse = np.unique(np.nan_to_num(x, nan=0.0), return_inverse=True)
    logs = np.array([log_density(d)(values) for d in hmm.emissions]).T[inverse]
    logs[np.isnan(x)] = 0.0
    return logs


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors (the last axis) that sum to one; even ones where all are zero."""
    s = v.sum(axis=-1, keepdims=True)
    return np.where(s > 0, v / np.where(s > 0, s, 1), 1 / v.shape[-1])


def _lanes(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block (bins by states) as lanes of about as many bins as there are lanes, and which of them are bins.

    A block's recursions go through all lanes at once; then lanes are chained.
    """
    n, k = e.shape
    t = max(1, math.isqrt(max(n - 1, 0)) + 1)
    lanes = -(-n // t)
    out = np.zeros((lanes * t, k), e.dtype)
    out[:n] = e
    return out.reshape(lanes, t, k), (np.arange(lanes * t) < n).reshape(lanes, t)


def _weights(hmm: Hmm, x: np.ndarray) -> np.ndarray:
    """Emissions of each bin, bins by states, the largest of a bin one."""
    logs = _emit(hmm, x)
    top = logs.max(axis=1, keepdims=True)
    return np.exp(logs - np.where(np.isfinite(top), top, 0))


def _products(hmm: Hmm, e: np.ndarray, there: np.ndarray) -> np.ndarray:
    """For each lane the scaled product of its steps: from its first state to its last one, emissions of both included."""
    out = e[:, 0, :, None] * np.eye(e.shape[2])
    for t in range(1, e.shape[1]):
        new = (out @ hmm.tr) * e[:, t, None, :]
        new /= np.maximum(new.max(axis=(1, 2), keepdims=True), 1e-300)
        out = np.where(there[:, t, None, None], new, out)
    return out


def _summary(hmm: Hmm, x: np.ndarray) -> np.ndarray:
    """The product of a block's steps, by rows."""
    lanes = _products(hmm, *_lanes(_weights(hmm, x)))
    out = lanes[0]
    for p in lanes[1:]:
        out = out @ hmm.tr @ p
        out /= max(out.max(), 1e-300)
    return out.ravel()


def _ends(hmm: Hmm, products: list[np.ndarray], before: np.ndarray | None, after: np.ndarray) -> tuple[list, list]:
    """For each product what is known of the state before its first bin (None at a sequence's start), and after its last one."""
    ahead, v = [], before
    for p in products:
        ahead.append(v)
        v = _scaled((hmm.pi if v is None else v @ hmm.tr) @ p)
    behind, w = [], after
    for p in reversed(products):
        behind.append(w)
        w = _scaled(hmm.tr @ (p @ w))
    return ahead, behind[::-1]


def _smooth(hmm: Hmm, x: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of a block's states, and expected transitions, from what comes before and after it."""
    flat = _weights(hmm, x)
    e, there = _lanes(flat)
    n, k = flat.shape
    ahead, behind = _ends(hmm, list(_products(hmm, e, there)), before, after)
    a, b = np.empty_like(e), np.empty_like(e)
    prior = np.array([hmm.pi if v is None else v @ hmm.tr for v in ahead])
    for t in range(e.shape[1]):
        a[:, t] = _scaled(prior * e[:, t])
        prior = a[:, t] @ hmm.tr
    b[:, -1] = np.array(behind)
    for t in range(e.shape[1] - 2, -1, -1):
        new = _scaled((e[:, t + 1] * b[:, t + 1]) @ hmm.tr.T)
        b[:, t] = np.where(there[:, t + 1, None], new, b[:, t + 1])
    a, b = a.reshape(-1, k)[:n], b.reshape(-1, k)[:n]
    post = _scaled(a * b)
    first = 1 if before is None else 0
    prev, now = (a[:-1] if before is None else np.concatenate([before[None], a[:-1]])), (flat * b)[first:]
    size = ((prev @ hmm.tr) * now).sum(axis=1, keepdims=True)
    return post, hmm.tr * ((prev / np.maximum(size, 1e-300)).T @ now)


def _chain(hmm: Hmm):
    k = len(hmm.pi)

    def chain(sums):
        before, after = _ends(hmm, [s.reshape(k, k) for s in sums], None, np.full(k, 1 / k))
        return before, after

    return chain


def posteriors(track: Track, hmm: Hmm, block: int = BLOCK) -> DataFrame:
    """(seqname, bin, p): the posterior probability of each state at each bin; masked bins carry no evidence."""
    rows = blocked(track.df, block)

    def run(pdf: pd.DataFrame, before, after) -> pd.DataFrame:
        post, _ = _smooth(hmm, pdf["value"].to_numpy(float), before, after)
        return pd.DataFrame({"seqname": pdf["seqname"], "bin": pdf["bin"], "p": list(post)})

    return by_blocks(rows, chained(rows, lambda x: _summary(hmm, x), _chain(hmm), "value"), run, "seqname string, bin int, p array<double>")


# Most probable paths ----------------------------------------------------------


def _units(p: np.ndarray) -> np.ndarray:
    """Log probabilities in whole units, so that sums are exact whatever their order and equal paths tie."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(np.log(np.where(p > 0, p, 1)) * UNITS), FAR).astype(np.int64)


def _emission_units(hmm: Hmm, x: np.ndarray) -> np.ndarray:
    """Emissions in units. Masked bins say nothing, and neither do bins that no state can give."""
    logs = _emit(hmm, x)
    logs[~np.isfinite(logs).any(axis=1)] = 0.0
    finite = np.isfinite(logs)
    return np.where(finite, np.round(np.where(finite, logs, 0) * UNITS), FAR).astype(np.int64)


def _best(scores: np.ndarray) -> np.ndarray:
    """Scores by the last axis with the largest one at zero; what is out of reach stays at FAR."""
    top = scores.max(axis=-1, keepdims=True)
    return np.maximum(scores - np.where(top > FAR // 2, top, 0), FAR)


def _as_doubles(scores: np.ndarray) -> np.ndarray:
    """Scores as doubles, two for each, which hold all their bits."""
    return np.concatenate([scores >> 32, scores & 0xFFFFFFFF]).astype(float)


def _as_scores(doubles: np.ndarray) -> np.ndarray:
    high, low = np.split(doubles.astype(np.int64), 2)
    return (high << 32) + low


def _longest(hmm_tr: np.ndarray, e: np.ndarray, there: np.ndarray) -> np.ndarray:
    """For each lane the score of its best path from each first state to each last one (a product of max and plus)."""
    k = e.shape[2]
    out = np.where(np.eye(k, dtype=bool), e[:, 0, :, None], FAR)
    for t in range(1, e.shape[1]):
        new = np.maximum((out[:, :, :, None] + hmm_tr).max(axis=2) + e[:, t, None, :], FAR)
        out = np.where(there[:, t, None, None], new, out)
    return out


def _lane_paths(tr: np.ndarray, e: np.ndarray, there: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Choices of each lane (lane, bin, state): the state before, from the scores of the states at its first bin.

    Of equal scores the smaller state is chosen. Bins that aren't there choose themselves. Also the scores at the last bins.
    """
    lanes, n, k = e.shape
    back = np.empty((lanes, n, k), np.int64)
    score = np.maximum(entry + e[:, 0], FAR)
    back[:, 0] = np.arange(k)
    for t in range(1, n):
        reach = score[:, :, None] + tr
        back[:, t] = np.where(there[:, t, None], reach.argmax(axis=1), np.arange(k))
        score = np.where(there[:, t, None], np.maximum(reach.max(axis=1) + e[:, t], FAR), score)
    return back, score


class _PathBlock:
    """One block: entry scores of its lanes, and the choices in them."""

    def __init__(self, hmm: Hmm, x: np.ndarray, before: np.ndarray | None):
        self.tr, self.n = _units(hmm.tr), len(x)
        e, there = _lanes(_emission_units(hmm, x))
        longest = _longest(self.tr, e, there)
        entry, into, v = [], [], None if before is None else _as_scores(before)
        for p in longest:
            # scores of the first bin's states, and the state before that each is reached from
            into.append(np.arange(len(hmm.pi)) if v is None else (v[:, None] + self.tr).argmax(axis=0))
            start = _units(hmm.pi) if v is None else np.maximum((v[:, None] + self.tr).max(axis=0), FAR)
            entry.append(start)
            v = _best(np.maximum((start[:, None] + p).max(axis=0), FAR))
        self.last = v
        self.back, _ = _lane_paths(self.tr, e, there, np.array(entry))
        self.into = np.array(into)

    def trace(self, ends: np.ndarray) -> np.ndarray:
        """States at each lane's bins (lane, bin, …) for the states at the lanes' last bins."""
        lanes, n, _ = self.back.shape
        out = np.empty((lanes, n, *ends.shape[1:]), np.int64)
        at = np.arange(lanes).reshape(-1, *[1] * (ends.ndim - 1))
        now = ends
        for t in range(n - 1, -1, -1):
            out[:, t] = now
            now = self.back[at, t, now]
        return out

    def origins(self) -> np.ndarray:
        """For each state at the last bin of the block, the state before its first bin."""
        k = self.back.shape[2]
        lanes = len(self.back)
        first = self.trace(np.tile(np.arange(k), (lanes, 1)))[:, 0]
        now = np.arange(k)
        for lane in range(lanes - 1, -1, -1):
            now = self.into[lane][first[lane][now]]
        return now

    def states(self, end: int) -> np.ndarray:
        """The path through the block to a state at its last bin."""
        k, lanes = self.back.shape[2], len(self.back)
        first = self.trace(np.tile(np.arange(k), (lanes, 1)))[:, 0]
        ends = np.empty(lanes, np.int64)
        now = end
        for lane in range(lanes - 1, -1, -1):
            ends[lane] = now
            now = self.into[lane][first[lane][now]]
        return self.trace(ends).reshape(-1)[: self.n]


def paths(track: Track, hmm: Hmm, block: int = BLOCK) -> DataFrame:
    """(seqname, bin, state): the most probable sequence of states (from 0) given all of a sequence's values.

    Of equal choices the smaller state is taken, from the last bin on backwards; log probabilities are rounded to 1e-9, so sums are
    exact and the blocks make no difference. Masked bins carry no evidence, and neither do values that no state can have. Blocks
    are summed up to a matrix of best scores each; chained, those give every block the scores before it; each block then
    tells for any state at its end where its path came from, which chained from the end gives the states at block ends; then blocks are
    traced in parallel. Only matrices and states of block ends are gone through by sequence.
    """
    k = len(hmm.pi)
    rows = blocked(track.df, block)

    def summary(x: np.ndarray) -> np.ndarray:
        tr, lanes = _units(hmm.tr), _longest(_units(hmm.tr), *_lanes(_emission_units(hmm, x)))
        out = lanes[0]
        for p in lanes[1:]:
            step = np.maximum((out[:, :, None] + tr).max(axis=1), FAR)
            out = np.maximum((step[:, :, None] + p).max(axis=1), FAR)
        return _as_doubles(_best(out.ravel()))

    def forward(sums):
        before, v = [], None
        for s in sums:
            before.append(None if v is None else _as_doubles(v))
            start = _units(hmm.pi) if v is None else np.maximum((v[:, None] + _units(hmm.tr)).max(axis=0), FAR)
            v = _best(np.maximum((start[:, None] + _as_scores(s).reshape(k, k)).max(axis=0), FAR))
        return before, [None] * (len(sums) - 1) + [_as_doubles(v)]

    ends = chained(rows, summary, forward, "value")

    def origins(pdf: pd.DataFrame, before, after) -> pd.DataFrame:
        # of the last block the best state at its end is known too
        best = -1.0 if after is None else float(_as_scores(after).argmax())
        found = _PathBlock(hmm, pdf["value"].to_numpy(float), before).origins()
        return pd.DataFrame({"seqname": pdf["seqname"][:1], "blk": pdf["blk"][:1], "before": [before], "s": [np.array([best, *found])]})

    maps = by_blocks(rows, ends, origins, "seqname string, blk long, before array<double>, s array<double>")

    def backward(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        out, now = [], 0
        for s in reversed(pdf["s"].tolist()):
            now = int(s[0]) if s[0] >= 0 else now
            out.append([float(now)])
            now = int(s[1 + now])
        return pd.DataFrame({"seqname": [key[0]] * len(pdf), "blk": pdf["blk"], "before": pdf["before"], "after": out[::-1]})

    ends = maps.groupBy("seqname").applyInPandas(backward, "seqname string, blk long, before array<double>, after array<double>")

    def trace(pdf: pd.DataFrame, before, after) -> pd.DataFrame:
        states = _PathBlock(hmm, pdf["value"].to_numpy(float), before).states(int(after[0]))
        return pd.DataFrame({"seqname": pdf["seqname"], "bin": pdf["bin"], "state": states})

    return by_blocks(rows, ends, trace, "seqname string, bin int, state int")


# Training ---------------------------------------------------------------------


def train_step(track: Track, hmm: Hmm, block: int = BLOCK) -> Hmm:
    """One Baum-Welch step. A block returns expected counts of transitions, of starts, and of each state's bins by their value.

    Values are added up over all blocks, where there are more than estimate.MAX_BINS of them on a grid; those sums, and a few numbers
    for each state, reach the driver.
    """
    k = len(hmm.pi)
    rows = blocked(track.df, block)

    def run(pdf: pd.DataFrame, before, after) -> pd.DataFrame:
        x = pdf["value"].to_numpy(float)
        post, moves = _smooth(hmm, x, before, after)
        seen = ~np.isnan(x)
        values, at = np.unique(x[seen], return_inverse=True)
        mass = np.array([np.bincount(at, p, len(values)) for p in post[seen].T]).reshape(k, -1).T
        start = post[0] if before is None else np.zeros(k)
        return pd.DataFrame({"x": [*values, np.nan], "n": [*mass, np.concatenate([moves.ravel(), start])]})  # NaN comes out as null

    parts = by_blocks(rows, chained(rows, lambda x: _summary(hmm, x), _chain(hmm), "value"), run, "x double, n array<double>").persist()
    add = lambda size: [F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(size)]
    try:
        sums = np.array(parts.filter("x IS NULL").agg(*add(k * k + k)).first(), float)
        hist = gridded(parts.filter("x IS NOT NULL").groupBy("x").agg(*add(k)), sums=[f"n{i}" for i in range(k)]).toArrow().to_pandas().sort_values("x")
    finally:
        parts.unpersist()
    tr, start = sums[: k * k].reshape(k, k), sums[k * k :]
    x = hist["x"].to_numpy(float)
    return Hmm(start / start.sum(), tr / tr.sum(axis=1, keepdims=True), tuple(updated(d, x, hist[f"n{i}"].to_numpy(float)) for i, d in enumerate(hmm.emissions)), hmm.names)
