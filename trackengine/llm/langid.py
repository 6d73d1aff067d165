"""Language proportions of documents by expectation-maximisation over letter trigrams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, give_back, giving_back, mix, spare

#: Trigrams are hashed to so many features; a model has one row of them for each language.
FEATURES = 1 << 15
#: Cells (features of texts by languages) that EM goes through at once, about.
CELLS = 1 << 20
#: Languages whose counts a task holds before it passes them on.
HELD_LANGUAGES = 256
#: A document of which no language has this share is not of one language.
MIN_SHARE = 0.5

_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 32 for what is no letter."""
    if not _TABLE:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def trigram_features(text: str | None) -> np.ndarray:
    """The hashed trigrams of a text's letters, in order; other characters are one space between words."""
    if not text:
        return np.empty(0, np.int64)
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    if not (codes != 32).any():
        return np.empty(0, np.int64)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    codes = codes[1:] if codes[1] == 32 else codes
    codes = codes[:-1] if codes[-2] == 32 else codes
    return (mix(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]) % np.uint64(FEATURES)).astype(np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, feature, n) over whole texts; counts are added up in each task before they are shuffled."""
    bounded_batches(docs.sparkSession)

    @giving_back
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(f := trigram_features(text)):
                    if lang not in sums:
                        sums[lang] = np.zeros(FEATURES, np.int64)
                    sums[lang] += np.bincount(f, minlength=FEATURES)
            if len(sums) > HELD_LANGUAGES:
                yield from flush(sums)
                sums = {}
        yield from flush(sums)

    def flush(sums):
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], ["lang", "feature", "n"])

    return docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their smoothed trigram probabilities, one row each, learned from lang and text alone.

    One pass over the texts. The model has 128 kB for each language, however many texts there are; there is no limit on
    languages but a worker's memory.
    """
    got = trigram_counts(docs.filter("lang IS NOT NULL")).toArrow()  # languages x features rows at most
    names, row = np.unique(np.array(got.column("lang").to_pylist(), object), return_inverse=True) if len(got) else ([], [])
    counts = np.zeros((len(names), FEATURES), np.float32)
    counts[row, got.column("feature").to_numpy()] = got.column("n").to_numpy()
    return list(names), ((counts + smoothing) / (counts.sum(axis=1, keepdims=True, dtype=float) + smoothing * FEATURES)).astype(np.float32)


def _proportions(weight: np.ndarray, p: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, need: np.ndarray | None = None, steps: int = 40, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: proportions of the allowed languages, and log-likelihoods.

    weight: count of each (document, feature), p: its probability in each language; sizes: features of each document.
    The likelihood is concave, so its gradient at any proportions bounds its maximum. A document whose bound is not above
    `need` is given up with a likelihood of -inf; one whose proportions stand still is done.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    shares, likelihood = share.copy(), np.full(len(sizes), -np.inf)
    live = np.arange(len(sizes))
    for step in range(steps + 1):
        starts = np.cumsum(sizes) - sizes
        total = np.add.reduceat(weight, starts)
        mixed = (p * np.repeat(share, sizes, axis=0)).sum(axis=1)
        slope = np.add.reduceat(p * (weight / mixed)[:, None], starts) * (allowed[live] > 0)
        new = share * slope / total[:, None]
        done = (np.abs(new - share).max(axis=1) < tol) | (step == steps)
        lost = np.zeros(len(live), bool)
        if need is not None and step % 4 == 0:
            lost = np.add.reduceat(weight * np.log(mixed), starts) + slope.max(axis=1) - total <= need[live]
        over = done & ~lost
        shares[live[over]] = new[over]
        if over.any():
            rows = np.repeat(over, sizes)
            fit = np.log((p[rows] * np.repeat(new[over], sizes[over], axis=0)).sum(axis=1))
            likelihood[live[over]] = np.add.reduceat(weight[rows] * fit, np.cumsum(sizes[over]) - sizes[over])
        stay = ~(done | lost)
        if not stay.any():
            break
        if not stay.all():
            rows = np.repeat(stay, sizes)
            weight, p, sizes, live, new = weight[rows], p[rows], sizes[stay], live[stay], new[stay]
        share = new
    return shares, likelihood


def infer(texts: list[str | None], model: np.ndarray, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each language in each text, zero outside the set of languages chosen for it; and which have letters.

    Sets are nested by the proportions that EM gives all languages. A set's score is its log-likelihood less penalty times
    log of the trigram count for each language in it; each further language must be worth that. Where all languages
    together aren't worth one more than the best single one, no set between is, and none is fitted.
    """
    out, has = np.zeros((len(texts), len(model))), np.zeros(len(texts), bool)
    held: list[tuple] = []
    cells = 0

    def flush():
        at, features, counts = zip(*held)
        has[list(at)] = True
        if len(model):
            out[list(at)] = _mixtures(features, counts, model, penalty)
        held.clear()

    for i, text in enumerate(texts):
        if len(found := trigram_features(text)):
            held.append((i, *np.unique(found, return_counts=True)))
            cells += len(held[-1][1]) * max(1, len(model))
        if cells > CELLS:
            flush()
            cells = 0
    if held:
        flush()
    return out, has


def _mixtures(features: Sequence[np.ndarray], counts: Sequence[np.ndarray], model: np.ndarray, penalty: float) -> np.ndarray:
    sizes = np.array([len(f) for f in features])
    starts = np.cumsum(sizes) - sizes
    weight = np.concatenate(counts).astype(float)
    p = model[:, np.concatenate(features)].T.astype(float)
    cost = penalty * np.log(np.add.reduceat(weight, starts) + 1)
    single = np.add.reduceat(weight[:, None] * np.log(p), starts)
    best = single.argmax(axis=1)
    score = single.max(axis=1) - cost
    share = np.zeros_like(single)
    share[np.arange(len(best)), best] = 1
    if len(model) == 1:
        return share
    full, top = _proportions(weight, p, sizes, np.ones_like(single), score + 2 * cost)
    for k in range(2, len(model) + 1):
        open_ = np.flatnonzero(top - k * cost > score)
        if not len(open_):
            break
        rows = np.repeat(np.isin(np.arange(len(sizes)), open_), sizes)
        allowed = (np.argsort(np.argsort(-full[open_], axis=1, kind="stable"), axis=1) < k).astype(float)
        part, fit = _proportions(weight[rows], p[rows], sizes[open_], allowed)
        won = fit - k * cost[open_] > score[open_]
        share[open_[won]], score[open_[won]] = part[won], (fit - k * cost[open_])[won]
    return share


def predictor(languages: list[str], model: np.ndarray) -> Callable[[Column], Column]:
    """text -> struct(lang_pred, score): the language with the largest share and that share; `und` and 0 without letters."""
    names = np.array([*languages, "und"], object)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            share, has = infer(list(texts), model)
            if not languages:
                yield pd.DataFrame({"lang_pred": ["und"] * len(has), "score": np.zeros(len(has))})
                continue
            best = np.where(has, share.argmax(axis=1), len(languages))
            yield pd.DataFrame({"lang_pred": names[best], "score": np.where(has, np.minimum(share.max(axis=1), 1.0), 0.0)})
        give_back()

    return predict


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, from models of the rows that aren't held out.

    held_out: crc32 of doc_id as text, modulo folds, is 0 (a null doc_id counts as empty text). Predictions see the text
    only. Null texts and texts without a letter are `und` with score 0; so is all if nothing can be learned.
    """
    bounded_batches(docs.sparkSession)
    held = crc_mod(F.col("doc_id"), folds) == 0
    predict = predictor(*fit_languages(docs.filter(~held).select("lang", "text")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, folds: int = 5, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs whose text is of a learned language by at least min_share; columns as they are."""
    bounded_batches(docs.sparkSession)
    held = crc_mod(F.col("doc_id"), folds) == 0
    predict = predictor(*fit_languages(docs.filter(~held).select("lang", "text")))
    (p,) = spare(docs, "p")
    found = docs.withColumn(p, predict("text")).filter((F.col(f"{p}.lang_pred") != "und") & (F.col(f"{p}.score") >= min_share))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))
