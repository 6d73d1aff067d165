"""Periodic runs of words, by Lyndon arrays whose comparisons reuse what earlier ones matched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, giving_back, word_bounds

#: A run is reported from so many words, and so many periods, on.
MIN_WORDS, MIN_PERIODS = 6, 4


def _matched(data: bytes, i: int, j: int, known: int, n: int) -> int:
    """How many symbols (4 bytes each) from i on equal those from j > i on, if `known` are known to; steps double, then halve."""
    l, step = known, 1
    while j + l + step <= n and data[4 * (i + l) : 4 * (i + l + step)] == data[4 * (j + l) : 4 * (j + l + step)]:
        l += step
        step *= 2
    while step > 1:
        step //= 2
        if j + l + step <= n and data[4 * (i + l) : 4 * (i + l + step)] == data[4 * (j + l) : 4 * (j + l + step)]:
            l += step
    return l


def lyndon_runs(x: np.ndarray, periods: int = MIN_PERIODS, shortest: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of x of `periods` (3 at least) periods and `shortest` symbols at least, by start and period.

    For both orders of the symbols, next smaller suffixes (the ends of the longest Lyndon words) come from left to right: suffix
    i is compared with those before it that no later one was smaller than. What a comparison matches is kept with its pair;
    one inside the stretch that was matched farthest to the right has a mirror image to the left, whose result holds as far as
    that stretch goes, so only symbols beyond all matched ones are read. A run's second Lyndon root is a longest Lyndon word in
    one of the orders; matches to its right were made already, and to its left at most a period is read.
    """
    n = len(x)
    if n < shortest:
        return []
    data = np.ascontiguousarray(x, np.int32).tobytes()
    found = set()
    for y in (x.tolist(), (-x).tolist()):
        following, preceding = [n] * n, [-1] * n
        match_next, match_prev = [0] * n, [0] * n
        left = right = end = 0  # the stretch that was matched farthest: end - right symbols from left and from right on
        for i in range(1, n):
            j, yi, l = i - 1, y[i], 0
            while j >= 0:
                if y[j] != yi:
                    smaller = yi < y[j]
                    l = 0
                else:
                    l, sure = 1, False
                    if right < i < end:
                        a, b = i - right + left, j - right + left if j >= right else j
                        a, b = (a, b) if a < b else (b, a)
                        v = match_next[a] if following[a] == b else match_prev[b] if preceding[b] == a else -1
                        if a == b:
                            v = end
                        if v >= 0:
                            l, sure = (v, True) if v < end - i else (end - i, False)
                    if not sure:
                        if i + l < n and y[i + l] == y[j + l]:
                            l = _matched(data, j, i, l, n)
                        if i + l > end:
                            left, right, end = j, i, i + l
                    smaller = i + l == n or y[i + l] < y[j + l]
                if not smaller:
                    break
                following[j], match_next[j] = i, l
                q = i - j
                if l > (periods - 2) * q:
                    k = 0
                    while k < q and k < j and y[j - 1 - k] == y[i - 1 - k]:
                        k += 1
                    if k < q and k + q + l >= max(shortest, periods * q):
                        found.add((j - k, k + q + l, q))
                j = preceding[j]
            preceding[i] = j
            if j >= 0:
                match_prev[i] = l
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, texts: np.ndarray, periods: int = MIN_PERIODS, shortest: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(from, to) of the parts of a sequence of coded words in which runs can be, each inside one text (a number for each word).

    A word that occurs less than `periods` times in its part is in no run there; nor is one whose last and next occurrence
    are both farther away than the longest period a run in the part can have. Parts are cut at such words until none is left.
    """
    out = []
    at = np.arange(len(codes))
    part = np.cumsum(np.concatenate([[0], texts[1:] != texts[:-1]])) if len(codes) else at
    while len(at):
        size = np.bincount(part)[part]
        # the longest period: 1 for parts of less than two times `periods`
        most = np.maximum(size // periods, 1)
        order = np.lexsort((at, codes[at], part))
        p, c, w = part[order], codes[at[order]], at[order]
        same = (p[1:] == p[:-1]) & (c[1:] == c[:-1])
        gap = np.where(same, w[1:] - w[:-1], len(codes) + 1)
        far = np.array([len(codes) + 1])
        group = np.cumsum(np.concatenate([[True], ~same]))
        rare = np.bincount(group)[group] < periods
        lone = (np.concatenate([far, gap]) > most[order]) & (np.concatenate([gap, far]) > most[order])
        keep = np.empty(len(at), bool)
        keep[order] = ~(rare | lone)
        keep &= size >= shortest
        whole = np.bincount(part, keep) == np.bincount(part)  # parts without a cut are done
        done = whole[part] & keep
        if done.any():
            mine = at[done]
            edge = np.flatnonzero(np.diff(part[done])) + 1
            out += zip(mine[np.concatenate([[0], edge])].tolist(), (mine[np.concatenate([edge - 1, [-1]])] + 1).tolist())
        keep &= ~done
        at, part = at[keep], part[keep]
        if len(at):
            part = np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]) | (np.diff(at) != 1)]))
            long = np.bincount(part)[part] >= shortest
            at, part = at[long], part[long]
            part = np.unique(part, return_inverse=True)[1] if len(part) else part
    return sorted(out)


def _coded(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word: the same for equal words only."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, texts: int) -> pa.Array:
    """Words as one string for each text, joined by one space."""
    last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.empty(0, bool)
    size = end - start + ~last
    to = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    out = buf[np.minimum(at, len(buf) - 1)] if len(at) else np.empty(0, np.uint8)
    out[to[1:][~last] - 1] = 32
    offsets = to[np.searchsorted(text, np.arange(texts + 1))]
    return pa.Array.from_buffers(pa.large_string(), texts, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, tail: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every text.

    Words are stretches without ASCII white space, numbered from 0. A run is a stretch of words with smallest period q (words q
    apart are identical), of max(6, 4 q) words at least, that no neighbouring word extends; runs come by start, then period.
    collapsed: the words that no run has behind its first period, joined by one space.

    tail(doc_id, n) may give (a, p) for a text of n > 0 words: from word a on, those are replaced by the p words from a on, over and over.

    Null and empty texts have no words, no runs and the empty text. Null and repeated doc_ids are rows like others, each with a
    row of its own; other columns take no part, an empty table gives no rows. Nothing is shuffled: a text is one
    task's, of whose size its memory is a small multiple, and its time grows in proportion.
    """
    bounded_batches(docs.sparkSession)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.num_rows
            column = batch.column(1).cast(pa.large_string())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1]
            buf = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            spaced = np.insert(buf, offsets[1:-1], 32)  # a word ends with its text
            start, end = word_bounds(spaced)
            first = np.searchsorted(start, offsets + np.arange(rows + 1))
            text = np.repeat(np.arange(rows), np.diff(first))
            if tail:
                for i in np.flatnonzero(np.diff(first)):
                    n = int(first[i + 1] - first[i])
                    if change := tail(ids[i], n):
                        a, p = change
                        at = first[i] + a + np.arange(n - a) % p
                        start[first[i] + a : first[i + 1]], end[first[i] + a : first[i + 1]] = start[at], end[at]
            codes = _coded(spaced, start, end)
            found, owner = [], []
            behind = np.zeros(len(codes) + 1, np.int64)
            for lo, hi in stretches(codes, text):
                part = np.unique(codes[lo:hi], return_inverse=True)[1]
                for s, length, q in lyndon_runs(part):
                    owner.append(text[lo])
                    found.append((lo + s - first[text[lo]], length, q))
                    behind[lo + s + q] += 1
                    behind[lo + s + length] -= 1
            kept = np.cumsum(behind)[:-1] == 0
            table = np.array(found, np.int64).reshape(-1, 3)
            runs = pa.StructArray.from_arrays([pa.array(c) for c in table.T], fields=list(_RUN))
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(np.array(owner, np.int64), np.arange(rows + 1)).astype(np.int32)), runs)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(first)), runs, _joined(spaced, start[kept], end[kept], text[kept], rows)], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, _SCHEMA)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period, of equal ones that of the smallest start, then period; null for none."""
    better = lambda a, b: a["length"].cast("decimal(19,0)") * b["period"] > b["length"].cast("decimal(19,0)") * a["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))
