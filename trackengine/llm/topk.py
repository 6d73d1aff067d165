"""Exact top-k search: term-at-a-time accumulation of weighted postings in dense score arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Candidates and queries of a block, about; queries that share a score array.
CANDIDATES, QUERIES, TOGETHER = 8192, 2048, 64
SCALE = 64
#: Vectors with a scaled component of this size or more are compared apart, so that they don't slow the others down.
LARGE = 1 << 24
MOST = 2**63 - 1


def usable(embedding: Column) -> Column:
    """The components as doubles; null where the vector or a component is null or not finite."""
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(embedding.isNotNull() & ok, F.transform(embedding, lambda x: x.cast("double")))


def scaled(vectors: np.ndarray, bound: float, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) exactly: as 32- or 64-bit numbers where scores up to `bound` fit them, else as Python's."""
    if bound < 2**62:
        return np.floor(vectors * scale).astype(np.int32 if bound < 2**31 else np.int64)
    whole = [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in vectors.ravel().tolist()]
    return np.array(whole, object).reshape(vectors.shape)


def _matrix(rows) -> np.ndarray:
    n = max(map(len, rows), default=0)
    out = np.zeros((len(rows), n))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def block_top(queries: np.ndarray, query_rows: np.ndarray, candidates: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """The k best candidates of each query, itself (the candidate of the same row number) left out: (place of the query, of
    the candidate, score) arrays for each chunk of queries.

    Postings of a term are the candidates with a weight in it; those of a term that most have are held as a whole column.
    Candidates must be sorted by id, so that of equal scores the smaller position is the smaller id.
    """
    terms = min(queries.shape[1], candidates.shape[1])
    n = len(candidates)
    bound = (float(np.abs(queries).max(initial=0)) * SCALE + 1) * (float(np.abs(candidates).max(initial=0)) * SCALE + 1) * max(1, terms)
    queries, candidates = scaled(queries, bound), scaled(candidates, bound)
    kind = candidates.dtype
    weights = np.ascontiguousarray(candidates[:, :terms].T)
    postings = [np.flatnonzero(w) for w in weights]
    out = []
    for at in range(0, len(queries), TOGETHER):
        part = queries[at : at + TOGETHER]
        score = np.zeros((len(part), n), kind)
        for t in range(terms):
            with_t = np.flatnonzero(part[:, t])
            where = postings[t]
            if not len(with_t) or not len(where):
                continue
            if 2 * len(where) >= n:
                score[with_t] += part[with_t, t, None] * weights[t][None]
            else:
                score[np.ix_(with_t, where)] += part[with_t, t, None] * weights[t][where][None]
        own = query_rows[at : at + TOGETHER, None] == rows[None]
        m = min(k + int(own.sum(axis=1).max(initial=0)), n)
        if bound < 2**48 and n <= 1 << 14:
            rank = np.where(own, np.iinfo(np.int64).min, score.astype(np.int64) * (1 << 14) - np.arange(n))
            best = np.argpartition(rank, n - m, axis=1)[:, n - m :]
        elif kind == object:
            score = np.clip(score, -MOST, MOST).astype(np.int64)
            best = np.stack([np.lexsort((np.arange(n), -s, o))[:m] for s, o in zip(score, own)])
        else:
            best = np.stack([np.lexsort((np.arange(n), -s.astype(np.int64), o))[:m] for s, o in zip(score, own)])
        q, c = np.repeat(np.arange(len(part)), m), best.ravel()
        ok = ~own[q, c]
        out.append((q[ok] + at, c[ok], score[q[ok], c[ok]].astype(np.int64)))
    return out


_FOUND = ("query_row", "query_id", "vec_id", "score")


def _pair(key, queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(candidates):
        return pd.DataFrame({c: [] for c in _FOUND}, dtype="int64")
    candidates = candidates.sort_values(["vec_id", "row"], kind="stable")
    sides = [(pdf.row.to_numpy(), pdf.vec_id.to_numpy(), _matrix(pdf.terms.tolist())) for pdf in (queries, candidates)]
    parts = [[(r[some], i[some], x[some]) for some in (large, ~large) if some.any()] for r, i, x in sides for large in [np.abs(x).max(axis=1, initial=0) * SCALE >= LARGE]]
    found = [(qrows[q], qids[q], ids[c], s) for qrows, qids, x in parts[0] for rows, ids, y in parts[1] for q, c, s in block_top(x, qrows, y, rows, k)]
    return pd.DataFrame(dict(zip(_FOUND, (np.concatenate(x) for x in zip(*found)))))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` holds for, the k other rows of highest inner product.

    Components are scaled to whole numbers, floor(64 x); ties go to the smaller id. Every query meets every candidate, in blocks: a task
    accumulates the scores of one block of queries over one block of candidates and passes on k rows a query, and the
    blocks' rows are merged by rank. Rows with a null id, and vectors that are null or hold null or non-finite components,
    take no part; shorter vectors have zeros behind. Scores are exact whatever the components' size; those that no long
    holds are given as the largest or smallest one and tie there. Rows that repeat an id are
    rows of their own: each query row has its k best among all other rows, those of its own id too. An empty table or no query
    gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), usable(F.col(embedding)).alias("terms"), queries.alias("asks")).filter("vec_id IS NOT NULL AND terms IS NOT NULL")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "terms")  # numbers stay as they were written
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-asked // QUERIES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda count: F.pmod(F.xxhash64("vec_id", "row"), F.lit(count)).cast("int")
    c = rows.select("row", "vec_id", "terms", block(c_blocks).alias("c"), every(q_blocks).alias("q"))
    q = rows.filter("asks").select("row", "vec_id", "terms", F.pmod(F.xxhash64("vec_id", "row", F.lit(1)), F.lit(q_blocks)).cast("int").alias("q"), every(c_blocks).alias("c"))
    parts = q.groupBy("c", "q").cogroup(c.groupBy("c", "q")).applyInPandas(lambda key, a, b: _pair(key, a, b, k), "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
