"""Whole-sequence classifiers in parallel: blocks are summed up, the sums are chained over a sequence, blocks are finished."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a block.
BLOCK = 65_536

Summary = np.ndarray | None


def two_sided(combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Sequence[np.ndarray]], tuple[list[Summary], list[Summary]]]:
    """A chain that gives each block the combined summaries of all blocks before it and after it (None for none)."""

    def chain(sums: Sequence[np.ndarray]) -> tuple[list[Summary], list[Summary]]:
        before: list[Summary] = [None]
        for s in sums[:-1]:
            before.append(s if before[-1] is None else combine(before[-1], s))
        after: list[Summary] = [None]
        for s in reversed(sums[1:]):
            after.append(s if after[-1] is None else combine(s, after[-1]))
        return before, after[::-1]

    return chain


@dataclass(frozen=True)
class BlockScan:
    """A classifier of whole sequences that never sees one whole.

    summary(x): a few numbers (an array of one dimension) about a block; x has its values, or for several tracks a row for
    each. chain(summaries of a sequence's blocks, in order): what finish needs to know of the blocks before and
    after each one. finish(x, before, after): a value for each bin of the block.
    """

    summary: Callable[[np.ndarray], np.ndarray]
    chain: Callable[[Sequence[np.ndarray]], tuple[list[Summary], list[Summary]]]
    finish: Callable[[np.ndarray, Summary, Summary], np.ndarray]


def running(f: np.ufunc, of: Callable[[np.ndarray], np.ndarray] | None = None, reverse: bool = False) -> BlockScan:
    """f (an associative ufunc: np.add, np.maximum, …) of all values up to each bin, or from it on if reverse is set.

    of: makes one row of the block's values, or of several tracks' rows.
    """
    row = of or (lambda x: x)

    def finish(x: np.ndarray, before: Summary, after: Summary) -> np.ndarray:
        y, far = (row(x)[::-1], after) if reverse else (row(x), before)
        out = f.accumulate(y)
        if far is not None:
            out = f(far[0], out)
        return out[::-1] if reverse else out

    return BlockScan(lambda x: np.atleast_1d(f.reduce(row(x))), two_sided(f), finish)


def values_of(pdf: pd.DataFrame, value: str) -> np.ndarray:
    """A block's values in order of its (sorted) rows; of arrays, a row for each place in them."""
    column = pdf[value]
    if column.dtype == object:
        return np.array(column.tolist(), float).reshape(len(column), -1).T
    return column.to_numpy(float)


def chained(rows: DataFrame, summary: Callable[[np.ndarray], np.ndarray], chain: Callable, value: str) -> DataFrame:
    """(seqname, blk, before, after) of rows (seqname, bin, blk, value): one row for each block, null where there is nothing.

    Blocks are summed up where they are; only the summaries, a few numbers for each, are gone through by sequence.
    """

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"seqname": [key[0]], "blk": [key[1]], "s": [np.asarray(summary(values_of(pdf.sort_values("bin"), value)), float)]})

    def over(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        before, after = chain([np.asarray(s, float) for s in pdf["s"]])
        return pd.DataFrame({"seqname": [key[0]] * len(pdf), "blk": pdf["blk"], "before": list(before), "after": list(after)})

    parts = rows.groupBy("seqname", "blk").applyInPandas(sums, "seqname string, blk long, s array<double>")
    return parts.groupBy("seqname").applyInPandas(over, "seqname string, blk long, before array<double>, after array<double>")


def by_blocks(rows: DataFrame, ends: DataFrame, f: Callable[[pd.DataFrame, Summary, Summary], pd.DataFrame], schema: str) -> DataFrame:
    """f(rows of a block in order, before, after) for each block of rows (seqname, bin, blk, …)."""

    def run(key: tuple, pdf: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        before, after = (None if x is None else np.asarray(x, float) for x in (end["before"].iloc[0], end["after"].iloc[0]))
        return f(pdf.sort_values("bin"), before, after)

    return rows.groupBy("seqname", "blk").cogroup(ends.groupBy("seqname", "blk")).applyInPandas(run, schema)


def blocked(df: DataFrame, block: int = BLOCK) -> DataFrame:
    return df.withColumn("blk", F.expr(f"bin div {block}"))


def scan(df: DataFrame, classifier: BlockScan, value: str = "value", block: int = BLOCK) -> DataFrame:
    """(seqname, bin, value): the classifier's value at each bin of df (seqname, bin, value or an array of values).

    Any number of bins in a sequence is any number of tasks; blocks that have no bins in df are passed over.
    """
    rows = blocked(df.select("seqname", "bin", value), block)

    def finish(pdf: pd.DataFrame, before: Summary, after: Summary) -> pd.DataFrame:
        out = np.asarray(classifier.finish(values_of(pdf, value), before, after), float)
        if len(out) != len(pdf):
            raise ValueError("a sequence classifier must keep the length")
        return pd.DataFrame({"seqname": pdf["seqname"], "bin": pdf["bin"], "value": out})

    return by_blocks(rows, chained(rows, classifier.summary, classifier.chain, value), finish, "seqname string, bin int, value double")
