"""Embedding near duplicates: spherical k-means cells, blocked cosine products inside them, one vector a group kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, giving_back, materialize, spare
from .components import connected_components
from .simhash import _Forest

#: Cosine from which two vectors link.
THRESHOLD = 0.93
#: Vectors that the cells are fitted on at most: those with the smallest hashes of their ids. All vectors are compared.
SAMPLE = 20_000
#: Vectors in a cell, about; cells at most; vectors of a block of a large cell, about.
CELL, MAX_CELLS, BLOCK = 8192, 1024, 4096


def unit_rows(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors], float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit rows; a cell that gets empty takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        dots = x @ c.T
        cell = dots.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        norms = np.linalg.norm(sums, axis=1)
        far = iter(np.argsort(dots.max(axis=1)))
        for i in np.flatnonzero(norms < 1e-9):
            sums[i], norms[i] = x[next(far)], 1
        c = sums / norms[:, None]
    return c


def _usable(embedding: str, label: str):
    """Rows that can link: label, id and vector there, all components finite and one of them not zero."""
    v = F.col(embedding)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def _cells(reps: DataFrame, centroids: np.ndarray, threshold: float) -> DataFrame:
    """Each vector's cell, and the later cells where a vector within the threshold may be.

    If y is in cell d then y.d >= y.c. With |x - y| <= r, x.c - x.d <= (x - y).(c - d) <= r |c - d|; so the cells for which
    that doesn't hold have no partner of x, and leaving them out loses no link. Of two cells the earlier one's rows visit.
    """
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    gaps = np.linalg.norm(centroids[:, None] - centroids[None], axis=2) * radius

    @giving_back
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            dots = _sized(b.column(3).to_pylist(), centroids.shape[1]) @ centroids.T
            cell = dots.argmax(axis=1)
            near = dots[np.arange(len(cell)), cell][:, None] - dots <= gaps[cell]
            near &= np.arange(len(centroids))[None] > cell[:, None]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array([np.flatnonzero(r).astype(np.int32) for r in near], pa.list_(pa.int32()))], ["rep", "label", "copies", "v", "cell", "visits"])

    return reps.select("rep", "label", "copies", "v").mapInArrow(run, f"rep long, label string, copies long, v {reps.schema['v'].dataType.simpleString()}, cell int, visits array<int>")


def _sized(vectors: list, dims: int) -> np.ndarray:
    """Unit rows, cut or filled with zeros to the centroids' size (vectors of another size have a key of their own)."""
    x = unit_rows(_filled(vectors))
    return np.pad(x[:, :dims], ((0, 0), (0, max(0, dims - x.shape[1]))))


def _filled(vectors: list) -> list:
    n = max(map(len, vectors))
    return [np.pad(np.asarray(v, float), (0, n - len(v))) for v in vectors]


def _block_links(pdf: pd.DataFrame, threshold: float, rows: int = 512) -> pd.DataFrame:
    """Links of one block: of its own vectors with each other and with the visitors'. How many each has, and a forest."""
    pdf = pdf.sort_values(["own", "rep"], ascending=[False, True])
    x, rep, copies = unit_rows(pdf.v), pdf.rep.to_numpy(), pdf.copies.to_numpy()
    homes = int(pdf.own.sum())
    count, forest, links = np.zeros(len(x), np.int64), _Forest(len(x)), []
    for at in range(0, len(x), rows):
        i, j = np.nonzero(x[at : at + rows] @ x[:homes].T >= threshold)
        i = i + at
        once = j < i
        i, j = i[once], j[once]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        links += forest.add(i, j)
    some = np.flatnonzero(count)
    a, b = np.array(links, int).reshape(-1, 2).T
    return pd.DataFrame({"a": np.concatenate([rep[some], rep[a]]), "n": np.concatenate([count[some], np.zeros(len(a), np.int64)]), "b": np.concatenate([rep[some], rep[b]])})


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cell_rows: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; two vectors link if their labels are equal and their cosine,
    in double precision, is at least the threshold.

    Cells only say which vectors are compared: every pair that can reach the threshold is (see _cells), also for vectors
    at the border of cells, so the cells' quality changes the cost and not the result. Equal vectors of a label are one
    vector with a count; links are counted inside blocks, and blocks return counts and spanning forests only. Rows with a
    null id, label or vector, zero vectors and those with null or non-finite components have no link and stay. Vectors of
    different sizes never link. Rows that repeat an id are vectors of their own. An empty table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("v"))
    good = rows.filter(_usable("v", "label") & F.col("vec_id").isNotNull()).withColumn("label", F.concat_ws("/", F.size("v").cast("string"), "label"))
    reps = good.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")  # a number, since vectors may share an id
    n = reps.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = [r.v for r in reps.orderBy(F.xxhash64("low"), "low", "v").limit(SAMPLE).select("v").collect()]
    centroids = spherical_kmeans(unit_rows(_filled(sample)), min(MAX_CELLS, -(-n // cell_rows)))
    placed = materialize(_cells(reps, centroids, threshold), "cells")
    sizes = placed.groupBy("label", "cell").count().select("label", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    flat = ["rep", "label", "copies", "v"]
    home = placed.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    own = home.select(*flat, "cell", "block", F.lit(True).alias("own"))
    before = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b < F.col("block"))
    beside = home.filter("block > 0").select(*flat, "cell", F.explode(before).alias("block"), F.lit(False).alias("own"))
    away = placed.select(*flat, F.explode("visits").alias("cell")).join(sizes, ["label", "cell"])
    away = away.select(*flat, "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("own"))
    found = own.unionByName(beside).unionByName(away).groupBy("label", "cell", "block").applyInPandas(lambda pdf: _block_links(pdf, threshold), "a long, n long, b long")
    found = materialize(found, "cell-links")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    groups = connected_components(found.filter("n = 0").select(F.col("a").alias("u"), F.col("b").alias("v")), "vector-links")
    about = reps.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    about = about.select(F.col("label").alias("l"), F.col("v").alias("w"), "low", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    about = about.join(about.groupBy("c").agg(F.min("low").alias("component_id")), "c")
    linked = good.join(about, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("vec_id", F.col("n").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = rows.filter(~_usable("v", "label") | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(rest)


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", **columns) -> DataFrame:
    """The rows of vectors but those whose group has a smaller id; rows with a null id stay."""
    (lost,) = spare(vectors, "lost")
    gone = embedding_groups(vectors, threshold, key, **columns).filter("NOT kept").select(F.col("vec_id").alias(lost)).distinct()
    return vectors.join(gone, vectors[key].cast("long") == F.col(lost), "left_anti")
