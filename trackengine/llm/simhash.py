"""SimHash near duplicates: tiled exact comparison of fingerprints with exclusive-or and bit counts."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, giving_back, materialize, spare, text_bytes
from .components import connected_components

#: Sixteen-bit parts of a fingerprint; a tile holds the fingerprints with the same population count in every part.
PARTS = 4
#: Distinct fingerprints that a block of a tile holds on average at most.
BLOCK = 16_384


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles (A-Z lower-cased); no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the unsigned 64-bit fingerprint held in a signed long. Null text counts as empty."""
    bounded_batches(docs.sparkSession)

    @giving_back
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint_of(x) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(run, "doc_id long, fp long")


def _part_count(part: int):
    return F.bit_count(F.shiftrightunsigned(F.col("fp"), 16 * part).bitwiseAND(F.lit(0xFFFF)))


def _offsets(radius: int) -> list[int]:
    """Differences of tile numbers (base 32) for half of the neighbours: one of each pair of opposite directions.

    Part counts that differ by more than the radius in sum can't be those of two fingerprints within the radius.
    """
    near = (d for d in itertools.product(range(-radius, radius + 1), repeat=PARTS) if 0 < sum(map(abs, d)) <= radius)
    return [sum(x * 32**p for p, x in enumerate(d)) for d in near if next(x for x in d if x) > 0]


class _Forest:
    """Joins local numbers into trees; keeps only the links that join two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        ra, rb = self.up[a], self.up[b]
        for _ in range(64):  # up to the roots, all at once
            na, nb = self.up[ra], self.up[rb]
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        differ = ra != rb
        pairs = np.unique(np.stack([ra[differ], rb[differ]], 1), axis=0) if differ.any() else np.empty((0, 2), int)
        for x, y in pairs.tolist():
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append((max(x, y), min(x, y)))
        return out


def _compare(pdf: pd.DataFrame, radius: int, rows: int = 512) -> pd.DataFrame:
    """Spanning links of one block: its own fingerprints with each other and with the visitors' ones."""
    pdf = pdf.drop_duplicates(["fp", "own"])
    home = pdf[pdf.own].fp.to_numpy().view(np.uint64)
    all_fp = np.concatenate([home, pdf[~pdf.own].fp.to_numpy().view(np.uint64)])
    forest, links = _Forest(len(all_fp)), []
    for at in range(0, len(all_fp), rows):
        left = all_fp[at : at + rows]
        for to in range(0, len(home), 4096):
            right = home[to : to + 4096]
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
            i, j = i + at, j + to
            keep = i != j
            links += forest.add(i[keep], j[keep])
    fp = all_fp.view(np.int64)
    a, b = np.array(links, int).reshape(-1, 2).T
    return pd.DataFrame({"u": fp[a], "v": fp[b]})


def fingerprint_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (u, v) that join exactly the fingerprints (column fp) that chains of differing bits <= radius join.

    Every fingerprint is at home in the tile of its four part counts and visits the half of the neighbouring tiles whose
    counts differ by at most the radius in sum; other tile pairs are skipped, which loses no link. Tiles of many
    fingerprints are cut into blocks by a hash, as many as their own size asks for, and a visitor goes to each block of
    the tile that it visits. The sizes of tiles are broadcast: there are at most 17 ** 4. A block returns a spanning forest
    of its links, so that a group of n near copies gives n - 1 rows, not n * n.
    """
    tile = sum((_part_count(p) * 32**p for p in range(PARTS)), F.lit(0)).cast("int")
    tiled = distinct.select("fp", tile.alias("tile"))
    sizes = F.broadcast(tiled.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    home = tiled.join(sizes, "tile").select("fp", "tile", own.alias("block"), F.lit(True).alias("own"))
    steps = F.array(*[F.lit(x) for x in _offsets(radius)])
    before = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("block")
    visits = tiled.select("fp", F.explode(F.transform(steps, lambda d: F.col("tile") + d)).alias("tile")).join(sizes, "tile").select("fp", "tile", before(F.col("blocks")), F.lit(False).alias("own"))
    within = home.filter("block > 0").select("fp", "tile", before(F.col("block")), F.lit(False).alias("own"))  # blocks of one tile meet each other as well
    rows = home.unionByName(visits).unionByName(within)
    return rows.groupBy("tile", "block").applyInPandas(lambda pdf: _compare(pdf, radius), "u long, v long")


def simhash_groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id: smallest doc_id of all documents that chains of links reach, the document itself included. Texts without
    words (null ones too) have fingerprint zero and link like any other. Rows that repeat a doc_id all count; a null
    doc_id stays null, takes part as a link and gets the smallest non-null id it reaches. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "simhash")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = fingerprint_links(firsts.select("fp"), radius)
    groups = connected_components(links, "simhash-links")
    named = firsts.join(groups, firsts.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    lowest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(lowest, "group").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of docs without those of documents that are not the smallest doc_id of their group; null doc_ids stay."""
    (lost,) = spare(docs, "lost")
    gone = simhash_groups(docs, radius).filter("doc_id <> component_id").select(F.col("doc_id").alias(lost)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(lost), "left_anti")
