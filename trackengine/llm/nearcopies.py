"""Near copies by their shared word shingles: candidates by SimHash, and those that its fingerprints can't reach by banded minimum hashes; all are confirmed by exact Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checked, discard, giving_back, materialize, mix, spare, text_bytes, window_hashes, word_bounds, word_hashes
from .components import connected_components
from .simhash import _Forest, fingerprint_links, fingerprint_of

#: Words of a shingle, and the similarity from which two texts are near copies, as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Texts whose SimHash fingerprints are joined by chains of so many differing bits are compared.
RADIUS = 3
#: Two texts are compared if all minima of one band are equal. At similarity 0.8, 1 pair in 150,000 has no such band.
BANDS, ROWS = 30, 5
#: Texts of a band that are compared pair by pair; texts and shingles of either side of a tile, about.
FEW, TILE_TEXTS, TILE_GRAMS = 16, 512, 1 << 18
_SALTS, _FACTORS = np.random.default_rng(20240301).integers(1, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NO_ID = 2**63 - 1


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of k words (A-Z lower-cased); a shorter text is one run."""
    buf = np.frombuffer(text.lower(), np.uint8)
    start, end = word_bounds(buf)
    if not len(start):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(buf, start, end), min(k, len(start))))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """A hash for each band of minimum hashes, different bands' hashes apart."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        least = np.minimum(least, ((grams[None, at : at + 4096] ^ _SALTS) * _FACTORS).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in least.reshape(BANDS, ROWS).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of SIMILAR or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def _fits(a: str, b: str) -> Column:
    """Whether sets of two sizes can be similar."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def _rows() -> list:
    body = text_bytes()
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("body_hash"), body.alias("body")]


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, body_hash, print, n, bands, fp): print tells sets of shingles apart, n is the set's size, fp the text's fingerprint."""

    @giving_back
    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            sets = [shingles(x) for x in texts]
            n = np.array([len(s) for s in sets], np.int32)
            with np.errstate(over="ignore"):
                prints = mix(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64) + n.astype(np.uint64))
            bands = np.array([band_keys(s) for s in sets], np.uint64).reshape(-1, BANDS).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            fp = np.array([fingerprint_of(x, SHINGLE) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints.view(np.int64)), pa.array(n), lists, pa.array(fp)], ["doc_id", "body_hash", "print", "n", "bands", "fp"])

    return docs.select(*_rows()).mapInArrow(run, "doc_id long, body_hash long, print long, n int, bands array<long>, fp long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(print, grams): the shingles of one text for each wanted (print, first, body_hash)."""

    @giving_back
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["print", "grams"])

    rows = docs.select(*_rows()).withColumn("first", F.coalesce("doc_id", F.lit(_NO_ID)))
    found = rows.join(checked(wanted), ["first", "body_hash"]).select("print", "body").mapInArrow(run, "print long, grams binary")
    return found.groupBy("print").agg(F.first("grams").alias("grams"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose sets are similar."""

    @giving_back
    def run(batches):
        for b in batches:
            u, v, x, y = (c.to_pylist() for c in b.columns)
            ok = [i for i, (s, t) in enumerate(zip(x, y)) if similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64))]
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in ok], pa.int64()), pa.array([v[i] for i in ok], pa.int64())], ["u", "v"])

    of = lambda name, grams: sets.select(F.col("print").alias(name), F.col("grams").alias(grams))
    return pairs.join(of("u", "x"), "u").join(of("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _linked(home: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
    """Links (u, v) that join the groups of similar sets of two tables (print, n, group, grams), as a forest of groups."""
    sets = [np.frombuffer(g, np.uint64) for g in [*home.grams, *guests.grams]]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    gram, at = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(home), len(guests)), np.float32)
    for low in range(0, len(gram), 4096):  # so many shingles at a time
        a, b = np.searchsorted(at, (low, low + 4096))
        has = np.zeros((len(sets), min(4096, len(gram) - low)), np.float32)
        has[owner[a:b], at[a:b] - low] = 1
        both += has[: len(home)] @ has[len(home) :].T
    sizes = home.n.to_numpy()[:, None] + guests.n.to_numpy()[None]
    i, j = np.nonzero((both * SIMILAR[1] >= (sizes - both) * SIMILAR[0]) & (home.group.to_numpy()[:, None] != guests.group.to_numpy()[None]))
    groups, number = np.unique(np.concatenate([home.group, guests.group]), return_inverse=True)
    forest = _Forest(len(groups))
    links = forest.add(number[: len(home)][i], number[len(home) :][j])
    a, b = np.array(links, int).reshape(-1, 2).T
    return pd.DataFrame({"u": groups[a], "v": groups[b]}, dtype="int64")


def _across_groups(members: DataFrame, stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join what the stars left apart: similar texts of members (key, print, n, group) that share a key.

    Keys of a few texts give their pairs, each of which is confirmed once however many keys it shares. Of a key with more
    texts, those outside its largest group meet all its texts tile by tile, and a tile returns a forest: tiles are so many
    that one holds about TILE_TEXTS texts and TILE_GRAMS shingles of either side, so no group is too large for a task.
    """
    per_group = members.groupBy("key", "group").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    largest = F.max(F.struct("c", "group", "n"))
    keys = per_group.groupBy("key").agg(F.count("*").alias("groups"), F.sum("c").alias("c"), F.sum("n").alias("n"), largest.alias("top")).filter("groups > 1")
    tiles = lambda c, n: F.ceil(F.greatest(c / TILE_TEXTS, n / TILE_GRAMS)).cast("int")
    sized = keys.select("key", "c", F.col("top.group").alias("main"), tiles(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n")).alias("homes"), tiles(F.col("c"), F.col("n")).alias("guests"))
    rows = materialize(members.join(sized, "key"), "near-apart")

    few = rows.filter(F.col("c") <= FEW)
    other = few.select("key", F.col("print").alias("v"), F.col("n").alias("v_n"), F.col("group").alias("v_group"))
    pairs = few.join(other, "key").filter((F.col("print") > F.col("v")) & (F.col("group") != F.col("v_group")) & _fits("n", "v_n"))
    pairs = pairs.select(F.col("print").alias("u"), "v").distinct().join(stars, ["u", "v"], "left_anti")

    many = rows.filter(F.col("c") > FEW).join(sets, "print")
    tile = lambda salt, count: F.pmod(F.xxhash64("print", F.lit(salt)), F.col(count)).cast("int")
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    own = F.when(F.col("group") != F.col("main"), F.transform(every("guests"), lambda g: F.struct(tile(1, "homes").alias("h"), g.alias("g"), F.lit(True).alias("own"))))
    guest = F.transform(every("homes"), lambda h: F.struct(h.alias("h"), tile(2, "guests").alias("g"), F.lit(False).alias("own")))
    places = F.explode(F.when(own.isNotNull(), F.concat(own, guest)).otherwise(guest))
    placed = many.select("key", "n", "group", "grams", places.alias("at")).select("key", "n", "group", "grams", "at.*")
    tiled = placed.groupBy("key", "h", "g").applyInPandas(lambda pdf: _linked(pdf[pdf.own], pdf[~pdf.own]), "u long, v long")
    out = materialize(_confirmed(pairs, sets).unionByName(tiled), "near-rest")
    discard(rows)
    return out


def simhash_keys(named: DataFrame) -> DataFrame:
    """(print, n, key): a key for each group of texts whose fingerprints chains of at most RADIUS differing bits join."""
    groups = connected_components(fingerprint_links(named.select("fp").distinct(), RADIUS), "near-simhash")
    group = F.coalesce("component", "fp")
    return named.join(groups, named.fp == groups.node, "left").select("print", "n", F.xxhash64(F.lit("SimHash"), group).alias("key"))


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, component_id, kept) for every row of docs; component_id is the smallest doc_id that chains of near
    copies reach. kept marks one text of each group, that of the smallest (doc_id, text_id); text_id is a hash of the text.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Texts with equal sets
    (those without words are one) are compared once. Texts share a key if SimHash groups them, and, as three bits of 64 don't
    reach a similarity of 0.8, also if they have a band of minimum hashes in common. Of the texts that share a key, each is first compared with one of them;
    then, of texts that these links have not joined yet, those outside the key's largest group with all others in tiles,
    so that no pair is left out, and none is a row. Null doc_ids take part as links.
    """
    bounded_batches(docs.sparkSession)
    prints = materialize(_prints(docs), "near-prints")
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("first"), "body_hash"))
    named = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("low"), one.alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "near-named")
    texts = named.filter("n > 0")
    keys = simhash_keys(texts).unionByName(texts.select("print", "n", F.explode("bands").alias("key")))
    shared = keys.groupBy("key").agg(F.min("print").alias("star"), F.min_by("n", "print").alias("star_n"), F.count("*").alias("c")).filter("c > 1").drop("c")
    members = materialize(keys.join(shared, "key"), "near-members")
    stars = materialize(members.filter("print <> star").filter(_fits("n", "star_n")).select(F.col("print").alias("u"), F.col("star").alias("v")).distinct(), "near-stars")
    wanted = materialize(members.select("print").distinct().join(named.select("print", "one.*"), "print"), "near-wanted")
    sets = materialize(_sets(docs, wanted), "near-sets")
    links = materialize(_confirmed(stars, sets), "near-links")
    joined = connected_components(links, "near-first").select(F.col("node").alias("print"), "component")
    apart = members.join(joined, "print", "left").select("key", "print", "n", F.coalesce("component", "print").alias("group"))
    rest = _across_groups(apart, stars, sets)
    groups = connected_components(links.unionByName(rest), "near-copies")
    grouped = named.join(groups, named.print == groups.node, "left").select("print", "low", "one", F.coalesce("component", "print").alias("group"))
    lowest = grouped.groupBy("group").agg(F.min("low").alias("component_id"), F.min("one").alias("kept_one"))
    named_groups = grouped.join(lowest, "group").select("print", "component_id", "kept_one")
    kept = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("first"), "body_hash") == F.col("kept_one")
    out = materialize(prints.join(named_groups, "print").select("doc_id", F.col("body_hash").alias("text_id"), "component_id", kept.alias("kept")), "near-groups")
    discard(prints, named, members, stars, wanted, sets, links, rest)
    return out


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: that of the smallest (doc_id, text), and of rows that repeat both only one.

    Rows with a null doc_id stay. Columns are those of docs.
    """
    groups = near_copy_groups(docs).filter("doc_id IS NOT NULL").groupBy("doc_id", "text_id").agg(F.first("kept").alias("kept"), F.count("*").alias("rows"))
    of, text_id = spare(docs, "of", "text_id")
    marked = materialize(groups.filter("NOT kept OR rows > 1").withColumnsRenamed({"doc_id": of, "text_id": text_id}), "near-marks")
    own = (docs["doc_id"].cast("long") == F.col(of)) & (F.xxhash64(text_bytes()) == F.col(text_id))
    out = docs.join(checked(marked.select(of, text_id)), own, "left_anti")
    again = marked.filter("kept").select(of, text_id)
    if again.limit(1).count():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        out = out.unionByName(docs.join(again, own).dropDuplicates([of, text_id]).select(*columns))
    return out
