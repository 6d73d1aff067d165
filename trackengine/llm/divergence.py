"""How the sources of a language differ in their words: exact divergences over integer-coded terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, giving_back, materialize, discard

#: Terms are kept if so many documents of their language have them; probabilities are whole numbers of SCALE.
MIN_DOCS, SCALE = 3, 1_000_000_000
#: Terms of a chunk of the dictionary; ranks of terms that are reported.
CHUNK, TOP = 8192, 200
#: Distinct (group, term) rows that a counting task merges at, and holds at most before it passes them on.
MERGE_ROWS, HELD_ROWS = 1 << 19, 1 << 18
#: Cells of dense vectors that pairs are summed over at once.
CELLS = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[97:123] = _TERM[128:] = True


def term_array(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that lie one behind the other in a UTF-8 buffer, in order, and how many each text has.

    Terms are runs of letters A-Z, a-z and characters beyond ASCII; A-Z become lower case.
    """
    low = _LOWER[buf]
    inside = _TERM[low]
    before = np.concatenate([[False], inside[:-1]])
    first = offsets[:-1][offsets[:-1] < len(buf)]
    before[first] = False  # a term ends with its text
    starts = np.flatnonzero(inside & ~before)
    place = np.concatenate([[0], np.cumsum(inside)])
    at = np.concatenate([place[starts], place[-1:]])
    small = at[-1] < 2**31
    kind = pa.string() if small else pa.large_string()
    terms = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(at.astype(np.int32 if small else np.int64)), pa.py_buffer(low[inside])])
    return terms, np.diff(np.searchsorted(starts, offsets))


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of one batch: occurrences, and texts with the term."""
    groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
    pairs = pd.DataFrame({"lang": batch.column(0).to_pylist(), "source": batch.column(1).to_pylist()})
    code, names = pd.factorize(pd.MultiIndex.from_frame(pairs)) if len(groups) else (np.empty(0, int), [])
    terms, sizes = term_array(*_utf8(batch.column(2)))
    if not len(terms):
        return _COUNTED.empty_table()
    coded = terms.dictionary_encode()
    ids, distinct = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    in_doc = np.unique(np.repeat(np.arange(len(sizes)), sizes) * distinct + ids)
    key, n = np.unique(np.repeat(code, sizes) * distinct + ids, return_counts=True)
    docs = np.unique(code[in_doc // distinct] * distinct + in_doc % distinct, return_counts=True)[1]
    group = key // distinct
    columns = [pa.array([x[i] for x in names]).take(pa.array(group)) for i in (0, 1)]
    return pa.Table.from_arrays([*columns, coded.dictionary.cast(pa.string()).take(pa.array(key % distinct)), pa.array(n), pa.array(docs)], schema=_COUNTED)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over whole texts, null lang, source and text as ''. Tasks add up before they shuffle."""
    bounded_batches(docs.sparkSession)

    def merged(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTED.names)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            parts.append(_batch_counts(batch))
            rows += len(parts[-1])
            if rows > MERGE_ROWS:
                parts = [merged(parts)]
                rows = len(parts[0])
                if rows > HELD_ROWS:
                    yield from parts[0].cast(_COUNTED).to_batches(1 << 16)
                    parts, rows = [], 0
        if parts:
            yield from merged(parts).cast(_COUNTED).to_batches(1 << 16)

    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = text.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


_CODED = "lang string, chunk string, source string, terms array<string>, ids array<int>, counts array<long>, total long, kept long"


def _encode(rows: pa.Table, lang: str) -> list[dict]:
    """The rows of one chunk: its dictionary (source null), then each source's ids and counts, ids in UTF-8 order."""
    term = np.array([t.encode() for t in rows.column("term").to_pylist()], object)
    n, docs = rows.column("n").to_numpy(), rows.column("docs").to_numpy()
    distinct, at = np.unique(term, return_inverse=True)
    in_docs = np.zeros(len(distinct), np.int64)
    np.add.at(in_docs, at, docs)
    kept = distinct[in_docs >= MIN_DOCS]
    if not len(kept):
        return []
    ids = np.searchsorted(kept, term)
    known = (ids < len(kept)) & (kept[np.minimum(ids, len(kept) - 1)] == term)
    chunk = kept[0].decode()
    out = [{"lang": lang, "chunk": chunk, "source": None, "terms": [t.decode() for t in kept], "ids": None, "counts": None, "total": 0, "kept": len(kept)}]
    sources = pd.Series(rows.column("source").to_pylist())
    for source, where in sources[known].groupby(sources[known]).groups.items():
        where = np.asarray(where)
        # a (source, term) pair has one row, so counts are set and not added
        order = where[np.argsort(ids[where], kind="stable")]
        out.append({"lang": lang, "chunk": chunk, "source": source, "terms": None, "ids": ids[order].tolist(), "counts": n[order].tolist(), "total": int(n[order].sum()), "kept": 0})
    return out


def coded_terms(counts: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks of each language's sorted kept terms, and each source's counts by ids in them.

    Counts are dealt out by ranges of (lang, term), so all rows of a term are together and whether it is kept is known there. A
    task reads its rows in order and closes a chunk after `size` terms.
    """
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("source", pa.string()), ("terms", pa.list_(pa.string())), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("total", pa.int64()), ("kept", pa.int64())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        terms, last = 0, (None, None)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            lang, term = (np.array(t.column(c).to_pylist(), object) for c in ("lang", "term"))
            new = np.concatenate([[(lang[0], term[0]) != last], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])])
            number = terms + np.cumsum(new)
            switch = np.concatenate([[last[0] is not None and lang[0] != last[0]], lang[1:] != lang[:-1]])
            at, begun, owner = 0, 0, last[0]
            for i in np.flatnonzero(new):
                if switch[i] or number[i] - begun > size:
                    held.append(t.slice(at, i - at))
                    if out := _encode(pa.concat_tables(held), owner if owner is not None else lang[i]):
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                    held, at, begun = [], i, number[i] - 1
                owner = lang[i]
            held.append(t.slice(at))
            terms, last = int(number[-1] - begun), (lang[-1], term[-1])
        if held and (out := _encode(pa.concat_tables(held), last[0])):
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ordered = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    return ordered.mapInArrow(run, _CODED)


def probabilities(count: np.ndarray, size: int) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / size) exactly, by long division in steps of 1000, for sizes below 2**53."""
    out, rest = np.ones(count.shape, np.int64), count + 1
    power = SCALE
    while power > 1:
        power //= 1000
        whole, rest = np.divmod(rest * 1000, size)
        out += whole * power
    return out


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q), which 64 bits hold."""
    d = p - q
    return d * d // q


def _chunk_parts(rows: pd.DataFrame, top: int) -> Iterator[pd.DataFrame]:
    """Partial sums of each pair of sources over one chunk, and each source's best terms in it."""
    head = rows[rows["source"].isna()].iloc[0]
    rows = rows[rows["source"].notna()].sort_values("source")
    sources, terms = rows["source"].tolist(), np.array(list(head["terms"]), object)
    size, s = len(terms), len(rows)
    v = int(head["lang_kept"])
    whole = np.zeros(size, np.int64)
    for ids, counts in zip(rows["ids"], rows["counts"]):
        if ids is not None:
            np.add.at(whole, np.asarray(ids), np.asarray(counts))
    q_lang = probabilities(whole, int(head["lang_total"]) + v)
    lang = head["lang"]
    best = []
    sums = np.zeros((s, s), np.int64)
    width = max(1, CELLS // max(1, s))
    for at in range(0, size, width):
        dense = np.zeros((s, min(width, size - at)), np.int64)
        for i, (ids, counts, total) in enumerate(zip(rows["ids"], rows["counts"], rows["group_total"])):
            if ids is not None:
                ids = np.asarray(ids)
                inside = (ids >= at) & (ids < at + dense.shape[1])
                dense[i, ids[inside] - at] = np.asarray(counts)[inside]
            p = probabilities(dense[i], int(total) + v)
            q = q_lang[at : at + dense.shape[1]]
            value = np.where((dense[i] > 0) & (p > q), excess(p, q), -1)
            found = np.flatnonzero(value >= 0)
            found = found[np.lexsort((found, -value[found]))[:top]]
            best.append(pd.DataFrame({"source": sources[i], "item": terms[at + found], "value": value[found]}))
            dense[i] = p
        for i in range(s):
            sums[i] += excess(dense[i][None], dense).sum(axis=1)
    i, j = np.nonzero(~np.eye(s, dtype=bool))
    names = np.array(sources, object)
    yield pd.DataFrame({"lang": lang, "source": names[i], "part": "pair", "item": names[j], "value": sums[i, j]})
    if best:
        yield pd.concat(best).assign(lang=lang, part="term")[["lang", "source", "part", "item", "value"]]


def source_divergence(docs: DataFrame, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group that occurs.

    part `pair`: item is each other source of the language; value is the sum over its kept terms of floor((p - q)^2 / q), p the
    group's probabilities and q the item's. part `term`: item is a kept term that the group has, more probable there
    than in the language; value as before with the language's q; the `top` best. Ranks go by value, then item in UTF-8 order.

    Null lang, source and text are ''; null and repeated doc_ids are rows like others. A language without kept terms has pairs
    of value 0. An empty table gives no rows, a language with one source no pairs. Texts are read once; counts of
    (lang, source, term) are shuffled, sorted by ranges of terms and coded in chunks of `chunk` terms; each chunk is a
    task's group, as dense as sources times terms, in slices of a bounded number of cells. Pairs grow with the square of a
    language's sources, which is what is asked for.
    """
    counts = materialize(term_counts(docs), "terms")
    coded = materialize(coded_terms(counts, chunk), "coded")
    discard(counts)
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = coded.filter("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("total").alias("t"))
    groups = materialize(occurring.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("t", F.lit(0)).alias("group_total")), "groups")
    langs = coded.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("kept").alias("lang_kept"))
    heads = coded.filter("source IS NULL").select("lang", "chunk", "terms").join(langs, "lang")
    # every group of the language takes part in every chunk, whether it has a term of it or not
    cells = heads.select("lang", "chunk").join(groups, "lang").join(coded.filter("source IS NOT NULL").select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    whole = cells.select("lang", "chunk", "source", "group_total", none("array<string>", "terms"), "ids", "counts", none("long", "lang_total"), none("long", "lang_kept"))
    whole = whole.unionByName(heads.select("lang", "chunk", none("string", "source"), none("long", "group_total"), "terms", none("array<int>", "ids"), none("array<long>", "counts"), "lang_total", "lang_kept"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(_chunk_parts(pdf, top)))

    parts = whole.groupBy("lang", "chunk").applyInPandas(run, "lang string, source string, part string, item string, value long")
    parts = materialize(parts, "parts")
    zero = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = parts.filter("part = 'pair'").unionByName(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(parts.filter("part = 'term'")).filter(F.col("rank") <= top))
