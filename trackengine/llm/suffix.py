"""Repeated passages by a sparse suffix array: minimiser suffixes, sorted neighbours, extension to whole passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, give_back, giving_back, materialize, mix, sliding, span_hashes, spare, text_bytes, window_hashes, word_bounds, word_hashes

#: Words that a passage has at least; words that a retained suffix is keyed by.
MIN_WORDS = 50
SEED_WORDS = 32
#: Rows that a task holds of a sorted partition.
CHUNK = 65_536
#: A text: its doc_id and a hash, so that two texts of one doc_id are apart.
TEXT = ["doc_id", "text_id"]


def _words(text: bytes):
    buf = np.frombuffer(text, np.uint8)
    start, end = word_bounds(buf)
    return start, end, word_hashes(buf, start, end)


def _least(words: np.ndarray, min_words: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the suffix heads, and for each run of min_words words the smallest of those inside it: its minimiser."""
    heads = window_hashes(words, seed_words)
    return heads, sliding(heads, min_words - seed_words + 1)


def _retained(text: bytes, min_words: int, seed_words: int) -> np.ndarray:
    """Head hashes of the suffixes at minimiser positions, one for each position."""
    heads, least = _least(_words(text)[2], min_words, seed_words)
    if not len(least):
        return least
    w = min_words - seed_words + 1
    wide = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return heads[sliding(wide, w, np.maximum) == heads]


def _texts(docs: DataFrame) -> DataFrame:
    body = text_bytes()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_id"), body.alias("body"))


def _repeat(values: pa.Array, times: list[int] | np.ndarray) -> pa.Array:
    return values.take(pa.array(np.repeat(np.arange(len(times)), times)))


def retained_suffixes(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """(head, doc_id, text_id): the suffixes at positions whose head is the smallest hash of a run of min_words words.

    The choice depends on the words alone, so equal runs retain equal suffixes; one word in ten starts one.
    """
    bounded_batches(docs.sparkSession)

    @giving_back
    def run(batches):
        for b in batches:
            heads = [_retained(x, min_words, seed_words) for x in b.column(2).to_pylist()]
            n = [len(x) for x in heads]
            head = np.concatenate([*heads, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(head), _repeat(b.column(0), n), _repeat(b.column(1), n)], ["head", *TEXT])

    return _texts(docs).mapInArrow(run, "head long, doc_id long, text_id long")


def _sorted(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in one order over all partitions; ranges are over all keys, so no value of the first key is too large for one."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _beside(batches: Iterator[pa.RecordBatch], keys: list[str], place: list[str]) -> Iterator[tuple]:
    """The sorted rows of a partition in chunks: (rows, equal to the one before, equal to the one after, edge).

    Rows are equal if their keys are; rows that repeat keys and place are one. edge marks the partition's first and last
    row, of which one side isn't known. One row is carried from chunk to chunk.
    """

    def same(t: pa.Table, columns: list[str]) -> np.ndarray:
        out = np.ones(max(0, len(t) - 1), bool)
        for c in columns:
            x = t.column(c).to_numpy()
            out &= x[1:] == x[:-1]
        return out

    def chunks():
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    carried, before, first = None, False, True
    for t in chunks():
        t = t if carried is None else pa.concat_tables([carried, t]).combine_chunks()
        if place:
            t = t.filter(pa.array(np.concatenate([[True], ~same(t, keys + place)])))
        equal, n = same(t, keys), len(t)
        edge = np.zeros(n - 1, bool)
        edge[:1] = first
        if n > 1:
            yield t.slice(0, n - 1), np.concatenate([[before], equal[:-1]]), equal, edge
            before, first = bool(equal[-1]), False
        carried = t.slice(n - 1)
    if carried is not None:
        yield carried, np.array([before]), np.array([False]), np.array([True])


def _shared_heads(suffixes: DataFrame) -> DataFrame:
    """(doc_id, text_id, heads): the heads of each text that a neighbour in the order has too, or that border a partition."""

    @giving_back
    def run(batches):
        for rows, before, after, edge in _beside(batches, ["head"], []):
            yield from rows.filter(pa.array(before | after | edge)).to_batches()

    shared = _sorted(suffixes, "head", *TEXT).mapInArrow(run, "head long, doc_id long, text_id long")
    return shared.groupBy(*TEXT).agg(F.collect_set("head").alias("heads"))


def _runs_of(body: bytes, known: np.ndarray, min_words: int, seed_words: int) -> tuple[np.ndarray, ...]:
    """Of the runs of min_words words around shared suffixes: (head, hash, first, number) of each stretch of them that one
    suffix holds together, and the hashes of all runs, stretch by stretch.

    Hashes of runs and stretches are of other word hashes than the heads are, so that equal head and hash are 128 bits.
    """
    words = _words(body)[2]
    heads, least = _least(words, min_words, seed_words)
    at = np.flatnonzero(np.isin(least, known))
    other = mix(words ^ np.uint64(0x5851F42D4C957F2D))
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    inside = np.lib.stride_tricks.sliding_window_view(heads, min_words - seed_words + 1)
    place = np.concatenate([a + (inside[a] == least[a, None]).argmax(axis=1) for a in np.array_split(at, -(-len(at) // 8192))])
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    number = np.diff(np.append(new, len(at)))
    first = at[new]
    stretch = mix(span_hashes(other, first, first + number - 1 + min_words) ^ number.astype(np.uint64))
    return heads[place[new]].view(np.int64), stretch.view(np.int64), first, number, window_hashes(other, min_words)[at].view(np.int64)


def _stretches(docs: DataFrame, shared: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """(head, hash, doc_id, text_id, at, runs): from each shared suffix to the left and right, the runs that hold it."""

    @giving_back
    def run(batches):
        for b in batches:
            found = [_runs_of(body, heads.values.to_numpy(zero_copy_only=False).view(np.uint64), min_words, seed_words) for body, heads in zip(b.column(2).to_pylist(), b.column(3))]
            if not found:
                continue
            head, stretch, first, number, runs = (np.concatenate(x) for x in zip(*found))
            n = [len(x[0]) for x in found]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32)), pa.array(runs))
            yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(stretch), _repeat(b.column(0), n), _repeat(b.column(1), n), pa.array(first.astype(np.int32)), lists], ["head", "hash", *TEXT, "at", "runs"])

    return _texts(docs).join(shared, TEXT).select(*TEXT, "body", "heads").mapInArrow(run, "head long, hash long, doc_id long, text_id long, at int, runs array<long>")


def _extended(stretches: DataFrame) -> DataFrame:
    """(doc_id, text_id, at, number, twin, head, runs): sorted stretches that equal the one before, with runs null: all their
    runs are repeated, and not the first of their kind. The others with their runs; twin if they equal the one after."""

    @giving_back
    def run(batches):
        for rows, before, after, _ in _beside(batches, ["head", "hash"], [*TEXT, "at"]):
            runs = rows.column("runs").combine_chunks()
            number = np.diff(runs.offsets.to_numpy()).astype(np.int32)
            own = runs.take(pa.array(np.where(before, 0, np.arange(len(runs))), mask=before))
            yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in (*TEXT, "at")), pa.array(number), pa.array(after), rows.column("head").combine_chunks(), own], [*TEXT, "at", "number", "twin", "head", "runs"])

    return _sorted(stretches, "head", "hash", *TEXT, "at").mapInArrow(run, "doc_id long, text_id long, at int, number int, twin boolean, head long, runs array<long>")


def _neighbours(runs: DataFrame) -> DataFrame:
    """Compare each of the sorted runs (head, hash, doc_id, text_id, at, twin) with the one before and the one after it.

    later: an equal run comes before; twin: one comes before or after. Only twins are returned, and the first and last row
    of each partition, with part set, whose other neighbour is in another partition.
    """

    @giving_back
    def run(batches):
        for rows, before, after, edge in _beside(batches, ["head", "hash"], [*TEXT, "at"]):
            twin = rows.column("twin").to_numpy() | before | after
            keep = twin | edge
            part = pa.array(np.full(keep.sum(), TaskContext.get().partitionId(), np.int32), mask=~edge[keep])
            out = rows.filter(pa.array(keep)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(out.column(c).combine_chunks() for c in ("head", "hash", *TEXT, "at")), pa.array(before[keep]), pa.array(twin[keep]), part], ["head", "hash", *TEXT, "at", "later", "twin", "part"])

    return _sorted(runs, "head", "hash", *TEXT, "at").mapInArrow(run, "head long, hash long, doc_id long, text_id long, at int, later boolean, twin boolean, part int")


def _across(edges: list) -> list[tuple]:
    """The border rows of all partitions, each now compared with its neighbour in another partition."""
    rows = sorted(([*r[:5], r.later, r.twin] for r in edges), key=lambda r: r[:5])
    rows = [r for r, before in zip(rows, [None, *rows]) if before is None or r[:5] != before[:5]]
    for a, b in zip(rows, rows[1:]):
        if a[:2] == b[:2]:
            a[6] = b[6] = b[5] = True
    return [(doc, text, at, 1, later) for _, _, doc, text, at, later, twin in rows if twin]


def _spans(at: np.ndarray, number: np.ndarray, later: np.ndarray, min_words: int) -> list[tuple[int, int, bool]]:
    """Runs of words (from, to, kept) that the repeated runs cover: kept where a first occurrence covers them."""
    last = at + number - 1 + min_words
    n = int(last.max())
    cover = []
    for some in (np.ones(len(at), bool), ~later):
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, at[some], 1)
        np.add.at(step, last[some], -1)
        cover.append(np.cumsum(step)[:n] > 0)
    state = np.concatenate([[0], cover[0].astype(int) + cover[1], [0]])
    edge = np.flatnonzero(state[1:] != state[:-1])
    return [(int(a), int(b), bool(state[a + 1] == 2)) for a, b in zip(edge, edge[1:]) if state[a + 1]]


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, first_word, last_word, kept, text_id): every run of words that occurs at least twice, in one text or several.

    Words are runs without ASCII white space, compared byte for byte; last_word is exclusive. A run of min_words words is
    repeated if an equal one (by two independent 64-bit hashes) starts at another place; the result covers exactly the
    words inside such runs. kept marks words inside a first occurrence (smallest doc_id, then text_id, then place), so that
    dropping the other spans leaves one whole copy of each repeated run. text_id, a hash, tells texts of one doc_id apart.
    Rows with null text or doc_id, and texts of fewer words, give no spans; a row that is repeated in full counts once; an
    empty table gives no rows.
    """
    if not 0 < seed_words <= min_words:
        raise ValueError("seed_words must be between 1 and min_words")
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    suffixes = materialize(retained_suffixes(docs, min_words, seed_words), "suffixes")
    stretches = materialize(_stretches(docs, _shared_heads(suffixes), min_words, seed_words), "suffix-stretches")
    discard(suffixes)
    extended = materialize(_extended(stretches), "suffix-extended")
    discard(stretches)
    runs = extended.filter("runs IS NOT NULL").select("head", *TEXT, "at", "twin", F.posexplode("runs").alias("k", "hash"))
    twins = materialize(_neighbours(runs.select("head", "hash", *TEXT, (F.col("at") + F.col("k")).alias("at"), "twin")), "suffix-twins")
    edges = _across(twins.filter("part IS NOT NULL").drop("part").collect())  # two rows a partition
    rows = twins.filter("part IS NULL").select(*TEXT, "at", F.lit(1).alias("number"), "later")
    rows = rows.unionByName(extended.filter("runs IS NULL").select(*TEXT, "at", "number", F.lit(True).alias("later")))
    if edges:
        rows = rows.unionByName(docs.sparkSession.createDataFrame(edges, rows.schema))

    @giving_back
    def run(batches):
        for b in batches:
            spans = []
            for found in b.column(2):
                at, number, later = (found.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                spans.append(_spans(at.astype(np.int64), number, later, min_words))
            n = [len(x) for x in spans]
            first, last, kept = zip(*(x for s in spans for x in s)) if sum(n) else ((), (), ())
            yield pa.RecordBatch.from_arrays([_repeat(b.column(0), n), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(kept, pa.bool_()), _repeat(b.column(1), n)], ["doc_id", "first_word", "last_word", "kept", "text_id"])

    out = rows.groupBy(*TEXT).agg(F.collect_list(F.struct("at", "number", "later")).alias("found"))
    out = materialize(out.mapInArrow(run, "doc_id long, first_word int, last_word int, kept boolean, text_id long"), "suffix-spans")
    discard(extended, twins)
    return out


def cut_words(text: str, spans: list) -> str:
    """A text without the words of the spans [(from, to)]; the white space after a dropped word goes with it."""
    body = text.encode()
    start, _ = word_bounds(np.frombuffer(body, np.uint8))
    start = np.append(start, len(body))
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(body[at : start[a]])
        at = start[b]
    return b"".join([*out, body[at:]]).decode()


def suffix_dedup(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """docs with every repeated passage but its first occurrence cut out of text, and n_chars set anew where that column is.

    Documents of which no word is left go; all others stay, those with null text or doc_id as they are. Texts that share a
    doc_id are cut each at its own passages. Columns are those of docs, whatever they are called.
    """
    gone = repeated_spans(docs, min_words, seed_words).filter("NOT kept")
    of, text_id, cuts, now = spare(docs, "of", "text_id", "cuts", "now")
    gone = gone.groupBy(F.col("doc_id").alias(of), F.col("text_id").alias(text_id)).agg(F.collect_list(F.struct("first_word", "last_word")).alias(cuts))

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, cuts in batches:
            yield pd.Series([x if c is None or x is None else cut_words(x, [(s["first_word"], s["last_word"]) for s in c]) for x, c in zip(text, cuts)], dtype=object)
        give_back()

    cut = cut.asNondeterministic()  # else Spark would run it once more for the filter, in a second worker for each task
    own = (docs["doc_id"].cast("long") == F.col(of)) & (F.xxhash64(text_bytes()) == F.col(text_id))
    joined = docs.join(gone, own, "left").withColumn(now, cut("text", cuts))
    left = joined.filter(F.col(cuts).isNull() | F.col(now).rlike("[^ \\t-\\r]"))
    changed = {"text": F.col(now)} | ({"n_chars": F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length(now).cast("long"))} if "n_chars" in docs.columns else {})
    return left.withColumns(changed).select(*(F.col(f"`{c}`") for c in docs.columns))
