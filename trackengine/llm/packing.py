"""Packing token pieces into fixed sequences: exact complements first, best fit for the rest."""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, giving_back, materialize, text_bytes, word_hashes

#: Tokens of a sequence.
CAPACITY = 2048
#: Words whose ids a worker remembers (about 20 bytes each); others are encoded again when they come.
KNOWN_WORDS = 1 << 20
#: Bytes of text that are looked up together, about; a longer text is cut between words.
TOGETHER = 1 << 19
#: Pieces of one length that share a numbering bucket, about.
BUCKET_PIECES = 4096


#: ASCII marks that, behind a letter, begin a piece of their own in the vocabulary's splitting.
_MARKS = b".,;:!?*%&$#+=_/()[]{}-"
_IS_MARK = np.isin(np.arange(256), np.frombuffer(_MARKS, np.uint8))


class WordIds:
    """Token ids of texts, word by word: the vocabulary's splitting never joins what a space or newline parts.

    It lower-cases, so A-Z are lowered first, but for words that may hold a special token; and it parts an ASCII letter
    from marks behind it, so those are words of their own. Words are known by 64-bit hashes; the ids of all known ones lie
    one after the other in one array.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.encode, kind = model.encode_batch_fast, np.uint16 if model.get_vocab_size() <= 1 << 16 else np.uint32
        self.known, self.start, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, kind)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for part in _parts(texts):
            for (i, _), ids in zip(part, self._ids([x for _, x in part])):
                out[i].append(ids)
        return [b"".join(x) for x in out]

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        raw = b"\n".join(texts) + b"\n"
        start, end = _words(np.frombuffer(raw, np.uint8))
        word, first, of = np.unique(word_hashes(np.frombuffer(raw, np.uint8), start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, word)
        new = np.ones(len(word), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != word[inside]
        begin, size, ids = np.zeros(len(word), np.int64), np.zeros(len(word), np.int32), self.ids
        begin[~new], size[~new] = self.start[at[~new]], self.size[at[~new]]
        if new.any():
            found = [e.ids for e in self.encode([raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())], add_special_tokens=False)]
            size[new] = [len(x) for x in found]
            begin[new] = len(ids) + np.cumsum(size[new]) - size[new]
            ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(found), ids.dtype, int(size[new].sum()))])
            if len(self.known) < KNOWN_WORDS:
                self.known, self.start, self.size, self.ids = np.insert(self.known, at[new], word[new]), np.insert(self.start, at[new], begin[new]), np.insert(self.size, at[new], size[new]), ids
        sizes = size[of]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = ids[np.repeat(begin[of] - upto[:-1], sizes) + np.arange(upto[-1])].astype("<u4")
        ends = upto[np.searchsorted(start, np.cumsum([len(x) + 1 for x in texts]))]
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _parts(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(number of the text, bytes of it), about TOGETHER bytes at once; long texts are cut behind a space or newline."""
    part, n = [], 0
    for i, text in enumerate(texts):
        text, at = _lowered(text), 0
        while at == 0 or at < len(text):
            to = len(text)
            if to - at > TOGETHER:
                to = max(text.rfind(b" ", at, at + TOGETHER), text.rfind(b"\n", at, at + TOGETHER)) + 1
                to = to or min((k + 1 for x in (b" ", b"\n") if (k := text.find(x, at + TOGETHER)) >= 0), default=len(text))
            part.append((i, text[at:to]))
            n, at = n + to - at, max(to, 1)
            if n >= TOGETHER:
                yield part
                part, n = [], 0
    if part:
        yield part


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end: between spaces and newlines, marks behind a last ASCII letter apart."""
    inside = np.concatenate([[False], (buf != 32) & (buf != 10), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return start, end
    stem = np.maximum.accumulate(np.where(_IS_MARK[buf], -1, np.arange(len(buf))))[end - 1] + 1
    last = buf[np.maximum(stem - 1, 0)]
    cut = (stem > start) & (stem < end) & (last >= 97) & (last <= 122)
    return np.sort(np.concatenate([start, stem[cut]])), np.sort(np.concatenate([end, stem[cut]]))


def _lowered(text: bytes) -> bytes:
    """A-Z lowered but in words that may hold a special token."""
    if b"<|" not in text:
        return text.lower()
    return b"\n".join(b" ".join(w if b"<|" in w else w.lower() for w in line.split(b" ")) for line in text.split(b"\n"))


@lru_cache(4)
def word_ids(path: str | None) -> WordIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordIds(path)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, order: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a final id 0, cut every `capacity` ids.

    tokenizer: file of the vocabulary as executors see it; None takes the installed public one. Null text is empty.
    order: a long that every piece of the row gets as `position` behind the other columns.
    """
    bounded_batches(docs.sparkSession)

    @giving_back
    def run(batches):
        encode = word_ids(tokenizer)
        step = 4 * capacity
        for b in batches:
            rows = []
            for i, ids in enumerate(encode(b.column(1).to_pylist())):
                ids = memoryview(ids + b"\0\0\0\0")
                rows += [(i, k, at // 4, len(part := ids[at : at + step]) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), step))]
            of, piece, start, length, crc = (list(x) for x in zip(*rows)) if rows else ([],) * 5
            of = pa.array(of, pa.int64())
            own = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), *own, *(c.take(of) for c in b.columns[2:])], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"), *([] if order is None else [order.alias("position")]))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ("" if order is None else ", position long")
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(run, schema)


class _Lengths:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            self.left[n] = c

    def times(self, pattern: tuple[int, ...]) -> int:
        """How often a pattern can be made of what is left."""
        return min(int(self.left[n]) // pattern.count(n) for n in set(pattern))

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for n in pattern:
            self.left[n] -= times

    def single(self, gap: int, having: tuple[int, ...]):
        if self.times((*having, gap)):
            yield (gap,)

    def pairs(self, gap: int, having: tuple[int, ...]):
        """Index of sums of two: a length and its complement in the gap are both there; longest first."""
        there = self.left[1:gap] > 0
        for a in np.flatnonzero(there & there[::-1])[::-1] + 1:
            if 2 * a < gap:
                return
            if self.times((*having, int(a), int(gap - a))):
                yield int(a), int(gap - a)

    def triples(self, gap: int, having: tuple[int, ...]):
        for a in np.flatnonzero(self.left[1 : gap - 1] > 0)[::-1] + 1:
            if 3 * a < gap:
                return
            if self.times((*having, int(a))):
                for pair in self.pairs(int(gap - a), (*having, int(a))):
                    if pair[0] <= a:
                        yield int(a), *pair
                        break


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, how many sequences) that use up all counts of lengths from 1 to capacity.

    From the longest down, each length's gap is filled exactly by one, two or three other lengths while there are any;
    what finds no exact complement is placed by best fit, longest first, group by group. Every step uses up a length or a
    group, so the number of patterns follows the number of different lengths and not that of the pieces.
    """
    lengths, out, rest = _Lengths(counts, capacity), [], {}
    for n in range(capacity, 0, -1):
        while lengths.left[n]:
            gap = capacity - n
            found = () if gap == 0 else next((p for kind in (lengths.single, lengths.pairs, lengths.triples) for p in kind(gap, (n,))), None)
            if found is None:
                break
            out.append((pattern := (n, *found), times := lengths.times(pattern)))
            lengths.take(pattern, times)
        if left := int(lengths.left[n]):
            rest[n] = left
            lengths.left[n] = 0
    return out + _best_fit(rest, capacity)


def _best_fit(rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first; sequences with equal contents are one group."""
    by_gap: dict[int, list[list]] = {}
    put = lambda pattern, times: by_gap.setdefault(capacity - sum(pattern), []).append([pattern, times])
    for n in sorted(rest, reverse=True):
        left = rest[n]
        for gap in sorted(g for g in by_gap if g >= n):
            groups, room = by_gap[gap], gap // n
            while groups and left:
                pattern, times = groups.pop()
                full = min(times, left // room)
                few = left - full * room if full < times else 0
                if full:
                    put((*pattern, *[n] * room), full)
                if few:
                    put((*pattern, *[n] * few), 1)
                left -= full * room + few
                if times > full + (few > 0):
                    groups.append([pattern, times - full - (few > 0)])
        if left:
            room = capacity // n
            if left // room:
                put((n,) * room, left // room)
            if left % room:
                put((n,) * (left % room), 1)
    return [(tuple(p), t) for groups in by_gap.values() for p, t in groups]


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, order: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece, and where it lies.

    Sequences hold at most `capacity` ids; offsets have no gaps. Only the counts of lengths, at most `capacity` rows, go
    to the driver; the plan over them is of the same size and tells each piece its sequence by its number among those of
    its length. Null and empty texts are one id. Rows that repeat a doc_id are packed each; a null doc_id stays null.

    order: a long from 0 that says where each row stands. Pieces of a length are then used up in this order, and sequences are
    numbered by the first row in them, so that reading them by sequence_id follows the order of the rows.
    """
    pieces = materialize(token_pieces(docs, capacity, tokenizer, order), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, used, base = [], {}, 0
    for pattern, times in packing_plan(counts, capacity):
        offset = 0
        for n in pattern:
            runs.append((n, used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        base += times
    assert used == counts
    runs.sort()
    length, first, start, offset = (np.array(x, np.int64) for x in (zip(*runs) if runs else [()] * 4))
    keys = (length << 48) + first
    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET_PIECES))
    bucket, place_by, carried = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)), ["doc_id", "piece", "ids_crc32"], []
    if order is not None:
        rows = (pieces.agg(F.max("position")).first()[0] or 0) + 1
        bucket, place_by, carried = _stretch("position", rows, buckets), ["position", *place_by], ["position"]
    bucketed = pieces.withColumn("bucket", bucket)
    by = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(by), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*place_by)) - 1
    ranked = bucketed.withColumn("within", within).join(before, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"), *carried)

    @giving_back
    def place(batches):
        for b in batches:
            n, rank = (b.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, (n << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(start[at] + rank - first[at]), pa.array(offset[at]), *b.columns[6:]], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *carried])

    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", position long" * len(carried))
    return placed if order is None else _in_order(placed, rows, max(1, -(-base // BUCKET_PIECES)))


def _stretch(position: str, rows: int, stretches: int) -> Column:
    """Which of so many equal stretches of the positions from 0 to rows - 1 one lies in."""
    return F.floor(F.col(position) * (stretches / rows)).cast("long")


def _in_order(placed: DataFrame, rows: int, buckets: int) -> DataFrame:
    """Sequences numbered anew, without gaps, by the smallest position in them (then by their number so far)."""
    placed = materialize(placed, "placed")
    firsts = placed.groupBy("sequence_id").agg(F.min("position").alias("at")).withColumn("bucket", _stretch("at", rows, buckets))
    by = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = firsts.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(by), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("at", "sequence_id")) - 1
    numbers = firsts.withColumn("within", within).join(before, "bucket").select("sequence_id", (F.col("before") + F.col("within")).alias("number"))
    return placed.join(numbers, "sequence_id").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("number").alias("sequence_id"), "offset")
