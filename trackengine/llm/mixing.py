"""Mixing sources to target weights: proportionate-fair blocks, dealt out earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, materialize, spare

#: Slots of the repeating pattern, which serves weights that are whole multiples of 1 / SLOTS.
SLOTS = 4096
#: Documents in a block.
BLOCK_DOCS = 64
#: Documents of one source that share a sorting bucket, about.
BUCKET_DOCS = 50_000
#: Repeats of one row that are written out at a time.
REPEATS = 65_536


def whole_weights(weights: list) -> list[int]:
    """Whole numbers in exactly the proportions of the weights, floats as the fractions that they are."""
    exact = [Fraction(w) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("target weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    common = math.gcd(*whole) or 1
    return [w // common for w in whole]


def exact_schedule(whole: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source number, block, slot, release, deadline) of all blocks, in the order of slots.

    Block k of a source with w of W is released at floor(k W / w) and due by ceil((k + 1) W / w). One block a slot, the
    earliest deadline first, meets all deadlines; that some sources end before others only leaves more room.
    """
    total, slot, ready = sum(whole), 0, []
    waiting = [(0, i, 0) for i, n in enumerate(blocks) if n]
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // whole[i]), i, k, release))
        due, i, k, release = heapq.heappop(ready)
        yield i, k, slot, release, due
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, ((k + 1) * total // whole[i], i, k + 1))
        slot += 1


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", key: str = "doc_id", block_docs: int = BLOCK_DOCS, slots: int = SLOTS, seed: int = 0) -> DataFrame:
    """Schedule every row: (key, source, rank, block, slot, release, deadline, position).

    rank: place in the source's own shuffled order (by a hash of the key, then the key, from 0); block = rank div
    block_docs; slot, release and deadline: where the block's weight puts it; position: place of the row in the whole
    mixture, from 0 and without gaps. Every row is kept. Weights are exact. Where all are whole multiples of 1 / slots, a
    pattern of so many slots repeats and is broadcast; a source that has run out leaves its slots empty. For any others,
    one task deals out the blocks (not rows) in turn, in memory of the number of sources, and rows join their block; then
    blocks of other sources may move up in their windows when one has run out. Sources without a weight in `weights`
    raise an error; a null source is a source; rows that repeat a key are counted before they are numbered, and stay together; an empty table gives no
    rows. The driver holds a number for each source.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(source).cast("string").alias(source))
    counts = sorted(rows.groupBy(source).count().collect(), key=lambda r: str(r[source]))
    weights = weights or {r[source]: r["count"] ** 0.5 for r in counts}
    if missing := [r[source] for r in counts if r[source] not in weights]:
        raise ValueError(f"no target weight for {missing[:5]}")
    names, whole = [r[source] for r in counts], whole_weights([weights[r[source]] for r in counts])
    repeats = all(w * slots % sum(whole) == 0 for w in whole)
    buckets = max(1, -(-max((r["count"] for r in counts), default=0) // BUCKET_DOCS)) * 8
    order = F.xxhash64(key, F.lit(seed))
    placed = rows.groupBy(key, source).count().select(key, source, "count", order.alias("order"), F.pmod(F.shiftright("order", 40), F.lit(buckets)).alias("bucket"))
    placed = materialize(placed, "mix-rows") if len(counts) else placed
    sizes = placed.groupBy(source, "bucket").agg(F.sum("count").alias("count"))
    before = sizes.select(F.col(source).alias("b_source"), F.col("bucket").alias("b_bucket"), _sum_before(Window.partitionBy(source).orderBy("bucket")).alias("before"))
    within = _sum_before(Window.partitionBy(source, "bucket").orderBy("order", key))
    ranked = placed.withColumn("within", within).join(before, F.col(source).eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    ranked = ranked.select(key, source, "count", (F.col("before") + F.col("within")).alias("first"), F.explode(F.expr(f"sequence(0L, count - 1, {REPEATS}L)")).alias("some"))
    ranked = ranked.select(key, source, "first", F.explode(F.expr(f"sequence(some, least(some + {REPEATS}L, count) - 1)")).alias("more"))
    ranked = ranked.select(key, source, (F.col("first") + F.col("more")).alias("rank")).withColumn("block", F.expr(f"rank div {block_docs}"))
    if not repeats:
        return _numbered(_dealt(ranked, source, key, names, whole, [-(-r["count"] // block_docs) for r in counts]), key)
    shares = {n: w * slots // sum(whole) for n, w in zip(names, whole)}
    # all windows of a period end where it does, so the schedule of one is that of all
    period = exact_schedule(list(shares.values()), list(shares.values()))
    pattern = spark.createDataFrame([(names[i], shares[names[i]], *rest) for i, *rest in period], "p_source string, share long, k long, at long, p_release long, p_due long")
    share = pattern.select("p_source", "share").distinct()
    ranked = ranked.join(F.broadcast(share), F.col(source).eqNullSafe(F.col("p_source"))).drop("p_source")
    ranked = ranked.withColumns({"k": F.col("block") % F.col("share"), "turn": F.expr("block div share") * slots})
    slotted = ranked.join(F.broadcast(pattern.select("p_source", F.col("k").alias("p_k"), "at", "p_release", "p_due")), F.col(source).eqNullSafe(F.col("p_source")) & (F.col("k") == F.col("p_k")))
    slotted = slotted.select(key, source, "rank", "block", *((F.col("turn") + F.col(a)).alias(b) for a, b in (("at", "slot"), ("p_release", "release"), ("p_due", "deadline"))))
    return _numbered(slotted, key)


def _dealt(ranked: DataFrame, source: str, key: str, names: list, whole: list[int], blocks: list[int]) -> DataFrame:
    """The ranked rows with slot, release and deadline of their block in the exact schedule."""

    def run(batches):
        for _ in batches:
            out = []
            for i, *rest in exact_schedule(whole, blocks):
                out.append((names[i], *rest))
                if len(out) == 65_536:
                    yield batch(out)
                    out = []
            yield batch(out)

    columns = ("b_source", "b_block", "slot", "release", "deadline")

    def batch(out):
        kinds = (pa.string(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], list(columns))

    plan = ranked.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "b_source string, b_block long, slot long, release long, deadline long")
    plan = materialize(plan, "mix-blocks")
    joined = ranked.join(plan, F.col(source).eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    return joined.select(key, source, "rank", "block", "slot", "release", "deadline")


def _sum_before(w) -> Column:
    return F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _numbered(slotted: DataFrame, key: str, together: int = 64) -> DataFrame:
    """position: runs of slots are counted, the counts summed up, and rows numbered inside their run."""
    runs = slotted.withColumn("run", F.expr(f"slot div {together}"))
    sizes = runs.groupBy("run").count().withColumn("far", F.expr("run div 1024"))
    far = sizes.groupBy("far").agg(F.sum("count").alias("count")).select(F.col("far").alias("f"), _sum_before(Window.orderBy("far")).alias("far_before"))
    near = sizes.join(far, F.col("far") == F.col("f")).select(F.col("run").alias("r"), (F.col("far_before") + _sum_before(Window.partitionBy("far").orderBy("run"))).alias("run_before"))
    within = F.row_number().over(Window.partitionBy("run").orderBy("slot", "rank")) - 1
    return runs.withColumn("within", within).join(near, F.col("run") == F.col("r")).select(key, "source" if "source" in slotted.columns else slotted.columns[1], "rank", "block", "slot", "release", "deadline", (F.col("run_before") + F.col("within")).alias("position"))


def mixed(docs: DataFrame, weights: dict | None = None, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all of them, in the order of the mixture: sorted within and across partitions by position.

    Rows that repeat a key come together, at the first place of any of them. Rows with a null key can't be matched to
    their place and come last.
    """
    plan = mix(docs.filter(F.col(key).isNotNull()), weights, source, key, **options)
    of, position = spare(docs, "of", "position")
    places = materialize(plan.groupBy(F.col(key).alias(of)).agg(F.min("position").alias(position)), "mix-places")
    joined = docs.join(checked(places), docs[key].cast("long") == F.col(of), "left").withColumn(position, F.coalesce(position, F.lit(2**62)))
    return joined.repartitionByRange(position).sortWithinPartitions(position).select(*(F.col(f"`{c}`") for c in docs.columns))
