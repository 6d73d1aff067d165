"""State tracks and segmentations: import to bins, runs, hierarchies, histograms by state, BED9 text."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackengine.functions.arrays import colours

from .intervals import merge_runs
from .track import KEYS, Track, spine
from .windows import BLOCK, runs


@dataclass(frozen=True)
class StateTree:
    """A node of a hidden-state hierarchy: states [lo, hi) and children."""

    lo: int
    hi: int
    children: tuple["StateTree", ...] = field(default=())

    @classmethod
    def from_json(cls, doc: dict) -> "StateTree":
        lo, hi = doc["States"]
        return cls(lo, hi, tuple(cls.from_json(c) for c in doc.get("Children") or ()))

    def leaves(self) -> list["StateTree"]:
        return [self] if not self.children else [x for c in self.children for x in c.leaves()]


def state_groups(tree: StateTree, level: int) -> dict[int, int]:
    """State to group: each child of a node at the level is one, and so is a leaf at or above it; numbered depth first."""
    out: dict[int, int] = {}

    def mark(node: StateTree) -> None:
        group = len(set(out.values()))
        for leaf in node.leaves():
            for k in range(leaf.lo, leaf.hi):
                out[k] = group

    def walk(node: StateTree, depth: int) -> None:
        if not node.children:
            mark(node)
        elif depth == level:
            for c in node.children:
                mark(c)
        else:
            for c in node.children:
                walk(c, depth + 1)

    walk(tree, 0)
    if not out:
        raise ValueError("the tree has no states at this level")
    return out


def tree_levels(tree: StateTree) -> list[dict[str, int]]:
    """A row for each state with the number of its node on each level of the tree, from 0; leaves are numbered in order."""
    rows: dict[int, dict[str, int]] = {}
    count = 0

    def walk(node: StateTree, depth: int, above: dict[str, int]) -> None:
        nonlocal count
        if not node.children:
            count += 1
            for k in range(node.lo, node.hi):
                rows[k] = {"state": k, **above, f"L{depth}": count}
        for c in node.children:
            walk(c, depth + 1, above | {f"L{depth}": depth})

    walk(tree, 0, {})
    return [rows[k] for k in sorted(rows)]


def import_segmentation(segments: DataFrame, genome: DataFrame, bin_size: int, states: dict[str, int] | None = None, fill: float = 0.0) -> Track:
    """A state track from (seqname, from, to, name, line): bins of from, from + bin_size, … below to get the state.

    The state is that of the map, or the number after the name's first character; later lines overwrite earlier ones.
    Bins without a segment get fill. A name that gives no state is an error.
    """
    if states is None:
        number = F.when(F.length("name") > 1, F.substring("name", 2, 1000).cast("int"))
    else:
        number = F.create_map(*(F.lit(x) for p in states.items() for x in p))[F.col("name")] if states else F.lit(None).cast("int")
    known = F.coalesce(number, F.raise_error(F.concat(F.lit("no state for segment "), F.coalesce("name", F.lit("null")))).cast("int"))
    rows = segments.filter(F.col("to") > F.col("from")).select("seqname", known.alias("state"), "line", F.explode(F.sequence(F.col("from"), F.col("to") - 1, F.lit(bin_size))).alias("pos"))
    last = rows.groupBy("seqname", F.expr(f"pos div {bin_size}").cast("int").alias("bin")).agg(F.max_by("state", "line").alias("state"))
    df = spine(genome).join(last, KEYS, "left").select(*KEYS, F.coalesce(F.col("state").cast("double"), F.lit(fill)).alias("value"))
    return Track(df, genome, bin_size, fill)


def state_runs(track: Track, block: int = BLOCK) -> DataFrame:
    """(seqname, from, to, state): maximal runs of equal values. NaN, negative or fractional states are an error."""
    bad = F.isnan("value") | (F.col("value") < 0) | (F.col("value") != F.floor("value"))
    state = F.when(bad, F.raise_error(F.lit("states must be whole numbers from 0")).cast("int")).otherwise(F.col("value").cast("int"))
    rows = track.df.select(F.concat_ws("\t", "seqname", state.cast("string")).alias("seqname"), "bin")
    found = runs(rows, F.lit(0), block)
    pair = F.split("seqname", "\t")
    return found.select(pair[0].alias("seqname"), (F.col("first") * track.bin_size).alias("from"), ((F.col("last") + 1) * track.bin_size).alias("to"), pair[1].cast("int").alias("state"))


def hierarchical_runs(track: Track, tree: StateTree, level: int) -> DataFrame:
    """Runs of the groups that states have at a level of a tree; a state without a group is an error."""
    groups = F.create_map(*(F.lit(float(x)) for p in state_groups(tree, level).items() for x in p))
    group = F.coalesce(groups[F.col("value")], F.raise_error(F.concat(F.lit("no group for state "), F.col("value").cast("string"))).cast("double"))
    return state_runs(replace(track, df=track.df.select(*KEYS, group.alias("value"))))


def bed9(segments: DataFrame, names: list[str] | None = None, rgb: list[str] | None = None, scores: list[int] | None = None, n: int | None = None) -> DataFrame:
    """BED9 columns of (seqname, from, to, state) rows; names s0, s1, … and a grid of colours by default."""
    n = n or max(len(names or ()), len(rgb or ()), 1)
    names, rgb = names or [f"s{i}" for i in range(n)], rgb or colours(n)
    if len(names) < n or len(rgb) < n:
        raise ValueError("a name and a colour are needed for each state")
    of = lambda xs: F.get(F.array(*(F.lit(x) for x in xs)), F.col("state"))
    return segments.select("seqname", "from", "to", of(names).alias("name"), (of(scores) if scores else F.lit(0)).alias("score"), F.lit(".").alias("strand"), F.col("from").alias("thickStart"), F.col("to").alias("thickEnd"), of(rgb).alias("itemRgb"))


def merge_segments(segments: DataFrame) -> DataFrame:
    return merge_runs(segments)


def histogram_by_state(states: Track, tracks: list[Track], nstates: int) -> DataFrame:
    """(track, state, value, count): how often each exact value of each track occurs in bins of each state.

    States outside [0, nstates) are an error; NaN values are one row with their count.
    """
    at = F.col("s").cast("int")
    state = F.when(F.isnan("s") | (at < 0) | (at >= nstates), F.raise_error(F.lit("state out of range")).cast("int")).otherwise(at)
    long = None
    for i, t in enumerate(tracks):
        part = t.df.select(*KEYS, F.lit(i).alias("track"), "value")
        long = part if long is None else long.unionByName(part)
    rows = long.join(states.df.select(*KEYS, F.col("value").alias("s")), KEYS)
    return rows.groupBy("track", state.alias("state"), "value").agg(F.count("*").alias("count"))


def histogram_text(hist: DataFrame) -> DataFrame:
    """(track, state, value, text): the lines of the text table, to be ordered by the first three."""
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    return hist.select("track", "state", "value", F.format_string("%10d %10d %20s %15d", "track", "state", number, "count").alias("text"))


HISTOGRAM_HEADER = f"{'track':>10} {'state':>10} {'value':>20} {'count':>15}"
