"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(links: DataFrame) -> DataFrame:
    """One round on links (u > v): each node's larger neighbours, then its smaller ones, move to its smallest."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """From links (u, v) of non-null ids: one row (node, component) for every node with a link to another.

    component is the smallest node that can be reached. Self-links and repeated links change nothing, no links give no
    rows. Each round writes its links to the shared folder, so that lineage stays short; minima are taken before the
    shuffle, and the joins are ones whose large partitions Spark can split.
    """
    now = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    while seen[0]:
        after = materialize(_stars(now), label)
        found = print_of(after)
        discard(now)
        now, changed, seen = after, found != seen, found
        if not changed:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
