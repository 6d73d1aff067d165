"""From raw documents to packed sequences: language, near copies, repeated passages, mixture, packing.

Each stage reads the Parquet that the one before wrote; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackengine.llm import langid, mixing, nearcopies, packing, suffix
from trackengine.llm.common import checked, discard, materialize, spare


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those of which no language has half; the rest stay as they are."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (the smallest doc_id): five-word shingles, Jaccard similarity 0.8 or more.

    SimHash fingerprints group candidates; as 64 bits can't tell 0.8 from less (the README has figures), texts that share a band of
    minimum hashes are candidates too. All are compared exactly. Of rows that are repeated in full one stays.
    """
    return nearcopies.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that occurred before, in another text or the same one."""
    return suffix.suffix_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the rows in the order of the mixture of sources, to the square roots of their sizes; all rows stay."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048, which are filled and numbered in the order of the rows read.

    That order is the mixture's, by the names of its files (in the order of partitions) and the rows' places in them.
    """
    at, row, name, before = spare(docs, "file", "row", "name", "before")
    meta = docs.metadataColumn("_metadata")
    docs = docs.select("*", meta["file_path"].alias(at), meta["row_index"].alias(row))
    sizes = docs.groupBy(F.col(at).alias(name)).agg((F.max(row) + 1).alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(Window.orderBy(F.length(name), name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(sizes.select(name, earlier.alias(before)), "files")
    return packing.pack(docs.join(checked(sizes), F.col(at) == F.col(name)), order=F.col(before) + F.col(row))


STAGES = [("language ID", language), ("near-dedup", near_copies), ("suffix-array dedup", repeated_passages), ("mixing to target weights", mixture), ("best-fit packing", packing_stage)]

#: Minimum hashes, suffix comparison and tokens aren't expressible in SQL; tests hold the stages' operators against brute force
#: and run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again.

    A stage's table goes once the next one is written, the last one when the application ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
        discard(*before)
        before = [docs]
    return docs
