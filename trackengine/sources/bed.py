"""BED and bedGraph text as Spark tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import track_sizes, write_track  # noqa: F401

BED9 = ["seqname", "from", "to", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no header or comment, split at tabs. Gzip goes by the file's ending; gzip under another name is an error."""
    text = spark.read.text(path)
    if bad := misnamed_gzip(text):
        raise ValueError(f"gzip files must be named .gz: {', '.join(bad[:5])}")
    return text.filter(~F.col("value").rlike(r"^(track|browser|#)") & (F.trim("value") != "")).withColumn("f", F.split("value", "\t"))


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _lines(spark, path).select(f[0].alias("seqname"), f[1].cast("int").alias("from"), f[2].cast("int").alias("to"))


def read_bed9(spark: SparkSession, path: str) -> DataFrame:
    """BED9 columns and line, a number that grows with the place in a file. Only header lines are left out."""
    f, ints = F.col("f"), {"from", "to", "score", "thickStart", "thickEnd"}
    rows = _lines(spark, path).withColumn("line", F.monotonically_increasing_id())
    return rows.select(*(F.get(f, F.lit(i)).cast("int" if c in ints else "string").alias(c) for i, c in enumerate(BED9)), "line")


def write_bed9(segments: DataFrame, path: str, name: str, description: str, compress: bool = False) -> None:
    """A folder of BED9 text in order of place, its first file headed by the track line."""
    head = f'track name="{name}" description="{description}" visibility=1 itemRgb="On"'
    lines = segments.select(F.lit(1).alias("k"), "seqname", "from", F.concat_ws("\t", *BED9).alias("value"))
    first = segments.sparkSession.createDataFrame([(0, "", 0, head)], lines.schema)
    ordered = first.unionByName(lines).repartitionByRange("k", "seqname", "from").sortWithinPartitions("k", "seqname", "from")
    ordered.select("value").write.mode("overwrite").text(path, compression="gzip" if compress else "none")


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """(seqname, from, to, value) rows of a binned signal."""
    f = F.col("f")
    return _lines(spark, path).select(f[0].alias("seqname"), f[1].cast("int").alias("from"), f[2].cast("int").alias("to"), f[3].cast("double").alias("value"))


def bedgraph_signal(rows: DataFrame, bin_size: int) -> DataFrame:
    """(seqname, pos, value) observations, one for each bin of bin_size that a row reaches into."""
    first, last = F.expr(f"`from` div {bin_size}"), F.expr(f"(`to` - 1) div {bin_size}")
    return rows.filter(F.col("to") > F.col("from")).select("seqname", F.explode(F.transform(F.sequence(first, last), lambda b: b * bin_size)).alias("pos"), "value")


def is_gzip(head: bytes) -> bool:
    """Whether a file's first bytes are those of gzip."""
    return head[:2] == b"\x1f\x8b"


def misnamed_gzip(text: DataFrame) -> list[str]:
    """Files of a text table that are gzip but aren't called so, by the first two bytes of each."""
    spark, bad = text.sparkSession, []
    for name in text.inputFiles():
        if not name.endswith(".gz"):
            at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
            stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
            head = [stream.read(), stream.read()]
            stream.close()
            if min(head) >= 0 and is_gzip(bytes(head)):
                bad.append(name)
    return bad


def write_histogram_text(lines: DataFrame, header: str, path: str) -> None:
    """The text table of (track, state, value, text) lines in their order, its first file headed by the header."""
    rows = lines.select(F.lit(1).alias("k"), "track", "state", "value", "text")
    first = lines.sparkSession.range(1).select(F.lit(0).alias("k"), *(F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("track", "state", "value")), F.lit(header).alias("text"))
    order = ["k", "track", "state", "value"]
    first.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("overwrite").text(path)
