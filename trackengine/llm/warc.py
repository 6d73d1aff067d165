"""WARC records under Merkle trees: fixity roots, and audits that descend only where two replicas differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Children of a tree node; records of a file, about.
FANOUT = 16
FILE_RECORDS = 1024
#: Files that one task orders, about, and tasks for all of them at most.
TASK_FILES, TASKS = 4, 1 << 15


def warc_records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, offset, length, page_id, record): each page as a WARC/1.1 resource record, and where it lies in which file.

    Pages go to files by a hash of page_id and url, about file_records in each, ordered by page_id, url and digest; offsets
    follow from the lengths. Null url and html are empty, a null page_id is written as such. An empty table gives no rows.
    """
    files = max(1, -(-pages.count() // file_records))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page, url = F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit(""))
    body = html.cast("binary")
    lines = ["WARC/1.1", "WARC-Type: resource", F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]+", " ")), F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(body, 256)), "Content-Type: text/html", F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")), "", ""]
    head = F.concat_ws("\r\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    record = F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))
    rows = pages.select(page.alias("page_id"), F.pmod(F.xxhash64(page, url), F.lit(files)).alias("file"), url.alias("url"), record.alias("record"))
    rows = rows.withColumn("length", F.octet_length("record").cast("long")).repartition(min(-(-files // TASK_FILES), TASKS), "file")
    order = Window.partitionBy("file").orderBy("page_id", "url", F.sha2("record", 256)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"), "length", "page_id", "record")


def leaves(records: DataFrame) -> DataFrame:
    """(file, node, lo, hi, digest): level 0, a node for each record, numbered by offset; digest of its bytes and range."""
    digest = F.sha2(F.col("record"), 256)
    node = F.row_number().over(Window.partitionBy("file").orderBy("offset")) - 1
    lo, hi = F.col("offset"), F.col("offset") + F.col("length")
    return records.select("file", F.col("offset"), F.col("length"), digest.alias("d")).select("file", node.cast("long").alias("node"), lo.alias("lo"), hi.alias("hi"), _seal(F.col("d"), lo, hi).alias("digest"))


def _seal(inner: Column, lo: Column, hi: Column) -> Column:
    return F.sha2(F.concat_ws(":", inner, lo.cast("string"), hi.cast("string")).cast("binary"), 256)


def _parents(level: DataFrame, fanout: int) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("node", "digest")))
    up = level.groupBy("file", F.expr(f"node div {fanout}").alias("parent")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids.alias("kids"))
    joined = F.concat_ws(",", F.transform("kids", lambda k: k["digest"]))
    return up.select("file", F.col("parent").alias("node"), "lo", "hi", _seal(joined, F.col("lo"), F.col("hi")).alias("digest"))


def merkle_tree(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the tree over (file, offset, length, record): first the records' nodes, last one node for each file.

    A node seals the digests of at most `fanout` children in order and the range of offsets they cover. Each level is a
    table of its own; a file's root alone says whether a replica of the file is whole.
    """
    levels = [materialize(leaves(records), "merkle")]
    while levels[-1].filter("node > 0").limit(1).count():
        levels.append(materialize(_parents(levels[-1], fanout), "merkle"))
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, lo, hi, fault): records that differ between two trees of the same files.

    Roots are compared first; each further level only below nodes that differ, so an intact file costs one comparison.
    fault: 'changed', 'missing' (in the replica) or 'added'; lo and hi are the record's range, ours where we have it.
    Trees of unequal height are compared from the lower one's top down.
    """
    height = min(len(ours), len(theirs))
    below = None
    for a, b in reversed(list(zip(ours[:height], theirs[:height]))):
        a, b = a.withColumn("a", F.lit(1)), b.withColumn("b", F.lit(1))
        if below is not None:
            a, b = (x.withColumn("parent", F.expr(f"node div {fanout}")).join(below, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        a, b = a.select("file", "node", *(F.col(x).alias(f"a_{x}") for x in ("lo", "hi", "digest"))), b.select("file", "node", *(F.col(x).alias(f"b_{x}") for x in ("lo", "hi", "digest")))
        differ = a.join(b, ["file", "node"], "full").filter("NOT (a_digest <=> b_digest)")
        below = differ.select("file", F.col("node").alias("parent"))
    fault = F.when(F.col("a_digest").isNull(), "added").when(F.col("b_digest").isNull(), "missing").otherwise("changed")
    return differ.select("file", F.coalesce("a_lo", "b_lo").alias("lo"), F.coalesce("a_hi", "b_hi").alias("hi"), fault.alias("fault"))


def corpus_root(tree: list[DataFrame], fanout: int = FANOUT) -> str | None:
    """One digest over the roots of all files, level by level in the order of files; None without any file."""
    level = tree[-1].select(F.lit(0).cast("long").alias("file"), F.col("file").cast("long").alias("node"), F.lit(0).cast("long").alias("lo"), F.col("hi"), "digest")
    top = level.agg(F.max("node")).first()[0]
    if top is None:
        return None
    level = reduce(lambda df, _: _parents(df, fanout), range(_height(top, fanout)), level)
    return level.first().digest


def _height(top: int, fanout: int) -> int:
    n = 0
    while top:
        top, n = top // fanout, n + 1
    return n


def damaged(records: DataFrame, salt: str = "fixity drill", one_in: int = 257) -> DataFrame:
    """A replica with a byte turned over in about one of `one_in` records, chosen by their digests, for fixity drills.

    Every record stays; `hurt` tells which ones a complete audit must find.
    """
    hurt = F.pmod(F.xxhash64("record", F.lit(salt)), F.lit(one_in)) == 0
    middle = F.expr("length div 2").cast("int")
    other = F.unhex(F.lpad(F.hex(255 - F.conv(F.hex(F.substring("record", middle + 1, F.lit(1))), 16, 10).cast("int")), 2, "0"))
    turned = F.concat(F.substring("record", F.lit(1), middle), other, F.substring("record", middle + 2, F.col("length").cast("int")))
    return records.select("file", "offset", "length", "page_id", F.when(hurt, turned).otherwise(F.col("record")).alias("record"), hurt.alias("hurt"))


def fixity_drill(pages: DataFrame, fanout: int = FANOUT, file_records: int = FILE_RECORDS) -> DataFrame:
    """(page_id, file, lo, hi, digest, root, hurt, found) for every page: its leaf, its file's root, and the audit's word.

    A replica is damaged() and audited against the original; found must equal hurt everywhere.
    """
    records = materialize(warc_records(pages, file_records), "warc")
    replica = damaged(records)
    ours, theirs = merkle_tree(records, fanout), merkle_tree(replica, fanout)
    found = audit(ours, theirs, fanout).select(F.col("file").alias("f"), F.col("lo").alias("l"), F.lit(True).alias("found"))
    base = ours[0].join(ours[-1].select("file", F.col("digest").alias("root")), "file")
    marks = replica.select(F.col("file").alias("r_file"), F.col("offset").alias("r_lo"), "page_id", "hurt")
    out = base.join(marks, (F.col("file") == F.col("r_file")) & (F.col("lo") == F.col("r_lo")))
    out = out.join(found, (F.col("file") == F.col("f")) & (F.col("lo") == F.col("l")), "left")
    return out.select("page_id", "file", "lo", "hi", "digest", "root", "hurt", F.coalesce("found", F.lit(False)).alias("found"))
