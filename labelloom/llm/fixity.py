"""Fixity audit of WARC replicas by Merkle trees.

The records of a replica, in order, lie at consecutive offsets of its files. A leaf hashes a record with its offset and
length; a node hashes its FAN children, which cover one range of offsets. Two replicas whose roots agree are equal. If
they do not, only the children of nodes that differ are compared, level by level, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.llm.common import in_order
from labelloom.staging import stage

FAN, LEVELS_TO_FILE = 16, 3
#: Records of a file: the leaves below a node LEVELS_TO_FILE up.
PER_FILE = FAN**LEVELS_TO_FILE
CRLF = "\r\n"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as text; a null url or body is an empty one."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"),
    )
    return F.concat(head, F.lit(CRLF * 2), body, F.lit(CRLF * 2))


def leaves(pages: DataFrame) -> DataFrame:
    """A row for each record: ``node`` (its number), ``page_id``, ``file``, ``offset``, ``length``, ``digest`` and ``hash``.

    Records are in order of (page_id, digest); records equal in both are interchangeable. Offsets start anew in each
    file of PER_FILE records.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = stage(pages.select(F.col("page_id").cast("long"), record.alias("r")).select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest")), "records")
    placed = in_order(hashed, ["page_id", "digest"], "length").with_places("node", "_before")
    file = F.expr(f"node div {PER_FILE}")
    in_file = Window.partitionBy("file")
    offset = F.col("_before") - F.min("_before").over(in_file)
    return stage(
        placed.withColumn("file", file)
        .withColumn("offset", offset)
        .select("node", "page_id", "file", "offset", "length", "digest", F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256).alias("hash")),
        "leaves",
    )


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: the hash of up to FAN children in order."""
    child = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return nodes.groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.sha2(F.array_join(child["hash"], ""), 256).alias("hash"))


def tree(level: DataFrame) -> list[DataFrame]:
    """All levels from the leaves to the root; an empty replica has no nodes."""
    levels, width = [level.select("node", "hash")], level.count()
    while width > 1:
        levels.append(stage(parents(levels[-1]), "nodes"))
        width = -(-width // FAN)
    return levels


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose hashes differ or that one side lacks."""
    both = a.select("node", F.col("hash").alias("a")).join(b.select("node", F.col("hash").alias("b")), "node", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ: ``page_id, file, record, offset, length, expected, found``, the last null where the replica has
    no record in that place; the first and what was expected are null where only the replica has one.

    A record of another length moves all that follow it in its file and they are reported as well, since no
    range of that file then holds what it should; other files are not affected, unless records are lost or
    added, which moves records across files. Equal replicas, and two empty ones, give no rows.
    """
    sides = [leaves(pages), leaves(replica)]
    trees = [tree(s) for s in sides]
    while len(trees[0]) != len(trees[1]):  # unlike heights: go on up from the lower one
        low = min(trees, key=len)
        low.append(stage(parents(low[-1]), "nodes"))
    bad = stage(unequal(trees[0][-1], trees[1][-1]), "unequal")
    for a, b in list(zip(*trees))[-2::-1]:
        if bad.isEmpty():
            break
        up = bad.select(F.col("node").alias("up"))
        below = [t.join(up, F.expr(f"node div {FAN}") == F.col("up"), "left_semi") for t in (a, b)]
        bad = stage(unequal(*below), "unequal")
    own = sides[0].join(bad, "node", "left_semi").select("node", "page_id", "file", "offset", "length", F.col("digest").alias("expected"))
    other = sides[1].join(bad, "node", "left_semi").select("node", F.col("file").alias("f"), F.col("offset").alias("o"), F.col("length").alias("l"), F.col("digest").alias("found"))
    return own.join(other, "node", "full").select(
        "page_id",
        F.coalesce("file", "f").alias("file"),
        (F.col("node") % PER_FILE).alias("record"),
        F.coalesce("offset", "o").alias("offset"),
        F.coalesce("length", "l").alias("length"),
        "expected",
        "found",
    )


def decayed(pages: DataFrame) -> DataFrame:
    """A replica with damage in a known fiftieth of its records: letters changed in place."""
    return pages.withColumn("html", F.when(F.col("page_id") % 50 == 7, F.translate("html", "e", "3")).otherwise(F.col("html")))
