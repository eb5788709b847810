"""Merkle fixity audit of WARC replicas.

A replica is a table of records at byte offsets of files. Records are hashed;
nodes hash the ordered digests of their children: records in offset ranges,
ranges sixteen to one up to the file, files sixteen to one by digits of their
name's hash up to the root. Two replicas are compared from the root down, and
only children of nodes that differ are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from garoa.llm.shared import checkpointed

RANGE_BYTES = 1 << 16
FAN = 4
FILE_DIGITS = 2


def page_payload() -> Column:
    """A page of ``url, html`` as a WARC resource record; null is empty."""
    url, html = (F.coalesce(c, F.lit("")) for c in ("url", "html"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, html, F.lit("\r\n\r\n"))


def page_records(pages: DataFrame, per_file: int = 1000, **more: Column) -> DataFrame:
    """``file, offset, length, page_id, payload_sha256``: one record per row of ``pages(page_id, url, html, ...)``.

    A file holds the pages of ``per_file`` consecutive ids, by id; pages without
    id share one file. Columns in ``more`` are made from ``payload``; the
    payload itself is not moved.
    """
    numbered = F.format_string("pages-%08d.warc", F.floor(F.col("page_id") / per_file))
    name = F.when(F.col("page_id").isNull(), "pages-none.warc").otherwise(numbered)
    made = pages.select("page_id", name.alias("file"), page_payload().alias("payload"))
    hashed = {"length": F.octet_length("payload").cast("long"), "payload_sha256": F.sha2("payload", 256)}
    made = made.withColumns(hashed | more).drop("payload")
    before = Window.partitionBy("file").orderBy("page_id", "payload_sha256").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def leaves(replica: DataFrame, side: str) -> DataFrame:
    """``side, name, part, length, digest``: a row per distinct record; ``part`` is its offset.

    Records without an offset are spread below 0 by their digest.
    """
    own = F.col("payload_sha256") if "payload_sha256" in replica.columns else F.sha2(F.coalesce("payload", F.lit("")), 256)
    digest = F.sha2(F.concat_ws("|", F.col("length").cast("string"), own), 256)
    named = replica.select(F.lit(side).alias("side"), F.coalesce("file", F.lit("")).alias("name"), "offset", "length", digest.alias("digest"))
    part = F.coalesce("offset", -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 40)))
    return named.select("side", "name", part.alias("part"), "length", "digest").distinct()


def _parent(level: int, ranges: int) -> list[Column]:
    """The node above one of a level: a wider range, then files by digits of their hash, then the root."""
    name, part = F.col("name"), F.col("part")
    if level < 0:
        part = F.floor(part / RANGE_BYTES)
    elif level < ranges:
        part = F.shiftright(part, FAN)
    else:
        name = F.substring(F.sha2(name, 256) if level == ranges else name, 1, FILE_DIGITS - (level - ranges))
        part = F.lit(0).cast("long")
    return [name.alias("up_name"), part.alias("up_part")]


def build(records: DataFrame, ranges: int) -> list[DataFrame]:
    """The levels of the trees of all sides, ranges first, root last: ``side, name, part, digest``."""
    levels, current = [], records
    for level in range(-1, ranges + FILE_DIGITS + 1):
        child = F.struct("name", "part", "digest")
        up = current.groupBy("side", *_parent(level, ranges)).agg(F.array_sort(F.collect_list(child)).alias("children"))
        digest = F.sha2(F.array_join(F.transform("children", lambda c: c.digest), "|"), 256)
        current = checkpointed(up.select("side", F.col("up_name").alias("name"), F.col("up_part").alias("part"), digest.alias("digest")))
        levels.append(current)
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """``file, offset, status, left_length, left_digest, right_length, right_digest`` of every damaged record.

    ``left`` and ``right`` are replicas ``file, offset, length, payload, ...``, or
    with ``payload_sha256`` for a payload hashed where it lies.
    Status is ``changed``, ``missing`` (only on the left) or ``extra`` (only on
    the right). A null file or payload counts as empty; records without offset
    are compared by their digest. Equal repeated rows count once; of several
    records that differ at one offset the least digest is named. Other columns
    are ignored. Replicas that agree, and two empty ones, give an empty result.
    """
    records = checkpointed(leaves(left, "left").union(leaves(right, "right")))
    far = records.agg(F.max(F.abs("part"))).first()[0] or 0
    ranges = max(0, math.ceil(((far // RANGE_BYTES + 1).bit_length()) / FAN))
    levels = build(records, ranges)
    differ = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        if differ is not None:
            nodes = _below(nodes, differ, _parent(level, ranges))
        sides = nodes.groupBy("name", "part").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        differ = checkpointed(sides.where("n < 2 or low <> high").select("name", "part"))
    suspect = _below(records, differ, _parent(-1, ranges))
    alone = suspect.groupBy("name", "part", "length", "digest").agg(F.count("*").alias("n"), F.min("side").alias("side")).where("n < 2")
    pick = lambda side: F.min(F.when(F.col("side") == side, F.struct("digest", "length")))
    pairs = alone.groupBy("name", "part").agg(pick("left").alias("l"), pick("right").alias("r"))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("changed")
    return pairs.select(
        F.col("name").alias("file"),
        F.when(F.col("part") >= 0, F.col("part")).alias("offset"),
        status.alias("status"),
        F.col("l.length").alias("left_length"),
        F.col("l.digest").alias("left_digest"),
        F.col("r.length").alias("right_length"),
        F.col("r.digest").alias("right_digest"),
    )


def _below(children: DataFrame, differ: DataFrame, parent: list[Column]) -> DataFrame:
    """Children of nodes that differ."""
    up = differ.select(F.col("name").alias("up_name"), F.col("part").alias("up_part"))
    return children.select("*", *parent).join(up, ["up_name", "up_part"], "left_semi").drop("up_name", "up_part")
