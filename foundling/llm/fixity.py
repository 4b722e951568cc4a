"""Merkle fixity audit of two replicas of a WARC archive.

Records are leaves.  A node covers a range of record keys, sixteen children each, and hashes its children in order with
the byte range that each takes in the archive.  Two archives are compared at the root, and only below nodes that differ:
a level is cut down to the children of differing nodes before its two sides meet, and equal roots end the audit.  What is
left at the leaves are the damaged, missing and added records with their byte ranges.

Ranges are cut by key, so a lost record moves no other to another node.  Records of one key (a repeated row, or a hot
key) are one leaf: their digests are added up in four parts, which needs no list and no order.

Keys are whole numbers; a column of another type is refused.  Defined results: a null key is a leaf of its own (key null) after all others; a null body is an empty one; repeated rows
count, so a lost copy is found; two empty archives have no differences; extra columns are not part of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegralType

from ..session import freeze

FANOUT = 16
SIDES = ("left", "right")
FEW = 100_000  # differing nodes (24 bytes each) that every task may hold
UNDATED = "1970-01-01T00:00:00Z"


def record(url: Column, body: Column, date: Column | None = None) -> Column:
    """One WARC resource record as bytes: header, empty line, body, two empty lines.  The record id is a name-based UUID of
    URL, date and payload; ``date`` is the capture's time as WARC writes it, the epoch when unknown."""
    payload = F.coalesce(body, F.lit("")).cast("binary")
    day = F.coalesce(date, F.lit(UNDATED)) if date is not None else F.lit(UNDATED)
    uri, digest = F.coalesce(url, F.lit("")), F.sha2(payload, 256)
    name = F.sha2(F.concat_ws(" ", uri, day, digest).cast("binary"), 256)
    part = lambda at, n: F.substring(name, at, n)
    # version 8 and variant 2 of a UUID: its maker's own digest
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Date: "), day,
        F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha256:"), digest,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), payload, F.lit("\r\n\r\n").cast("binary"))


def leaves(archive: DataFrame, key: str, record: str) -> DataFrame:
    """``key``, ``bytes``, ``n`` and ``hash`` of the records of each key."""
    if not isinstance(archive.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must hold whole numbers")
    digest = F.sha2(F.col(record), 256)
    part = lambda i: F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")  # noqa: E731  60 bits each
    rows = archive.select(F.col(key).cast("long").alias("key"), F.octet_length(F.col(record)).cast("long").alias("bytes"), *[part(i).alias(f"p{i}") for i in range(4)])
    sums = rows.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(4)])
    return sums.select("key", "bytes", "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(4)]), 256).alias("hash"))


def tree(left: DataFrame, right: DataFrame) -> list[DataFrame]:
    """The levels of both trees, leaves first, each with ``side``, ``node``, ``bytes``, ``hash``, and frozen: a level is built
    from the one below, once."""
    both = left.withColumn("side", F.lit(SIDES[0])).unionByName(right.withColumn("side", F.lit(SIDES[1])))
    both = freeze(both)  # records are read and hashed once
    span = both.agg(F.min("key"), F.max("key")).first()
    low, high = (span[0] or 0), (span[1] or 0)
    # the null key stands after all others
    level = both.select("side", F.coalesce(F.col("key") - F.lit(low), F.lit(high - low + 1)).alias("node"), "key", "bytes", "n", "hash")
    levels, top = [level], high - low + 1
    while top > 0:
        top //= FANOUT
        child = F.struct(F.col("node").alias("node"), F.col("bytes").alias("bytes"), F.col("hash").alias("hash"))
        # at most FANOUT children
        level = (
            levels[-1].groupBy("side", F.floor(F.col("node") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"), F.sum("bytes").alias("bytes"))
        )
        # each child's first and last byte in the node, with its hash
        ranges = F.aggregate(
            "c", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("s")),
            lambda a, x: F.struct(
                (a["at"] + x["bytes"]).alias("at"),
                F.concat_ws(";", a["s"], F.concat_ws(",", x["node"].cast("string"), a["at"].cast("string"), (a["at"] + x["bytes"]).cast("string"), x["hash"])).alias("s"),
            ),
        )["s"]
        level = freeze(level.select("side", F.col("up").alias("node"), "bytes", F.sha2(ranges, 256).alias("hash")))
        levels.append(level)
    return levels


def audit(left: DataFrame, right: DataFrame, *, key: str, record: str) -> DataFrame:
    """The keys whose records differ: ``key``, ``status`` (changed, missing, added), byte range in the left archive,
    and the leaf hashes of both sides."""
    levels = tree(leaves(left, key, record), leaves(right, key, record))
    found = differing(levels[-1].withColumn("up", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long")), len(levels) == 1)
    for depth in range(len(levels) - 2, -1, -1):
        n = found.count()
        kids = levels[depth].withColumn("up", F.floor(F.col("node") / FANOUT))
        parent = found.select(F.col("node").alias("up"), F.col("start").alias("base"))
        if not n:  # equal so far, so below as well
            kids = levels[0].limit(0).withColumns({"up": F.lit(0).cast("long"), "base": F.lit(0).cast("long")})
            return _report(differing(kids, True))
        found = differing(kids.join(F.broadcast(parent) if n <= FEW else parent, "up"), depth == 0)
    return _report(found)


def differing(level: DataFrame, last: bool) -> DataFrame:
    """Of the nodes of a level (both sides, with their parent ``up`` and its first byte ``base``) those whose hashes differ,
    with their own first byte ``start``.  Frozen, for the level below reads it twice."""
    more = ("key", "n") if last else ()
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    both = level.groupBy("up", "base", "node").agg(*[of(side, c) for side in SIDES for c in ("bytes", "hash", *more)])
    before = W.partitionBy("up").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(F.coalesce("left_bytes", F.lit(0))).over(before), F.lit(0))
    return freeze(both.withColumn("start", start).filter(~F.col("left_hash").eqNullSafe(F.col("right_hash"))))


def _report(found: DataFrame) -> DataFrame:
    return found.select(
        F.coalesce("left_key", "right_key").alias("key"),
        F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "added").otherwise("changed").alias("status"),
        F.col("start").alias("first_byte"), (F.col("start") + F.coalesce("left_bytes", F.lit(0))).alias("end_byte"),
        F.coalesce("left_n", F.lit(0)).cast("long").alias("left_records"), F.coalesce("right_n", F.lit(0)).cast("long").alias("right_records"),
        F.col("left_hash"), F.col("right_hash"),
    )
