"""Sharding by Karmarkar-Karp differencing: indivisible groups (equal texts) to shards of nearly equal bytes.

Partial partitions are tuples of ``shards`` sums.  The two with the largest spread are combined again and again, the
largest sum of one with the smallest of the other, until one is left.

Groups come in classes by size, each class at most ``RANGE`` times finer than the one before, so the first holds at most
``RANGE`` groups and each later one is dealt over tasks of about ``PER_TASK`` groups.  A task starts from a partial
partition that the classes before have left, in proportion to its bytes: the smaller groups thereby even out what the
larger ones could not.  Only the sums of a class (one number per shard) pass through the driver.

Defined results: a null text is a group of its own; a group larger than a shard's fair share stays whole and the others
are balanced around it; repeated rows each count and stay together; an empty table gives no rows; extra columns pass.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import freeze
from .common import text_key

SHARDS = 16
RANGE = 4096
PER_TASK = 50_000
#: Rows of one slot count.
PER_CHUNK = 1 << 17


def difference(sizes: Sequence[int], start: Sequence[float], shards: int = SHARDS, seed: str = "") -> list[int]:
    """A shard for each size, by differencing.  ``start`` is a first partial partition whose places are the shards."""
    lines: list[list] = []  # (sum, members) in falling order; members is a tree of indices
    heap: list[tuple[float, int, int]] = []

    def put(parts: list) -> None:
        parts.sort(key=lambda x: -x[0])
        low = parts[-1][0]
        lines.append([(s - low, m) for s, m in parts])
        heapq.heappush(heap, (low - parts[0][0], len(lines) - 1, 0))

    # shards that start alike take turns, or what tasks leave over would add up in the same ones
    first = [(float(s), ("shard", i)) for i, s in enumerate(start)]
    random.Random(f"{seed}:{len(sizes)}:{sum(sizes)}").shuffle(first)
    put(first)
    for i, size in enumerate(sizes):
        put([(float(size), ("one", i))] + [(0.0, None)] * (shards - 1))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = lines[a], lines[b]
        lines[a] = lines[b] = None
        put([
            (s + t, m if n is None else n if m is None else ("both", m, n))
            for (s, m), (t, n) in zip(x, reversed(y), strict=True)
        ])
    out = [0] * len(sizes)
    for _, tree in lines[heap[0][1]]:
        stack, members, shard = [tree], [], 0
        while stack:
            node = stack.pop()
            if node is None:
                continue
            if node[0] == "both":
                stack += node[1:]
            elif node[0] == "one":
                members.append(node[1])
            else:
                shard = node[1]
        for i in members:
            out[i] = shard
    return out


def _class(size: Column, total: int) -> Column:
    """0 for groups over a RANGE-th of all bytes, 1 for those over a RANGE-th of that, and so on."""
    out, bound, k = F.lit(0), total, 0
    while bound > RANGE:
        bound //= RANGE
        k += 1
        out = F.when(size <= bound, F.lit(k)).otherwise(out)
    return out


def _dealer(over: list[float], shards: int):
    """Differencing of one task's groups, from what the classes before left for each byte of these."""

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        mine = int(frame["bytes"].sum())
        shard = difference(frame["bytes"].tolist(), [x * mine for x in over], shards, bytes(frame["key"].iloc[0]).hex())
        return pd.DataFrame({"key": frame["key"], "shard": pd.array(shard, dtype="int32"), "bytes": frame["bytes"]})

    return deal


def assign(groups: DataFrame, *, shards: int = SHARDS, per_task: int = PER_TASK) -> DataFrame:
    """``key``, ``bytes`` of each group to ``key``, ``shard``."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    classed = freeze(groups.withColumn("class", _class(F.col("bytes"), total)))
    counts = sorted((r["class"], r["n"], r["b"]) for r in classed.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).collect())
    sums, parts = [0] * shards, []
    for k, n, nbytes in counts:
        low = min(sums)
        over = [(s - low) / max(nbytes, 1) for s in sums]

        tasks = -(-n // per_task)
        dealt = freeze(
            classed.filter(F.col("class") == k).groupBy(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"))
            .applyInPandas(_dealer(over, shards), "key binary, shard int, bytes long")
        )
        for r in dealt.groupBy("shard").agg(F.sum("bytes").alias("b")).collect():
            sums[r["shard"]] += r["b"]
        parts.append(dealt.select("key", "shard"))
    if not parts:
        return spark.createDataFrame([], "key binary, shard int")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def shard(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, per_task: int = PER_TASK) -> DataFrame:
    """Each row as a struct ``row``, with ``size``, ``shard`` and ``slot``, its place in the shard."""
    body = F.col(text)
    size = (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long")
    key = F.when(body.isNull(), F.unhex(F.lit("00"))).otherwise(text_key(body))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"), key.alias("key"), F.col(doc_id).alias("_id"))
    small = docs.select(size.alias("size"), key.alias("key"))
    groups = small.groupBy("key").agg(F.sum("size").alias("bytes"))
    found = rows.join(assign(groups, shards=shards, per_task=per_task), "key")
    return _slots(found, docs.count(), shards).select("row", "size", "shard", "slot")


def _slots(found: DataFrame, rows: int, shards: int) -> DataFrame:
    """Gapless numbers from 0 in each shard: a count inside chunks of rows, after the counts of the chunks before."""
    chunks = max(1, -(-rows // PER_CHUNK))
    # rows of one id stay apart by their text, so that a hot id does not fill a chunk
    found = found.withColumn("_chunk", F.pmod(F.xxhash64("_id", "key"), F.lit(chunks)))
    sizes = found.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("shard", "_chunk").orderBy("_id", "key")) - 1
    return found.withColumn("_in", inside).join(starts, ["shard", "_chunk"]).withColumn("slot", (F.col("_start") + F.col("_in")).cast("long"))
