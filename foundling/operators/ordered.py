"""Ordered operators that survive a hot key.

A plain window over a key puts all rows of the key into one task.  The
operators here first split long keys into contiguous chunks of the order
column, run the window inside each chunk, and carry one summary row per chunk
from one chunk to the next.  No task ever holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import freeze

CHUNK = "_chunk"
SMALL = 10_000


def fixed_chunks(df: DataFrame, position: str | Column, width: int) -> DataFrame:
    """Chunks of ``width`` consecutive positions.  For dense integer positions
    (turn numbers, line numbers) this bounds a chunk exactly, with no pass over
    the data."""
    pos = F.col(position) if isinstance(position, str) else position
    return df.withColumn(CHUNK, F.floor(pos / F.lit(width)))


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Chunks of about ``rows_per_chunk`` rows for the keys that are longer.

    A count per key finds those keys; there are at most ``rows / rows_per_chunk``
    of them, and usually none.  Their rows alone are range partitioned on
    (key, order), and the first row of each partition is a split point.  The
    points are frozen: both levels of a carry must see the same chunks.  Their
    number follows the rows.  ``order`` names columns of any ordered type and
    should end in a tie-break: only rows equal in all of it share a chunk of
    any size.
    """
    keys, order = list(keys), list(order)
    long = freeze(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_chunk))
    found, rows = long.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not found:
        return df.withColumn(CHUNK, F.lit(0).cast("long"))
    hot = _by_key(df.select(*dict.fromkeys([*keys, *order])), _sized(long.select(*keys), found), keys, "left_semi")
    ranged = hot.repartitionByRange(-(-rows // rows_per_chunk) + 1, *keys, *order).withColumn("_part", F.spark_partition_id())
    firsts = freeze(ranged.groupBy(*keys, "_part").agg(F.min(F.struct(*order)).alias("_from")))
    points = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list("_from")).alias("_cuts"))
    # count the points up to a row in two steps of about the square root of their number
    step = F.ceil(F.sqrt(F.size("_cuts"))).cast("int")
    side = points.withColumn("_step", step).withColumn(
        "_ends", F.filter(F.transform("_cuts", lambda c, i: F.when((i + 1) % F.col("_step") == 0, c)), lambda c: c.isNotNull())
    )
    at = F.struct(*order)
    passed = lambda cuts: F.size(F.filter(cuts, lambda c: c <= at))
    joined = _by_key(df, _sized(side, firsts.count()), keys, "left").withColumn("_block", passed(F.col("_ends")) * F.col("_step"))
    chunk = F.col("_block") + passed(F.slice("_cuts", F.col("_block") + 1, F.col("_step")))
    return joined.withColumn(CHUNK, F.coalesce(chunk, F.lit(0)).cast("long")).drop("_cuts", "_ends", "_step", "_block")


def _sized(side: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side that has been counted to be small; leave others to Spark."""
    return F.broadcast(side) if rows <= SMALL else side


def _by_key(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys that may be null on both sides; the side's keys are dropped."""
    renamed = side.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _carried(df: DataFrame, keys: Sequence[str], summary: Column, carry) -> DataFrame:
    """One row per (keys, chunk) with the value carried in from the chunks before."""
    per_chunk = df.groupBy(*keys, CHUNK).agg(summary.alias("_s"))
    before = W.partitionBy(*keys).orderBy(CHUNK)
    return per_chunk.select(*keys, CHUNK, carry(F.col("_s"), before).alias("_in"))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` on chunked rows."""
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order)
    numbered = df.withColumn(out, F.row_number().over(inner))
    carry = _carried(
        df, keys, F.count(F.lit(1)),
        lambda s, w: F.coalesce(F.sum(s).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    )
    return (
        _by_key(numbered, carry, [*keys, CHUNK], "left")
        .withColumn(out, F.col(out) + F.coalesce("_in", F.lit(0)))
        .drop("_in", CHUNK)
    )


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str = "prev"
) -> DataFrame:
    """``lag(value)`` on chunked rows.  ``order`` names columns, ascending."""
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order)
    boxed = df.withColumn("_v", F.struct(value.alias("v")))
    lagged = boxed.withColumn("_lag", F.lag("_v").over(inner))
    carry = _carried(
        boxed, keys, F.max_by("_v", F.struct(*order)), lambda s, w: F.lag(s).over(w)
    )
    return (
        _by_key(lagged, carry, [*keys, CHUNK], "left")
        .withColumn(out, F.coalesce("_lag", "_in")["v"])
        .drop("_in", "_lag", "_v", CHUNK)
    )


def last_seen(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str = "last", current: bool = True
) -> DataFrame:
    """Last non-null ``value`` up to the row (``current``) or before it."""
    upper = 0 if current else -1
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, upper)
    valued = df.withColumn("_v", value)
    filled = valued.withColumn("_last", F.last("_v", ignorenulls=True).over(inner))
    newest = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    carry = _carried(
        valued, keys, newest,
        lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)),
    )
    return (
        _by_key(filled, carry, [*keys, CHUNK], "left")
        .withColumn(out, F.coalesce("_last", "_in"))
        .drop("_in", "_last", "_v", CHUNK)
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str = "total") -> DataFrame:
    """Inclusive running sum on chunked rows."""
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    valued = df.withColumn("_v", value)
    summed = valued.withColumn("_sum", F.sum("_v").over(inner))
    carry = _carried(
        valued, keys, F.sum("_v"),
        lambda s, w: F.sum(s).over(w.rowsBetween(W.unboundedPreceding, -1)),
    )
    return (
        _by_key(summed, carry, [*keys, CHUNK], "left")
        .withColumn(out, F.coalesce("_sum", F.lit(0)) + F.coalesce("_in", F.lit(0)))
        .drop("_in", "_sum", "_v", CHUNK)
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """The first ``n`` rows per key.  Spark limits each group before the
    shuffle (window group limit), so a hot key sends ``n`` rows per map task."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= n)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key, by partial aggregation: a
    hot key sends one row per task.  Equal orders are decided by the other
    columns, so the choice is the same in every run."""
    return _extreme(df, keys, order, F.max, F.max_by)


def oldest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, by partial aggregation."""
    return _extreme(df, keys, order, F.min, F.min_by)


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], extreme, extreme_by) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    kinds = [df.schema[c].dataType.simpleString() for c in rest]
    if any("map<" in k or "variant" in k for k in kinds):  # these have no order of their own
        best = extreme_by(F.struct(*order, *rest), F.struct(*order))
    else:
        best = extreme(F.struct(*order, *rest))
    cells = [F.col("_row")[c].alias(c) for c in [*order, *rest]]
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *cells).select(*df.columns)
