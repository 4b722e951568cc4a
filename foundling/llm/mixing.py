"""Mixing sources to target weights by systematic sampling.  DataFrame functions only.

A source's target is water-filled: shares follow the weights, stop at ``most`` times the source's size, and the excess is
shared again by weight.  Every document of a source expects ``target / source size`` copies.  The documents of a source
stand in a fixed order (by size, so that the words taken stay near the target); the running sum of expected copies,
moved by one random offset per source, gives a document one copy for every integer it crosses.

The running sum never puts a source into one task: it is the sum of three counts, taken over the sizes of a source (at
most as many rows as the longest text has words), over 256 slices of one size, and over the rows of one slice.

Defined results: a null text has size 0; null is a source of its own and comes last; rows of one doc_id are separate rows;
an empty table gives an empty mix; extra columns pass through, even with the names used here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source (``_source``, ``_total``) to one with ``_target``, the words it is to give.

    Sharing again until no source is above its limit is the same as raising one level for all: sources in order of limit
    per weight are full as long as the level that the rest would reach is not below theirs.
    """
    # one row per source meets here, not one per document
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_i"), F.lit(len(weights))) + 1).cast("int"))
    cap = (F.lit(float(most)) * F.col("_total")).alias("_cap")
    ranked = (
        sizes.withColumn("_i", F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1)
        .select("_source", "_total", "_i", weight.alias("_w"), cap)
    )
    sooner = W.orderBy(F.col("_cap") / F.col("_w"), F.col("_i")).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("_total").over(every) - F.coalesce(F.sum("_cap").over(sooner), F.lit(0.0))
    weigh = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(sooner), F.lit(0.0))
    level = ranked.withColumn("_level", left / weigh)
    full = F.col("_level") * F.col("_w") >= F.col("_cap")
    # the level is that of the first source which is not full
    first = F.min(F.when(~full, F.struct(F.col("_cap") / F.col("_w"), F.col("_i"), F.col("_level")))).over(every)
    return level.withColumn("_first", first).select(
        "_source", "_total",
        F.when(full | F.col("_first").isNull(), F.col("_cap")).otherwise(F.col("_first")["_level"] * F.col("_w")).alias("_target"),
    )


def mix(
    docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """Each row as a struct ``row``, with its size, source_size, target and copies."""
    order = [F.col(source).alias("_source"), words(F.col(text)).alias("_size"),
             F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 1, 2).alias("_slice")]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, *order, F.col(doc_id).alias("_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_md5"))
    cells = docs.select(*order).groupBy("_source", "_size", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    sizes = cells.groupBy("_source", "_size").agg(F.sum("_n").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_size = sizes.withColumn("_before", before(W.partitionBy("_source").orderBy("_size"))).drop("_n")
    per_source = sizes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_total"))
    by_slice = cells.withColumn("_within", before(W.partitionBy("_source", "_size").orderBy("_slice"))).drop("_n")
    goal = targets(per_source, weights=weights, share=share, most=most)
    starts = _join(_join(by_slice, by_size, ["_source", "_size"]), goal, ["_source"])
    rank = F.row_number().over(W.partitionBy("_source", "_size", "_slice").orderBy("_id", "_md5"))
    found = _join(rows.withColumn("_rank", rank), starts, ["_source", "_size", "_slice"])
    rate = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(0.0)
    # 32 bits of a digest over 2^32: one offset for each source, the same in every run
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_source"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(2**32)
    place = F.col("_before") + F.col("_within") + F.col("_rank")
    crossed = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return found.select(
        F.col("_row").alias("row"), F.col("_size").alias("size"), F.col("_total").alias("source_size"),
        F.col("_target").alias("target"), crossed.cast("long").alias("copies"),
    )


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which the first, the source, may be null."""
    names = {k: f"_r{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    cond = F.col(keys[0]).eqNullSafe(F.col(names[keys[0]]))
    for k in keys[1:]:
        cond = cond & (F.col(k) == F.col(names[k]))
    return left.join(right, cond).drop(*names.values())


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, a row for each copy, with the columns of ``docs``."""
    copies = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))
    return mix(docs, **options).select("row", copies).select("row.*")
