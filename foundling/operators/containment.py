"""Which texts contain which ids or phrases, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import let
from ..session import dealt, freeze

WORDS = 4
SIGNS = 8
BROADCAST_ANCHORS = 200_000
FEW_SHORT = 64
#: Logarithm of the most bits of the bitmap: 512 KB.
BITS = 22


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _run_hash(w: Column, start: Column | int, n: int) -> Column:
    return F.xxhash64(*[F.get(w, F.lit(start) + k) for k in range(n)])


def _parts(needle: Column) -> Column:
    """Parts every text with the needle must have: its runs of up to four inner words (the outer two may be cut inside a
    word of the text), or its runs of signs when the needle is short.  ``mode`` is the number of words, or minus the signs."""

    def of(w: Column) -> Column:
        inner = F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))
        k = F.least(F.size(inner), F.lit(WORDS))
        n = F.least(F.length(needle), F.lit(SIGNS))
        runs = F.array().cast("array<bigint>")
        for m in range(1, WORDS + 1):
            hashed = partial(_run_hash, inner, n=m)
            runs = F.when(k == m, F.transform(F.sequence(F.lit(0), F.size(inner) - m), lambda i: hashed(i))).otherwise(runs)
        signs = F.transform(F.sequence(F.lit(1), F.length(needle) - n + 1), lambda i: F.xxhash64(F.substring(needle, i, n)))
        return F.when(k >= 1, F.struct(k.alias("mode"), runs.alias("runs"))).otherwise(F.struct((-n).alias("mode"), signs.alias("runs")))

    return let(_words(needle), of)


def anchors(needles: DataFrame, key: str, needle: str, on: Sequence[str] = ()) -> DataFrame:
    """Of each needle the part that the fewest needles have, so that needles with a common beginning, or one common phrase,
    don't meet every text that has it: ``key``, ``on``, ``_mode``, ``_h``."""
    parts = needles.select(key, *on, F.xxhash64(needle).alias("_n"), _parts(F.col(needle)).alias("_a")).select(
        key, *on, "_n", F.col("_a.mode").alias("_mode"), F.explode(F.array_distinct("_a.runs")).alias("_h")
    )
    often = parts.groupBy(*on, "_mode", "_h").agg(F.count(F.lit(1)).alias("_times"))
    chosen = parts.join(often, [*on, "_mode", "_h"]).groupBy(key, *on, "_n", "_mode").agg(F.min(F.struct("_times", "_h"))["_h"].alias("_h"))
    return chosen.select(key, *on, "_mode", "_h").distinct()


def _bitmap(anchored: DataFrame, n: int) -> tuple[Column, Callable[[Column], Column]]:
    """A scalar of bits that are set where an anchor's hash falls, about one in sixteen, and the test of a hash.  At most
    ``BITS``, so its size is bounded; more anchors only let more runs through to the join."""
    width = max(10, min(BITS, (16 * n).bit_length()))
    mask = (1 << width) - 1
    word, bit = F.shiftright(F.col("_h").bitwiseAND(mask), 6).cast("int"), F.col("_h").bitwiseAND(63).cast("int")
    zeros = anchored.sparkSession.range(1 << (width - 6)).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    ones = anchored.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    # every word has a row, so the words in order are the bitmap; a look-up of each in a map would take the square of their number
    words = zeros.unionByName(ones).groupBy("w").agg(F.bit_or("b").alias("b"))
    dense = words.agg(F.array_sort(F.collect_list(F.struct("w", "b")))["b"].alias("bits"))
    bits = dense.scalar()

    def may(h: Column, bits: Column) -> Column:
        return F.getbit(F.get(bits, F.shiftright(h.bitwiseAND(mask), 6).cast("int")), h.bitwiseAND(63).cast("int")) == 1

    return bits, may


def _runs(text: Column, mode: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """All word (or sign) runs of one length, or those that ``keep`` keeps, as ``array<struct<_mode,_h>>``.
    Runs are made distinct as plain numbers, which is linear."""
    if mode < 0:
        # a look-ahead matches at every sign: one linear pass gives all runs
        grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{-mode}}}))"), F.lit(1))
        hashes = F.transform(grams, lambda g: F.xxhash64(g))
    else:

        def of(w: Column) -> Column:
            last = F.size(w) - mode
            at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: _run_hash(w, i, mode))

        hashes = let(_words(text), of)
    hashes = F.filter(hashes, keep) if keep else hashes
    return F.transform(F.array_distinct(hashes), lambda h: F.struct(F.lit(mode).alias("_mode"), h.alias("_h")))


def _few(texts: DataFrame, short: DataFrame, text_key: str, text: str, needle_key: str, needle: str) -> DataFrame:
    """A counted handful of short needles, looked for in each text directly."""
    rows = short.collect()
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col(text), F.lit(r[1])), F.lit(i)) for i, r in enumerate(rows)]))
    numbered = texts.sparkSession.createDataFrame(
        [(i, r[0]) for i, r in enumerate(rows)], StructType([StructField("_i", IntegerType()), short.schema[needle_key]])
    )
    return texts.select(text_key, F.explode(hits).alias("_i")).join(F.broadcast(numbered), "_i").select(text_key, needle_key)


def contains_join(
    texts: DataFrame, needles: DataFrame, text_key: str, text: str, needle_key: str, needle: str, within: Sequence[str] = ()
) -> DataFrame:
    """Pairs (text, needle) where the text contains the needle literally.

    Texts give the hashes of their short word runs, needles one anchor each, the
    part that the fewest needles share; candidates meet in an equi join on the hash (and the ``within`` columns,
    such as the page), carrying keys only.  The texts are then looked up by
    key and tested.  Exact: every containing text has the anchor.  Empty
    needles match nothing.
    """
    on = [*within]
    some = needles.filter(F.length(needle) > 0)
    anchored = freeze(anchors(dealt(some, needle_key), needle_key, needle, on))
    # one row per mode, at most WORDS + SIGNS of them
    sizes = {r["_mode"]: r["n"] for r in anchored.groupBy("_mode").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        kind = needles.schema[needle_key].dataType
        return texts.select(text_key).limit(0).withColumn(needle_key, F.lit(None).cast(kind))
    modes, tested = list(sizes), None
    n_short = sum(n for m, n in sizes.items() if m < 0)
    if n_short and not on and n_short <= FEW_SHORT:
        short = some.join(anchored.filter(F.col("_mode") < 0).select(needle_key), needle_key, "left_semi")
        tested = _few(texts, short.select(needle_key, needle), text_key, text, needle_key, needle)
        anchored, modes = anchored.filter(F.col("_mode") > 0), [m for m in modes if m > 0]
        if not modes:
            return tested
    n = sum(sizes.values())
    # a text has a run at every sign: a file of a few MB is much work
    keep, marked = None, dealt(texts, text_key) if modes and min(modes) < 0 else texts
    # few anchors are counted to be small and go to every task, where they meet the runs without a shuffle; many meet
    # them in one, and runs that no anchor can equal are dropped before they become rows of it.  The runs are never
    # broadcast: their size is not known from the size of the files they come from.
    if n <= BROADCAST_ANCHORS:
        anchored = F.broadcast(anchored)
    else:
        bits, may = _bitmap(anchored, n)
        marked, keep = marked.withColumn("_bits", bits), lambda h: may(h, F.col("_bits"))
        anchored = anchored.hint("merge")
    pieces = F.concat(*[_runs(F.col(text), mode, keep) for mode in sorted(modes)])
    runs = marked.select(text_key, *on, F.explode(pieces).alias("_r")).select(text_key, *on, "_r.*")
    candidates = runs.join(anchored, [*on, "_mode", "_h"]).select(text_key, needle_key).distinct()
    found = (
        candidates.join(texts.select(text_key, text), text_key)
        .join(some.select(needle_key, F.col(needle).alias("_needle")), needle_key)
        .filter(F.contains(F.col(text), F.col("_needle")))
        .select(text_key, needle_key)
    )
    return found if tested is None else found.unionByName(tested)
