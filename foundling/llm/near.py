"""Near-duplicates of 0.8 five-word similarity by wide SimHash fingerprints and their deletion-variant signatures.

Two bits of 64 are much less than what texts of similarity 0.8 differ by, so this form has wider fingerprints.  A text has
two of them: one of its two-word shingles, cut into ``SEGMENTS`` segments of ``WIDTH`` bits that are indexed with every bit
wiped out in turn, and one of its five-word shingles, whose differing bits are verified.  Two texts of Jaccard similarity s
differ in a share arccos(2 s / (1 + s)) / pi of the second; ``APART`` of its ``LONGS * 64`` bits stand for s = 0.8 and one
standard error of the estimate.  A pair is a candidate if a segment differs by one bit at most.

A value of a segment is a cell.  One wiped bit leaves room for two cells, so the variants of the distinct cells give the cells that are one
bit apart, each pair once, whatever number of texts a cell holds.  Texts first meet the smallest text of their cell, and
these the smallest of the neighbouring cells.  Texts outside the largest component of a cell and its neighbour then meet the
other cell's largest component in one text, and those still outside are compared with all texts there in other components.
So no candidate is lost, and the copies of a large group are never paired with each other nor written once per wiped bit.

Defined results: null is an empty text; texts without words are alike; texts shorter than a shingle are one shingle;
repeated rows fall into one component; an empty table gives no rows; extra columns pass through the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import freeze, gathered
from .common import encoded, pieces
from .components import stars

SEGMENTS, WIDTH = 6, 25
LONGS = 4
APART = 44
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_INDEXED = SEGMENTS // 2
NAMES = [f"c{i}" for i in range(_INDEXED)] + [f"v{i}" for i in range(LONGS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words (fewer words: of the whole), from the hashes of the words."""
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = _mixed(total + words[i:n + i])
    return np.unique(total)


def majority(hashes: np.ndarray, longs: int, block: int = 255 * 64) -> np.ndarray:
    """``longs * 64`` bits, each set if over half of the hashes set it."""
    counts = np.zeros(longs * 64, np.int64)
    for low in range(0, len(hashes), block):
        part = hashes[low:low + block]
        wide = np.stack([_mixed(part + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(longs)], axis=1)
        bits = np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")


def fingerprint(text: bytes) -> np.ndarray:
    """The indexed and the verified bits of a text as signed longs."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(_INDEXED + LONGS, np.int64)
    with np.errstate(over="ignore"):
        hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        return np.concatenate([majority(shingles(hashes, 2), _INDEXED), majority(shingles(hashes, 5), LONGS)])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 8 << 20):
        marks = np.stack([fingerprint(t) for t in encoded(batch.column(1))])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(m)) for m in marks.T)], names=["row", *NAMES])


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Each row's other columns as a struct ``row``, its fingerprints, and ``node``, a hash that stands for them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest, F.lit(True).alias("_")).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in NAMES)])
    return rows.mapInArrow(_fingerprints, schema).withColumn("node", F.xxhash64(*NAMES))


def _cells(marks: DataFrame) -> DataFrame:
    """``node``, ``cell``: the value of each segment, with the segment's number above it."""
    cells = [
        F.shiftrightunsigned(f"c{s // 2}", WIDTH * (s % 2)).bitwiseAND(F.lit((1 << WIDTH) - 1)).bitwiseOR(F.lit(s << WIDTH)) for s in range(SEGMENTS)
    ]
    return marks.select("node", F.explode(F.array(*cells)).alias("cell"))


def _neighbours(cells: DataFrame) -> DataFrame:
    """``u`` < ``v``: the distinct cells that have a variant in common, so differ in one bit."""
    wiped = [F.col("cell").bitwiseAND(F.lit(~(1 << b))).bitwiseOR(F.lit(b << 32)) for b in range(WIDTH)]
    # cells are distinct, so a variant of two rows has its bit once clear and once set
    met = cells.select(F.explode(F.array(*wiped)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    clear = met.select("key", F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("u"))
    return clear.select("u", (F.col("u") + F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("key", 32).cast("int"))).alias("v"))


def _bits(marks: DataFrame, node: str, out: str) -> DataFrame:
    return marks.select(F.col("node").alias(node), F.array(*(f"v{i}" for i in range(LONGS))).alias(out))


def _apart(a: str, b: str) -> Column:
    """Number of bits in which two five-word fingerprints differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(LONGS)), F.lit(0))


def _verified(candidates: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """The candidates ``a``, ``b`` (about ``most``) whose five-word fingerprints differ in ``APART`` bits at most."""
    both = gathered(candidates.join(_bits(marks, "a", "va"), "a"), most).join(_bits(marks, "b", "vb"), "b")
    return both.filter(_apart("va", "vb") <= APART).select("a", "b")


def _rooted(rows: DataFrame, roots: DataFrame, node: str = "node") -> DataFrame:
    """The rows with ``root``, which is the node itself where it has no link."""
    found = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return rows.join(found, node, "left").withColumn("root", F.coalesce("_root", node)).drop("_root")


def _joined(roots: DataFrame, links: DataFrame, nodes: int) -> DataFrame:
    """The roots, of ``nodes`` at most, after further links between nodes."""
    ends = _rooted(gathered(_rooted(links, roots, "a").withColumnRenamed("root", "ra"), nodes), roots, "b").select(F.col("ra").alias("a"), F.col("root").alias("b"))
    later = stars(gathered(ends, nodes), nodes)
    again = later.select(F.col("node").alias("root"), F.col("root").alias("last"))
    moved = roots.join(again, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    # a root that now hangs on another one had no row
    return freeze(gathered(moved.union(later.join(roots, "node", "left_anti").select("node", "root")), nodes))


def _outside(members: DataFrame, pairs: DataFrame, roots: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The members with their roots, and ``x``, ``rx``, ``cell``, ``centre``, ``rc``: the texts outside the largest component of a cell and
    a neighbour, with the other cell and its largest component and smallest text of that."""
    rooted = freeze(gathered(_rooted(members, roots), most))
    parts = gathered(rooted.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")), most)
    cells = freeze(gathered(parts.groupBy("cell").agg(F.max(F.struct("n", "root", "centre")).alias("m"), F.count(F.lit(1)).alias("roots")), most))
    u, v = (cells.select(F.col("cell").alias(x), F.col("m").alias(f"m{x}"), F.col("roots").alias(f"r{x}")) for x in "uv")
    # a pair is left alone once one component holds both cells
    open_ = gathered(pairs.join(u, "u"), most).join(v, "v").filter("ru > 1 OR rv > 1 OR mu.root <> mv.root").withColumn("main", F.greatest("mu", "mv")["root"])
    sides = [F.struct(F.col(x).alias("own"), F.col(y).alias("cell"), F.col(f"m{y}").alias("m"), F.col("main").alias("main")) for x, y in ("uv", "vu")]
    within = cells.filter("roots > 1").select(F.col("cell").alias("own"), "cell", "m", F.col("m.root").alias("main"))
    todo = gathered(open_.select(F.explode(F.array(*sides)).alias("s")).select("s.*").union(within), most)
    mine = rooted.select(F.col("cell").alias("own"), F.col("node").alias("x"), F.col("root").alias("rx"))
    met = mine.join(todo, (mine["own"] == todo["own"]) & (F.col("rx") != F.col("main")))
    return rooted, met.select("x", "rx", "cell", F.col("m.centre").alias("centre"), F.col("m.root").alias("rc"))


def components(marks: DataFrame) -> DataFrame:
    """``node``, ``root`` for the nodes that have a link."""
    n = marks.count()
    most = SEGMENTS * n
    index = freeze(gathered(_cells(marks), most))
    cells = freeze(gathered(index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")), most))
    pairs = freeze(gathered(_neighbours(cells.select("cell")), most))
    least = cells.select("cell", "least")
    members = freeze(gathered(index.join(least, "cell"), most))
    same = members.filter("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    u, v = (least.toDF(x, f"n{x}") for x in "uv")
    beside = gathered(pairs.join(u, "u"), most).join(v, "v").filter("nu <> nv").select(F.least("nu", "nv").alias("a"), F.greatest("nu", "nv").alias("b"))
    roots = stars(_verified(gathered(same.union(beside), most), marks, most), n)
    _, outside = _outside(members.drop("least"), pairs, roots, most)
    centred = outside.filter("rx <> rc").select(F.least("x", "centre").alias("a"), F.greatest("x", "centre").alias("b"))
    roots = _joined(roots, _verified(gathered(centred, most), marks, most), n)
    rooted, outside = _outside(members.drop("least"), pairs, roots, most)
    outer = freeze(gathered(outside.select("x", "rx", "cell"), most)).join(_bits(marks, "x", "vx"), "x")
    there = gathered(rooted.join(outer.select("cell").distinct(), "cell", "left_semi"), most).join(_bits(marks, "node", "vy"), "node")
    # verified where they meet, so that only links become rows
    other = there.select("cell", F.col("node").alias("y"), F.col("root").alias("ry"), "vy")
    met = outer.join(other, "cell").filter((F.col("rx") != F.col("ry")) & (_apart("vx", "vy") <= APART))
    return _joined(roots, met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), n)


def classes(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Each row's other columns as ``row``, with ``node`` and ``root``, the node that stands for its component."""
    rows = freeze(fingerprints(docs, text=text))
    marks = rows.select("node", *NAMES).dropDuplicates(["node"])
    return _rooted(rows.select("row", "node"), components(marks))
