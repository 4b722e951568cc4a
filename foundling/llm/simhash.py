"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most two bits are cut into two segments, so that in one of them they differ by one bit at
most.  Each segment is indexed with every bit wiped out in turn; two segments that differ in one bit meet under the variant
that lacks it.  An equality join on the variants gives candidates, and the number of differing bits decides.

A variant shared by more than ``CROWD`` fingerprints (a large group of near copies) would give all pairs of them.  Such
fingerprints meet on the points around them instead: two fingerprints differ by at most two bits exactly when some point is
within one bit of both.  A point has at most 65 fingerprints around it and needs no pairs, as all of them hang together
through the smallest.  Both ways are exact, so no link is lost.

Only distinct fingerprints are indexed; copies are one row before any join.

Defined results: null is an empty text; texts without words have fingerprint zero and are linked like any other; repeated
rows fall into one component; a null doc_id takes part and gets a component, but is the smallest of none unless alone;
an empty table gives no rows; extra columns pass through the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import freeze
from .common import encoded, pieces
from .components import stars

SHINGLE = 3
SEED = 42
CROWD = 16
SEGMENTS, WIDTH = 2, 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED, block: int = 1 << 18) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes.  Shingles are counted in blocks."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, block):
        stop = min(n, at + block)
        part = words[at:stop + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
        hashes = np.fromiter((xxh64_intdigest(b" ".join(r), seed) for r in rows), np.uint64, stop - at)
        for low in range(0, len(hashes), 1 << 15):
            bits = np.unpackbits(hashes[low:low + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 8 << 20):
        marks = np.fromiter((fingerprint(t) for t in encoded(batch.column(1))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["row", "fp"])


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Each row's other columns as a struct ``row``, and ``fp``, the fingerprint as a signed long."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest, F.lit(True).alias("_")).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints, T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())]))


def _segment(fp, i: int):
    return F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))


def variants(marks: DataFrame) -> DataFrame:
    """``key``, ``fp``: for each segment and bit the segment without that bit."""
    keys = [
        _segment(F.col("fp"), s).bitwiseAND(F.lit(((1 << WIDTH) - 1) ^ (1 << b))).bitwiseOR(F.lit((s * WIDTH + b) << WIDTH))
        for s in range(SEGMENTS) for b in range(WIDTH)
    ]
    return marks.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(marks: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a``, ``b``: links of distinct fingerprints (``fp``) whose components are those of all pairs within two bits."""
    index = variants(marks)
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # one pass over the index: the entries of keys that several fingerprints share.  Spark sizes an exploded table as if a row
    # gave one, not 64 or 65, and would broadcast it: such joins are hinted to shuffle
    shared = freeze(index.join(sizes.hint("merge"), "key"))
    few = shared.filter(F.col("n") <= crowd).select("key", "fp")
    other = few.select(F.col("key").alias("key2"), F.col("fp").alias("fp2"))
    apart = F.col("fp").bitwiseXOR(F.col("fp2"))
    near = few.join(other, (F.col("key") == F.col("key2")) & (F.col("fp") < F.col("fp2")) & (F.bit_count(apart) <= 2)).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    crowded = shared.filter(F.col("n") > crowd).select("fp").distinct()
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in range(64)]
    points = crowded.select("fp", F.explode(F.array(*around)).alias("point"))
    centre = points.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    tied = points.join(centre.hint("merge"), "point").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.union(tied).distinct()


def classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """Each row's other columns as ``row``, with ``fp``, ``root`` (a fingerprint that stands for its component) and
    ``component_id``, the smallest id that links reach."""
    rows = freeze(fingerprints(docs, text=text))
    marks = rows.groupBy("fp").agg(F.min(f"row.{doc_id}").alias("least"))
    roots = stars(links(marks.select("fp"), crowd))
    placed = marks.join(roots, marks["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return rows.join(found, "fp")
