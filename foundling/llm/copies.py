"""Near copies of five-word similarity 0.8 and more: MinHash bands find the candidates, shingle sets decide.

A text is the set of its distinct five-word shingles (64-bit hashes).  ``BANDS`` bands of ``ROWS`` minima each are its
cells: two texts of Jaccard similarity s share one with probability 1 - (1 - s^ROWS)^BANDS, which is 0.998 at s = 0.8
whatever kind of change makes the difference (scattered words, a replaced paragraph, text appended).  Every link of these
is verified by the exact similarity of both sets, joined back by key.  The fingerprints of :mod:`near`, which lose block
edits and appended text and link some texts under 0.8, add candidates: each text of a component of theirs with its smallest
one, verified by the sets like the others.

Texts first meet the smallest text of their cell.  Texts outside the largest component of a cell then meet the smallest
text of that component, and those still outside are compared with all texts of other components in the cell.  So no
candidate is lost, and the copies of a large group are not paired with each other.  Texts with equal sets are one node.

Defined results: null is an empty text; texts without words are alike; texts shorter than a shingle are one shingle;
repeated rows fall into one component; an empty table gives no rows; extra columns pass through the struct ``row``.

The sets are as large as the texts, so they are made in a second pass, and only those of nodes with a candidate are kept.  A
table whose texts are not the same in each read must be frozen first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import PER_TASK, freeze, gathered
from .common import encoded, pieces
from .components import stars
from .near import _LOWER, NAMES, _joined, _mixed, _rooted, components as near_components, fingerprint, shingles

BANDS, ROWS = 16, 5
#: At least so many of five shared: a similarity of 0.8 in whole numbers.
PART, WHOLE = 4, 5
#: So many nodes (16 bytes each) may go to every task; more are joined by a shuffle.
FEW = 2_000_000


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a text without words has one."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        return shingles(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)), 5)


def cells(own: np.ndarray) -> np.ndarray:
    """A signed long for each band of minima."""
    with np.errstate(over="ignore"):
        seeds = _mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        least = np.empty(BANDS * ROWS, np.uint64)
        for k in range(BANDS * ROWS):
            x = (own ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
            least[k] = ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).min()
        out = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for column in least.reshape(BANDS, ROWS).T:
            out = _mixed(out + column)
    return out.view(np.int64)


def _node(own: np.ndarray) -> int:
    """The 64 bits that stand for a set."""
    from hashlib import blake2b

    return int.from_bytes(blake2b(own, digest_size=8).digest(), "little", signed=True)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 4 << 20):
        nodes, bands, prints = [], [], []
        for text in encoded(batch.column(1)):
            own = shingle_set(text)
            prints.append(fingerprint(text))
            nodes.append(_node(own))
            bands.append(cells(own))
        ends = pa.array(np.arange(0, BANDS * len(nodes) + 1, BANDS, dtype=np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bands)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(np.ascontiguousarray(m)) for m in np.stack(prints).T), pa.array(nodes, pa.int64()), lists],
            names=["row", *NAMES, "node", "cells"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 4 << 20):
        sets = [shingle_set(t) for t in encoded(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "own"])


def _sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The set of each of the nodes; the others are left behind before anything is shuffled."""
    nodes = freeze(nodes.distinct())
    n = nodes.count()
    nodes = gathered(nodes, n)
    found = texts.mapInArrow(_sets, "node long, own binary")
    if n <= FEW:
        return freeze(gathered(found.join(F.broadcast(nodes), "node", "left_semi").dropDuplicates(["node"]), n, PER_TASK))
    # copies of one text are brought together before the join
    return freeze(gathered(found.dropDuplicates(["node"]).join(nodes, "node", "left_semi"), n, PER_TASK))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(WHOLE * both >= PART * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(candidates: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """The candidates ``a``, ``b`` (about ``most``) whose sets have the similarity."""
    x, y = (sets.select(F.col("node").alias(n), F.col("own").alias(f"own_{n}")) for n in "ab")
    both = gathered(candidates.distinct().join(x, "a"), most, PER_TASK).join(y, "b").filter(  # sets of too different a size can't be alike
        WHOLE * F.least(F.length("own_a"), F.length("own_b")) >= PART * F.greatest(F.length("own_a"), F.length("own_b")),
    )
    return both.select("a", "b", "own_a", "own_b").mapInArrow(_alike, "a long, b long")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def components(marks: DataFrame, more: DataFrame, texts: DataFrame) -> DataFrame:
    """``node``, ``root`` for the nodes that have a link; ``marks`` has a row for each node, ``more`` further candidates as
    ``node`` and ``root``; ``texts`` is the column of texts."""
    n = marks.count()
    most = BANDS * n
    index = gathered(marks.select("node", F.explode("cells").alias("cell")), most)
    shared = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1")
    members = freeze(gathered(index.join(shared.select("cell", "least"), "cell"), most))
    most = members.count()
    members = gathered(members, most)
    sets = _sets_of(texts, members.select("node").union(more.select("node")).union(more.select("root")))
    candidates = members.filter("least < node").select(*_pair("least", "node")).union(more.select(*_pair("node", "root")))
    roots = stars(_verified(gathered(candidates, most), sets, n), n)
    for last in (False, True):
        rooted = freeze(gathered(_rooted(members.select("cell", "node"), roots), most))
        parts = gathered(rooted.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")), most)
        main = parts.groupBy("cell").agg(F.max(F.struct("n", "root", "centre")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        outside = gathered(rooted.join(main.select("cell", "m"), "cell").filter("root <> m.root"), most)
        if last:
            other = rooted.select("cell", F.col("node").alias("other"), F.col("root").alias("there"))
            pairs = outside.join(other, "cell").filter("root <> there").select(*_pair("node", "other"))
        else:
            pairs = outside.select("node", F.col("m.centre").alias("other")).select(*_pair("node", "other"))
        roots = _joined(roots, _verified(gathered(pairs, most), sets, n), n)
    return roots


def classes(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Each row's other columns as ``row``, with ``node`` and ``root`` of the components of :mod:`near` and these links."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest, F.lit(True).alias("_")).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([
        rows.schema["row"], *(T.StructField(c, T.LongType()) for c in NAMES),
        T.StructField("node", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType())),
    ])
    rows = freeze(rows.mapInArrow(_marks, schema))
    rows = gathered(rows, rows.count())
    more = near_components(rows.select("node", *NAMES).dropDuplicates(["node"]))
    return _rooted(rows.select("row", "node"), components(rows.select("node", "cells").dropDuplicates(["node"]), more, docs.select(F.col(text).alias("text"))))
