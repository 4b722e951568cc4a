"""Small helpers that several operators share."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words as the contracts define them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null and empty share a key."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def pieces(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one piece hold about ``max_bytes`` at most (a longer text comes alone)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, base + max_bytes, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class Numbers(defaultdict):
    """Strings by the order in which they come."""

    def __init__(self):
        super().__init__(count().__next__)
        self.seen = 0

    def fresh(self) -> list[str]:
        """The strings that came since the last call."""
        new = list(islice(reversed(self), len(self) - self.seen))[::-1]
        self.seen = len(self)
        return new


class Lists:
    """Numbered lists of whole numbers in one array."""

    def __init__(self, kind):
        self.counts, self.values = np.zeros(0, np.int64), np.zeros(0, kind)
        self.first = self.counts

    def add(self, counts: np.ndarray, values: np.ndarray) -> None:
        self.counts, self.values = np.concatenate([self.counts, counts]), np.concatenate([self.values, values.astype(self.values.dtype)])
        self.first = np.cumsum(self.counts) - self.counts

    def gather(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen lists one after the other, and their lengths."""
        counts = self.counts[chosen]
        ends = np.cumsum(counts)
        return self.values[np.repeat(self.first[chosen] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts
