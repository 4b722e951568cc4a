"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks.  Its ratio (compressed bytes over bytes) must lie in a
band that depends on its length: under the band it repeats itself, over it there is nothing a compressor can find in it
(random strings, encoded data).  Short texts compress badly whatever they say, so bands open towards short lengths, and
texts under the first length are not judged.  The upper limits lie between clean text (four languages of the sf0.1 and
check_h tables: at most 0.745 from 256 bytes, 0.61 from 1 KB, 0.48 from 4 KB) and base64 (at least 0.84 below 512 bytes,
0.79 below 1 KB, 0.75 beyond).  Few signs, as in hex, give lower ratios, so from ``FREQUENCIES`` bytes on a text over the
entropy of its single bytes is out too: the compressor found no more than their frequencies (clean texts at most 0.98 of
it, hex 1.04).  Shorter hex can't be told from text of random syllables this way and passes.  A chunk is judged by the band
of its own length; a text fails when more than ``BAD_SHARE`` of its chunks do.

Defined results: null is an empty text; an empty text has no words and fails the base rule; repeated rows get equal
results; extra columns pass through the struct ``row``; an empty table gives no rows.  Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import pieces

#: Texts from so many bytes on, the lowest and the highest ratio that passes.
BANDS = ((256, 0.25, 0.80), (1024, 0.20, 0.70), (4096, 0.18, 0.65), (16384, 0.16, 0.65))
FREQUENCIES = 16384
CHUNK = 4096
BAD_SHARE = 0.25
LEVEL = 3
SYMBOLS = b"#*$%&|<>"

RESULT = T.StructType([
    T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
] + [
    T.StructField("ratio", T.DoubleType()), T.StructField("n_chunks", T.LongType()), T.StructField("n_bad_chunks", T.LongType()),
    T.StructField("verdict", T.StringType()),
])
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_HEAD = bytes(range(0x80, 0xC0))  # bytes inside a code point


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows."""
    found = text.split()  # bytes.split() cuts at ASCII white space only
    chars = len(b"".join(found).translate(None, _NOT_HEAD))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return len(found), chars, symbols, again, _repeated(found)


def _repeated(found: list[bytes]) -> int:
    n = len(found)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, n)
    if len(number) >= n - 2:
        # a repeated window repeats three words
        return 0
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    starts = count[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:shift + n - 2] |= starts
    return int(covered.sum())


def outside(size: int, packed: int) -> str:
    """'' for a ratio within the band of its length, else on which side it is out."""
    for least, low, high in reversed(BANDS):
        if size >= least:
            ratio = packed / size
            return "repetitive" if ratio < low else "incompressible" if ratio > high else ""
    return ""


def entropy(text: bytes) -> float:
    """Bytes that the text takes by the frequencies of its single bytes."""
    counts = np.bincount(np.frombuffer(text, np.uint8))
    counts = counts[counts > 0]
    return float((counts * (np.log2(len(text)) - np.log2(counts))).sum()) / 8


def judged(text: bytes, packed: int) -> str:
    """The side of the band, or that nothing but frequencies was found."""
    side = outside(len(text), packed)
    return "incompressible" if not side and len(text) >= FREQUENCIES and packed > entropy(text) else side


def bands(text: bytes, zip_) -> tuple[float, int, int, str]:
    size = len(text)
    whole = len(zip_.compress(text)) if size else 0
    verdict, chunks, bad = judged(text, whole), 0, 0
    if size >= 2 * CHUNK:
        for at in range(0, size, CHUNK):
            part = text[at:at + CHUNK]
            chunks += 1
            bad += bool(judged(part, len(zip_.compress(part))))
        if not verdict and bad > BAD_SHARE * chunks:
            verdict = "chunks"
    return (whole / size if size else 0.0), chunks, bad, verdict


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    names = [f.name for f in RESULT.fields]
    for batch in pieces(batches, "text", 8 << 20):
        rows = []
        for value in batch.column(1).cast(pa.binary()):
            text = value.as_py() or b""
            rows.append((*base(text), *bands(text, zip_)))
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.float64() if n == "ratio" else pa.string() if n == "verdict" else pa.int64()) for n, c in zip(names, columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *names])


def judge(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Each row's other columns as a struct ``row``, base counts, ratios and ``kept``, with ``verdict`` saying why not."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest, F.lit(True).alias("_")).alias("row"), F.col(text).alias("text"))
    out = rows.mapInArrow(_score, T.StructType([rows.schema["row"], *RESULT.fields]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("verdict") == ""))
