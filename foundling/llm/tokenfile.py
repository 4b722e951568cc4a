"""Token ids in files of patched frame-of-reference blocks.

Texts are encoded where they are read, an end id is added to each, and the ids travel packed to the range of document ids
they belong to.  A range writes files of about ``FILE_IDS`` ids; a file holds blocks of ``BLOCK`` ids, a table of its documents
and an index of the blocks' first bytes, so a reader gets any stretch of ids from the blocks that hold it.

A block stores its smallest id, the offsets from it packed at the width that ``PERCENTILE`` per cent of them need, and for
the others their places and the bits beyond that width.  Layout, little-endian::

    "TOKB" version:u32
    block...      smallest:u32 exceptions:u16 width:u8 0:u8 | offsets, ``width`` bits each | places:u8... | high bits:u32...
    documents     id:i64... | null:u8... | ids before it in the file:u64... (one more than documents)
    block starts  u64...
    footer        ids, documents, first byte of documents, first byte of block starts:u64 | "TOKB"

Files are named by the attempt that writes them; the manifest, frozen in the shared folder, names those that count, so a lost
or repeated task changes nothing.  Ranges come from quantiles of the ids; an id with many rows is split by the rows' places in
the input.  The input is to be a table read from files, or frozen, so that places do not change when a task is repeated.

Defined results: a null or empty text has the end id alone; rows without id come first; rows of one id follow each other in
input order, and repeated rows are documents each; an empty table gives no file and no rows; extra columns are ignored.
Special strings in a text are read as the tokenizer reads them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import freeze
from .common import Lists, Numbers, pieces

MAGIC, VERSION = b"TOKB", 1
BLOCK = 256
PERCENTILE = 95
FILE_IDS = 16 << 20
#: Ids that are packed or unpacked at once.
RUN = 4096 * BLOCK
#: Documents of a range, and the most ranges; beyond that ranges grow, files don't.
RANGE_ROWS, RANGES = 20_000, 10_000
#: Distinct words, and ids of them, that a task keeps; then it starts anew.
WORDS, WORD_IDS = 400_000, 4_000_000
END = 1
NO_ID = -(1 << 63)


# blocks


HEAD = np.dtype([("smallest", "<u4"), ("exceptions", "<u2"), ("width", "u1"), ("spare", "u1")])


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of some ids; all but the last have ``BLOCK`` ids."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK * BLOCK
    for part in (ids[:whole].reshape(-1, BLOCK), ids[whole:].reshape(1, -1)):
        if not part.size:
            continue
        part = part.astype(np.uint32)
        size = part.shape[1]
        least = part.min(axis=1)
        offsets = part - least[:, None]
        rank = min(size - 1, max(0, int(-(-size * percentile // 100)) - 1))
        widths = np.frexp(np.partition(offsets, rank, axis=1)[:, rank].astype(np.float64))[1]  # bits of that offset, 0 for zero
        blocks: list[bytes] = [b""] * len(part)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            own = offsets[rows]
            bits = np.unpackbits(own.astype("<u4").view(np.uint8).reshape(len(rows), size, 4), axis=2, bitorder="little")[:, :, :width]
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            high = own.astype(np.uint64) >> np.uint64(width)
            row, place = np.nonzero(high)
            heads = np.zeros(len(rows), HEAD)
            heads["smallest"], heads["exceptions"], heads["width"] = least[rows], np.bincount(row, minlength=len(rows)), width
            step, head, body = packed.shape[1], heads.tobytes(), packed.tobytes()
            places, beyond = place.astype(np.uint8).tobytes(), high[row, place].astype("<u4").tobytes()
            ends = np.cumsum(heads["exceptions"], dtype=np.int64).tolist()
            for i, (to, end) in enumerate(zip(rows.tolist(), ends, strict=True)):
                start = ends[i - 1] if i else 0
                blocks[to] = head[8 * i:8 * i + 8] + body[step * i:step * i + step] + places[start:end] + beyond[4 * start:4 * end]
        out += blocks
    return out


def unpack(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` of ``data`` and hold ``sizes`` ids."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(8)].view(HEAD)[:, 0]
    widths, exceptions = heads["width"].astype(np.int64), heads["exceptions"].astype(np.int64)
    ids = np.zeros((len(starts), BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        for size in np.unique(sizes[widths == width]).tolist() if width else ():
            rows = np.flatnonzero((widths == width) & (sizes == size))
            packed = raw[starts[rows, None] + 8 + np.arange(-(-size * width // 8))]
            bits = np.zeros((len(rows), size, 32), np.uint8)
            bits[:, :, :width] = np.unpackbits(packed, axis=1, count=size * width, bitorder="little").reshape(len(rows), size, width)
            ids[rows, :size] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    patched = np.flatnonzero(exceptions)
    if len(patched):
        many = exceptions[patched]
        row = np.repeat(patched, many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        at = starts[row] + 8 + -(-sizes[row] * widths[row] // 8)
        high = raw[(at + exceptions[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
        ids[row, raw[at + nth]] += high << widths[row].astype(np.uint32)
    ids += heads["smallest"][:, None]
    return ids[np.arange(BLOCK) < sizes[:, None]]


# files


class Writer:
    """One file; documents are added in their order."""

    def __init__(self, out, percentile: float = PERCENTILE):
        self.out, self.percentile, self.at = out, percentile, 0
        self.waiting: list[np.ndarray] = []
        self.held = self.n = 0
        self.ids: list[int | None] = []
        self.before: list[int] = [0]
        self.starts: list[int] = []
        self._put(MAGIC + np.array([VERSION], "<u4").tobytes())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        for run in range(0, stop, RUN):
            blocks = pack(ids[run:min(run + RUN, stop)], self.percentile)
            self.starts += (self.at + np.cumsum([0] + [len(b) for b in blocks[:-1]])).tolist()
            self._put(b"".join(blocks))
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.n += len(ids)
        self.before.append(self.n)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= RUN:
            self._blocks(last=False)

    def close(self) -> int:
        """Bytes of the file."""
        self._blocks(last=True)
        documents = self.at
        self._put(np.array([0 if i is None else i for i in self.ids], "<i8").tobytes() + bytes(i is None for i in self.ids))
        self._put(np.array(self.before, "<u8").tobytes())
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(np.array([self.n, len(self.ids), documents, index], "<u8").tobytes() + MAGIC)
        return self.at


class Reader:
    """Stretches of ids, and the documents, of one file that can seek."""

    def __init__(self, file):
        self.file = file
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        foot = self._get(size - 36, 36)
        if foot[32:] != MAGIC or self._get(0, 4) != MAGIC:
            raise ValueError("not a file of token blocks")
        self.n, self.n_docs, self.documents, self.index = np.frombuffer(foot[:32], "<u8").astype(np.int64).tolist()
        table = self._get(self.documents, self.index - self.documents)
        ids, null = np.frombuffer(table, "<i8", self.n_docs), table[8 * self.n_docs:9 * self.n_docs]
        self.ids = [None if gone else i for i, gone in zip(ids.tolist(), null, strict=True)]
        self.before = np.frombuffer(table, "<u8", self.n_docs + 1, 9 * self.n_docs).astype(np.int64)
        self.starts = np.frombuffer(self._get(self.index, size - 36 - self.index), "<u8").astype(np.int64)

    def _get(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks that hold them."""
        first, last = start // BLOCK, -(-stop // BLOCK)
        if start >= stop:
            return np.zeros(0, np.uint32)
        begin = int(self.starts[first])
        end = int(self.starts[last]) if last < len(self.starts) else self.documents
        sizes = np.minimum(BLOCK, self.n - BLOCK * np.arange(first, last))
        return unpack(self._get(begin, end - begin), self.starts[first:last] - begin, sizes)[start - first * BLOCK:stop - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.before[k]), int(self.before[k + 1]))

    def checksums(self) -> list[int]:
        """crc32 of the ids of each document as unsigned 32-bit integers."""
        sums, k = [0] * self.n_docs, 0
        while k < self.n_docs:
            stop = max(int(np.searchsorted(self.before, self.before[k] + RUN, side="right")) - 1, k + 1)
            low, high = int(self.before[k]), int(self.before[stop])
            if high - low <= RUN:
                run = self.read(low, high).astype("<u4")
                for d in range(k, stop):
                    sums[d] = crc32(run[self.before[d] - low:self.before[d + 1] - low])
            else:  # one long document
                for at in range(low, high, RUN):
                    sums[k] = crc32(self.read(at, min(at + RUN, high)).astype("<u4"), sums[k])
            k = stop
        return sums


# encoding


class Lexicon:
    """Ids of the distinct words of a task.  The tokenizer lets no token cross a blank, so a text's ids are those of its words;
    those of a word of common letters are again those of its parts, cut as the tokenizer cuts them."""

    #: ASCII and the letters up to U+00FF: composed already, lower case sign by sign.
    PLAIN = re.compile("[\x21-\x7EÀ-ÖØ-öø-ÿ]*")
    #: The tokenizer's cut of such words (fixed values), and the blanks between them.
    PARTS = re.compile("[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]| |[^a-zß-öø-ÿ0-9 ]+")
    #: Parts that are given to the tokenizer as one text.
    TOGETHER = 512

    def __init__(self, tokenizer: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        own = Tokenizer.from_str(tokenizer)
        cut = Tokenizer(own.model)  # parts need no normalising and no further cut
        cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode, self.encode_parts = ((lambda texts, t=t: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]) for t in (own, cut))
        n = own.get_vocab_size(with_added_tokens=True)
        self.last = np.array([(own.id_to_token(i) or "").endswith("</w>") for i in range(n)])  # ends a part
        self.clear()

    def clear(self) -> None:
        self.word, self.part = Numbers(), Numbers()
        self.part[" "]  # number 0, without ids
        self.part.seen = 1
        self.parts_of, self.ids_of = Lists(np.int32), Lists(np.uint32)
        self.ids_of.add(np.zeros(1, np.int64), np.zeros(0))

    def _learn(self) -> None:
        fresh = self.word.fresh()
        plain = [bool(self.PLAIN.fullmatch(w)) and "<|" not in w for w in fresh]
        cut = self.PARTS.findall(" ".join(w if p else "" for w, p in zip(fresh, plain, strict=True)).lower())
        numbers = np.fromiter(map(self.part.__getitem__, cut), np.int64, len(cut))
        new = self.part.fresh()
        if new:
            found = self.encode_parts([" ".join(new[i:i + self.TOGETHER]) for i in range(0, len(new), self.TOGETHER)])
            ids = np.array([i for own in found for i in own], np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(new):
                raise ValueError("the tokenizer does not mark the ends of words")
            self.ids_of.add(np.diff(ends, prepend=0), ids)
        words = np.cumsum(numbers == 0)[numbers != 0]  # blanks part the words
        numbers = numbers[numbers != 0]
        other = [i for i, p in enumerate(plain) if not p]
        if other:  # whole words stand for their parts
            found = self.encode([fresh[i] for i in other])
            self.ids_of.add(np.array([len(i) for i in found], np.int64), np.array([i for own in found for i in own], np.int64))
            own = np.arange(len(self.ids_of.counts) - len(other), len(self.ids_of.counts))
            for n in own.tolist():
                self.part[f"\n{n}"]  # takes the number
            self.part.seen = len(self.part)
            words, numbers = np.concatenate([words, other]), np.concatenate([numbers, own])
            order = np.argsort(words, kind="stable")
            words, numbers = words[order], numbers[order]
        self.parts_of.add(np.bincount(words, minlength=len(fresh)), numbers)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.word) > WORDS or len(self.part) > WORDS or len(self.ids_of.values) > WORD_IDS:
            self.clear()
        number, words = self.word.__getitem__, []
        for text in texts:
            own = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            words.append(np.fromiter(map(number, own), np.int64, len(own)))
        if len(self.word) > self.word.seen:
            self._learn()
        parts, in_word = self.parts_of.gather(np.concatenate(words) if words else np.zeros(0, np.int64))
        ids, in_part = self.ids_of.gather(parts)
        # ends of the texts in words, then in parts, then in ids
        ends = np.cumsum([len(own) for own in words])
        for inner in (in_word, in_part):
            ends = np.append(0, np.cumsum(inner))[ends]
        return np.split(ids, ends[:-1])


def _encoder(tokenizer, cuts, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_, lexicon = zstandard.ZstdCompressor(level=1), Lexicon(tokenizer.value)
        for batch in pieces(batches, "text", 1 << 20):
            keys, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = [bisect_right(cuts, (NO_ID if k is None else k, p)) for k, p in zip(keys, places, strict=True)]
            ids = [np.append(i, np.uint32(end)) for i in lexicon.ids([t or "" for t in batch.column(2).to_pylist()])]
            planes = [zip_.compress(i.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), batch.column(0), batch.column(1), pa.array(planes, pa.binary())], names=["part", "id", "place", "ids"],
            )

    return run


def _writer(folder: str, file_ids: int, percentile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        unzip = zstandard.ZstdDecompressor()
        store, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        part, nth, writer, name, out = None, 0, None, "", None

        def close():
            n_bytes = writer.close()
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (nth, pa.int32()), (name, pa.string()), (writer.n, pa.int64()), (len(writer.ids), pa.int64()), (n_bytes, pa.int64()))],
                names=["part", "nth", "file", "n_ids", "n_docs", "n_bytes"],
            )

        for batch in batches:
            for p, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if writer and (p != part or writer.n >= file_ids):
                    yield close()
                    nth = nth + 1 if p == part else 0
                    writer = None
                if writer is None:
                    part, name = p, f"{uuid4()}.tokens"
                    out = store.open_output_stream(f"{root}/{name}")
                    writer = Writer(out, percentile)
                writer.add(doc_id, np.frombuffer(unzip.decompress(ids), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0])
        if writer:
            yield close()

    return run


def cuts(docs: DataFrame, *, doc_id: str, ranges: int | None = None) -> list[tuple[int, int]]:
    """Ascending (id, place) at which ranges begin; places part the rows of an id that fills several ranges."""
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.monotonically_increasing_id().alias("place"))
    n = rows.count()
    ranges = min(ranges or min(max(shuffle, n // RANGE_ROWS), RANGES), n)
    if ranges < 2:
        return []
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = rows.agg(F.percentile_approx("id", steps, max(10_000, 10 * ranges))).first()[0]
    times = {i: found.count(i) for i in set(found)}
    hot = [i for i, many in times.items() if many > 1]
    out = [(i, -1) for i in times]
    if hot:
        for i, at in rows.filter(F.col("id").isin(hot)).groupBy("id").agg(F.percentile_approx("place", steps, max(10_000, 10 * ranges))).collect():
            out += [(i, at[k * len(at) // times[i]]) for k in range(1, times[i])]
    return sorted(set(out))


def write(docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end: int = END, ranges: int | None = None, file_ids: int = FILE_IDS, percentile: float = PERCENTILE) -> DataFrame:
    """Writes the files of all documents below ``folder`` (a URI or path that all executors reach), with the tokenizer whose
    JSON is given.  The manifest: ``file``, its ``first`` id in the whole order, ``n_ids``, ``n_docs``, ``n_bytes``."""
    spark = docs.sparkSession
    at = cuts(docs, doc_id=doc_id, ranges=ranges)
    shared = spark.sparkContext.broadcast(tokenizer)  # as long as the vocabulary
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.monotonically_increasing_id().alias("place"), F.col(text).alias("text"))
    coded = rows.mapInArrow(_encoder(shared, at, end), "part int, id long, place long, ids binary")
    dealt = coded.repartitionById(len(at) + 1, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_first(), "place")
    files = freeze(dealt.mapInArrow(_writer(folder, file_ids, percentile), "part int, nth int, file string, n_ids long, n_docs long, n_bytes long"))
    # the ranges, at most RANGES, are added up first, then the files of a range
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("own"))
    parts = parts.select("part", (F.sum("own").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("own")).alias("base"))
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_ids")
    return files.join(parts, "part").select("file", (F.col("base") + within).alias("first"), "n_ids", "n_docs", "n_bytes")


def _opened(folder: str, names: Iterable[str]) -> Iterator[Reader]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    for name in names:
        with store.open_input_file(f"{root}/{name}") as file:
            yield Reader(file)


def documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Of every document in the files: ``id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, reader in zip(batch.column(1).to_pylist(), _opened(folder, batch.column(0).to_pylist()), strict=True):
                starts = reader.before[:-1] + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.ids, pa.int64()), pa.array(starts), pa.array(np.diff(reader.before)), pa.array(reader.checksums(), pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    # a task reads a few files, not as many as fit into a partition of small rows
    spread = manifest.select("file", "first").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes the files of a folder that is no longer needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
