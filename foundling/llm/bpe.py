"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Texts are cut into pre-tokens.  A block of documents (about ``BLOCK`` bytes) numbers its distinct words; a document becomes
the row of word numbers by position.  Words go, packed by block, to the bucket of their digest; a bucket sees all blocks'
words and encodes each distinct word once.  The ids go back to the blocks, are put in by position, and decoding looks up
the token-byte table.  A frequent word is one entry per block, so no bucket is hot; a task holds one block or one bucket.
Blocks with the same texts in the same order have one name and the same numbers; their words are taken once.

Defined results: null is an empty text and has no ids; repeated rows get equal results; extra columns pass through the
struct ``row``; an empty table gives no rows.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import pieces

BLOCK = 32 << 20
#: Words with so many places in a block get the smallest numbers; the others are numbered in the order they are packed.
FREQUENT = 64
WORDS, DOCUMENT = 0, 1


def ranks(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    table = [b""] * (1 + max(int(i) for _, i in pairs))
    for token, i in pairs:
        table[int(i)] = base64.b64decode(token)
    return table


def _pack(numbers: np.ndarray) -> bytes:
    """Integers below 2^32 as four planes of bytes, which compress well."""
    return np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _head(data: bytes) -> tuple[int, int]:
    """Of packed words: where the lengths begin, and how many words there are."""
    often, rest, _ = np.frombuffer(data[:12], "<u4").tolist()
    return 12 + 4 * often, often + rest


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _cutter(pattern: str, buckets: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard

        find, zip_ = regex.compile(pattern).findall, zstandard.ZstdCompressor(level=1)
        held, mark = 0, blake2b(digest_size=16)  # a block is named by its texts
        number, kind = _Numbers(), None

        def out(name, kinds, buckets_, rows, payloads):
            n = len(payloads)
            rows = pa.nulls(n, kind) if rows is None else rows
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * n, pa.string()), pa.array([kinds] * n, pa.int32()), pa.array(buckets_, pa.int32()), rows, pa.array(payloads, pa.binary())],
                names=["block", "kind", "bucket", "row", "payload"],
            )

        def close(name):
            """The block's documents and words, renumbered so that both pack well."""
            all_ = np.concatenate([d for _, docs in waiting for d in docs])
            words = [w.encode() for w in number]
            counts = np.bincount(all_, minlength=len(words))
            often = [int(i) for i in np.argsort(-counts, kind="stable")[:int((counts >= FREQUENT).sum())]]
            dealt: dict[int, tuple[list, list]] = {}
            for n, i in enumerate(often):
                dealt.setdefault(crc32(words[i]) % buckets, ([], []))[0].append(n)
            for i in np.flatnonzero(counts < FREQUENT).tolist():
                dealt.setdefault(crc32(words[i]) % buckets, ([], []))[1].append(i)
            fresh = np.empty(len(words), np.int64)
            fresh[often] = np.arange(len(often))
            at, payloads, keys = len(often), [], sorted(dealt)
            for b in keys:
                top, rest = dealt[b][0], sorted(dealt[b][1], key=words.__getitem__)
                fresh[rest] = at + np.arange(len(rest))
                own = [words[often[n]] for n in top] + [words[i] for i in rest]
                head = np.array([len(top), len(rest), at], "<u4").tobytes() + _pack(np.array(top))
                payloads.append(zip_.compress(head + _pack(np.array([len(w) for w in own])) + b"".join(own)))
                at += len(rest)
            yield out(name, WORDS, keys, None, payloads)
            for rows, docs in waiting:
                yield out(name, DOCUMENT, [len(words)] * len(docs), rows, [zip_.compress(_pack(fresh[d])) for d in docs])

        waiting: list[tuple] = []
        for batch in pieces(batches, "text", 2 << 20):
            kind = batch.column(0).type
            docs = []
            for text in batch.column(1).to_pylist():
                found = find(text or "")
                docs.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                held += len(text or "")
                body = (text or "").encode()
                mark.update(b"%d " % len(body) + body)
            waiting.append((batch.column(0), docs))
            if held >= block:
                yield from close(mark.hexdigest())
                number.clear()
                waiting.clear()
                held, mark = 0, blake2b(digest_size=16)
        if waiting:
            yield from close(mark.hexdigest())

    return run


def _encoder(pattern: str, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import zstandard

        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        encode = None
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            kinds, buckets, payloads = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()
            for i, kind in enumerate(kinds):
                if kind != WORDS:
                    continue
                if encode is None:
                    merges = {t: r for r, t in enumerate(table.value) if t}
                    encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
                if buckets[i] != bucket:  # a word is in one bucket only
                    known.clear()
                    bucket = buckets[i]
                data = unzip.decompress(payloads[i])
                head, n = _head(data)
                ends = np.cumsum(_unpack(data[head:head + 4 * n])).tolist()
                at, ids, counts = head + 4 * n, [], []
                start = at
                for end in ends:
                    word = data[start:at + end]
                    start = at + end
                    own = known.get(word)
                    if own is None:
                        own = known[word] = encode(word.decode())
                    ids += own
                    counts.append(len(own))
                payloads[i] = zip_.compress(data[:head] + _pack(np.array(counts)) + _pack(np.array(ids)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(payloads, pa.binary())], names=batch.schema.names)

    return run


def _joiner(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        decode = Decoder(table.value)
        block, parts, lookup, seen = None, [], None, set()
        for batch in batches:
            blocks, kinds, sizes, payloads = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            rows, ids, texts, held = [], [], [], 0
            for i, kind in enumerate(kinds):
                if blocks[i] != block:
                    block, parts, lookup, seen = blocks[i], [], None, set()
                if kind == WORDS and sizes[i] in seen:  # of a block with the same texts, which is numbered alike
                    continue
                data = unzip.decompress(payloads[i])
                if kind == WORDS:
                    seen.add(sizes[i])
                    head, n = _head(data)
                    _, rest, at = np.frombuffer(data[:12], "<u4").tolist()
                    places = np.concatenate([_unpack(data[12:head]), at + np.arange(rest)])
                    parts.append((places, _unpack(data[head:head + 4 * n]), _unpack(data[head + 4 * n:])))
                    continue
                lookup = lookup or _table(parts)
                if len(lookup[0]) != sizes[i]:
                    raise ValueError(f"block {block} was numbered twice in different ways")
                own = _gather(_unpack(data), *lookup)
                rows.append(i)
                ids.append(own)
                texts.append(decode(own))
                held += len(own)
                if held > 1 << 20 or i + 1 == len(kinds):
                    yield _result(batch, rows, ids, texts)
                    rows, ids, texts, held = [], [], [], 0
            if rows:
                yield _result(batch, rows, ids, texts)

    return run


def _table(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: first id and number of ids of each word number, and all ids."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first, number = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    first[places], number[places] = np.cumsum(counts) - counts, counts
    return first, number, np.concatenate([p[2] for p in parts])


def _gather(chosen: np.ndarray, first: np.ndarray, number: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of each chosen entry, one after the other."""
    if not len(chosen):
        return values[:0]
    counts = number[chosen]
    ends = np.cumsum(counts)
    return values[np.repeat(first[chosen] - (ends - counts), counts) + np.arange(ends[-1])]


class Decoder:
    """Ids to bytes by the token-byte table."""

    def __init__(self, table: list[bytes]):
        self.number = np.array([len(t) for t in table], np.int64)
        self.first = np.cumsum(self.number) - self.number
        self.values = np.frombuffer(b"".join(table), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return _gather(np.asarray(ids, np.int64), self.first, self.number, self.values).tobytes()


def _result(batch, rows, ids, texts) -> pa.RecordBatch:
    offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
    return pa.RecordBatch.from_arrays(
        [batch.column(3).take(pa.array(rows, pa.int32())), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(texts, pa.binary())], names=["row", "ids", "decoded"],
    )


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Each row's other columns as ``row``, its token ``ids`` and the ``decoded`` bytes."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks(vocabulary))  # as long as the vocabulary
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest, F.lit(True).alias("_")).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("row", rows.schema["row"].dataType), T.StructField("payload", T.BinaryType()),
    ])
    cut = rows.mapInArrow(_cutter(pattern, 4 * parts, block), schema)
    # documents go to their block only; pre-tokens are cut once for them and once for the words, which costs less than a
    # second shuffle of the documents.  A document says how many words its block has, so a change between both is found.
    words = cut.filter(F.col("kind") == WORDS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoder(pattern, table), schema)
    joined = words.union(cut.filter(F.col("kind") == DOCUMENT)).repartition("block").sortWithinPartitions("block", "kind")
    return joined.mapInArrow(_joiner(table), T.StructType([schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """The number of ids and digests of ids and decoded bytes, beside ``row``."""
    return encoded.select(
        "row", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
