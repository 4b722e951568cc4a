"""Alignment of the tokens of two tokenizers by sparse incidence matrices.

Rows of the matrices are tokens, columns are bytes: the Gustavson product A·Bᵀ links the tokens that share bytes.  Bytes after
which a token of both ends part the text into groups; the product of the token-group incidences links all tokens of a group.
Neither tokenizer lets a token cross a blank that follows something else than white space, so the products are made once per
distinct chunk between such blanks and reused for its other places.

Documents are read once.  A block of documents keeps its distinct id pairs with the number of its documents that hold each;
block and pairs are written to the shared folder, the pairs are added up over the corpus, and each block gets the counts of
its pairs back.  A frequent pair is one row per block; a task holds one block.

Defined results: texts that are null or empty, or whose bytes either tokenizer does not give back, have no tokens, zeros
and empty groups; repeated rows are documents each; an empty table gives no rows; extra columns pass through the struct ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import shared_dir
from .common import Lists, Numbers, pieces

#: Bytes of text, and documents' distinct pairs, that close a block.
BLOCK, BLOCK_PAIRS = 32 << 20, 4_000_000
#: Chunks, and pairs of them, that a task keeps; then it starts anew.
CHUNKS, CHUNK_PAIRS = 300_000, 3_000_000
#: Terms of a product that are held at once.
TERMS = 1 << 22
#: Chunks that are given to the first tokenizer as one text.
TOGETHER = 512
#: Blanks that need a look: at either end of the text, or after white space.
LOOSE = re.compile(r"\A |\s | \Z")
PAIR, DOCUMENT = 0, 1


class Csr:
    """A sparse matrix by rows: those of row i are ``columns[first[i]:first[i + 1]]``, with ``values``."""

    def __init__(self, first: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.first, self.columns, self.values, self.width = first, columns, values, width

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int) -> Csr:
        """From entries in any order; entries of one place are added."""
        order = np.argsort(rows * width + columns, kind="stable")
        place = (rows * width + columns)[order]
        new = np.flatnonzero(np.diff(place, prepend=-1))
        values = np.add.reduceat(values[order], new) if len(new) else values[:0]
        rows, columns = place[new] // max(width, 1), place[new] % max(width, 1)
        return cls(np.searchsorted(rows, np.arange(height + 1)), columns, values, width)

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def transpose(self) -> Csr:
        return Csr.of(self.columns, self.rows, self.values, self.width, len(self.first) - 1)

    def product(self, other: Csr) -> Csr:
        """Gustavson's: a row is the sum of the other's rows that its entries name, ``TERMS`` terms at a time."""
        sizes = np.diff(other.first)[self.columns]
        ends, rows = np.cumsum(sizes), self.rows
        found, start = [], 0
        while start < len(sizes):
            done = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, done + TERMS, side="right")), start + 1)
            own = sizes[start:stop]
            term = np.repeat(other.first[self.columns[start:stop]] - (ends[start:stop] - own), own) + np.arange(done, int(ends[stop - 1]))
            part = Csr.of(np.repeat(rows[start:stop], own), other.columns[term], np.repeat(self.values[start:stop], own) * other.values[term], len(self.first) - 1, other.width)
            found.append((part.rows, part.columns, part.values))
            start = stop
        if not found:
            return Csr(np.zeros(len(self.first), np.int64), self.columns[:0], self.values[:0], other.width)
        return Csr.of(*map(np.concatenate, zip(*found, strict=True)), len(self.first) - 1, other.width)


def bytes_of(lengths: np.ndarray) -> Csr:
    """The token-byte incidence of tokens that follow each other."""
    ends = np.cumsum(lengths)
    width = int(ends[-1]) if len(ends) else 0
    return Csr(np.append(0, ends), np.arange(width), np.ones(width, np.int64), width)


def groups_of(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token on both sides, and how many groups there are."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common)


def chunks(text: str) -> list[str]:
    """Blank and text cut before each blank that follows something else than white space, every piece without its first blank."""
    parts = text.split(" ")
    if not LOOSE.search(text):
        return parts
    out, held = [], None
    for part in parts:
        part = part if held is None else f"{held} {part}"
        if part and not part[-1].isspace():
            out.append(part)
            held = None
        else:
            held = part
    if held is not None and out:  # a blank alone would be lost at the end of the second tokenizer's input
        out[-1] += f" {held}"
    elif held is not None:
        out.append(held)
    return out


class Tokenizers:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, byte_json: str, piece_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        # byte-level signs: printable Latin-1 stands for itself, the others follow from U+0100
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}
        n = self.a.get_vocab_size(with_added_tokens=True)
        signs = [self.a.id_to_token(i) or "" for i in range(n)]
        self.bytes_a = [bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s in signs]
        shown = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.cut = not any(re.search("[^▁]▁", p) for p in shown)  # a piece over such a blank would forbid to cut there

        self.starts_a = np.array([t.startswith(b" ") for t in self.bytes_a])
        # ids with what may follow them in the written groups
        self.ends = [f"{i}{after}" for after in ("", ",", "|", ";") for i in range(max(n, len(shown)))]
        self.most = max(n, len(shown))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[Lists, Lists]:
        """Ids of each text on both sides.  Texts without white space are given to the first tokenizer together: each starts
        with the only token that has a blank."""
        loose = np.array([t.isspace() or len(t.split(None, 1)) != 1 or t[0].isspace() or t[-1].isspace() for t in texts], bool)
        tight, other = np.flatnonzero(~loose), np.flatnonzero(loose)
        groups = [[texts[i] for i in tight[j:j + TOGETHER].tolist()] for j in range(0, len(tight), TOGETHER)]
        first = np.array([i for own in self.encode_a([" ".join(g) for g in groups]) for i in own], np.int64)
        starts = np.flatnonzero(self.starts_a[first])
        if len(starts) != len(tight):
            raise ValueError("a token of the first tokenizer goes over a blank")
        rest = self.encode_a([texts[i] for i in other.tolist()])
        mixed = Lists(np.int64)
        mixed.add(np.diff(np.append(starts, len(first))), first)
        mixed.add(np.array([len(i) for i in rest], np.int64), np.array([i for own in rest for i in own], np.int64))
        a, b = Lists(np.int64), Lists(np.int64)
        values, counts = mixed.gather(np.argsort(np.concatenate([tight, other])))
        a.add(counts, values)
        found = self.b.encode(texts, num_threads=1)
        b.add(np.array([len(i) for i in found], np.int64), np.array([i for own in found for i in own], np.int64))
        return a, b

    def exact(self, texts: list[str], a: Lists, b: Lists) -> np.ndarray:
        """Whether the tokens of each text give back its bytes, on both sides."""
        given = [f" {t}".encode() for t in texts]
        sizes, data = np.array([len(g) for g in given], np.int64), b"".join(given)
        good = np.ones(len(texts), bool)
        for own, table, width in ((a, self.bytes_a, self.sizes_a), (b, self.bytes_b, self.sizes_b)):
            of = np.repeat(np.arange(len(texts)), own.counts)
            same = np.bincount(of, width[own.values], len(texts)).astype(np.int64) == sizes
            if same.all() and b"".join(map(table.__getitem__, own.values.tolist())) == data:
                continue
            ids = np.split(own.values, own.first[1:])
            good &= [b"".join(map(table.__getitem__, i.tolist())) == g for i, g in zip(ids, given, strict=True)]
        return good


class Memory:
    """What the products found for the distinct chunks of a task."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.shown: list[str] = []
        self.stats = np.zeros((0, 5), np.int64)  # exact or not, tokens of either, groups, overlap links
        self.many, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.place: dict[int, int] = {}
        self.keys = np.zeros(0, np.int64)
        self.pairs, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.number) > CHUNKS or len(self.pairs) > CHUNK_PAIRS

    def learn(self) -> None:
        fresh = self.number.fresh()
        t = self.tokenizers
        a, b = t.encode(fresh)
        exact = t.exact(fresh, a, b)
        n_a, n_b = a.counts * exact, b.counts * exact
        ids_a, ids_b = a.values[np.repeat(exact, a.counts)], b.values[np.repeat(exact, b.counts)]
        chunk_a, chunk_b = np.repeat(np.arange(len(fresh)), n_a), np.repeat(np.arange(len(fresh)), n_b)
        # chunks lie one after the other: their ends are ends on both sides
        by_a, by_b = bytes_of(t.sizes_a[ids_a]), bytes_of(t.sizes_b[ids_b])
        overlaps = by_a.product(by_b.transpose())
        group_a, group_b, n = groups_of(t.sizes_a[ids_a], t.sizes_b[ids_b])
        chunk_of = np.zeros(n, np.int64)
        chunk_of[group_a] = chunk_a
        # tokens of one id in one group are one row with their number
        (token_a, at_a, times_a), (token_b, at_b, times_b) = (_tally(g, i) for g, i in ((group_a, ids_a), (group_b, ids_b)))
        in_a = Csr(np.arange(len(at_a) + 1), at_a, times_a, n)
        in_b = Csr(np.arange(len(at_b) + 1), at_b, times_b, n)
        shared = in_a.product(in_b.transpose())
        key = token_a[shared.rows] << 32 | token_b[shared.columns]
        distinct, dense = np.unique(key, return_inverse=True)
        per_chunk = Csr.of(chunk_of[at_a[shared.rows]], dense, shared.values, len(fresh), max(len(distinct), 1))
        number = np.array([self.place.setdefault(k, len(self.place)) for k in distinct.tolist()], np.int64)
        if len(self.place) > len(self.keys):
            self.keys = np.fromiter(self.place, np.int64, len(self.place))
        self.pairs = np.concatenate([self.pairs, number[per_chunk.columns] if len(number) else number])
        self.weights = np.concatenate([self.weights, per_chunk.values])
        self.many = np.concatenate([self.many, np.diff(per_chunk.first)])
        self.first = np.cumsum(self.many) - self.many
        groups = np.bincount(chunk_of, minlength=len(fresh))
        links = np.bincount(chunk_a[overlaps.rows], minlength=len(fresh))
        self.stats = np.concatenate([self.stats, np.stack([exact, n_a, n_b, groups, links], axis=1).astype(np.int64)])
        # the groups in writing: "," between ids, "|" between sides, ";" between groups, nothing after a chunk
        end_a, end_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        last = np.append(chunk_b[1:] != chunk_b[:-1], True) if len(chunk_b) else end_b
        written = np.concatenate([ids_a + t.most * np.where(end_a, 2, 1), ids_b + t.most * np.where(last, 0, np.where(end_b, 3, 1))])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        signs = list(map(t.ends.__getitem__, written[order].tolist()))
        stop = np.cumsum(n_a + n_b).tolist()
        self.shown += ["".join(signs[i:j]) for i, j in zip([0, *stop[:-1]], stop, strict=True)]


def _tally(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id): the ids, their groups, and how often each comes."""
    key, times = np.unique(group << 32 | ids, return_counts=True)
    return key & 0xFFFFFFFF, key >> 32, times.astype(np.int64)


def _totals(memory: Memory, texts: list[str | None]) -> list[tuple[list[int], str, np.ndarray, np.ndarray]]:
    """Of each text: tokens, groups and links counted, its groups' digest, its id pairs, and how often each is linked."""
    if memory.full():
        memory.clear()
    words = [(chunks(t) if memory.tokenizers.cut else [t]) if t else [] for t in texts]

    def known(lists):
        found = [np.fromiter(map(memory.number.__getitem__, own), np.int64, len(own)) for own in lists]
        if len(memory.number) > memory.number.seen:
            memory.learn()
        return found

    numbers = known(words)
    unsure = [i for i, own in enumerate(numbers) if len(own) and not memory.stats[own, 0].all()]
    if unsure:  # bytes go missing in a chunk; the text as a whole decides
        for i, own in zip(unsure, known([[texts[i]] for i in unsure]), strict=True):
            numbers[i] = own if memory.stats[own, 0].all() else own[:0]
    doc = np.repeat(np.arange(len(texts)), [len(own) for own in numbers])
    chosen = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    many = memory.many[chosen]
    ends = np.cumsum(many)
    term = np.repeat(memory.first[chosen] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
    linked = Csr.of(np.repeat(doc, many), memory.pairs[term], memory.weights[term], len(texts), max(len(memory.keys), 1))
    out = []
    for i, own in enumerate(numbers):
        start, stop = linked.first[i], linked.first[i + 1]
        stats = memory.stats[own, 1:].sum(axis=0).tolist()
        shown = sha256(";".join(map(memory.shown.__getitem__, own.tolist())).encode()).hexdigest() if len(own) else ""
        out.append((stats, shown, memory.keys[linked.columns[start:stop]], linked.values[start:stop]))
    return out


FIELDS = "n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, n_links long"
PLAN = "block string, kind int, number int, a int, b int, documents long"


def _planner(byte_json, piece_model, row: T.DataType, block_bytes: int):
    names = ["block", "kind", "number", "a", "b", "documents", "row", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256", "n_links", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_, memory = zstandard.ZstdCompressor(level=1), Memory(Tokenizers(byte_json.value, piece_model.value))
        waiting: list[tuple[pa.Array, list]] = []
        held = pairs = 0

        def close():
            block = str(uuid4())
            keys, place, documents = np.unique(np.concatenate([d[2] for _, docs in waiting for d in docs]), return_inverse=True, return_counts=True)
            n, at, kind = len(keys), 0, waiting[0][0].type
            blank = lambda t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.string()), pa.array(np.full(n, PAIR, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array((keys >> 32).astype(np.int32)),
                 pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(documents.astype(np.int64)), blank(kind), *(blank(pa.int64()) for _ in range(4)), blank(pa.string()), blank(pa.int64()), blank(pa.binary())],
                names=names,
            )
            for rows, docs in waiting:
                n, payloads = len(docs), []
                blank = lambda t, n=n: pa.nulls(n, t)
                for _, _, own, times in docs:
                    payloads.append(zip_.compress(place[at:at + len(own)].astype("<i4").tobytes() + times.astype("<i8").tobytes()))
                    at += len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.string()), pa.array(np.full(n, DOCUMENT, np.int32)), blank(pa.int32()), blank(pa.int32()), blank(pa.int32()), blank(pa.int64()), rows,
                     *(pa.array([d[0][i] for d in docs], pa.int64()) for i in range(4)), pa.array([d[1] for d in docs], pa.string()), pa.array([int(d[3].sum()) for d in docs], pa.int64()), pa.array(payloads, pa.binary())],
                    names=names,
                )

        for batch in pieces(batches, "text", 1 << 20):
            texts = batch.column(1).to_pylist()
            docs = _totals(memory, texts)
            waiting.append((batch.column(0), docs))
            held += sum(len(t or "") for t in texts)
            pairs += sum(len(d[2]) for d in docs)
            if held >= block_bytes or pairs >= BLOCK_PAIRS:
                yield from close()
                waiting.clear()
                held = pairs = 0
        if waiting:
            yield from close()

    schema = T.StructType([*T._parse_datatype_string(PLAN).fields, T.StructField("row", row), *T._parse_datatype_string(FIELDS).fields, T.StructField("payload", T.BinaryType())])
    return run, schema


def _finish(row: T.DataType):
    kinds = ["row", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        block, parts, table = None, [], None
        for batch in batches:
            names, kind = batch.column("block").to_pylist(), np.asarray(batch.column("kind"))
            number, count, best = (np.asarray(batch.column(c).fill_null(0)) for c in ("number", "count", "best"))
            payloads = batch.column("payload").to_pylist()
            start = 0
            while start < batch.num_rows:  # a stretch of one block and kind
                stop = start + 1
                while stop < batch.num_rows and names[stop] == names[start] and kind[stop] == kind[start]:
                    stop += 1
                if names[start] != block:
                    block, parts, table = names[start], [], None
                if kind[start] == PAIR:
                    parts.append((number[start:stop], count[start:stop], best[start:stop]))
                else:
                    table = table or _places(parts)
                    sums, bests = [], []
                    for data in payloads[start:stop]:
                        data = unzip.decompress(data)
                        n = len(data) // 12
                        own, times = np.frombuffer(data, "<i4", n), np.frombuffer(data, "<i8", n, 4 * n)
                        sums.append(int(table[0][own] @ times))
                        bests.append(int(table[1][own] @ times))
                    some = batch.slice(start, stop - start)
                    yield pa.RecordBatch.from_arrays([*(some.column(k) for k in kinds), pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], names=[*kinds, "n_best", "count_sum"])
                start = stop

    return run, T.StructType([T.StructField("row", row), *T._parse_datatype_string(f"{FIELDS}, n_best long, count_sum long").fields])


def _places(parts) -> tuple[np.ndarray, np.ndarray]:
    """Counts and best marks of a block by pair number."""
    n = sum(len(p[0]) for p in parts)
    counts, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for place, count, mark in parts:
        counts[place], best[place] = count, mark
    return counts, best


class Alignment:
    """Blocks of documents written once, and what is read from them."""

    def __init__(self, docs: DataFrame, byte_json: str, piece_model: bytes, *, text: str = "text", block: int = BLOCK):
        spark = docs.sparkSession
        rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
        rows = docs.select(F.struct(*rest, F.lit(True).alias("_")).alias("row"), F.col(text).alias("text"))
        self.row = rows.schema["row"].dataType
        vocabularies = spark.sparkContext.broadcast(byte_json), spark.sparkContext.broadcast(piece_model)  # as long as the vocabularies
        folder = f"{shared_dir(spark)}/alignment-{uuid4()}"
        rows.mapInArrow(*_planner(*vocabularies, self.row, block)).write.parquet(folder)
        self.table = spark.read.parquet(folder)

    def pairs(self) -> DataFrame:
        """``a``, ``b``, ``count`` of documents that hold the pair linked, and whether it is the highest of its ``a``."""
        counts = self.table.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("documents").alias("count"))
        best = counts.groupBy("a").agg(F.max("count").alias("most"))
        return counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))

    def documents(self) -> DataFrame:
        """Each document's ``row``, ``n_a``, ``n_b``, ``n_groups``, ``n_overlaps``, ``groups_sha256``, ``n_links``, ``n_best``, ``count_sum``."""
        own = self.table.filter(F.col("kind") == PAIR).select("block", "kind", "number", "a", "b").join(self.pairs(), ["a", "b"]).drop("a", "b")
        docs = self.table.filter(F.col("kind") == DOCUMENT).select("block", "kind", "row", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256", "n_links", "payload")
        both = own.unionByName(docs, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
        return both.mapInArrow(*_finish(self.row))
