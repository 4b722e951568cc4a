"""Toxicity by multiple-instance learning.

Labels belong to documents, offence to sentences.  A sentence's score is a logistic function of its words and their
beginnings (stems, for languages that inflect); a document is
clean only if all its sentences are, so document scores are noisy-or: 1 - product(1 - sentence score).  The weights are
fitted to document labels through that formula, and afterwards say which sentences gave the offence.

The fit is done on the driver over a sample with a bound: at most ``SAMPLE_DOCS`` labelled documents and ``SAMPLE_WORDS``
words of them, taken in the order of a digest of their ids, at most half of either label, repeated rows once, none with more
than ``SAMPLE_WORDS / MOST_OF`` words.
Only hashed words of the sample reach the driver, never texts.  Scoring covers every document and whole texts.

Defined results: null is an empty text; an empty text has the score of no evidence, 0; without positive or negative labels
the model has no weights and scores 0; repeated label rows count by their largest label, null labels do not count; rows of
one doc_id are scored each for itself; extra columns pass through the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import encoded, pieces

SAMPLE_DOCS = 8_000
SAMPLE_WORDS = 2_000_000
#: A document with more than this part of the words would crowd out the others and is not learned from (it is scored).
MOST_OF = 16
#: Features that the fit handles at once.
BLOCK = 1 << 18
BITS = 20
ROUNDS = 300
#: Beginnings of words that count besides the words.
STEMS = (3, 4, 5, 6)
#: A feature counts if it is in so many documents of the sample, and one more for every so many documents.
LEAST, LEAST_PER = 6, 300
THRESHOLD = 0.7
OFFENDING = 0.5
#: Words of a sentence that ends nowhere; a longer one is cut into several.
LONGEST = 200
_EDGE = b".,;:!?\"'()[]{}*#$%&|<>-_~`"
_END = (b".", b"!", b"?")


def sentences_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of each sentence; lines end sentences too."""
    for line in text.split(b"\n"):
        own: list[bytes] = []
        for w in line.split():
            own.append(w)
            if w.endswith(_END) or len(own) == LONGEST:
                yield own
                own = []
        if own:
            yield own


class Features(dict):
    """Words to the buckets of their features, remembered up to a bound."""

    def __init__(self, bits: int, most: int = 200_000):
        self.mask, self.most = (1 << bits) - 1, most

    def __missing__(self, word: bytes) -> list[int]:
        plain = word.strip(_EDGE).decode(errors="ignore").lower()
        names = [plain] + [f"{k} {plain[:k]}" for k in STEMS if len(plain) > k]
        value = [crc32(x.encode()) & self.mask for x in names]
        if len(self) < self.most:
            self[word] = value
        return value


class Weights(dict):
    """Words to the sums of their features' weights."""

    def __init__(self, model: Model, most: int = 200_000):
        self.features, self.weights, self.most = Features(model.bits, 0), model.weights, most

    def __missing__(self, word: bytes) -> float:
        value = float(sum(self.weights[i] for i in self.features[word]))
        if len(self) < self.most:
            self[word] = value
        return value


@dataclass
class Model:
    bits: int
    weights: np.ndarray
    bias: float

    @staticmethod
    def noisy_or(logits: np.ndarray) -> float:
        return float(-np.expm1(-np.logaddexp(0, np.asarray(logits)).sum()))


@dataclass
class Block:
    """Some documents of the sample: the features of their sentences one after the other."""

    ids: np.ndarray  # int32
    lengths: np.ndarray  # features of each sentence
    sentences: np.ndarray  # sentences of each document, at least one
    labels: np.ndarray

    def documents(self) -> np.ndarray:
        """The document of each sentence."""
        return np.repeat(np.arange(len(self.sentences)), self.sentences)


def fit(blocks: list[Block], *, bits: int = BITS, rounds: int = ROUNDS, rate: float = 0.1, shrink: float = 1e-5) -> Model:
    """Adam on the log-likelihood of document labels, a block at a time, so that beside the features only arrays of a block's
    length are held.  The blocks' features are replaced by their places among the frequent ones."""
    model = Model(bits, np.zeros(1 << bits), 0.0)
    labels = np.concatenate([b.labels for b in blocks]) if blocks else np.zeros(0, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return model
    held = np.zeros(1 << bits, np.int32)
    for b in blocks:
        pairs = np.unique(np.repeat(b.documents(), b.lengths) << bits | b.ids)
        held += np.bincount(pairs & ((1 << bits) - 1), minlength=1 << bits).astype(np.int32)
    kept = np.flatnonzero(held >= LEAST + len(labels) // LEAST_PER)
    place = np.zeros(1 << bits, np.int32)
    place[kept] = 1 + np.arange(len(kept))
    for b in blocks:
        b.ids = place[b.ids]  # 0: rare features, without a weight
    # a start at which a document of usual length has an even chance
    usual = max(float(np.median(np.concatenate([b.sentences for b in blocks]))), 1.0)
    params = np.zeros(len(kept) + 2)
    params[-1] = np.log(np.expm1(np.log(2) / usual))
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        gradient = np.zeros_like(params)
        for b in blocks:
            starts = np.cumsum(b.lengths) - b.lengths
            z = np.add.reduceat(params[b.ids], starts) + params[-1]
            total = np.add.reduceat(np.logaddexp(0, z), np.cumsum(b.sentences) - b.sentences)  # -log(1 - document score)
            odds = np.exp(-total) / np.maximum(-np.expm1(-total), 1e-12)
            slope = np.where(b.labels == 1, -odds, 1.0) / len(labels)
            by_sentence = np.repeat(slope, b.sentences) / (1 + np.exp(-z))
            gradient[:-1] += np.bincount(b.ids, np.repeat(by_sentence, b.lengths), minlength=len(kept) + 1)
            gradient[-1] += by_sentence.sum()
        gradient[1:-1] += shrink * params[1:-1]
        gradient[0] = 0
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient**2 - second)
        params -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model.weights[kept] = params[1:-1]
    return Model(bits, model.weights, float(params[-1]))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in pieces(batches, "text", 8 << 20):
            rows = []
            for text in encoded(batch.column(1)):
                ids: list[int] = []
                starts = []
                for own in sentences_of(text):
                    starts.append(len(ids))
                    for w in own:
                        ids += features[w]
                rows.append((np.array(ids, np.int32).tobytes(), np.array(starts, np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], names=["label", "ids", "starts"])

    return run


def sample(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most_docs: int = SAMPLE_DOCS, most_words: int = SAMPLE_WORDS) -> DataFrame:
    """``text``, ``label`` of the labelled documents that a model may see, within the bounds."""
    marks = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    order = F.sha2(F.col(doc_id).cast("string"), 256)
    sizes = docs.select(doc_id, F.size(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")).alias("_words"), F.xxhash64(text).alias("_text"))
    fits = F.col("_words") <= max(most_words // MOST_OF, 1)
    marked = sizes.filter(fits).join(marks, doc_id).dropDuplicates([doc_id, "_text"]).withColumn("_order", order)
    # half of the bound for either label; a plain top-n, then a running sum over what is left
    sides = []
    for side in (0, 1):
        some = marked.filter(F.col("label") == side).orderBy("_order", "_text").limit(most_docs // 2)
        running = F.sum("_words").over(W.orderBy("_order", "_text").rowsBetween(W.unboundedPreceding, 0))
        sides.append(some.withColumn("_sum", running).filter(F.col("_sum") <= most_words // 2).select(doc_id, "label", "_text"))
    chosen = sides[0].union(sides[1])
    bodies = docs.select(doc_id, F.col(text).alias("text"), F.xxhash64(text).alias("_text"))
    found = bodies.join(F.broadcast(chosen), [doc_id, "_text"])  # chosen: at most most_docs rows
    return found.dropDuplicates([doc_id, "_text"]).select("label", "text")  # repeated rows come once


def train(docs: DataFrame, labels: DataFrame, *, bits: int = BITS, rounds: int = ROUNDS, **options) -> Model:
    found = sample(docs, labels, **options).mapInArrow(_features(bits), "label int, ids binary, starts binary")
    rows = sorted((r for r in found.collect() if len(r["starts"])), key=lambda r: (r["label"], bytes(r["ids"])), reverse=True)
    blocks: list[Block] = []
    while rows:
        own, held = [], 0
        while rows and (not own or held + len(rows[-1]["ids"]) // 4 <= BLOCK):
            own.append(rows.pop())  # and its place in the list is free
            held += len(own[-1]["ids"]) // 4
        ids = [np.frombuffer(r["ids"], np.int32) for r in own]
        starts = [np.frombuffer(r["starts"], np.int64) for r in own]
        lengths = [np.diff(np.append(s, len(i))) for s, i in zip(starts, ids, strict=True)]
        blocks.append(Block(
            np.concatenate(ids), np.concatenate(lengths).astype(np.int32), np.array([len(s) for s in starts], np.int32), np.array([r["label"] for r in own], np.int8),
        ))
    return fit(blocks, bits=bits, rounds=rounds)


RESULT = [
    T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.LongType()),
    T.StructField("offending", T.ArrayType(T.StructType([
        T.StructField("sentence", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType()),
    ]))),
]


def _scorer(bits: int, nonzero: np.ndarray, values: np.ndarray, bias: float):
    limit = np.log(OFFENDING / (1 - OFFENDING))
    kind = pa.list_(pa.struct([("sentence", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << bits)
        weights[nonzero] = values
        weight = Weights(Model(bits, weights, bias))
        for batch in pieces(batches, "text", 8 << 20):
            scores, counts, marks = [], [], []
            for text in encoded(batch.column(1)):
                z, own, first = [], [], 0
                for i, words in enumerate(sentences_of(text)) if bias else ():
                    logit = sum(map(weight.__getitem__, words)) + bias
                    z.append(logit)
                    if logit >= limit:
                        own.append({"sentence": i, "first_word": first, "n_words": len(words), "score": float(1 / (1 + np.exp(-logit)))})
                    first += len(words)
                scores.append(Model.noisy_or(z) if z else 0.0)
                counts.append(len(z))
                marks.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(marks, kind)], names=["row", "score", "n_sentences", "offending"],
            )

    return run


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Each row as a struct ``row``, its score, its number of sentences and the offending ones."""
    nonzero = np.flatnonzero(model.weights)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    run = _scorer(model.bits, nonzero, model.weights[nonzero], model.bias)
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *RESULT]))
