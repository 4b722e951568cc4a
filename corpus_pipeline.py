"""The corpus pipeline: each stage works on what the one before kept, written as Parquet and read again.

Defined results: a null text is an empty one and stays null; rows without id are documents; of repeated rows, and of documents
that share the smallest id of a group, the one with the smaller text digest stays; other columns, whatever their names, go
through all stages but the last; an empty table runs through.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foundling.llm import bpe, copies, mixing, substrings, toxicity
from foundling.llm.common import read, text_key
from foundling.llm.queries import tokenizer
from foundling.session import shared_dir


#: Repeated passages of so many words go; that many words of three letters and a space take ``LENGTH`` bytes.
WORDS, LENGTH, GRAM = 51, 200, 16


def whole(docs: DataFrame) -> Column:
    """A row as one column, so that no name of it can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score says toxic."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id, then text digest; a row of it."""
    mark = F.xxhash64("text").alias("mark")
    chosen = copies.classes(docs.select("doc_id", "text", mark)).groupBy("root").agg(F.min(F.struct("row.doc_id", "row.mark")).alias("m"))
    # one key that is never null, by which rows are both joined and made distinct
    key = lambda i, m: F.substring(F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col(i).cast("string"), F.lit("-")), F.col(m).cast("string")), 256)), 1, 16).alias("key")
    rows = docs.select("doc_id", mark, whole(docs).alias("row")).select(key("doc_id", "mark"), "row")
    return rows.join(chosen.select(key("m.doc_id", "m.mark")), "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of 51 words or of op4's length; a character cut in two goes whole.  No document goes."""
    kept = substrings.cut(docs, length=LENGTH, gram=GRAM, words=WORDS, as_text=True).select("key", F.col("kept").cast("string").alias("kept"))
    rows = docs.select(whole(docs.drop("text")).alias("row"), text_key(F.col("text")).alias("key"), F.col("text").isNull().alias("gone"))
    found = rows.join(kept, "key").withColumn("kept", F.when(~F.col("gone"), F.col("kept")))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each copy."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, and digests of them and of what they decode to."""
    vocabulary, pattern = tokenizer()
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), vocabulary, pattern)
    return bpe.digests(encoded).select("row.doc_id", "row.source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxic), ("simhash_near_dedup", alike), ("suffix_array_dedup", passages), ("mixing", mixture), ("bpe", tokens)]

#: A fitted classifier and shared passages can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
