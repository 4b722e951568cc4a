"""The thin queries over the given tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import freeze, shared_dir
from . import alignment, bpe, fixity, licences, mixing, quality, sharding, simhash, substrings, tokenfile, topk, toxicity, whitening
from .common import read, text_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op1_noisy_or_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_sentences", "offending",
    )


@query("op2_simhash_variants")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read(spark, sf_dir, "documents")).select(
        "row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


DAMAGE = """
WITH rec AS (
  SELECT page_id, url, coalesce(html, '') AS body,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || repeat('x', 36)
      || '>' || chr(13) || chr(10) || 'WARC-Date: ' || repeat('x', 20) || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' AS head,
    chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS mid
  FROM pages
), sized AS (
  SELECT page_id, strlen(head) + 64 + strlen(mid) + strlen(strlen(body)::varchar) + 4 + strlen(body) + 4 AS n_bytes FROM rec
), placed AS (
  SELECT page_id, n_bytes, sum(n_bytes) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::bigint AS end_byte FROM sized
)
SELECT page_id, CASE WHEN page_id % 97 = 13 THEN 'missing' ELSE 'changed' END AS status,
  (end_byte - n_bytes)::bigint AS first_byte, end_byte
FROM placed WHERE page_id % 97 = 13 OR page_id % 89 = 7
"""


@query("op3_warc_fixity", DAMAGE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archive of all pages against a replica in which some records are cut short and some are lost."""
    pages = read(spark, sf_dir, "pages")
    archive = pages.select("page_id", fixity.record(F.col("url"), F.col("html")).alias("record"))
    cut = F.when(F.col("page_id") % 89 == 7, F.expr("substring(record, 1, octet_length(record) - 5)")).otherwise(F.col("record"))
    replica = archive.filter(F.coalesce(F.col("page_id") % 97 != 13, F.lit(True))).withColumn("record", cut)
    return fixity.audit(archive, replica, key="page_id", record="record").select(
        F.col("key").alias("page_id"), "status", "first_byte", "end_byte",
    )


@query("op4_deep_shallow_substrings")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's strings of 400 bytes, and beside them how many repeated passages of over fifty words a text holds."""
    docs = read(spark, sf_dir, "documents")
    found = substrings.cut(docs, also=substrings.SHORT, also_words=substrings.WORDS).select(
        "key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_bytes",
    )
    return docs.select("doc_id", text_key(F.col("text")).alias("key")).join(found, "key").drop("key")


def tokenizer() -> tuple[str, str]:
    """Vocabulary file and pattern of the public tokenizer that the query encodes with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op5_distinct_word_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = tokenizer()
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, pattern)).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op6_karmarkar_karp_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents")).select(
        "row.doc_id", "size", F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_rare_word_licences")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices",
    )


NEAREST = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op8_threshold_topk", NEAREST)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


@query("op9_compression_bands")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio",
        "n_chunks", "n_bad_chunks", "verdict",
    )


MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
    md5(coalesce(text, '')) AS m, substr(md5(coalesce(doc_id::varchar, 'null')), 1, 2) AS slice
  FROM documents
), s AS (
  SELECT source, sum(size)::bigint AS total FROM d GROUP BY source
), w AS (
  SELECT source, total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i, 2.0::double * total AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS w
  FROM s
), l AS (
  SELECT *, (1.5::double * (SELECT sum(total) FROM w)
      - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w
), t AS (
  SELECT source, total, CASE WHEN level * w >= cap THEN cap
    ELSE coalesce((SELECT arg_min(level, (cap / w, i)) FROM l WHERE level * w < cap) * w, cap) END AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.total, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.slice, d.doc_id NULLS FIRST, d.m) AS place,
    CASE WHEN t.total > 0 THEN t.target / t.total ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8))::bigint::double / 4294967296.0::double AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, total AS source_size, target,
  (size * (floor(place * rate + off) - floor((place - 1) * rate + off)))::bigint AS taken
FROM r
"""


@query("op10_systematic_mix", MIX)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
    )


@query("op11_patched_token_blocks")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, read back, and the files removed once their digests are frozen."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    folder = f"{shared_dir(spark)}/token-blocks-{uuid4()}"
    manifest = tokenfile.write(read(spark, sf_dir, "documents"), folder, tokenizer)
    found = freeze(tokenfile.documents(manifest, folder))
    tokenfile.remove(spark, folder)
    return found.withColumnRenamed("id", "doc_id")


@query("op12_chebyshev_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


@query("op13_csr_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        found = alignment.Alignment(read(spark, sf_dir, "documents").select("doc_id", "text"), a.read(), b.read())
    return found.documents().select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
