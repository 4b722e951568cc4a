"""Small rows that stand for much work, and joins on few keys, are spread over tasks."""

import gc

import pytest
from pyspark.sql import functions as F

from foundling.operators import containment, extract, ingest
from foundling.plans import load, normalize, pages
from foundling.session import PER_TASK, dealt, small_side
from foundling.sources import layouts

N = 3 * PER_TASK


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """``part`` in one small file, larger than a task's share."""
    d = str(tmp_path_factory.mktemp("dealing"))
    k = F.col("id").cast("int")
    rows = spark.range(N).select(
        k.alias("p_partkey"), F.lit("x").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("T").alias("p_type"), (k % 50 + 1).alias("p_size"), F.lit(1.0).alias("p_retailprice"),
    )
    rows.coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_dealt_keeps_the_rows(spark):
    rows = spark.range(0, 1000, numPartitions=1)
    out = dealt(rows, "id", per_task=100)
    assert out.rdd.getNumPartitions() == 10 and largest(out) < 200
    assert sorted(r["id"] for r in out.collect()) == list(range(1000))
    assert dealt(rows, "id", per_task=1000).rdd.getNumPartitions() == 1
    assert dealt(rows.limit(0), "id").count() == 0


@pytest.mark.parametrize("of", [pages.parts, normalize.parts, lambda s, d: load.scraped(s, d)[0]])
def test_pages_made_of_small_rows_are_dealt(spark, folder, of):
    made = of(spark, folder)
    assert made.count() == N and largest(made) < 2 * PER_TASK


def test_pages_of_few_facilities_stay_where_they_are(spark, monkeypatch):
    rows = spark.range(0, 60, numPartitions=6).select(
        F.lit(0).alias("facility_id"), F.lit("kochi/kochi-pref").alias("facility"), F.col("id").alias("page_no"), F.lit("https://x.example/").alias("url"),
        F.concat(F.lit('<div class="tab-animal-card"><table><tr><th>管理番号</th><td>K'), "id", F.lit("</td></tr></table></div>")).alias("html"),
    )
    table = spark.createDataFrame([], "facility_id int, external_id string, name string, status string, created_at timestamp, updated_at timestamp")
    tasks, read = [], extract.listings

    def listings(covered, *more):
        tasks.append(covered.select(F.spark_partition_id().alias("p")).distinct().count())
        return read(covered, *more)

    monkeypatch.setattr(ingest.E, "listings", listings)
    out = ingest.from_pages(rows, layouts.catalogue(spark), table, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    assert tasks == [6]
    # the rows are numbered through their facility, whatever the chunks
    split = ingest.from_pages(rows, layouts.catalogue(spark), table, F.lit("2025-01-01 00:00:00").cast("timestamp"), rows_per_chunk=7)
    keys = lambda x: sorted((r["page_no"], r["position"], r["external_id"], r["name"], r["outcome"]) for r in x.rows.collect())
    assert keys(out) == keys(split) and [k[1] for k in keys(out)] == list(range(1, 61))
    assert out.runs.count() == 1


def test_small_side(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(small_side(spark.range(10))) and not hinted(small_side(spark.range(10_001)))


def test_reading_order_deals_documents(spark, tmp_path):
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    spark.range(0, 2 * PER_TASK, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    lines = pages.reading_order(spark, str(tmp_path))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    # the documents travel, not their words
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert lines.count() == 2 * PER_TASK * 2 * 20 * 2


def test_texts_with_a_run_at_every_sign_are_dealt(spark):
    k = F.col("id")
    texts = spark.range(0, N, numPartitions=1).select(k.alias("t"), (k % 7).alias("page"), F.concat(F.lit("ab"), F.lpad(k.cast("string"), 8, "0"), F.lit("yz")).alias("text"))
    needles = texts.select(F.col("t").alias("n"), "page", F.substring("text", 3, 8).alias("needle"))
    found = containment.contains_join(texts, needles, "t", "text", "n", "needle", within=["page"])
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == N and found.filter("t <> n").count() == 0


def test_bitmap_has_a_word_for_every_anchor(spark):
    anchored = spark.createDataFrame([(h,) for h in (-(2**63), -1, 0, 1, 63, 64, 65_535, 2**40 + 12_345)], "_h bigint")
    bits, may = containment._bitmap(anchored, 300_000)
    row = anchored.withColumn("_bits", bits).select(F.size("_bits").alias("n"), may(F.col("_h"), F.col("_bits")).alias("in"), may(F.col("_h") + 7, F.col("_bits")).alias("out")).collect()
    assert {r["n"] for r in row} == {1 << (containment.BITS - 6)} and all(r["in"] for r in row) and not any(r["out"] for r in row)


def test_freezing_lets_the_driver_collect(spark):
    from foundling.session import HEAP_PART, freeze

    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    used = lambda: heap.totalMemory() - heap.freeMemory()
    jvm.java.lang.System.gc()
    held, most = [], heap.maxMemory()
    while used() < most * 0.45:  # what rounds of plans leave
        held.append(jvm.java.nio.ByteBuffer.allocate(most // 8192))
    del held
    gc.collect()
    assert freeze(spark.range(5)).count() == 5
    assert used() < most // HEAP_PART + most // 10
