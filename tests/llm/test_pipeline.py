import hashlib
import os
import subprocess
import sys
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from test_near import similarity

import corpus_pipeline
from foundling.llm import toxicity

SOURCE = "/root/testdata/sf0.001"


def groups(texts):
    """Number of components of five-word similarity 0.8 and more, and the pairs, by comparing all."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if texts[i] == texts[j] or similarity(texts[i], texts[j]) >= 0.8:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(texts))]


def test_stages_take_effect(spark, tmp_path):
    """Each stage on what the one before kept: columns, and the effect of its decisions, over a small table."""
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet")
    extra = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))
    docs = docs.union(extra).union(docs.limit(2))  # a null row and repeated rows
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SOURCE).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            rows = before.collect()
            of = groups([r.text or "" for r in rows])
            best = {}
            for r, g in zip(rows, of, strict=True):
                own = (r.doc_id is not None, r.doc_id or 0)
                best[g] = min(best.get(g, own), own)
            assert sorted(docs.select("doc_id").toPandas()["doc_id"].fillna(-1)) == sorted(i if there else -1 for there, i in best.values())
        if name == "suffix_array_dedup":
            assert docs.count() == before.count()
    texts = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in before.collect()}
    assert {r.decoded_sha256 for r in docs.collect()} == texts
    assert len(seen) == 5
    # an empty table runs through
    nothing = before.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SOURCE).count() == 0


CLASHING = "_id _mark _key _null _kept key kept mark row node root id label ids cells own size copies block kind bucket payload score gone"


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_clashing_names(spark, stage):
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet").limit(40)
    wide = docs.select("*", *[F.lit(7).alias(c) for c in CLASHING.split()])
    out = stage(spark, wide, SOURCE)
    assert stage is corpus_pipeline.tokens or out.columns == wide.columns
    assert out.count() == stage(spark, docs, SOURCE).count()


def test_bounds_of_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i} a b") for i in range(60) for _ in range(32)] + [(1000, "w " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1000, 1)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, most_docs=10).count() == 10
    # a long text takes no room from the others
    few = toxicity.sample(docs, labels, most_words=4000)
    assert few.count() == few.distinct().count() and few.groupBy("label").count().count() == 2 and few.filter(F.length("text") > 1000).count() == 0
    assert few.count() == toxicity.sample(docs.filter("doc_id < 1000"), labels, most_words=4000).count() > 30


def test_executors_without_the_library():
    """A session that starts elsewhere: its workers can't import the repository."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.abspath(corpus_pipeline.__file__))!r})
import corpus_pipeline
from foundling.session import build
spark = build("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
docs = spark.read.parquet("{SOURCE}/documents.parquet").limit(30)
for name, stage in corpus_pipeline.STAGES:
    print(name, stage(spark, docs, "{SOURCE}").count())
from foundling.llm import queries
for name in ("op11_patched_token_blocks", "op12_chebyshev_whitening", "op13_csr_token_alignment"):
    print(name, queries.QUERIES[name](spark, "{SOURCE}").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) == 16
