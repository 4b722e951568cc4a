"""The streamed ledger equals the batch one."""

import pytest
from pyspark.sql import functions as F

from foundling.operators import monitor as M
from foundling.plans import roles as R
from foundling.streaming import ledger as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("runs"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    R.runs(spark, SF).repartitionByRange(4, "ts").write.mode("overwrite").parquet(path + "/in")
    return path


def test_ledger(spark, folder):
    batch = spark.read.parquet(folder + "/in")
    for _ in range(2):  # the second run finds nothing new
        q = S.keep_ledger(S.read_runs(spark, folder + "/in", batch.schema, 1), folder + "/out", folder + "/cp", once=True)
        q.awaitTermination(120)
    want = M.rollup(batch)
    got = S.ledger(spark, folder + "/out").select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert spark.read.parquet(folder + "/out").select("batch").distinct().count() == 4


def test_daily(spark, folder):
    batch = spark.read.parquet(folder + "/in")
    stream = S.daily(S.read_runs(spark, folder + "/in", batch.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = M.daily(batch.withColumns({c: F.lit(0) for c in ("added", "updated", "removed")}), R.runs_as_of(), 60)
    want = want.select("day", "runs", "successes", "found")
    assert sorted(map(repr, spark.table("daily_out").collect())) == sorted(map(repr, want.collect()))
