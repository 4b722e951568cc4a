"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even when doing so costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(app: str = "foundling", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the one the cluster names, or a
    local one when everything runs on this machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="foundling-")
    return _LOCAL[context.applicationId]


def freeze(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that every later read sees
    the same rows and a lost executor does not change them."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    frozen = df.checkpoint(eager=True)
    tidy(spark)
    return frozen


#: Part of the driver's heap that may be in use before plans are collected.
HEAP_PART = 4


def tidy(spark: SparkSession) -> None:
    """Lets the driver collect what the last queries left.  An operator with many
    rounds plans hundreds of stages, whose plans and stage records are garbage
    once a round is frozen; left alone they fill the heap to its limit before
    the collector takes them, and the memory isn't given back.  The shuffle files
    of the rounds before go with them."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > heap.maxMemory() // HEAP_PART:
        jvm.java.lang.System.gc()


#: Rows of a task when each row stands for much work.
PER_TASK = 4_096


def dealt(rows: DataFrame, *keys: str, per_task: int = PER_TASK) -> DataFrame:
    """Rows dealt by their keys to so many tasks that each has about ``per_task``
    of them.  Spark makes tasks by the size of files, which tells nothing of the
    work when each small row becomes a page or a long text: a million such rows
    fit in one task.  Deal the rows before they grow; their number is counted
    (from the footers, for files)."""
    tasks = -(-rows.count() // per_task)
    return rows.repartition(tasks, *keys) if tasks > 1 else rows


#: Rows of a task when rows are a few keys each.
KEYS_PER_TASK = 16_384


def gathered(rows: DataFrame, most: int, per_task: int = KEYS_PER_TASK) -> DataFrame:
    """Rows that are known to be ``most`` or about that, in no more tasks than
    they fill.  A shuffle leaves as many partitions as the session says, and the
    next one writes three files and a row of blocks for each of them: with few
    rows and many rounds that is more disk than the rows.  Partitions are only
    put together, so a table with more rows than this keeps those it has."""
    return rows.coalesce(max(1, -(-most // per_task)))


#: Rows of a side that goes to every task.
SMALL = 10_000


def small_side(side: DataFrame) -> DataFrame:
    """The side of a join on few keys, broadcast when it is counted to be small.
    Without the hint the rows are shuffled by those keys, a task a key, and
    adaptive execution leaves it so: it does not broadcast a side that fills
    few partitions."""
    return F.broadcast(side) if side.limit(SMALL + 1).count() <= SMALL else side
