"""Writers: snapshots, pages, publishing, rebuilds, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: rows of one remote statement
PUBLISH_BATCH = 20


def write_snapshots(rows: DataFrame, path: str, partitions: Sequence[str] = ("facility", "snapshot_ts")) -> None:
    """Append-only history, one folder per facility and stamp."""
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def route(count: str | Column, facility: str | Column, stamp: str | Column, kind: str = "cats") -> Column:
    """Where a captured page goes: pages without listings overwrite one file."""
    of = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(of(count) == 0, F.concat(of(facility), F.lit("/latest_empty.html"))).otherwise(
        F.concat(of(facility), F.lit("/"), of(stamp), F.lit(f"_{kind}.html"))
    )


def write_pages(pages: DataFrame, path: str, count: str = "record_count") -> None:
    """Pages with listings are added to the history; empty ones replace the
    facility's single empty page (dynamic partition overwrite)."""
    pages.filter(F.col(count) > 0).write.mode("append").partitionBy("facility").parquet(f"{path}/archive")
    (
        pages.filter(F.col(count) == 0).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("facility").parquet(f"{path}/latest_empty")
    )


def rebuild(rows: DataFrame, path: str, partition: str = "facility_id", incremental: bool = False) -> None:
    """Replace the whole table, or only the partitions present in ``rows``.

    Never write over a path the rows are read from: write to a new path and
    point readers at it.
    """
    mode = "dynamic" if incremental else "static"
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(partition).parquet(path)


def publish(rows: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None, batch: int = PUBLISH_BATCH) -> None:
    """Full refresh of a remote table in batches."""
    rows.write.mode("overwrite").option("truncate", True).option("batchsize", batch).jdbc(
        url, table, properties=dict(properties or {})
    )


def publish_files(rows: DataFrame, path: str) -> None:
    """Full refresh as files."""
    rows.write.mode("overwrite").parquet(path)


def split_poison(rows: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """``reason``: the first check a row fails, null for a good row.  Checks are
    (reason, condition that holds for good rows); an unknown result fails."""
    reason = F.lit(None).cast("string")
    for name, good in reversed(list(checks)):
        reason = F.when(~F.coalesce(good, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def reconcile(source: DataFrame, target: DataFrame, key: str, by: str) -> DataFrame:
    """Counts on both sides per group with what is missing and extra."""
    s = source.select(key, by).withColumn("_s", F.lit(1))
    t = target.select(key, F.col(by).alias("_by")).withColumn("_t", F.lit(1))
    both = s.join(t, key, "full_outer").withColumn(by, F.coalesce(by, "_by"))
    return both.groupBy(by).agg(
        F.count("_s").alias("source_rows"), F.count("_t").alias("target_rows"),
        F.count_if(F.col("_t").isNull()).alias("missing"), F.count_if(F.col("_s").isNull()).alias("extra"),
    )


def latest_metadata(events: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One current JSON document per facility."""
    newest = F.max_by(F.to_json(F.struct(*fields)), F.struct(*order))
    return events.groupBy(key).agg(newest.alias("metadata"))


# fixed values: static pages of the feed (path, change frequency, priority), its size, and the listings' values
FEED_STATIC = [
    ("/", "daily", 1.0), ("/search", "daily", 0.9), ("/about", "monthly", 0.5), ("/shelters", "weekly", 0.7),
    ("/legal/privacy", "yearly", 0.3), ("/legal/terms", "yearly", 0.3), ("/legal/disclaimer", "yearly", 0.3),
]
FEED_LISTING = ("daily", 0.6)


def feed(
    listings: DataFrame, key: str, updated: str, folder: str = "/listings", static: Sequence[tuple] = tuple(FEED_STATIC),
    limit: int | None = None,
) -> DataFrame:
    """Static pages and the available listings; with ``limit`` only the newest so many."""
    fixed = listings.sparkSession.createDataFrame(list(static), "path string, frequency string, priority double")
    fixed = fixed.withColumn(updated, F.lit(None).cast(listings.schema[updated].dataType))
    newest = listings.filter(F.col("status") == "available")
    if limit is not None:
        newest = newest.orderBy(F.col(updated).desc_nulls_last(), F.col(key).asc()).limit(limit)
    frequency, priority = FEED_LISTING
    rows = newest.select(
        F.concat(F.lit(f"{folder}/"), F.col(key)).alias("path"), F.lit(frequency).alias("frequency"),
        F.lit(priority).alias("priority"), updated,
    )
    return fixed.unionByName(rows)
