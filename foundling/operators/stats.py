"""Counts and facets.  Facts are aggregated to the key before they meet a
dimension, so a join never multiplies rows and a hot key arrives as one row
per task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .listing import with_dimensions


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def totals(listings: DataFrame, as_of: Column, steps: tuple[int, int, int] = (3, 7, 14)) -> DataFrame:
    """Totals by type and status; the urgency steps are cumulative."""
    today = as_of.cast("date")
    open_ = F.col("status") == "available"
    due = lambda n: F.count_if(open_ & (F.col("deadline_date") <= F.date_add(today, n)))
    return listings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("animal_type") == "cat").alias("cats"),
        F.count_if(F.col("animal_type") == "dog").alias("dogs"),
        F.count_if(open_).alias("available"),
        F.count_if(F.col("status") == "adopted").alias("adopted"),
        F.count_if("transfer_decided").alias("transfer_decided"),
        due(steps[0]).alias("urgent"), due(steps[1]).alias("warning"), due(steps[2]).alias("caution"),
    )


def per_facility(listings: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """Listing measures by facility: the only step that reads all listings."""
    return listings.groupBy("facility_id").agg(*[F.count_if(c).alias(n) for n, c in measures.items()])


def by_region(listings: DataFrame, facilities: DataFrame, regions: DataFrame) -> DataFrame:
    counts = per_facility(listings.filter(F.col("status") == "available"), {"n": F.lit(True)})
    return (
        with_dimensions(counts, facilities, regions)
        .filter(F.col("region_name").isNotNull())
        .groupBy("region_name").agg(F.sum("n").alias("count"))
    )


def region_facets(regions: DataFrame, facilities: DataFrame, listings: DataFrame) -> DataFrame:
    """Active facilities and available listings of every region, zero included."""
    counts = per_facility(listings.filter(F.col("status") == "available"), {"n": F.lit(True)})
    active = facilities.filter("is_active").select("facility_id", "region_id").join(counts, "facility_id", "left")
    sums = active.groupBy("region_id").agg(
        F.count("facility_id").alias("facilities"), F.sum(F.coalesce("n", F.lit(0))).alias("available")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return regions.select("region_id", "region_name", "region_code").join(sums, "region_id", "left").select(
        "region_id", "region_name", "region_code", zero("facilities"), zero("available")
    )


def facility_facets(facilities: DataFrame, regions: DataFrame, listings: DataFrame, active_only: bool = True) -> DataFrame:
    is_open = F.col("status") == "available"
    counts = per_facility(listings, {
        "available": is_open,
        "available_cats": is_open & (F.col("animal_type") == "cat"),
        "available_dogs": is_open & (F.col("animal_type") == "dog"),
    })
    base = facilities.filter("is_active") if active_only else facilities
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        base.join(regions.select("region_id", "region_name", "region_code"), "region_id")
        .join(counts, "facility_id", "left")
        .select(
            "facility_id", "facility_name", "region_id", "region_name", "region_code",
            *[zero(c) for c in ("available", "available_cats", "available_dogs")],
        )
    )


def facility_counts(facilities: DataFrame, listings: DataFrame) -> DataFrame:
    """Listings per facility, zero kept."""
    counts = listings.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"))
    return facilities.select("facility_id", "facility_name").join(counts, "facility_id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def type_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy("animal_type").agg(F.count(F.lit(1)).alias("n"))


def statistics(listings: DataFrame, facilities: DataFrame, regions: DataFrame) -> DataFrame:
    """Available listings by region, facility, type and gender."""
    grouped = (
        listings.filter(F.col("status") == "available")
        .groupBy("facility_id", "animal_type", "gender")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("protection_date").alias("earliest_protection"),
            F.max("last_scraped_at").alias("last_updated"),
        )
    )
    # names may repeat: regroup by name after the join, as the view does
    return (
        with_dimensions(grouped, facilities, regions, "inner")
        .groupBy("region_name", "facility_name", "animal_type", "gender")
        .agg(
            F.sum("n").alias("n"), F.min("earliest_protection").alias("earliest_protection"),
            F.max("last_updated").alias("last_updated"),
        )
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table, one row per table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def area_rollup(regions: DataFrame, areas: DataFrame, facilities: DataFrame) -> DataFrame:
    """Facilities by area group."""
    per_region = facilities.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        regions.join(per_region, "region_id", "left").join(areas, "area_id")
        .groupBy("area_name")
        .agg(F.count(F.lit(1)).alias("regions"), F.sum(F.coalesce("n", F.lit(0))).alias("facilities"))
    )


def coverage(registry: DataFrame, group: str | None = None) -> DataFrame:
    """Implemented and pending facilities, with the rate in percent."""
    grouped = registry.groupBy(group) if group else registry.groupBy()
    done = F.count_if(F.col("status") == "implemented")
    return grouped.agg(
        F.count(F.lit(1)).alias("total"),
        done.alias("implemented"),
        (F.count(F.lit(1)) - done).alias("pending"),
        F.when(F.count(F.lit(1)) > 0, F.round(100 * done / F.count(F.lit(1)), 1)).alias("rate"),
    )
