"""Listings with their facility and region, computed columns, nested output.

Dimension joins carry no broadcast hint: Spark broadcasts a side it has
measured to be small, and splits hot keys of a sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify


def with_dimensions(listings: DataFrame, facilities: DataFrame, regions: DataFrame, how: str = "left") -> DataFrame:
    regions = regions.select("region_id", "region_name", "region_code")
    dims = facilities.withColumnRenamed("region_id", "_region").join(
        regions, F.col("_region") == F.col("region_id"), how
    ).drop("_region")
    return listings.join(dims, "facility_id", how)


def with_urgency(df: DataFrame, as_of: Column) -> DataFrame:
    return df.withColumns(
        {
            "days_remaining": classify.days_remaining("deadline_date", as_of),
            "urgency_level": classify.urgency_level("deadline_date", as_of.cast("date")),
        }
    )


def detail(listings: DataFrame, facilities: DataFrame, regions: DataFrame, as_of: Column) -> DataFrame:
    return with_urgency(with_dimensions(listings, facilities, regions), as_of)


FACILITY_COLUMNS = ["facility_id", "facility_name", "facility_type", "is_active"]
REGION_COLUMNS = ["region_id", "region_name", "region_code"]


def nested(detail_df: DataFrame) -> DataFrame:
    """One ``facility`` and one ``region`` struct beside the listing's own columns."""
    own = [c for c in detail_df.columns if c not in FACILITY_COLUMNS + REGION_COLUMNS]
    return detail_df.select(
        *own, F.struct(*FACILITY_COLUMNS).alias("facility"), F.struct(*REGION_COLUMNS).alias("region")
    )


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; no row when the key is unknown."""
    return df.filter(F.col(key) == F.lit(value))


def available(
    listings: DataFrame, facilities: DataFrame, regions: DataFrame, facility_id=None, animal_type: str | None = None
) -> DataFrame:
    df = listings.filter(F.col("status") == "available")
    if facility_id:
        df = df.filter(F.col("facility_id") == facility_id)
    if animal_type:
        df = df.filter(F.col("animal_type") == animal_type)
    return with_dimensions(df, facilities, regions, "inner")


def region_or_lookup(facilities: DataFrame, regions: DataFrame, embedded: str = "region_name") -> DataFrame:
    """Use the embedded region name, look it up by id where it is missing."""
    names = regions.select("region_id", F.col("region_name").alias("_looked_up"))
    return (
        facilities.join(names, "region_id", "left")
        .withColumn(embedded, F.coalesce(F.col(embedded), F.col("_looked_up")))
        .drop("_looked_up")
    )
