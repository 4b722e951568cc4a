"""The nested ledger document: a map from scraper to its record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RUN = (
    "struct<timestamp:string,status:string,html_count:int,yaml_count:int,db_count:int,"
    "error_message:string,warning:string,duration_ms:bigint>"
)
RECORD = (
    "struct<name:string,page_type:string,verified:boolean,last_success:string,last_error:string,last_error_message:string,"
    f"total_runs:int,success_count:int,error_count:int,mismatch_count:int,last_10_runs:array<{RUN}>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Ledger files in JSON form."""
    return spark.read.schema(f"metadata map<string,string>, scrapers map<string,{RECORD}>").option("multiLine", True).json(path)


def flatten(ledger: DataFrame, runs_field: str = "last_runs") -> DataFrame:
    """One row per scraper and kept run; ``position`` 0 is the newest."""
    by_scraper = ledger.select(F.explode("scrapers").alias("scraper_id", "_record"))
    return by_scraper.select("scraper_id", F.posexplode(F.col("_record")[runs_field]).alias("position", "_run")).select(
        "scraper_id", "position", "_run.*"
    )
