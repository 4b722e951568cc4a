"""Snapshot documents and page captures: reading, shape check, newest, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import col, let, matched
from ..operators.ordered import newest_per_key

ANIMAL = (
    "struct<external_id:string,animal_type:string,name:string,breed:string,age_estimate:string,gender:string,color:string,"
    "size:string,health_status:string,personality:string,special_needs:string,images:array<string>,protection_date:string,"
    "deadline_date:string,status:string,transfer_decided:boolean,listing_type:string,source_url:string,raw_text:string,"
    "needs_review:boolean,confidence_score:double,confidence_level:string,extraction_notes:array<string>,"
    "extraction_error:boolean,error_message:string,inquiry_number:string,protection_location:string,"
    "extraction_method:string,container_html:string>"
)
META = (
    "struct<source_file:string,source_url:string,extracted_at:string,municipality:string,municipality_id:bigint,"
    "total_count:int,note:string,last_available_date:string>"
)
ENVELOPE = (
    f"struct<meta:{META},animals:array<{ANIMAL}>,statistics:map<string,string>,cross_check:map<string,string>,"
    "consistency_warnings:array<string>,confidence_level:string>"
)


def read_text(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files as ``path, body``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def yaml_to_json(files: DataFrame) -> DataFrame:
    """``path, body`` with YAML bodies turned into JSON, one file at a time.
    A file that does not parse keeps a null body."""

    def convert(batches):
        import json

        import pandas as pd
        import yaml

        def one(body):
            try:
                return json.dumps(yaml.load(body, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)), ensure_ascii=False, default=str)
            except yaml.YAMLError:
                return None

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "body": [one(b) for b in batch["body"]]})

    return files.select("path", "body").mapInPandas(convert, "path string, body string")


def envelopes(files: DataFrame, body: str = "body", schema: str = ENVELOPE) -> DataFrame:
    """Bodies parsed and their shape named in ``problem`` (null when loadable)."""
    b = F.col(body)
    # the shape is read from the raw text: a wrong type must not look missing
    seen = F.struct(
        F.json_object_keys(b).alias("keys"), F.get_json_object(b, "$.meta").alias("meta"),
        F.get_json_object(b, "$.animals").alias("animals"), F.ltrim(b).startswith("[").alias("listed"),
    )

    def shape(x: Column) -> Column:
        has = lambda k: F.array_contains(x["keys"], k)
        return (
            F.when(x["listed"], "bare_list").when(x["keys"].isNull(), "unparsable")
            .when(x["meta"].isNull() & has("metadata"), "metadata_key").when(x["meta"].isNull() & has("source"), "source_list")
            .when(x["meta"].isNull(), "no_meta")
            .when(x["animals"].isNull() | ~F.ltrim(x["animals"]).startswith("["), "no_animals")
        )

    return files.withColumn("problem", F.coalesce(let(seen, shape), F.when(b.isNull(), "unparsable"))).withColumn(
        "doc", F.when(F.col("problem").isNull(), F.from_json(b, schema))
    )


def loadable(parsed: DataFrame, body: str = "body", schema: str = ENVELOPE) -> DataFrame:
    """Documents without a problem.  They are parsed after the filter, so that
    the shape is looked at once per document."""
    return parsed.filter(F.col("problem").isNull()).withColumn("doc", F.from_json(body, schema))


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("problem").isNotNull())


def explode_animals(parsed: DataFrame, keep: Sequence[str], doc: str = "doc", array: str = "animals") -> DataFrame:
    """One row per animal with its position; a document without animals gives none."""
    return parsed.select(*keep, F.posexplode(F.col(doc)[array]).alias("position", "_a")).select(*keep, "position", "_a.*")


def entry_count(total: Column, animals: Column) -> Column:
    """The stated count, else the number of entries, else zero."""
    n = F.when(animals.isNotNull(), F.size(animals))
    return F.coalesce(total, n, F.lit(0))


def explode_json_map(df: DataFrame, body: str, fields: str, key: str = "external_id") -> DataFrame:
    """``{id: {fields}}`` documents as one row per id with a ``value`` struct."""
    parsed = F.from_json(F.col(body), f"map<string,struct<{fields}>>")
    return df.select("*", F.explode(parsed).alias(key, "value"))


# ---- choosing captures -----------------------------------------------------------

def latest(snapshots: DataFrame, facility: str, stamp: Sequence[str]) -> DataFrame:
    """The newest snapshot row of each facility."""
    return newest_per_key(snapshots, [facility], list(stamp))


def latest_rows(rows: DataFrame, facility: str, stamp: str) -> DataFrame:
    """All rows of each facility's newest snapshot.  The newest stamps are one
    row per facility; the rows are found by facility and stamp together."""
    newest = rows.groupBy(facility).agg(F.max(stamp).alias(stamp))
    return rows.join(newest, [facility, stamp], "left_semi")


def allowed(listings: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    return listings.join(registry.select(key), key, "left_semi")


def missing(registry: DataFrame, listings: DataFrame, key: str) -> DataFrame:
    """Allow-listed facilities without any data."""
    return registry.join(listings.select(key).distinct(), key, "left_anti")


CAPTURE_STAMP = r"([0-9]{8}_[0-9]{6})"
CAPTURE_PAGE = r"_page([0-9]+)"


def capture_parts(path: str | Column) -> list[Column]:
    """Stamp and page number in a capture's file name."""
    return [
        matched(path, CAPTURE_STAMP, 1).alias("stamp"),
        F.regexp_extract(col(path), CAPTURE_PAGE, 1).try_cast("int").alias("page"),
    ]


def batch(captures: DataFrame, facility: str, stamp: str = "stamp", page: str = "page") -> DataFrame:
    """The newest paged batch of each facility, else its newest single capture.

    One small aggregate per facility decides; captures are then chosen by a
    join on facility and stamp.
    """
    paged = F.col(page).isNotNull()
    best = captures.groupBy(facility).agg(
        F.max(F.when(paged, F.col(stamp))).alias("_paged"), F.max(F.when(~paged, F.col(stamp))).alias("_single")
    ).select(
        facility, F.coalesce("_paged", "_single").alias(stamp), F.col("_paged").isNotNull().alias("_is_paged")
    )
    return captures.withColumn("_is_paged", paged).join(best, [facility, stamp, "_is_paged"], "left_semi").drop("_is_paged")


def trim_repeats(pages: DataFrame, batch_key: str, page: str, fingerprint: Column) -> DataFrame:
    """Pages of a batch before the first one that repeats the page before it.

    Pages are numbered without gaps, so the page before is found by an equi
    join on batch and number: a batch of any size spreads over all tasks.
    """
    printed = pages.withColumn("_f", fingerprint)
    before = printed.select(batch_key, (F.col(page) + 1).alias(page), F.col("_f").alias("_before"))
    repeats = (
        printed.join(before, [batch_key, page]).filter(F.col("_f") == F.col("_before"))
        .groupBy(batch_key).agg(F.min(page).alias("_stop"))
    )
    return (
        printed.join(repeats, batch_key, "left")
        .filter(F.col("_stop").isNull() | (F.col(page) < F.col("_stop")))
        .drop("_f", "_stop")
    )


def split_by_marker(df: DataFrame, keep: Sequence[str], body: str, marker: str) -> DataFrame:
    """A blob cut at its markers: ``part_no, label, part``.  Group 1 of the
    marker is the label; text before the first marker has none."""
    sep, sub = "\x01", "\x02"
    cut = F.split(F.regexp_replace(F.col(body), marker, f"{sep}$1{sub}"), sep)
    parts = df.select(*keep, F.posexplode(cut).alias("part_no", "_p"))
    label = F.when(F.col("part_no") > 0, F.substring_index("_p", sub, 1))
    part = F.when(F.col("part_no") > 0, F.split_part("_p", F.lit(sub), F.lit(2))).otherwise(F.col("_p"))
    return parts.select(*keep, "part_no", label.alias("label"), part.alias("part"))


def labelled_union(sources: dict[str, DataFrame], column: str = "source_label") -> DataFrame:
    out = None
    for name, df in sources.items():
        df = df.withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# ---- registry, state ------------------------------------------------------------

def flatten_registry(registry: DataFrame) -> DataFrame:
    """Prefecture documents (``name, facilities[contact]``) to one row per facility."""
    p = registry.select(F.explode("prefectures").alias("p"))
    f = p.select(F.col("p.name").alias("prefecture_name"), F.explode("p.facilities").alias("f"))
    return f.select("prefecture_name", F.col("f.name").alias("facility_name"), "f.status", "f.contact.phone", "f.contact.address")


def since_mark(rows: DataFrame, state: DataFrame, posted: str, mark: str) -> DataFrame:
    """Rows at or after the newest mark in ``state``; all rows when there is no
    mark.  The mark is a scalar subquery, so it reaches the scan as a filter."""
    newest = state.groupBy().agg(F.max(mark).alias("m")).scalar()
    return rows.filter(F.coalesce(F.col(posted) >= newest, F.lit(True)))


def next_mark(rows: DataFrame, posted: str, available: Column) -> DataFrame:
    """The mark for the next run: the newest available row."""
    return rows.agg(F.max(F.when(available, F.col(posted))).alias("mark"))


def retention_plan(files: DataFrame, groups: Sequence[str], stamp: Sequence[str], key: str) -> DataFrame:
    """``keep`` for the newest file of each group, ``delete`` for the others.

    The newest files are one row per group and are marked by their own key, so
    no group is sorted or gathered.
    """
    newest = newest_per_key(files.select(*groups, *stamp, key), list(groups), [*stamp, key])
    kept = newest.select(key).withColumn("_keep", F.lit(True))
    return files.join(kept, key, "left").withColumn("action", F.when(F.col("_keep"), "keep").otherwise("delete")).drop("_keep")


def seed_ignore(target: DataFrame, seed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target with the seed rows whose unique key it lacks."""
    fresh = seed.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))
