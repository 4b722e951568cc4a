"""The load as one job for all facilities: gate, dedupe, name, merge, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dictionaries import MENTIONS
from ..functions.html import block_text
from ..functions.text import strip_code
from ..functions.urls import image_urls
from ..session import freeze, small_side
from . import extract as E
from . import load as L
from . import monitor as M
from . import quality as Q
from .ordered import ordered_chunks, row_numbers

# fixed values: loaded columns of a listing
COLUMNS = (
    "animal_type", "name", "breed", "age_estimate", "gender", "color", "size", "health_status", "personality", "special_needs",
    "images", "protection_date", "deadline_date", "status", "source_url", "listing_type",
)


def prepare(rows: DataFrame, override: bool = False, chunk: int = 100_000) -> DataFrame:
    """Rows of the newest snapshots (``facility_id, position`` and an animal's
    fields) with their ``outcome``; loadable rows have defaults, plain image
    URLs and a name unique in their facility.

    Only the last row of a key is loaded; the ones before it were overwritten
    (``superseded``).
    """
    gated = L.gate(rows, override)
    good = gated.filter(F.col("outcome") == "loaded")
    last = good.filter(F.col("external_id").isNotNull()).groupBy("facility_id", "external_id").agg(F.max("position").alias("_last"))
    marked = good.join(last, ["facility_id", "external_id"], "left")
    current = F.col("_last").isNull() | (F.col("_last") == F.col("position"))
    marked = marked.withColumn("outcome", F.when(current, "loaded").otherwise("superseded")).drop("_last")
    filled = L.with_defaults(marked).withColumns({
        "name": L.default_name("name", "animal_type", "external_id"), "images": image_urls("images"),
    })
    named = L.unique_names(filled.filter(F.col("outcome") == "loaded"), chunk=chunk).withColumn("name", F.col("unique_name")).drop("unique_name")
    out = named.unionByName(filled.filter(F.col("outcome") != "loaded"))
    return out.unionByName(gated.filter(F.col("outcome") != "loaded").select(*out.columns))


def merge(prepared: DataFrame, table: DataFrame, now: Column) -> DataFrame:
    """The listing table after the loadable rows are merged in."""
    rows = prepared.filter(F.col("outcome") == "loaded").withColumn("last_scraped_at", now)
    columns = [c for c in table.columns if c in (*L.KEY, *COLUMNS, "last_scraped_at")]
    return L.upsert(table, rows.select(*columns), now)


def outcomes(prepared: DataFrame, table: DataFrame) -> DataFrame:
    """Every row with what became of it: inserted, updated or why it was not."""
    loaded = prepared.filter(F.col("outcome").isin("loaded", "superseded"))
    known = L.classify_upsert(loaded, table)
    done = F.when(F.col("is_new") & (F.col("outcome") == "loaded"), "inserted").otherwise("updated")
    known = known.withColumn("outcome", done).drop("is_new")
    rest = prepared.filter(~F.col("outcome").isin("loaded", "superseded"))
    return known.unionByName(rest.select(*known.columns))


def run_rows(done: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """One ledger row per facility: what the page showed (``found``: facility_id,
    html_count), what was extracted, what was loaded, and the losses between."""
    totals = L.load_totals(done)
    joined = found.join(totals, "facility_id", "full_outer")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    counts = joined.select(
        "facility_id", now.alias("ts"), n("html_count").alias("html_count"), n("total").alias("yaml_count"),
        (n("inserted") + n("updated")).alias("db_count"), n("inserted").alias("added"), n("updated").alias("updated"),
    )
    warned = counts.withColumn("warning", M.stage_warnings())
    status = M.run_status(F.lit(None).cast("string"), F.col("warning"), [F.col(c) for c in ("html_count", "yaml_count", "db_count")])
    return warned.withColumn("status", status)


@dataclass(frozen=True)
class Load:
    """What a load of pages made of them."""

    rows: DataFrame  # every extracted row, its place and its outcome
    table: DataFrame  # the listing table after the load
    runs: DataFrame  # a ledger row per facility


def snapshots(pages: DataFrame, records: DataFrame, body: str = "html") -> DataFrame:
    """Each facility's snapshot: the records in it, what its pages mention, the warnings from that and its level."""
    said = Q.mentions("_text", {k: MENTIONS[k] for k in ("gender", "age")})
    said = pages.select("facility_id", block_text(strip_code(body)).alias("_text")).select("facility_id", *said)
    said = said.groupBy("facility_id").agg(F.sum("gender").alias("gender"), F.sum("age").alias("age"))
    n = records.groupBy("facility_id").agg(F.count(F.lit(1)).alias("valid"), F.sum(F.size("images")).alias("images"))
    both = said.join(n, "facility_id", "left").na.fill(0, ["valid", "images"])
    return both.withColumn("warnings", Q.warnings("valid", "gender", "age", "images")).withColumn("document_level", Q.level("warnings"))


def from_pages(
    pages: DataFrame, layouts: DataFrame, table: DataFrame, now: Column, *, order: Sequence[str] = ("page_no",), body: str = "html", url: str = "url",
    found: DataFrame | None = None, override: bool = False, rows_per_chunk: int = 100_000,
) -> Load:
    """Pages of the newest captures into the listing table.

    ``pages`` has ``facility_id``, ``facility`` (the layout), ``order`` (the
    place of a page in its facility, unique there), the URL and the HTML;
    ``table`` holds listings keyed by facility and external id.  The stages are
    extraction, cross-check of the whole snapshot, gate, last row per key,
    default and unique names, upsert, removal of listings no longer shown, and
    the ledger row.  A snapshot with a critical level changes nothing.
    Records skipped for review are still shown, so they do not remove a
    listing.  A facility without a layout is not touched; one whose pages show
    no record loses its available listings.  ``found`` (``facility_id,
    html_count``) is what the capture counted, by default what was extracted.

    Pages are parsed once for records and once for mentions; after that only
    records travel.  No facility is gathered, whatever its share: what there is
    one row of for each facility or layout goes to every task.
    """
    covered = pages.select("facility_id", "facility", *order, url, body).join(small_side(layouts.select("facility").distinct()), "facility", "left_semi")
    records = freeze(E.listings(covered, layouts, body, "facility", url))
    place = [*order, "record_no", "animal_no"]
    placed = row_numbers(ordered_chunks(records, ["facility_id"], place, rows_per_chunk=rows_per_chunk), ["facility_id"], [F.col(c) for c in place], "position")
    seen = small_side(freeze(snapshots(covered, records, body)))
    rows = placed.withColumn("extraction_error", F.lit(False)).join(seen.select("facility_id", "document_level"), "facility_id")
    prepared = freeze(prepare(rows, override, rows_per_chunk))

    accepted = seen if override else seen.filter(F.col("document_level") != "critical")
    shown = prepared.filter(F.col("outcome") != "rejected_document").select(*L.KEY)
    merged = L.mark_removed(merge(prepared, table, now), shown, accepted, now)

    done = outcomes(prepared, table)
    counted = found if found is not None else seen.select("facility_id", F.col("valid").alias("html_count"))
    gone = table.filter((F.col("status") == "available") & F.col("external_id").isNotNull()).join(accepted.select("facility_id"), "facility_id", "left_semi")
    gone = gone.join(shown.distinct(), list(L.KEY), "left_anti").groupBy("facility_id").agg(F.count(F.lit(1)).alias("removed"))
    runs = run_rows(done, counted, now).join(gone, "facility_id", "left").na.fill(0, ["removed"])
    return Load(done, merged, runs.join(seen.select("facility_id", "document_level", "warnings"), "facility_id", "left"))
