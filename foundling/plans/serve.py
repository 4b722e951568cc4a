"""Search, detail, urgency and statistics queries over the listing roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import listing, search, stats
from ..operators.search import SearchParams
from . import roles as R
from .registry import query
from .roles import DETAIL, FACILITY, LISTING, REGION, SERVE


def _detail(s, d):
    return listing.detail(R.listings(s, d), R.facilities(s, d), R.regions(s, d), R.as_of())


KEY = ["listing_id", "facility_id", "animal_type", "gender", "status", "deadline_date"]
SHOWN = [*KEY, "facility_name", "region_name", "days_remaining", "urgency_level"]
SHOWN_SQL = ", ".join(SHOWN)


@query("urgent_topk", f"""{DETAIL}
SELECT {SHOWN_SQL} FROM detail WHERE status = 'available' AND deadline_date >= DATE '1998-06-15'
ORDER BY deadline_date ASC NULLS FIRST, listing_id LIMIT 50""")
def urgent_topk(s, d):
    # the top rows are found before the dimensions are joined
    found = search.urgent(R.listings(s, d), R.as_of(), limit=50)
    out = listing.detail(found, R.facilities(s, d), R.regions(s, d), R.as_of()).select(*SHOWN)
    return out.orderBy("deadline_date", "listing_id")


@query("listing_detail", f"""{DETAIL}
SELECT {SHOWN_SQL}, facility_type, is_active, region_id, region_code FROM detail""")
def listing_detail(s, d):
    return _detail(s, d).select(*SHOWN, "facility_type", "is_active", "region_id", "region_code")


@query("listing_nested", f"""{DETAIL}
SELECT listing_id, status, facility_name, facility_type, region_name, region_code, days_remaining, urgency_level FROM detail""")
def listing_nested(s, d):
    n = listing.nested(_detail(s, d))
    return n.select(
        "listing_id", "status", "facility.facility_name", "facility.facility_type", "region.region_name",
        "region.region_code", "days_remaining", "urgency_level",
    )


@query("search_facets", f"""{DETAIL}
SELECT {SHOWN_SQL} FROM detail WHERE animal_type = 'cat' AND status = 'available' AND region_id = 3 AND gender = 'female'""")
def search_facets(s, d):
    p = SearchParams(animal_type="cat", status="available", region_id=3, gender="female")
    return search.matching(_detail(s, d), p, R.as_of()).select(*SHOWN)


@query("search_keyword", """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE lower(p_name) LIKE '%large%' OR lower(p_brand) LIKE '%large%' OR lower(p_type) LIKE '%large%'""")
def search_keyword(s, d):
    p = SearchParams(keyword="LARGE")
    cols = ("p_name", "p_brand", "p_type")
    return search.matching(R.table(s, d, "part"), p, R.as_of(), cols).select("p_partkey", *cols)


@query("search_traits", """
SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'shall')
   OR contains(lower(text), 'mente')""")
def search_traits(s, d):
    p = SearchParams(traits=("gentle", "lively", "mente"))
    terms = {"gentle": "license", "lively": "shall"}
    return search.matching(R.table(s, d, "documents"), p, R.as_of(), trait_column="text", trait_terms=terms).select(
        "doc_id", "lang"
    )


@query("urgency_window", f"""{DETAIL}
SELECT {SHOWN_SQL} FROM detail WHERE deadline_date BETWEEN DATE '1998-06-15' AND DATE '1998-06-29'""")
def urgency_window(s, d):
    return search.matching(_detail(s, d), SearchParams(urgency_days=14), R.as_of()).select(*SHOWN)


@query("urgency_min", f"""{DETAIL}
SELECT {SHOWN_SQL} FROM detail WHERE deadline_date > DATE '1998-06-22'""")
def urgency_min(s, d):
    return search.matching(_detail(s, d), SearchParams(urgency_days_min=7), R.as_of()).select(*SHOWN)


@query("search_page", f"""{DETAIL}, hit AS (SELECT * FROM detail WHERE animal_type = 'cat' AND status = 'available')
SELECT {SHOWN_SQL}, (SELECT count(*) FROM hit) AS total, (SELECT count(*) FROM hit) > 60 AS has_more
FROM hit ORDER BY deadline_date DESC NULLS LAST, listing_id LIMIT 20 OFFSET 40""")
def search_page(s, d):
    p = SearchParams.from_request({"sort_by": "deadline_date", "sort_order": "desc"}).page(3)
    hits = search.matching(R.listings(s, d), p, R.as_of())
    shown = search.search(hits, p, "listing_id")
    out = listing.detail(shown, R.facilities(s, d), R.regions(s, d), R.as_of()).select(*SHOWN, "total", "has_more")
    return out.orderBy(*search.ordering(p, "listing_id"))


@query("search_page_after", f"""{DETAIL}
SELECT {SHOWN_SQL} FROM detail WHERE deadline_date > DATE '1998-06-15'
   OR (deadline_date = DATE '1998-06-15' AND listing_id > 100)
ORDER BY deadline_date ASC NULLS FIRST, listing_id LIMIT 20""")
def search_page_after(s, d):
    import datetime

    found = search.page_after(R.listings(s, d), SearchParams(), "listing_id", datetime.date(1998, 6, 15), 100)
    return listing.detail(found, R.facilities(s, d), R.regions(s, d), R.as_of()).select(*SHOWN)


@query("page_index", f"""WITH {LISTING}
SELECT animal_type, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM listing GROUP BY animal_type""")
def page_index(s, d):
    return R.listings(s, d).groupBy("animal_type").agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", search.page_index("total")
    )


@query("active_facilities", f"""{SERVE}
SELECT facility_id, facility_name, region_id FROM facility WHERE is_active AND region_id = 7""")
def active_facilities(s, d):
    return search.active_facilities(R.facilities(s, d), 7).select("facility_id", "facility_name", "region_id")


@query("facility_text_filter", """
SELECT s_suppkey AS facility_id, s_name AS facility_name, n_name AS region_name FROM supplier
JOIN nation ON s_nationkey = n_nationkey WHERE lower(s_name) LIKE '%0001%' OR lower(n_name) LIKE '%0001%'""")
def facility_text_filter(s, d):
    f = R.table(s, d, "supplier").join(R.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("facility_id"), F.col("s_name").alias("facility_name"), F.col("n_name").alias("region_name")
    )
    return search.facility_text(f, "0001")


@query("days_remaining", f"""{DETAIL} SELECT listing_id, deadline_date, days_remaining FROM detail""")
def days_remaining(s, d):
    return R.listings(s, d).select(
        "listing_id", "deadline_date", classify.days_remaining("deadline_date", R.as_of()).alias("days_remaining")
    )


@query("urgency_level", f"""{DETAIL} SELECT listing_id, deadline_date, urgency_level FROM detail""")
def urgency_level(s, d):
    return R.listings(s, d).select(
        "listing_id", "deadline_date",
        classify.urgency_level("deadline_date", R.as_of().cast("date")).alias("urgency_level"),
    )


@query("urgency_label", f"""{DETAIL}
SELECT listing_id, CASE WHEN days_remaining > 0 THEN 'あと' || days_remaining || '日' END AS badge,
  CASE WHEN days_remaining = 0 THEN '今日まで' WHEN days_remaining > 0 THEN 'あと' || days_remaining || '日' END AS full_badge
FROM detail""")
def urgency_label(s, d):
    return R.listings(s, d).withColumn("days", classify.days_remaining("deadline_date", R.as_of())).select(
        "listing_id", classify.urgency_label("days").alias("badge"), classify.urgency_label("days", False).alias("full_badge")
    )


@query("point_lookup", f"""{DETAIL} SELECT {SHOWN_SQL} FROM detail WHERE listing_id = 77""")
def point_lookup(s, d):
    found = listing.by_key(R.listings(s, d), "listing_id", 77)
    return listing.detail(found, R.facilities(s, d), R.regions(s, d), R.as_of()).select(*SHOWN)


@query("listing_by_sql_args", f"""WITH {LISTING}
SELECT listing_id, status, deadline_date FROM listing WHERE status = 'adopted' AND price >= 400000""")
def listing_by_sql_args(s, d):
    return s.sql(
        "SELECT listing_id, status, deadline_date FROM {listing} WHERE status = :status AND price >= :low",
        args={"status": "adopted", "low": 400000}, listing=R.listings(s, d),
    )


@query("available_list", f"""{SERVE}
SELECT listing_id, l.facility_id, animal_type, protection_date, facility_name, region_name
FROM listing l JOIN facility f ON l.facility_id = f.facility_id JOIN reg r ON f.region_id = r.region_id
WHERE status = 'available' AND animal_type = 'dog'""")
def available_list(s, d):
    return (
        listing.available(R.listings(s, d), R.facilities(s, d), R.regions(s, d), animal_type="dog")
        .select("listing_id", "facility_id", "animal_type", "protection_date", "facility_name", "region_name")
        .orderBy(F.col("protection_date").desc_nulls_last(), "listing_id")
    )


@query("compose_title", f"""{DETAIL}
SELECT listing_id, concat_ws(' / ', external_id, nullif(category, ''), CAST(deadline_date AS VARCHAR), facility_name) AS title FROM detail""")
def compose_title(s, d):
    return _detail(s, d).select(
        "listing_id",
        text.share_title("external_id", "category", F.col("deadline_date").cast("string"), "facility_name").alias("title"),
    )


@query("listing_stats", f"""WITH {LISTING}
SELECT count(*) AS total, count(*) FILTER (animal_type = 'cat') AS cats, count(*) FILTER (animal_type = 'dog') AS dogs,
  count(*) FILTER (status = 'available') AS available, count(*) FILTER (status = 'adopted') AS adopted,
  count(*) FILTER (transfer_decided) AS transfer_decided,
  count(*) FILTER (status = 'available' AND deadline_date <= DATE '1998-06-18') AS urgent,
  count(*) FILTER (status = 'available' AND deadline_date <= DATE '1998-06-22') AS warning,
  count(*) FILTER (status = 'available' AND deadline_date <= DATE '1998-06-29') AS caution FROM listing""")
def listing_stats(s, d):
    return stats.totals(R.listings(s, d), R.as_of())


@query("stats_by_region", f"""{SERVE}
SELECT region_name, count(listing_id) AS count FROM listing l LEFT JOIN facility f ON l.facility_id = f.facility_id
LEFT JOIN reg r ON f.region_id = r.region_id WHERE status = 'available' AND region_name IS NOT NULL GROUP BY region_name""")
def stats_by_region(s, d):
    out = stats.by_region(R.listings(s, d), R.facilities(s, d), R.regions(s, d))
    return out.orderBy(F.col("count").desc(), "region_name")


@query("region_facets", f"""{SERVE}
SELECT r.region_id, region_name, region_code, count(DISTINCT f.facility_id) AS facilities,
  CAST(sum(CASE WHEN l.status = 'available' THEN 1 ELSE 0 END) AS BIGINT) AS available
FROM reg r LEFT JOIN facility f ON r.region_id = f.region_id AND f.is_active
LEFT JOIN listing l ON l.facility_id = f.facility_id AND l.status = 'available' GROUP BY ALL""")
def region_facets(s, d):
    return stats.region_facets(R.regions(s, d), R.facilities(s, d), R.listings(s, d)).orderBy("region_code")


@query("facility_facets", f"""{SERVE}
SELECT f.facility_id, facility_name, r.region_id, region_name, region_code,
  CAST(sum(CASE WHEN l.status = 'available' THEN 1 ELSE 0 END) AS BIGINT) AS available,
  CAST(sum(CASE WHEN l.status = 'available' AND animal_type = 'cat' THEN 1 ELSE 0 END) AS BIGINT) AS available_cats,
  CAST(sum(CASE WHEN l.status = 'available' AND animal_type = 'dog' THEN 1 ELSE 0 END) AS BIGINT) AS available_dogs
FROM facility f JOIN reg r ON r.region_id = f.region_id LEFT JOIN listing l ON l.facility_id = f.facility_id
WHERE f.is_active GROUP BY f.facility_id, facility_name, r.region_id, region_name, region_code""")
def facility_facets(s, d):
    return stats.facility_facets(R.facilities(s, d), R.regions(s, d), R.listings(s, d))


@query("facility_counts", f"""{SERVE}
SELECT f.facility_id, facility_name, count(listing_id) AS n FROM facility f
LEFT JOIN listing l ON l.facility_id = f.facility_id GROUP BY ALL""")
def facility_counts(s, d):
    return stats.facility_counts(R.facilities(s, d), R.listings(s, d))


@query("type_counts", f"WITH {LISTING} SELECT animal_type, count(*) AS n FROM listing GROUP BY 1")
def type_counts(s, d):
    return stats.type_counts(R.listings(s, d))


@query("listing_statistics", f"""{SERVE}
SELECT region_name, facility_name, animal_type, gender, count(*) AS n, min(protection_date) AS earliest_protection,
  max(last_scraped_at) AS last_updated
FROM listing l JOIN facility f ON l.facility_id = f.facility_id JOIN reg r ON f.region_id = r.region_id
WHERE status = 'available' GROUP BY ALL""")
def listing_statistics(s, d):
    return stats.statistics(R.listings(s, d), R.facilities(s, d), R.regions(s, d))


@query("area_rollup", """
SELECT r_name AS area_name, count(DISTINCT n_nationkey) AS regions, count(c_custkey) AS facilities
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def area_rollup(s, d):
    return stats.area_rollup(R.regions(s, d), R.areas(s, d), R.facilities(s, d))


@query("region_fallback", """
SELECT c_custkey AS facility_id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN n_name END, n_name) AS region_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def region_fallback(s, d):
    names = R.regions(s, d)
    embedded = R.facilities(s, d).withColumn(
        "region_name", F.when(F.col("facility_id") % 2 == 0, F.concat(F.lit("NATION_"), F.col("region_id")))
    )
    return listing.region_or_lookup(embedded, names).select("facility_id", "region_name")


@query("coverage_summary", """
SELECT n_name AS region_name, count(*) AS total, count(*) FILTER (s_acctbal > 0) AS implemented,
  count(*) FILTER (NOT s_acctbal > 0) AS pending, round(100.0 * count(*) FILTER (s_acctbal > 0) / count(*), 1) AS rate
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def coverage_summary(s, d):
    reg = R.table(s, d, "supplier").select(
        F.col("s_nationkey").alias("region_id"), F.when(F.col("s_acctbal") > 0, "implemented").otherwise("pending").alias("status")
    )
    return stats.coverage(reg.join(R.regions(s, d), "region_id"), "region_name")


@query("table_counts", """
SELECT 'regions' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'facilities', count(*) FROM customer
UNION ALL SELECT 'listings', count(*) FROM orders UNION ALL SELECT 'runs', count(*) FROM events""")
def table_counts(s, d):
    return stats.table_counts({
        "regions": R.regions(s, d), "facilities": R.facilities(s, d), "listings": R.listings(s, d), "runs": R.runs(s, d),
    })
