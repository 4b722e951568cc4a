"""Source and sink queries: envelopes, captures, registry, publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import sinks, snapshots as S
from . import roles as R
from .registry import query

c = F.col


def docs(s, d):
    return R.table(s, d, "documents")


def say(*pieces):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in pieces])


def bodies(s, d):
    """Each document as a JSON snapshot; three in ten in shapes that do not load."""
    meta = F.struct(
        F.lit(None).cast("string").alias("source_url"), c("lang").alias("municipality"), c("doc_id").alias("municipality_id"),
        F.when(c("doc_id") % 3 == 0, c("n_chars").cast("int")).alias("total_count"),
    )
    animals = F.transform(
        F.split("text", "\n"), lambda x, i: F.struct(say("x", i).alias("external_id"), x.alias("name"))
    )
    n = c("doc_id") % 10
    whole = F.to_json(F.struct(meta.alias("meta"), animals.alias("animals")))
    body = (
        F.when(n == 7, F.to_json(animals)).when(n == 8, F.to_json(F.struct(c("lang").alias("source"), animals.alias("cats"))))
        .when(n == 9, F.lit('{"meta": {"municipality')).when(n == 6, F.to_json(F.struct(meta.alias("meta"))))
        .otherwise(whole)
    )
    return docs(s, d).select("doc_id", "source", body.alias("body"))


@query("envelope_scan", """
SELECT doc_id, CASE doc_id % 10 WHEN 6 THEN 'no_animals' WHEN 7 THEN 'bare_list' WHEN 8 THEN 'source_list' WHEN 9 THEN 'unparsable' END AS problem,
  CASE WHEN doc_id % 10 < 6 THEN lang END AS municipality, CASE WHEN doc_id % 10 < 6 THEN len(string_split(text, chr(10))) END AS n
FROM documents""")
def envelope_scan(s, d):
    p = S.envelopes(bodies(s, d))
    return p.select(
        "doc_id", "problem", c("doc.meta.municipality").alias("municipality"),
        F.when(c("problem").isNull(), F.size("doc.animals")).alias("n"),
    )


@query("envelope_explode", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position
  FROM documents WHERE doc_id % 10 < 6)
SELECT doc_id, CAST(position AS INTEGER) AS position, 'x' || position AS external_id, line AS name FROM l""")
def envelope_explode(s, d):
    p = S.loadable(S.envelopes(bodies(s, d)))
    return S.explode_animals(p, ["doc_id"]).select("doc_id", "position", "external_id", "name")


@query("entry_count", """
SELECT doc_id, CASE WHEN doc_id % 10 >= 7 THEN 0 WHEN doc_id % 3 = 0 THEN n_chars WHEN doc_id % 10 = 6 THEN 0
  ELSE len(string_split(text, chr(10))) END AS n FROM documents""")
def entry_count(s, d):
    doc = F.from_json("body", S.ENVELOPE)
    return bodies(s, d).select("doc_id", S.entry_count(doc["meta"]["total_count"], doc["animals"]).alias("n"))


LATEST = """
SELECT facility_id, external_id, quantity, snapshot_ts FROM (
  SELECT l_suppkey AS facility_id, l_orderkey AS external_id, l_quantity AS quantity, CAST(l_shipdate AS DATE) AS snapshot_ts,
    rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC) AS r FROM lineitem) WHERE r = 1"""


@query("latest_snapshot", LATEST)
def latest_snapshot(s, d):
    """All rows of each facility's newest snapshot date."""
    rows = R.table(s, d, "lineitem").select(
        c("l_suppkey").alias("facility_id"), c("l_orderkey").alias("external_id"), c("l_quantity").alias("quantity"),
        c("l_shipdate").cast("date").alias("snapshot_ts"),
    )
    return S.latest_rows(rows, "facility_id", "snapshot_ts").select("facility_id", "external_id", "quantity", "snapshot_ts")


@query("allowlist_scan", f"""WITH {R.LISTING}, {R.FACILITY}
SELECT 'listing' AS kind, listing_id AS id FROM listing WHERE facility_id IN (SELECT facility_id FROM facility WHERE facility_type = 'MACHINERY')
UNION ALL SELECT 'missing', facility_id FROM facility WHERE facility_type = 'MACHINERY' AND facility_id NOT IN (SELECT facility_id FROM listing)""")
def allowlist_scan(s, d):
    listed, rows = R.facilities(s, d).filter(c("facility_type") == "MACHINERY"), R.listings(s, d)
    ok = S.allowed(rows, listed, "facility_id").select(F.lit("listing").alias("kind"), c("listing_id").alias("id"))
    return ok.unionByName(S.missing(listed, rows, "facility_id").select(F.lit("missing").alias("kind"), c("facility_id").alias("id")))


@query("batch_pages", """
WITH f AS (SELECT conv_id % 7 AS facility, conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) = 0 AS single FROM conversations),
b AS (SELECT facility, max(conv_id) FILTER (NOT single) AS p, max(conv_id) FILTER (single) AS q FROM f GROUP BY facility)
SELECT f.facility, f.conv_id, CASE WHEN NOT single THEN turn END AS page, role FROM f JOIN b ON f.facility = b.facility
WHERE CASE WHEN p IS NOT NULL THEN NOT single AND conv_id = p ELSE conv_id = q END""")
def batch_pages(s, d):
    """A conversation is a batch, a turn a page; file names carry both."""
    conv = R.table(s, d, "conversations")
    lengths = conv.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    page = F.when(c("_last") > 0, say("_page", c("turn"))).otherwise("")
    files = conv.join(lengths, "conv_id").select(
        (c("conv_id") % 7).alias("facility"), "conv_id", "role",
        say(F.format_string("20240101_%06d", "conv_id"), page, ".html").alias("path"),
    )
    captures = files.select("facility", "conv_id", "role", *S.capture_parts("path"))
    return S.batch(captures, "facility").select("facility", "conv_id", "page", "role")


@query("repeat_page_trim", """
WITH f AS (SELECT conv_id, turn, role, length(text) % 3 AS fp FROM conversations),
l AS (SELECT *, lag(fp) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM f),
st AS (SELECT conv_id, min(turn) AS stop FROM l WHERE fp = before GROUP BY conv_id)
SELECT l.conv_id, turn, role FROM l LEFT JOIN st ON st.conv_id = l.conv_id WHERE stop IS NULL OR turn < stop""")
def repeat_page_trim(s, d):
    return S.trim_repeats(R.table(s, d, "conversations"), "conv_id", "turn", F.length("text") % 3).select("conv_id", "turn", "role")


@query("marker_split", r"""
WITH p AS (SELECT page_id, unnest(string_split(regexp_replace(html, '<!-- ad ([0-9]+) -->', chr(1) || '\1' || chr(2), 'g'), chr(1))) AS x,
  generate_subscripts(string_split(regexp_replace(html, '<!-- ad ([0-9]+) -->', chr(1) || '\1' || chr(2), 'g'), chr(1)), 1) - 1 AS part_no FROM pages)
SELECT page_id, CAST(part_no AS INTEGER) AS part_no, CASE WHEN part_no > 0 THEN split_part(x, chr(2), 1) END AS label,
  length(CASE WHEN part_no > 0 THEN split_part(x, chr(2), 2) ELSE x END) AS n FROM p""")
def marker_split(s, d):
    out = S.split_by_marker(R.table(s, d, "pages"), ["page_id"], "html", "<!-- ad ([0-9]+) -->")
    return out.select("page_id", "part_no", "label", F.length("part").alias("n"))


@query("labelled_union", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS kind, 'adults' AS source_label FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, 'kittens' FROM supplier""")
def labelled_union(s, d):
    adults = R.table(s, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("kind"))
    kittens = R.table(s, d, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    return S.labelled_union({"adults": adults, "kittens": kittens})


@query("registry_flatten", """
SELECT n_name AS prefecture_name, s_name AS facility_name, CASE WHEN s_acctbal > 0 THEN 'implemented' ELSE 'pending' END AS status,
  'tel-' || s_suppkey AS phone, CAST(NULL AS VARCHAR) AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def registry_flatten(s, d):
    """Registry documents hold one block of up to a hundred facilities each."""
    f = R.table(s, d, "supplier").join(R.table(s, d, "nation"), c("s_nationkey") == c("n_nationkey"))
    facility = F.struct(
        c("s_name").alias("name"), F.when(c("s_acctbal") > 0, "implemented").otherwise("pending").alias("status"),
        F.struct(say("tel-", c("s_suppkey")).alias("phone"), F.lit(None).cast("string").alias("address")).alias("contact"),
    )
    doc = f.groupBy("n_name", F.floor(c("s_suppkey") / 100).alias("block")).agg(F.collect_list(facility).alias("facilities"))
    return S.flatten_registry(doc.select(F.array(F.struct(c("n_name").alias("name"), "facilities")).alias("prefectures")))


@query("seed_ignore", """
SELECT c_custkey AS facility_id, c_nationkey AS region_id, c_name AS name FROM customer WHERE c_acctbal > 0
UNION ALL SELECT c.c_custkey, n_nationkey, c_name FROM customer c JOIN nation ON printf('R%02d', n_nationkey) = printf('R%02d', c_nationkey)
WHERE NOT c_acctbal > 0""")
def seed_ignore(s, d):
    """Active facilities are loaded; all are seeded by region code."""
    every = R.facilities(s, d).withColumnRenamed("facility_name", "name")
    cust = every.select("facility_id", "region_id", "name")
    loaded = every.filter("is_active").select("facility_id", "region_id", "name")
    seed = cust.select("facility_id", F.format_string("R%02d", "region_id").alias("region_code"), "name")
    coded = seed.join(R.regions(s, d).select("region_code", "region_id"), "region_code")
    return S.seed_ignore(loaded, coded, ["region_id", "name"])


@query("incremental_hwm", """
WITH m AS (SELECT max(ts) AS hwm FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-20'),
n AS (SELECT * FROM events, m WHERE ts >= hwm)
SELECT event_id, event_type, strftime((SELECT max(ts) FROM n WHERE event_type <> 'error'), '%Y-%m-%d %H:%M:%S') AS next_mark FROM n""")
def incremental_hwm(s, d):
    ev = R.table(s, d, "events")
    state = ev.filter((c("event_type") == "signup") & (c("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))).select(c("ts").alias("mark"))
    fresh = S.since_mark(ev, state, "ts", "mark")
    mark = S.next_mark(fresh, "ts", c("event_type") != "error").select(F.date_format("mark", "yyyy-MM-dd HH:mm:ss")).scalar()
    return fresh.select("event_id", "event_type", mark.alias("next_mark"))


@query("route_pages", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'f' || (page_id % 5) || '/latest_empty.html'
  ELSE 'f' || (page_id % 5) || '/' || printf('20240101_%06d', page_id) || '_cats.html' END AS route FROM pages""")
def route_pages(s, d):
    n = F.when(c("page_id") % 3 == 0, 0).otherwise(F.regexp_count("html", F.lit("<p")))
    r = sinks.route(n, say("f", c("page_id") % 5), F.format_string("20240101_%06d", "page_id"))
    return R.table(s, d, "pages").select("page_id", r.alias("route"))


@query("latest_metadata", """
SELECT user_id AS facility_id, arg_max('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ts) AS metadata FROM events GROUP BY 1""")
def latest_metadata(s, d):
    ev = R.table(s, d, "events").withColumnRenamed("user_id", "facility_id")
    return sinks.latest_metadata(ev, "facility_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("quarantine_split", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'bad_date' WHEN o_orderkey % 11 = 0 THEN 'bad_price'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'no_category' END AS reason FROM orders""")
def quarantine_split(s, d):
    raw = R.table(s, d, "orders").select(
        "o_orderkey", F.when(c("o_orderkey") % 9 == 0, "1998-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(c("o_orderkey") % 11 == 0, "n/a").otherwise(c("o_totalprice").cast("string")).alias("price"), "o_orderpriority",
    )
    checks = [
        ("bad_date", F.try_to_date("day", "yyyy-MM-dd").isNotNull()), ("bad_price", c("price").try_cast("double").isNotNull()),
        ("no_category", c("o_orderpriority") != "4-NOT SPECIFIED"),
    ]
    return sinks.split_poison(raw, checks).select("o_orderkey", "reason")


@query("reconcile_counts", f"""WITH {R.LISTING}
SELECT category, count(*) FILTER (price <= 450000) AS source_rows, count(*) FILTER (status <> 'pending') AS target_rows,
  count(*) FILTER (price <= 450000 AND status = 'pending') AS missing, count(*) FILTER (price > 450000 AND status <> 'pending') AS extra
FROM listing WHERE price <= 450000 OR status <> 'pending' GROUP BY category""")
def reconcile_counts(s, d):
    """Listings up to a price against those that are not pending."""
    rows = R.listings(s, d)
    source, target = rows.filter(c("price") <= 450000), rows.filter(c("status") != "pending")
    return sinks.reconcile(source.select("listing_id", "category"), target.select("listing_id", "category"), "listing_id", "category")


FEED = ", ".join(f"('{p}', '{f}', {x})" for p, f, x in sinks.FEED_STATIC)


@query("feed_export", f"""WITH {R.LISTING}
SELECT * FROM (VALUES {FEED}) t(path, frequency, priority), (SELECT CAST(NULL AS DATE) AS last_scraped_at)
UNION ALL SELECT * FROM (SELECT '/listings/' || listing_id, 'daily', 0.6, last_scraped_at FROM listing WHERE status = 'available'
  ORDER BY last_scraped_at DESC NULLS LAST, listing_id LIMIT 1000)""")
def feed_export(s, d):
    return sinks.feed(R.listings(s, d), "listing_id", "last_scraped_at", limit=1000)


@query("retention_plan", """
WITH f AS (SELECT page_id, page_id % 7 AS facility, CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'yaml' END AS kind FROM pages)
SELECT page_id, facility, kind, CASE WHEN page_id = max(page_id) OVER (PARTITION BY facility, kind) THEN 'keep' ELSE 'delete' END AS action FROM f""")
def retention_plan(s, d):
    files = R.table(s, d, "pages").select(
        "page_id", (c("page_id") % 7).alias("facility"), F.when(c("page_id") % 2 == 0, "html").otherwise("yaml").alias("kind"),
        F.format_string("20240101_%06d", "page_id").alias("stamp"),
    )
    return S.retention_plan(files, ["facility", "kind"], ["stamp"], "page_id").select("page_id", "facility", "kind", "action")


@query("union_distinct", """
SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS folder FROM pages UNION
SELECT DISTINCT source FROM documents""")
def union_distinct(s, d):
    from ..functions import urls

    a = R.table(s, d, "pages").select(urls.site("url").alias("folder"))
    return a.union(docs(s, d).select("source")).distinct()


def _fresh(s, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("snapshot_sink", """
SELECT doc_id, lang AS facility, '2024010' || (doc_id % 3 + 1) AS snapshot_ts, n_chars FROM documents""")
def snapshot_sink(s, d):
    """Documents written as history and read back."""
    path = _fresh(s, "snapshots")
    rows = docs(s, d).select(
        "doc_id", c("lang").alias("facility"), say("2024010", c("doc_id") % 3 + 1).alias("snapshot_ts"), "n_chars"
    )
    sinks.write_snapshots(rows, path)
    return s.read.schema("doc_id bigint, n_chars bigint, facility string, snapshot_ts string").parquet(path)


@query("publish_roundtrip", f"WITH {R.LISTING} SELECT listing_id, status, price FROM listing")
def publish_roundtrip(s, d):
    """A full refresh replaces what was published before."""
    path = _fresh(s, "published")
    rows = R.listings(s, d).select("listing_id", "status", "price")
    sinks.publish_files(rows.filter(c("status") == "available"), path)
    sinks.publish_files(rows, path)
    return s.read.parquet(path)


@query("rebuild_modes", f"""WITH {R.LISTING}
SELECT listing_id, status, CASE WHEN status = 'available' THEN price + 1 ELSE price END AS price FROM listing""")
def rebuild_modes(s, d):
    """A static rebuild, then an incremental one of a single partition."""
    path = _fresh(s, "rebuilt")
    rows = R.listings(s, d).select("listing_id", "status", "price")
    sinks.rebuild(rows, path, "status")
    sinks.rebuild(rows.filter(c("status") == "available").withColumn("price", c("price") + 1), path, "status", incremental=True)
    return s.read.parquet(path)
