"""Loading queries: dedupe, naming, overlay, upsert, soft delete."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import load as L, quality as Q
from ..session import dealt
from . import roles as R
from .registry import query

c = F.col
NOW = "2001-12-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# lineitem rows as snapshot rows, in a total order
ORDER = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag, l_linestatus"
ORDER_COLUMNS = ORDER.split(", ")
FIELDS = ["l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"]


def items(s, d):
    """Snapshot rows with a null external id planted in some."""
    return R.table(s, d, "lineitem").select(
        c("l_orderkey").alias("facility_id"),
        F.when(c("l_quantity") == 1, None).otherwise(c("l_linenumber").cast("string")).alias("external_id"),
        *ORDER_COLUMNS,
    )


ITEMS = "item AS (SELECT *, l_orderkey AS facility_id, CASE WHEN l_quantity <> 1 THEN CAST(l_linenumber AS VARCHAR) END AS external_id FROM lineitem)"
DEDUPED = f"""WITH {ITEMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY facility_id, external_id ORDER BY
  {', '.join(x + ' DESC' for x in ORDER_COLUMNS)}) AS rn FROM item WHERE external_id IS NOT NULL)"""


@query("batch_last_wins", f"""{DEDUPED}
SELECT facility_id, external_id, l_partkey, l_quantity, l_extendedprice FROM ranked WHERE rn = 1
UNION ALL SELECT facility_id, external_id, l_partkey, l_quantity, l_extendedprice FROM item WHERE external_id IS NULL""")
def batch_last_wins(s, d):
    return L.last_wins(items(s, d), ORDER_COLUMNS).select(
        "facility_id", "external_id", "l_partkey", "l_quantity", "l_extendedprice"
    )


def halves(s, d):
    """Two snapshots: older and newer shipments, one row per key each."""
    it = items(s, d)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return L.last_wins(it.filter(c("l_shipdate") < cut), ORDER_COLUMNS), L.last_wins(it.filter(c("l_shipdate") >= cut), ORDER_COLUMNS)


def target_of(rows, *more):
    """Snapshot rows as a loaded table."""
    return rows.select(
        *more,
        "facility_id", "external_id", c("l_returnflag").alias("animal_type"), c("l_partkey").alias("name"),
        c("l_extendedprice").alias("price"),
        F.when(c("l_linestatus") == "O", "available").otherwise("adopted").alias("status"),
        c("l_shipdate").cast("timestamp").alias("created_at"), c("l_shipdate").cast("timestamp").alias("updated_at"),
    )


def source_of(rows, *more):
    return target_of(rows, *more).drop("created_at", "updated_at")


SIDES = f"""WITH {ITEMS}, base AS (SELECT facility_id, external_id, {ORDER}, l_shipdate < TIMESTAMP '1998-01-01' AS old,
    row_number() OVER (PARTITION BY facility_id, external_id, l_shipdate < TIMESTAMP '1998-01-01' ORDER BY
    {', '.join(x + ' DESC' for x in ORDER_COLUMNS)}) AS rn FROM item),
one AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'available' ELSE 'adopted' END AS status FROM base WHERE rn = 1 OR external_id IS NULL),
t AS (SELECT * FROM one WHERE old), s AS (SELECT * FROM one WHERE NOT old)"""


@query("upsert_merge", f"""{SIDES}
SELECT coalesce(t.facility_id, s.facility_id) AS facility_id, coalesce(t.external_id, s.external_id) AS external_id,
  CASE WHEN t.facility_id IS NOT NULL THEN t.l_returnflag ELSE s.l_returnflag END AS animal_type,
  CASE WHEN s.facility_id IS NOT NULL THEN s.l_partkey ELSE t.l_partkey END AS name,
  CASE WHEN s.facility_id IS NOT NULL THEN s.l_extendedprice ELSE t.l_extendedprice END AS price,
  CASE WHEN s.facility_id IS NOT NULL THEN s.status ELSE t.status END AS status,
  strftime(CASE WHEN t.facility_id IS NOT NULL THEN t.l_shipdate ELSE TIMESTAMP '{NOW}' END, '%Y-%m-%d') AS created_at,
  strftime(CASE WHEN s.facility_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE t.l_shipdate END, '%Y-%m-%d') AS updated_at
FROM t FULL OUTER JOIN s ON t.facility_id = s.facility_id AND t.external_id = s.external_id""")
def upsert_merge(s, d):
    old, _ = halves(s, d)
    batch = items(s, d).filter(c("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    raw = source_of(batch, *[c(x).alias(f"_o{i}") for i, x in enumerate(ORDER_COLUMNS)])
    out = L.upsert(target_of(old), raw, now(), position=[f"_o{i}" for i in range(len(ORDER_COLUMNS))])
    return out.withColumns({x: F.date_format(x, "yyyy-MM-dd") for x in ("created_at", "updated_at")})


@query("upsert_classify", f"""{SIDES}
SELECT s.facility_id, s.external_id, s.l_partkey AS name, t.facility_id IS NULL AS is_new FROM s
LEFT JOIN t ON t.facility_id = s.facility_id AND t.external_id = s.external_id""")
def upsert_classify(s, d):
    old, new = halves(s, d)
    return L.classify_upsert(source_of(new), target_of(old)).select("facility_id", "external_id", "name", "is_new")


@query("mark_removed", f"""{SIDES}
SELECT t.facility_id, t.external_id, t.l_partkey AS name, CASE WHEN t.status = 'available' AND t.external_id IS NOT NULL
  AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = t.facility_id AND o_orderstatus <> 'P')
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.facility_id = t.facility_id AND s.external_id = t.external_id)
  THEN 'removed' ELSE t.status END AS status FROM t""")
def mark_removed(s, d):
    """Facilities in two of three states were scraped; some of those have no rows left."""
    old, new = halves(s, d)
    scraped = R.table(s, d, "orders").filter(c("o_orderstatus") != "P").select(c("o_orderkey").alias("facility_id"))
    out = L.mark_removed(target_of(old), source_of(new), scraped, now())
    return out.select("facility_id", "external_id", "name", "status")


@query("load_totals", f"""{SIDES}, o AS (SELECT s.facility_id % 20 AS grp, CASE WHEN s.external_id IS NULL THEN 'skipped_no_key'
    WHEN t.facility_id IS NULL THEN 'inserted' ELSE 'updated' END AS outcome FROM s
  LEFT JOIN t ON t.facility_id = s.facility_id AND t.external_id = s.external_id)
SELECT grp, count(*) AS total, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'skipped_no_key') AS skipped, CAST(0 AS BIGINT) AS errors FROM o GROUP BY grp""")
def load_totals(s, d):
    old, new = halves(s, d)
    rows = source_of(new).withColumns({
        "document_level": F.lit("high"), "needs_review": F.lit(False), "extraction_error": F.lit(False),
    })
    known = L.classify_upsert(L.gate(rows), target_of(old))
    done = F.when(c("outcome") != "loaded", c("outcome")).when(c("is_new"), "inserted").otherwise("updated")
    return L.load_totals(known.withColumn("outcome", done).withColumn("grp", c("facility_id") % 20), ["grp"])


@query("snapshot_diff", f"""{SIDES}
SELECT coalesce(t.facility_id, s.facility_id) AS facility_id, coalesce(t.external_id, s.external_id) AS external_id,
  CASE WHEN t.facility_id IS NULL THEN 'added' WHEN s.facility_id IS NULL THEN 'removed'
       WHEN s.l_returnflag = t.l_returnflag AND s.status = t.status THEN 'same' ELSE 'changed' END AS change
FROM (SELECT * FROM t WHERE external_id IS NOT NULL) t FULL OUTER JOIN (SELECT * FROM s WHERE external_id IS NOT NULL) s
  ON t.facility_id = s.facility_id AND t.external_id = s.external_id""")
def snapshot_diff(s, d):
    old, new = (source_of(x).filter(c("external_id").isNotNull()) for x in halves(s, d))
    return L.snapshot_diff(old, new, L.KEY, ["animal_type", "status"])


@query("overlay_enrich", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 1 THEN 'good' END ELSE d.lang END AS lang,
  coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, d.source) AS source,
  CASE WHEN l.doc_id IS NOT NULL THEN 'high' ELSE 'low' END AS confidence_level, l.doc_id IS NULL AS needs_review
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def overlay_enrich(s, d):
    rows = R.table(s, d, "documents").select(
        "doc_id", "lang", "source", F.lit("low").alias("confidence_level"), F.lit(True).alias("needs_review")
    )
    found = R.table(s, d, "labels").select(
        "doc_id", F.when(c("quality") == 1, "good").alias("lang"), F.when(c("toxic") == 1, "toxic").alias("source")
    )
    return L.overlay(rows, found, "doc_id", ["lang"], ["source"], {"confidence_level": "high", "needs_review": False})


@query("unique_names", """
SELECT p_partkey, p_brand, p_name || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS unique_name
FROM part WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_partkey)""")
def unique_names(s, d):
    rows = R.table(s, d, "part").select("p_partkey", "p_brand", c("p_name").alias("name"))
    return L.unique_names(rows, "p_brand", "name", "p_partkey").select("p_partkey", "p_brand", "unique_name")


@query("unique_names_contested", """
WITH RECURSIVE named AS (SELECT p_partkey, p_brand, p_name || CASE p_partkey % 5 WHEN 1 THEN '-2' WHEN 2 THEN '-3' ELSE '' END AS name,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
step AS (
  SELECT p_brand, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS p_partkey, CAST(NULL AS VARCHAR) AS name,
    CAST(NULL AS VARCHAR) AS unique_name FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL
  SELECT p_brand, i, list_append(taken, u), p_partkey, name, u FROM (
    SELECT s.p_brand, n.i, s.taken, n.p_partkey, n.name, CASE WHEN NOT list_contains(s.taken, n.name) THEN n.name
      ELSE n.name || '-' || list_filter(range(2, len(s.taken) + 3), lambda k: NOT list_contains(s.taken, n.name || '-' || k))[1] END AS u
    FROM step s JOIN named n ON n.p_brand = s.p_brand AND n.i = s.i + 1))
SELECT p_partkey, p_brand, name, unique_name FROM step WHERE i > 0""")
def unique_names_contested(s, d):
    """Some names already end in a number that another name's suffix may take."""
    n = c("p_partkey") % 5
    name = F.when(n == 1, F.concat(c("p_name"), F.lit("-2"))).when(n == 2, F.concat(c("p_name"), F.lit("-3"))).otherwise(c("p_name"))
    rows = R.table(s, d, "part").select("p_partkey", "p_brand", name.alias("name"))
    return L.unique_names(rows, "p_brand", "name", "p_partkey").select("p_partkey", "p_brand", "name", "unique_name")


@query("first_seen", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
SELECT source, line, min(doc_id) AS doc_id, arg_min(no - 1, (doc_id, no)) AS line_no FROM l JOIN (SELECT doc_id, source FROM documents) USING (doc_id)
GROUP BY source, line""")
def first_seen(s, d):
    rows = R.table(s, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return L.first_seen(rows, ["source", "line"], ["doc_id", "line_no"])


@query("preference_dedupe", f"""WITH {R.LISTING}
SELECT facility_id, arg_min(listing_id, (CASE WHEN animal_type = 'cat' THEN 0 ELSE 1 END, listing_id)) AS listing_id,
  arg_min(animal_type, (CASE WHEN animal_type = 'cat' THEN 0 ELSE 1 END, listing_id)) AS animal_type FROM listing GROUP BY facility_id""")
def preference_dedupe(s, d):
    rows = R.listings(s, d).select("facility_id", "listing_id", "animal_type")
    return L.preferred(rows, ["facility_id"], c("animal_type") == "cat", ["listing_id"])


@query("review_gate", """
SELECT d.doc_id, CASE WHEN d.source = 'src3' THEN 'rejected_document' WHEN d.n_chars < 300 THEN 'skipped_error'
  WHEN d.lang = 'de' THEN 'skipped_no_key' WHEN coalesce(l.toxic = 1, false) THEN 'skipped_review' ELSE 'loaded' END AS outcome,
  CASE WHEN d.n_chars < 300 THEN 'skipped_error' ELSE 'loaded' END AS outcome_override
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def review_gate(s, d):
    rows = R.table(s, d, "documents").join(R.table(s, d, "labels"), "doc_id", "left").select(
        "doc_id", F.when(c("source") == "src3", "critical").otherwise("high").alias("document_level"),
        F.when(c("lang") != "de", c("doc_id").cast("string")).alias("external_id"),
        (c("toxic") == 1).alias("needs_review"), (c("n_chars") < 300).alias("extraction_error"),
    )
    strict = L.gate(rows)
    return L.gate(strict.withColumnRenamed("outcome", "strict"), override=True).select(
        "doc_id", c("strict").alias("outcome"), c("outcome").alias("outcome_override")
    )


@query("snapshot_stats", """
SELECT l_suppkey AS facility_id, count(*) AS containers, count(*) FILTER (l_quantity > 2) AS valid, count(*) FILTER (l_quantity <= 2) AS errors,
  count(*) FILTER (l_returnflag = 'A') AS dogs, count(*) FILTER (l_returnflag = 'N') AS cats FROM lineitem GROUP BY 1""")
def snapshot_stats(s, d):
    rows = R.table(s, d, "lineitem").select(
        c("l_suppkey").alias("facility_id"), (c("l_quantity") <= 2).alias("extraction_error"),
        F.when(c("l_returnflag") == "A", "dog").when(c("l_returnflag") == "N", "cat").alias("animal_type"),
    )
    return Q.snapshot_stats(rows, ["facility_id"])


def scraped(s, d):
    """Rows of ``part`` as pages of three facilities with two animals each, and the listing table that a load meets."""
    k, even = c("p_partkey").cast("string"), c("p_size") % 2 == 0
    say = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    sex = [F.when(even, "オス").otherwise("メス"), F.when(even, "メス").otherwise("オス")]
    second = F.when(c("p_partkey") % 7 == 0, "1").otherwise("2")

    def card(i, number, name):
        named = say("<tr><th>仮名</th><td>", name, "</td></tr>") if name is not None else ""
        return say('<div class="tab-animal-card"><img src="', k, f'-{i}.jpg"><table><tr><th>管理番号</th><td>K', k, "-", number, "</td></tr>", named,
                   "<tr><th>種類</th><td>", F.when(even, "猫").otherwise("犬"), "</td></tr><tr><th>性別</th><td>", sex[i - 1], "</td></tr></table></div>")

    cards = say(card(1, "1", c("p_brand")), "<p>間</p>", card(2, second, None))
    row = lambda i, number: say('<figure><img src="', k, f'-{i}.jpg"></figure><table><caption>', number, "</caption><tr><th>種類</th></tr><tr><td>雑種</td><td>黒</td><td>", sex[i - 1], "</td></tr></table>")
    tables = say(row(1, say("動物番号：K", k)), row(2, "番号なし"))
    # no picture, no sex and too many ages: the whole snapshot is rejected
    bad = lambda i: say('<div class="tab-animal-card"><table><tr><th>管理番号</th><td>X', k, f"-{i}</td></tr><tr><th>推定年齢</th><td>生後3歳</td></tr></table></div>")
    n = c("p_partkey") % 3
    # each small row becomes a page
    pages = dealt(R.table(s, d, "part"), "p_partkey").select(
        n.alias("facility_id"), c("p_partkey").alias("page_no"), F.lit("https://x.example/a/list.html").alias("url"),
        F.when(n == 1, "ishikawa/kanazawa-city-cats").otherwise("kochi/kochi-pref").alias("facility"),
        say("<html><body>", F.when(n == 0, cards).when(n == 1, tables).otherwise(say(bad(1), bad(2))), "</body></html>").alias("html"),
    )
    old = F.lit("2024-01-01 00:00:00").cast("timestamp")
    part = R.table(s, d, "part")
    known = part.filter("p_partkey % 4 = 0").select(
        n.alias("facility_id"), F.when(n == 0, say("kochi-pref-k", k, "-1")).when(n == 1, say("K", k)).otherwise(say("x", k)).alias("external_id"), F.lit("available").alias("status"))
    gone = part.filter("p_partkey % 5 = 0").select(
        (c("p_partkey") % 4).alias("facility_id"), say("gone-", k).alias("external_id"), F.when(c("p_partkey") % 2 == 0, "available").otherwise("adopted").alias("status"))
    table = known.unionByName(gone).select(
        "*", F.lit("unknown").alias("animal_type"), F.lit("old").alias("name"), F.lit(None).cast("string").alias("gender"), F.lit(None).cast("array<string>").alias("images"),
        old.alias("last_scraped_at"), old.alias("created_at"), old.alias("updated_at"))
    return pages, table


SCRAPED = """WITH card AS (
  SELECT p_partkey % 3 AS facility_id, p_partkey AS page_no, i, CASE p_partkey % 3 WHEN 0 THEN 'kochi-pref-k' || p_partkey || '-' || CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE i END
      WHEN 1 THEN CASE i WHEN 1 THEN 'K' || p_partkey ELSE 'kanazawa_2' END ELSE 'kochi-pref-x' || p_partkey || '-' || i END AS external_id,
    CASE WHEN p_partkey % 3 = 0 AND i = 1 THEN p_brand END AS given, CASE WHEN p_partkey % 3 = 1 OR p_size % 2 = 0 THEN 'cat' ELSE 'dog' END AS kind,
    CASE WHEN (p_size + i) % 2 = 1 THEN 'male' ELSE 'female' END AS gender,
    CASE WHEN p_partkey % 3 = 2 THEN 'rejected_document' WHEN p_partkey % 3 = 1 AND i = 2 THEN 'skipped_review'
      WHEN p_partkey % 3 = 0 AND p_partkey % 7 = 0 AND i = 1 THEN 'superseded' ELSE 'loaded' END AS outcome
  FROM part, (VALUES (1), (2)) t(i)),
named AS (SELECT *, coalesce(given, CASE kind WHEN 'cat' THEN '保護猫' ELSE '保護犬' END || external_id) AS base FROM card WHERE outcome = 'loaded'),
fresh AS (SELECT *, base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS name FROM named
  WINDOW w AS (PARTITION BY facility_id, base ORDER BY page_no, i)),
known AS (
  SELECT p_partkey % 3 AS facility_id, CASE p_partkey % 3 WHEN 0 THEN 'kochi-pref-k' || p_partkey || '-1' WHEN 1 THEN 'K' || p_partkey ELSE 'x' || p_partkey END AS external_id,
    'available' AS status FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey % 4, 'gone-' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'available' ELSE 'adopted' END FROM part WHERE p_partkey % 5 = 0),
after AS (
  SELECT coalesce(k.facility_id, f.facility_id) AS facility_id, coalesce(k.external_id, f.external_id) AS external_id, coalesce(f.name, 'old') AS name,
    CASE WHEN k.facility_id IS NULL THEN f.kind ELSE 'unknown' END AS animal_type, f.gender,
    CASE WHEN f.facility_id IS NOT NULL THEN 'available' WHEN k.facility_id < 2 AND k.status = 'available' THEN 'removed' ELSE k.status END AS status,
    k.facility_id IS NULL AS is_new FROM known k FULL OUTER JOIN fresh f ON k.facility_id = f.facility_id AND k.external_id = f.external_id)"""


def loaded(s, d):
    from ..operators import ingest
    from ..sources import layouts

    pages, table = scraped(s, d)
    return ingest.from_pages(pages, layouts.catalogue(s), table, now())


@query("ingest_pages", f"""{SCRAPED}
SELECT *, is_new OR status = 'removed' OR name <> 'old' AS touched FROM after""")
def ingest_pages(s, d):
    """Pages to the listing table: extraction, cross-check, gate, names, upsert, soft delete."""
    return loaded(s, d).table.select(
        "facility_id", "external_id", "name", "animal_type", "gender", "status", (c("created_at") == now()).alias("is_new"), (c("updated_at") == now()).alias("touched"))


@query("ingest_runs", f"""{SCRAPED},
o AS (SELECT c.facility_id, count(*) AS n, count(*) FILTER (outcome IN ('loaded', 'superseded') AND k.facility_id IS NOT NULL OR outcome = 'superseded') AS updated,
    count(*) FILTER (outcome = 'loaded' AND k.facility_id IS NULL) AS added
  FROM card c LEFT JOIN known k ON k.facility_id = c.facility_id AND k.external_id = c.external_id GROUP BY 1),
r AS (SELECT facility_id, count(*) AS removed FROM after WHERE status = 'removed' GROUP BY 1)
SELECT o.facility_id, n AS html_count, n AS yaml_count, updated + added AS db_count, added, updated, coalesce(removed, 0) AS removed,
  CASE WHEN updated + added < n THEN 'mismatch' ELSE 'success' END AS status, CASE o.facility_id WHEN 2 THEN 'critical' ELSE 'high' END AS document_level
FROM o LEFT JOIN r ON r.facility_id = o.facility_id""")
def ingest_runs(s, d):
    """The ledger rows of the same load."""
    return loaded(s, d).runs.select("facility_id", "html_count", "yaml_count", "db_count", "added", "updated", "removed", "status", "document_level")
