"""Operators on small frames, against brute force where order matters."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from foundling.operators import load as L, monitor as M, ordered as O, search as S, stats
from foundling.operators.containment import contains_join
from foundling.sources import snapshots as N


def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")



# ---- ordered operators: small chunks must not show --------------------------------

@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice([None, i, -i])) for k in ("hot", "cold", None) for i in range(200 if k == "hot" else 7)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, pos int, v int").repartition(5).cache()


def brute(rows, key):
    return sorted((r for r in rows if r[0] == key), key=lambda r: r[1])


@pytest.mark.parametrize("how", ["fixed", "ordered"])
def test_chunked_windows(series, how):
    rows, df = series
    cut = lambda: O.fixed_chunks(df, "pos", 13) if how == "fixed" else O.ordered_chunks(df, ["k"], ["pos"], rows_per_chunk=20)
    num = {(r["k"], r["pos"]): r["rn"] for r in O.row_numbers(cut(), ["k"], [F.col("pos")]).collect()}
    lag = {(r["k"], r["pos"]): r["prev"] for r in O.previous_row(cut(), ["k"], ["pos"], F.col("v")).collect()}
    last = {(r["k"], r["pos"]): r["last"] for r in O.last_seen(cut(), ["k"], ["pos"], F.col("v")).collect()}
    before = {(r["k"], r["pos"]): r["last"] for r in O.last_seen(cut(), ["k"], ["pos"], F.col("v"), current=False).collect()}
    total = {(r["k"], r["pos"]): r["total"] for r in O.running_sum(cut(), ["k"], ["pos"], F.col("v")).collect()}
    assert len(num) == len(rows)
    for key in ("hot", "cold", None):
        prev = seen = None
        running = 0
        for i, (_, pos, v) in enumerate(brute(rows, key)):
            at = (key, pos)
            assert before[at] == seen
            seen = v if v is not None else seen
            running += v or 0
            assert (num[at], lag[at], last[at], total[at]) == (i + 1, prev, seen, running)
            prev = v


def test_chunks_of_one_key_and_time(spark):
    """One key, one time stamp, ties decided by text: no chunk far over the limit, and the numbers are those of one window."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.lit(1).alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("tie"))
    cut = O.ordered_chunks(df, ["k"], ["ts", "tie"], rows_per_chunk=500)
    sizes = [r["count"] for r in cut.groupBy(O.CHUNK).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 20 and max(sizes) < 2_500
    got = [r["tie"] for r in O.row_numbers(cut, ["k"], [F.col("ts"), F.col("tie")]).orderBy("rn").collect()]
    assert got == sorted(got) and len(got) == 20_000


# ---- unique names ---------------------------------------------------------------------

def one_by_one(rows):
    taken, out = {}, {}
    for group, pos, name in sorted(rows, key=lambda r: (r[0], r[1])):
        used, chosen, n = taken.setdefault(group, set()), name, 2
        while chosen in used:
            chosen, n = f"{name}-{n}", n + 1
        used.add(chosen)
        out[group, pos] = chosen
    return out


@pytest.mark.parametrize("seed", range(6))
def test_unique_names_as_if_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = ["A", "A-2", "A-3", "A-2-2", "A-02", "B", "B-2", "A-4", "A-2-3", "B-1", "C"]
    rows = [(g, i, rng.choice(names)) for g in range(12) for i in range(rng.choice([3, 12, 40]))]
    df = spark.createDataFrame(rows, "facility_id int, position int, name string")
    got = {(r["facility_id"], r["position"]): r["unique_name"] for r in L.unique_names(df, chunk=5).collect()}
    assert got == one_by_one(rows)


def test_unique_names_known_case(spark):
    df = spark.createDataFrame([(1, 0, "A"), (1, 1, "A"), (1, 2, "A-2")], "facility_id int, position int, name string")
    assert [r["unique_name"] for r in L.unique_names(df).orderBy("position").collect()] == ["A", "A-2", "A-2-2"]


# ---- containment ------------------------------------------------------------------------

@pytest.mark.parametrize("few", [0, 64])
def test_contains_join_is_exact(spark, monkeypatch, few):
    import foundling.operators.containment as C

    monkeypatch.setattr(C, "FEW_SHORT", few)
    rng = random.Random(3)
    vocabulary = ["ab", "abc", "b", "猫", "猫犬", "No.12", "12", "x\ny"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(60)]
    needles = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 7)))) for i in range(40)]
    needles += [(100 + i, t[3:3 + n]) for i, (_, t) in enumerate(texts) for n in (1, 2, 9, 30) if len(t) > 3 + n and i % 4 == n % 4]
    needles = list({k: (k, v) for k, v in needles}.values()) + [(999, "")]
    got = contains_join(
        spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(needles, "n int, needle string"), "t", "text", "n", "needle"
    )
    rows = [(r["t"], r["n"]) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(t, n) for t, text in texts for n, v in needles if v and v in text}


def test_contains_join_within_a_page(spark):
    texts = spark.createDataFrame([(1, "p", "写真 26-0001 です"), (2, "q", "写真 26-0001 です")], "t int, page string, text string")
    ids = spark.createDataFrame([(7, "p", "26-0001"), (8, "q", "26-0002")], "n int, page string, id string")
    assert [tuple(r) for r in contains_join(texts, ids, "t", "text", "n", "id", within=["page"]).collect()] == [(1, 7)]


# ---- loading ------------------------------------------------------------------------------

TARGET = "facility_id int, external_id string, animal_type string, name string, status string, created_at timestamp, updated_at timestamp"
OLD = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, "a", "cat", "A", "available", OLD, OLD), (1, "b", "cat", "B", "available", OLD, OLD), (1, "c", "dog", "C", "adopted", OLD, OLD),
         (2, "a", "dog", "D", "available", OLD, OLD), (3, "z", "dog", "Z", "available", OLD, OLD), (1, None, "cat", "N", "available", OLD, OLD)], TARGET)


def source(spark, rows):
    return spark.createDataFrame(rows, "facility_id int, external_id string, animal_type string, name string, status string")


def test_upsert(spark, table):
    s = source(spark, [(1, "a", "dog", None, "pending"), (1, "n", "dog", "New", "available"), (1, None, "cat", "Loose", "available")])
    got = {(r["facility_id"], r["external_id"], r["name"]): r for r in L.upsert(table, s, now()).collect()}
    assert len(got) == 8
    hit = got[1, "a", None]
    assert (hit["animal_type"], hit["status"], hit["created_at"], hit["updated_at"].year) == ("cat", "pending", OLD, 2025)
    assert got[1, "n", "New"]["animal_type"] == "dog" and got[1, "n", "New"]["created_at"].year == 2025
    assert got[1, "b", "B"]["updated_at"] == OLD and (1, None, "N") in got and (1, None, "Loose") in got


def test_upsert_twice_changes_nothing(spark, table):
    s = source(spark, [(1, "a", "dog", "X", "pending"), (5, "q", "dog", "Q", "available")])
    once = L.upsert(table, s, now())
    twice = L.upsert(once, s, now())
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))


def test_mark_removed(spark, table):
    current = spark.createDataFrame([(1, "a")], "facility_id int, external_id string")
    scraped = spark.createDataFrame([(1,), (2,)], "facility_id int")
    got = {(r["facility_id"], r["external_id"]): r["status"] for r in L.mark_removed(table, current, scraped, now()).collect()}
    assert got == {(1, "a"): "available", (1, "b"): "removed", (1, "c"): "adopted", (2, "a"): "removed", (3, "z"): "available", (1, None): "available"}


def test_mark_removed_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_PER_TASK", 50)
    rows = spark.range(1_000).selectExpr(
        "cast(if(id < 600, 1, id) as int) AS facility_id", "cast(id as string) AS external_id", "'cat' AS animal_type", "'A' AS name",
        "'available' AS status", "timestamp'2024-01-01' AS created_at", "timestamp'2024-01-01' AS updated_at")
    current = rows.filter("external_id % 3 = 0").select("facility_id", "external_id")
    scraped = rows.filter("facility_id < 800").select("facility_id")
    out = L.mark_removed(rows, current, scraped, now())
    got = {int(r["external_id"]): r["status"] for r in out.collect()}
    assert got == {i: "removed" if i < 800 and i % 3 else "available" for i in range(1_000)}
    changed = out.filter("status IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in changed) < 200  # facility 1 has 600 rows


def test_last_wins_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 2), (1, "a", 1), (1, None, 3), (1, None, 4)], "facility_id int, external_id string, position int")
    assert sorted(map(repr, (tuple(r) for r in L.last_wins(df, ["position"]).collect()))) == ["(1, 'a', 2)", "(1, None, 3)", "(1, None, 4)"]


# ---- monitoring ------------------------------------------------------------------------------

def ledger(spark, **series):
    """Runs given newest first as (count, status) or a count."""
    rows = []
    for name, runs in series.items():
        for i, r in enumerate(runs):
            n, status = r if isinstance(r, tuple) else (r, "success" if r else "empty")
            ts = datetime.datetime(2025, 1, 31) - datetime.timedelta(days=i)
            rows.append((1000 - i, name, ts, status, n, n, n, "boom" if status == "error" else None, "lost" if status == "mismatch" else None, 5))
    return spark.createDataFrame(
        rows, "run_id int, scraper_id string, ts timestamp, status string, html_count int, yaml_count int, db_count int, "
              "error_message string, warning string, duration_ms bigint")


def test_anomaly_rules(spark):
    runs = ledger(
        spark, zeros=[0, 0, 0, 5], broken=[0, 0, (0, "error"), 0], drop=[4, 10], half=[5, 10], lone=[(0, "error")], errors=[3, (0, "error"), (0, "error"), 3],
        mismatch=[(3, "mismatch"), 3], old=[5] * 5 + [(0, "error")] * 9,
    )
    found = {}
    for r in M.anomalies(runs).collect():
        found.setdefault(r["scraper_id"], set()).add(r["type"])
    assert found == {"zeros": {"consecutive_zero"}, "drop": {"sudden_drop"}, "lone": {"latest_error"}, "errors": {"high_error_rate"}, "mismatch": {"mismatch"}}


def test_rollup_registers_unknown_and_idle(spark):
    reg = spark.createDataFrame([("idle",), ("a",)], "scraper_id string")
    got = {r["scraper_id"]: r for r in M.rollup(ledger(spark, a=[1, (0, "error")], b=[0]), reg).collect()}
    assert (got["idle"]["total_runs"], got["idle"]["verified"]) == (0, False)
    assert (got["a"]["success_count"], got["a"]["error_count"], got["a"]["last_error_message"], got["a"]["verified"]) == (1, 1, "boom", True)
    assert (got["b"]["success_count"], got["b"]["verified"]) == (1, False)


def test_carry_forward_with_hot_scraper(spark):
    counts = [3, 0, 7, 0, 0, 2] * 30
    got = M.carry_forward(ledger(spark, hot=counts, cold=[1]), rows_per_chunk=10).filter("scraper_id = 'hot'").orderBy("ts").collect()
    assert [r["inherited_yaml_count"] for r in got] == [None] + [n or None for n in counts[::-1][:-1]]


# ---- search and statistics -------------------------------------------------------------------

def test_request_defaults_and_clamps():
    p = S.SearchParams.from_request({"limit": "500", "urgency_days": "0", "region_id": "0", "traits": "a, b,"})
    assert (p.animal_type, p.status, p.limit, p.urgency_days, p.traits, p.offset) == ("cat", "available", 100, 0, ("a", "b"), 0)
    assert S.SearchParams.from_request({"limit": "0"}).limit == 20


def test_wildcards_are_plain_signs(spark):
    df = spark.createDataFrame([("100%",), ("100x",), (None,)], "name string")
    assert [r[0] for r in df.filter(S.keyword_match(["name"], "0%")).collect()] == ["100%"]


def test_pages_join_to_the_full_order(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else datetime.date(2025, 1, 1 + i % 7)) for i in range(47)], "k int, deadline_date date")
    full = [r["k"] for r in df.orderBy(F.col("deadline_date").asc_nulls_first(), "k").collect()]
    paged = [r["k"] for n in range(1, 6) for r in S.page(df, S.SearchParams().page(n, 10), "k").collect()]
    assert paged == full
    keyset, last = [], None
    while True:
        got = (S.page(df, S.SearchParams(limit=10), "k") if last is None else S.page_after(df, S.SearchParams(limit=10), "k", *last)).collect()
        if not got:
            break
        keyset += [r["k"] for r in got]
        last = (got[-1]["deadline_date"], got[-1]["k"])
    assert keyset == full


def test_urgency_counts_are_cumulative(spark):
    d = lambda n: datetime.date(2025, 6, 15) + datetime.timedelta(days=n)
    rows = [("available", d(n), "cat", False) for n in (-1, 0, 3, 4, 7, 8, 14, 15)] + [("adopted", d(0), "dog", True), ("available", None, "dog", None)]
    df = spark.createDataFrame(rows, "status string, deadline_date date, animal_type string, transfer_decided boolean")
    r = stats.totals(df, F.lit("2025-06-15").cast("timestamp")).collect()[0]
    assert (r["urgent"], r["warning"], r["caution"], r["total"], r["transfer_decided"]) == (3, 5, 7, 10, 1)


# ---- sources ----------------------------------------------------------------------------------

def test_yaml_shapes(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("meta: {municipality: x, total_count: 2}\nanimals:\n  - {external_id: '1', images: [u, {url: v}]}\n  - {external_id: '2'}\n")
    (tmp_path / "b.yaml").write_text("- {external_id: '1'}\n")
    (tmp_path / "c.yaml").write_text("metadata: {}\nanimals: []\n")
    (tmp_path / "d.yaml").write_text("source: x\ncats: []\n")
    (tmp_path / "e.yaml").write_text("a: [1\n")
    files = N.yaml_to_json(N.read_text(spark, str(tmp_path), "*.yaml"))
    parsed = N.envelopes(files)
    shapes = {r["path"][-6:-5]: r["problem"] for r in parsed.collect()}
    assert shapes == {"a": None, "b": "bare_list", "c": "metadata_key", "d": "source_list", "e": "unparsable"}
    animals = N.explode_animals(N.loadable(parsed), ["path"]).orderBy("position").collect()
    assert [r["external_id"] for r in animals] == ["1", "2"]
    assert animals[0]["images"] == ["u", '{"url":"v"}']


def test_batches_prefer_pages(spark):
    names = ["20250101_000000_page1.html", "20250101_000000_page2.html", "20250201_000000.html", "20241201_000000_page1.html"]
    df = spark.createDataFrame([("f", n) for n in names] + [("g", "20250101_000000.html"), ("g", "20250102_000000.html")], "facility string, path string")
    got = N.batch(df.select("facility", "path", *N.capture_parts("path")), "facility")
    assert sorted(r["path"] for r in got.collect()) == ["20250101_000000_page1.html", "20250101_000000_page2.html", "20250102_000000.html"]


def test_mark_without_state_keeps_all(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9)], "k int, posted int")
    none = spark.createDataFrame([], "mark int")
    assert N.since_mark(rows, none, "posted", "mark").count() == 2
    assert N.since_mark(rows, spark.createDataFrame([(9,)], "mark int"), "posted", "mark").count() == 1


def test_urgent_gives_as_many_as_asked(spark):
    from datetime import date

    from pyspark.sql import functions as F

    from foundling.operators import search

    rows = spark.range(200).select(F.col("id").alias("listing_id"), F.lit("available").alias("status"), F.lit(date(2030, 1, 1)).alias("deadline_date"))
    as_of = F.lit("2029-12-31").cast("timestamp")
    assert search.urgent(rows, as_of, limit=120).count() == 120
    assert search.urgent(rows, as_of, limit=120, cap=50).count() == 50


def test_suffixes_of_many_digits_are_contested():
    import re

    from foundling.operators.load import SUFFIX

    assert re.match(SUFFIX, "x-12345678901234").group(2) == "12345678901234"


def test_no_default_limits(spark):
    """More than each old cap: 50 runs, 1,000 listings of a feed, 2,000 signs of a section."""
    from foundling.functions.records import keyword_sections
    from foundling.operators import monitor
    from foundling.sources import sinks

    runs = spark.range(70).select(F.col("id").alias("run_id"), (F.col("id") % 3).alias("facility_id"), F.col("id").cast("timestamp").alias("ts"))
    facilities = spark.range(3).select(F.col("id").alias("facility_id"), F.lit("f").alias("facility_name"))
    assert monitor.newest_runs(runs, facilities).count() == 70 and monitor.newest_runs(runs, facilities, limit=50).count() == 50
    listings = spark.range(1200).select(F.col("id").cast("string").alias("key"), F.lit("available").alias("status"), F.col("id").cast("timestamp").alias("at"))
    assert sinks.feed(listings, "key", "at").count() == 1200 + len(sinks.FEED_STATIC)
    long = spark.range(1).select(keyword_sections(F.concat(F.lit("cat "), F.repeat(F.lit("x"), 5000)), ["cat"]).alias("s")).first().s
    assert len(long) == 1 and len(long[0]) == 5004


@pytest.mark.parametrize("few", [0, 200_000])
def test_needles_with_a_common_beginning(spark, monkeypatch, few):
    """A thousand needles of one beginning: each is anchored where it differs, so that few candidates meet."""
    from foundling.operators import containment

    monkeypatch.setattr(containment, "BROADCAST_ANCHORS", few)
    start = "all of them begin with the same long phrase and only then comes"
    needles = spark.createDataFrame([(i, f"{start} word{i} which is the end") for i in range(1000)], "n long, needle string")
    texts = spark.createDataFrame([(i, f"x{i} {start} word{i * 7} which is the end of it" if i % 2 else f"{start} nothing") for i in range(200)], "t long, text string")
    found = {(r.t, r.n) for r in containment.contains_join(texts, needles, "t", "text", "n", "needle").collect()}
    assert found == {(i, i * 7) for i in range(200) if i % 2 and i * 7 < 1000}
    anchored = containment.anchors(needles, "n", "needle")
    assert anchored.groupBy("_mode", "_h").count().agg(F.max("count")).first()[0] == 1
    runs = texts.select("t", F.explode(containment._runs(F.col("text"), 4)).alias("r")).select("t", F.col("r._h").alias("_h"))
    assert runs.join(anchored, "_h").count() <= 2 * len(found)
