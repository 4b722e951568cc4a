"""The whole load on a small table."""

import datetime

import pytest
from pyspark.sql import functions as F

from foundling.operators import extract, ingest

OLD = datetime.datetime(2024, 1, 1)
ROW = (
    "facility_id int, position int, document_level string, external_id string, animal_type string, name string, breed string, "
    "age_estimate string, gender string, color string, size string, health_status string, personality string, special_needs string, "
    "images array<string>, protection_date string, deadline_date string, status string, source_url string, listing_type string, "
    "needs_review boolean, extraction_error boolean"
)


def row(facility, position, key, name="タマ", kind="cat", level="high", review=False, error=None, images=None):
    return (facility, position, level, key, kind, name, None, None, None, None, None, None, None, None, images, None, None, "", None, None, review, error)


@pytest.fixture(scope="module")
def state(spark):
    rows = spark.createDataFrame([
        row(1, 0, "a", images=["u", '{"url":"v"}']), row(1, 1, "b"), row(1, 2, None), row(1, 3, "c", review=True), row(1, 4, "d", error=True),
        row(1, 5, "b", name=None), row(1, 6, "e", name="保護動物3号", kind=None), row(1, 7, "f"), row(2, 0, "a", level="critical"), row(3, 0, "a"),
    ], ROW)
    table = spark.createDataFrame(
        [(1, "a", "dog", "旧名", None, "available", OLD, OLD, OLD), (9, "z", "dog", "Z", ["i"], "available", OLD, OLD, OLD)],
        "facility_id int, external_id string, animal_type string, name string, images array<string>, status string, "
        "last_scraped_at timestamp, created_at timestamp, updated_at timestamp",
    )
    return rows, table, F.lit("2025-01-01 00:00:00").cast("timestamp")


def test_merge(state):
    rows, table, now = state
    got = {(r["facility_id"], r["external_id"]): r for r in ingest.merge(ingest.prepare(rows), table, now).collect()}
    assert {k: r["name"] for k, r in got.items()} == {
        (1, "a"): "タマ", (1, "b"): "保護猫b", (1, "e"): "保護動物e", (1, "f"): "タマ-2", (3, "a"): "タマ", (9, "z"): "Z",
    }
    a = got[1, "a"]
    assert (a["animal_type"], a["images"], a["status"], a["created_at"], a["last_scraped_at"].year) == ("dog", ["u", "v"], "available", OLD, 2025)


def test_outcomes_and_run_rows(spark, state):
    rows, table, now = state
    done = ingest.outcomes(ingest.prepare(rows), table)
    got = sorted((r["facility_id"], r["position"], r["outcome"]) for r in done.collect())
    assert got == [
        (1, 0, "updated"), (1, 1, "updated"), (1, 2, "skipped_no_key"), (1, 3, "skipped_review"), (1, 4, "skipped_error"),
        (1, 5, "inserted"), (1, 6, "inserted"), (1, 7, "inserted"), (2, 0, "rejected_document"), (3, 0, "inserted"),
    ]
    found = spark.createDataFrame([(1, 8), (3, 1), (4, 0)], "facility_id int, html_count int")
    runs = {r["facility_id"]: (r["status"], r["html_count"], r["yaml_count"], r["db_count"]) for r in ingest.run_rows(done, found, now).collect()}
    assert runs == {1: ("mismatch", 8, 8, 5), 2: ("mismatch", 0, 1, 0), 3: ("success", 1, 1, 1), 4: ("empty", 0, 0, 0)}


def test_text_fallback(spark):
    pages = spark.createDataFrame([
        (1, "u", "<p>かわいい猫のオスです。推定2歳、健康で元気いっぱいの白い子です。</p>"), (2, "u", "<p>猫がいます。とてもとても長い文章が続きます。</p>"),
    ], "page_id int, url string, html string")
    got = extract.text_fallback(pages, spark.createDataFrame([(2,)], "page_id int")).collect()
    assert [(r["page_id"], r["animal_type"], r["gender"], r["age_estimate"], r["color"], r["needs_review"]) for r in got] == [(1, "cat", "male", "2歳", "白", True)]


CARD = '<div class="tab-animal-card"><img src="{n}.jpg"><table><tr><th>管理番号</th><td>{n}</td></tr><tr><th>仮名</th><td>{name}</td></tr><tr><th>種類</th><td>猫</td></tr><tr><th>性別</th><td>オス</td></tr></table></div>'
PAGE = "facility_id int, facility string, page_no int, url string, html string, note string"
LISTED = "facility_id int, external_id string, animal_type string, name string, status string, created_at timestamp, updated_at timestamp"


def load(spark, pages, listed, **more):
    from foundling.sources import layouts

    return ingest.from_pages(spark.createDataFrame(pages, PAGE), layouts.catalogue(spark), spark.createDataFrame(listed, LISTED), F.lit("2025-01-01 00:00:00").cast("timestamp"), **more)


def test_pages_to_ledger(spark):
    """A facility of many pages in small chunks, one without records, one rejected, one without a layout, one not scraped."""
    pages = [(1, "kochi/kochi-pref", i, "https://k.jp/l.html", CARD.format(n=f"A{i}", name="タマ"), None) for i in range(40)]
    pages += [(2, "kochi/kochi-pref", 0, "https://k.jp/l.html", "<p>ただいま募集はありません</p>", None), (4, "no/such", 0, "https://k.jp", CARD.format(n="Q", name="x"), None)]
    pages += [(3, "kochi/kochi-pref", i, "https://k.jp", f'<div class="tab-animal-card"><table><tr><th>管理番号</th><td>B{i}</td></tr><tr><th>年齢</th><td>生後3歳</td></tr></table></div>', None) for i in range(4)]
    listed = [(f, "old", "cat", "Old", "available", OLD, OLD) for f in (1, 2, 3, 4, 5)] + [(1, "kochi-pref-a3", "dog", "Three", "available", OLD, OLD), (1, None, "dog", "N", "available", OLD, OLD)]
    got = load(spark, pages, listed, rows_per_chunk=7)
    table = {(r["facility_id"], r["external_id"]): r for r in got.table.collect()}
    assert {f: table[f, "old"]["status"] for f in (1, 2, 3, 4, 5)} == {1: "removed", 2: "removed", 3: "available", 4: "available", 5: "available"}
    assert [table[1, f"kochi-pref-a{i}"]["name"] for i in range(40)] == ["タマ"] + [f"タマ-{i}" for i in range(2, 41)]
    assert table[1, "kochi-pref-a3"]["animal_type"] == "dog" and table[1, None]["status"] == "available" and (3, "kochi-pref-b1") not in table
    runs = {r["facility_id"]: (r["yaml_count"], r["added"], r["updated"], r["removed"], r["status"], r["document_level"]) for r in got.runs.collect()}
    assert runs == {1: (40, 39, 1, 1, "success", "high"), 2: (0, 0, 0, 1, "empty", "high"), 3: (4, 0, 0, 0, "mismatch", "critical")}
    forced = load(spark, pages, listed, override=True)
    assert {r["facility_id"]: (r["added"], r["removed"]) for r in forced.runs.collect()}[3] == (4, 1)


def test_no_pages(spark):
    got = load(spark, [], [(1, "old", "cat", "Old", "available", OLD, OLD)])
    assert [r["status"] for r in got.table.collect()] == ["available"] and got.runs.count() == 0 and got.rows.count() == 0


def test_two_loads_of_one_capture(spark):
    """The second load of the same pages adds and removes nothing."""
    pages = [(1, "kochi/kochi-pref", i, "https://k.jp/l.html", CARD.format(n=f"A{i % 5}", name="タマ"), None) for i in range(6)]
    once = load(spark, pages, [])
    from foundling.sources import layouts

    again = ingest.from_pages(spark.createDataFrame(pages, PAGE), layouts.catalogue(spark), once.table, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    key = lambda t: sorted((r["external_id"], r["name"], r["status"]) for r in t.collect())
    assert key(once.table) == key(again.table) and len(key(once.table)) == 5
    assert [(r["added"], r["updated"], r["removed"]) for r in again.runs.collect()] == [(0, 6, 0)]
