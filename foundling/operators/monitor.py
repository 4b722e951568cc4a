"""Run ledger: status, rollups, recent history, anomalies, fleet summary.

Anomaly rules only look at the newest runs of a scraper.  Those are cut out
first (at most ten per scraper, limited before the shuffle), so every later
window works on ten rows at most however long a scraper's history is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.urls import in_target
from .ordered import first_n, ordered_chunks, previous_row

# fixed value: length of the kept history
HISTORY = 10


@dataclass(frozen=True)
class Thresholds:
    # fixed values: alarm limits
    zero_runs: int = 3
    error_rate: float = 0.5
    window: int = 5
    drop_ratio: float = 0.5


def run_status(error: Column, warning: Column, counts: Sequence[Column]) -> Column:
    """Error beats mismatch beats empty (nothing counted anywhere) beats success."""
    nothing = F.lit(True)
    for c in counts:
        nothing = nothing & (F.coalesce(c, F.lit(0)) == 0)
    return (
        F.when(error.isNotNull(), "error").when(warning.isNotNull(), "mismatch").when(nothing, "empty").otherwise("success")
    )


def stage_warnings(html: str = "html_count", extracted: str = "yaml_count", loaded: str = "db_count") -> Column:
    """Losses between stages, joined by ``; ``; null when nothing was lost."""
    h, y, d = F.col(html), F.col(extracted), F.col(loaded)
    # fixed values: wording of the warnings
    lost = lambda a, b, what: F.when(
        (a > 0) & (b < a), F.concat(F.lit(f"{what}で"), a - b, F.lit("匹減少 ("), a, F.lit("→"), b, F.lit(")"))
    )
    parts = F.array_compact(F.array(lost(h, y, "HTML→YAML"), lost(y, d, "YAML→DB")))
    return F.when(F.size(parts) > 0, F.array_join(parts, "; "))


def recent(runs: DataFrame, n: int = HISTORY) -> DataFrame:
    """Newest ``n`` runs per scraper with their rank ``rn``."""
    return first_n(runs, ["scraper_id"], [F.col("ts").desc(), F.col("run_id").desc()], n)


def history(runs: DataFrame, n: int = HISTORY) -> DataFrame:
    """The nested form: one row per scraper with its newest runs in order."""
    entry = F.struct("rn", "ts", "status", "html_count", "yaml_count", "db_count", "error_message", "warning", "duration_ms")
    return recent(runs, n).groupBy("scraper_id").agg(F.array_sort(F.collect_list(entry)).alias("last_runs"))


def rollup(runs: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Counters per scraper; registered scrapers without runs get zeros."""
    ok = F.col("status").isin("success", "empty")
    err = F.col("status") == "error"
    found = (F.col("html_count") > 0) | (F.col("yaml_count") > 0) | (F.col("db_count") > 0)
    newest_error = F.max_by(F.struct("error_message"), F.when(err, F.struct("ts", "run_id")))
    out = runs.groupBy("scraper_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(ok).alias("success_count"),
        F.count_if(err).alias("error_count"),
        F.count_if(F.col("status") == "mismatch").alias("mismatch_count"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        F.max(F.when(err, F.col("ts"))).alias("last_error"),
        newest_error["error_message"].alias("last_error_message"),
        F.coalesce(F.bool_or(ok & found), F.lit(False)).alias("verified"),
    )
    if registry is None:
        return out
    zero = ["total_runs", "success_count", "error_count", "mismatch_count"]
    joined = registry.select("scraper_id").join(out, "scraper_id", "full_outer")
    return joined.withColumns(
        {**{c: F.coalesce(c, F.lit(0)) for c in zero}, "verified": F.coalesce("verified", F.lit(False))}
    )


def _profile(runs: DataFrame, limits: Thresholds, target: str | None) -> DataFrame:
    """One row per scraper with all measures the rules need."""
    newest = recent(runs.filter(in_target("scraper_id", target)), max(limits.window, 2))
    ordered = W.partitionBy("scraper_id").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    in_window = F.col("rn") <= limits.window
    zero = (F.col("yaml_count") == 0) & (F.col("status") != "error")
    count_at = lambda n: F.coalesce(F.max(F.when(F.col("rn") == n, F.col("yaml_count"))), F.lit(0))
    at_first = lambda c: F.max(F.when(F.col("rn") == 1, F.col(c)))
    return (
        newest.withColumn("_breaks", F.sum(F.when(F.coalesce(zero, F.lit(False)), 0).otherwise(1)).over(ordered))
        .groupBy("scraper_id")
        .agg(
            F.count_if(in_window & (F.col("_breaks") == 0)).alias("zero_streak"),
            F.count_if(in_window).alias("window_runs"),
            F.count_if(in_window & (F.col("status") == "error")).alias("window_errors"),
            F.count(F.lit(1)).alias("known_runs"),
            at_first("status").alias("latest_status"),
            at_first("ts").alias("latest_ts"),
            at_first("error_message").alias("latest_error"),
            at_first("warning").alias("latest_warning"),
            count_at(1).alias("current"),
            count_at(2).alias("previous"),
            F.array_sort(
                F.collect_list(F.when(in_window, F.struct("rn", "ts", "yaml_count", "status")))
            ).alias("recent_counts"),
        )
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.floor(100 * part / whole + F.lit(0.5)).cast("bigint")


# fixed values: issue types in report order
ISSUES = ["consecutive_zero", "high_error_rate", "latest_error", "sudden_drop", "mismatch"]


def issues(limits: Thresholds) -> Column:
    """All issues of a profile row as ``array<struct<type,severity,message>>``."""
    streak, errors, n = F.col("zero_streak"), F.col("window_errors"), F.col("window_runs")
    cur, prev = F.col("current"), F.col("previous")

    def issue(kind: str, severity: str, cond: Column, message: Column) -> Column:
        body = F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("message"))
        return F.when(cond, body)

    # fixed values: wording of the messages
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.array_compact(
        F.array(
            issue(ISSUES[0], "critical", streak >= limits.zero_runs, text("直近", streak, "回連続で0匹")),
            issue(
                ISSUES[1], "critical", (errors >= limits.error_rate * n) & (n >= 2),
                text("直近", n, "回中", errors, "回エラー (", _percent(errors, n), "%)"),
            ),
            issue(
                ISSUES[2], "warning", F.col("latest_status") == "error",
                text("最新の実行がエラー: ", F.coalesce("latest_error", F.lit("null"))),
            ),
            issue(
                ISSUES[3], "warning",
                (F.col("known_runs") >= 2) & (prev > 0) & (cur < prev * (1 - limits.drop_ratio)),
                text("件数が急減 (", prev, "→", cur, "匹、", _percent(prev - cur, prev), "%減)"),
            ),
            issue(
                ISSUES[4], "warning", F.col("latest_status") == "mismatch",
                text("HTML→YAML変換で不整合: ", F.coalesce("latest_warning", F.lit("null"))),
            ),
        )
    )


def anomaly_report(runs: DataFrame, limits: Thresholds = Thresholds(), target: str | None = None) -> DataFrame:
    """One row per scraper with an issue: issues, latest run, recent counts."""
    return _profile(runs, limits, target).withColumn("issues", issues(limits)).filter(F.size("issues") > 0)


def anomalies(runs: DataFrame, limits: Thresholds = Thresholds(), target: str | None = None, kind: str | None = None) -> DataFrame:
    """One row per scraper and issue."""
    report = anomaly_report(runs, limits, target)
    flat = report.select("scraper_id", F.posexplode("issues").alias("issue_no", "_i")).select(
        "scraper_id", "issue_no", "_i.type", "_i.severity", "_i.message"
    )
    return flat.filter(F.col("type") == kind) if kind else flat


def carry_forward(
    runs: DataFrame, counts: Sequence[str] = ("html_count", "yaml_count", "db_count"), rows_per_chunk: int = 1_000_000
) -> DataFrame:
    """Counts a stage starts from: the previous run's, where they were positive."""
    chunked = ordered_chunks(runs, ["scraper_id"], ["ts", "run_id"], rows_per_chunk=rows_per_chunk)
    out = previous_row(chunked, ["scraper_id"], ["ts", "run_id"], F.struct(*counts), "_previous")
    return out.withColumns(
        {f"inherited_{c}": F.when(F.col("_previous")[c] > 0, F.col("_previous")[c]) for c in counts}
    ).drop("_previous")


def latest(runs: DataFrame, key: str = "scraper_id") -> DataFrame:
    """Newest run per key by partial aggregation."""
    rest = [c for c in runs.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct("ts", "run_id")).alias("_r")
    return runs.groupBy(key).agg(best).select(key, "_r.*")


def latest_by_id(runs: DataFrame, key: str = "facility_id") -> DataFrame:
    """Run with the largest id per key."""
    rest = [c for c in runs.columns if c not in (key, "run_id")]
    best = F.max_by(F.struct("run_id", *rest), F.col("run_id")).alias("_r")
    return runs.groupBy(key).agg(best).select(key, "_r.*")


def latest_status(runs: DataFrame, facilities: DataFrame, regions: DataFrame, listings: DataFrame) -> DataFrame:
    """Latest run and number of available listings of each facility with runs."""
    open_ = listings.filter(F.col("status") == "available").groupBy("facility_id").agg(F.count(F.lit(1)).alias("_n"))
    newest = latest_by_id(runs).select(
        "facility_id", F.col("ts").alias("last_run_at"), F.col("status").alias("last_status"),
        F.col("yaml_count").alias("last_found"),
    )
    return (
        facilities.join(newest, "facility_id")
        .join(regions.select("region_id", "region_name"), "region_id", "left")
        .join(open_, "facility_id", "left")
        .select("facility_name", "region_name", "last_run_at", "last_status", "last_found",
                F.coalesce("_n", F.lit(0)).alias("active_listings"))
    )


def fleet_summary(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Scrapers by status of their last run, with rounded percentages."""
    last = latest(runs).select("scraper_id", "status")
    fleet = registry.select("scraper_id").join(last, "scraper_id", "left")
    total = F.count(F.lit(1))
    n = lambda s: F.count_if(F.col("status") == s)
    pct = lambda s: F.when(total > 0, _percent(n(s), total))
    kinds = ["success", "mismatch", "error", "empty"]
    return fleet.agg(
        total.alias("total"), *[n(k).alias(k) for k in kinds],
        F.count_if(F.col("status").isNull()).alias("not_run"), *[pct(k).alias(f"{k}_pct") for k in kinds],
    )


def fleet_list(runs: DataFrame, status: str) -> DataFrame:
    """Scrapers whose last run has the status, with what the list shows."""
    out = latest(runs).filter(F.col("status") == status)
    lost = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    return out.select(
        "scraper_id", "ts", "html_count", "yaml_count", "db_count", "error_message", "warning",
        lost("html_count", "yaml_count").alias("lost_extracting"), lost("yaml_count", "db_count").alias("lost_loading"),
    )


# fixed values: report lists longer than this show only their length
LIST_LIMIT = 5


def fleet_empty_list(runs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The empty list with its length and whether a report hides its rows."""
    empty = fleet_list(runs, "empty").select("scraper_id", "ts")
    n = empty.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    return empty.withColumn("list_length", n).withColumn("hidden", F.col("list_length") > limit)


def kpis(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Totals of the last ``days`` days."""
    recent_ = runs.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    ok, n = F.count_if(F.col("status") == "success"), F.count(F.lit(1))
    return recent_.agg(
        n.alias("total_runs"), ok.alias("successful_runs"), F.count_if(F.col("status") == "error").alias("failed_runs"),
        F.coalesce(F.sum("yaml_count"), F.lit(0)).alias("total_found"),
        F.coalesce(F.floor(F.sum("duration_ms") / n + F.lit(0.5)), F.lit(0)).cast("bigint").alias("avg_duration_ms"),
        F.when(n > 0, F.round(100 * ok / n, 1)).alias("success_rate"),
        F.max("ts").alias("last_run"),
    )


def daily(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row per day, newest first."""
    recent_ = runs.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    return (
        recent_.groupBy(F.to_date("ts").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(F.col("status") == "success").alias("successes"),
            F.coalesce(F.sum("yaml_count"), F.lit(0)).alias("found"),
            F.coalesce(F.sum("added"), F.lit(0)).alias("added"),
            F.coalesce(F.sum("updated"), F.lit(0)).alias("updated"),
            F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"),
            F.floor(F.sum("duration_ms") / F.count(F.lit(1)) + F.lit(0.5)).cast("bigint").alias("avg_duration_ms"),
        )
        .orderBy(F.col("day").desc())
    )


def newest_runs(runs: DataFrame, facilities: DataFrame, limit: int | None = None, facility_id=None) -> DataFrame:
    """Runs with the facility's name, newest first; with ``limit`` only so many.  Runs of unknown facilities do not
    count, so they are dropped (semi join) before the top rows are taken."""
    if facility_id:
        runs = runs.filter(F.col("facility_id") == facility_id)
    known = runs.join(facilities.select("facility_id"), "facility_id", "left_semi")
    top = known if limit is None else known.orderBy(F.col("ts").desc(), F.col("run_id").desc()).limit(limit)
    return top.join(facilities.select("facility_id", "facility_name"), "facility_id").orderBy(
        F.col("ts").desc(), F.col("run_id").desc()
    )


def lifecycle(events: DataFrame) -> DataFrame:
    """State of each run from its open and close events (``run_id, phase, ts,
    status, found, added, updated, removed, error_message``)."""
    closing = F.col("phase") == "close"
    last_close = F.max_by(
        F.struct("ts", "status", "found", "added", "updated", "removed", "error_message"), F.when(closing, F.col("ts"))
    )
    folded = events.groupBy("run_id").agg(
        F.min(F.when(F.col("phase") == "open", F.col("ts"))).alias("started_at"), last_close.alias("_c")
    )
    ms = F.unix_millis(F.col("_c.ts")) - F.unix_millis("started_at")
    return folded.select(
        "run_id", "started_at", F.col("_c.ts").alias("completed_at"),
        F.coalesce("_c.status", F.lit("running")).alias("status"),
        *[F.coalesce(F.col(f"_c.{c}"), F.lit(0)).alias(c) for c in ("found", "added", "updated", "removed")],
        F.col("_c.error_message").alias("error_message"), ms.alias("duration_ms"),
    )


def escalation(runs: DataFrame) -> DataFrame:
    """Number of facilities whose last run failed and the level that calls for."""
    failing = F.count_if(F.col("status") == "error")
    # fixed values: steps of the operations guide
    level = F.when(failing == 0, 0).when(failing <= 2, 1).when(failing <= 5, 2).otherwise(3)
    return latest(runs).agg(failing.alias("failing"), level.alias("level"))
