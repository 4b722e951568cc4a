"""Run ledger and anomaly queries over the run role."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..operators import monitor as M
from . import roles as R
from .registry import query
from .roles import FACILITY, LISTING, REGION, RUNS

STAMP = "%Y-%m-%d %H:%M:%S"
WITH_RUNS = f"WITH {RUNS}"
RANKED = f"{WITH_RUNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY scraper_id ORDER BY ts DESC, run_id DESC) AS rn FROM runs)"
LAST = f"{RANKED}, latest AS (SELECT * FROM ranked WHERE rn = 1)"


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sql_stamp(c: str, out: str | None = None) -> str:
    return f"strftime({c}, '{STAMP}') AS {out or c}"


@query("run_status", f"""{WITH_RUNS}
SELECT run_id, CASE WHEN error_message IS NOT NULL THEN 'error' WHEN warning IS NOT NULL THEN 'mismatch'
  WHEN html_count = 0 AND yaml_count = 0 AND db_count = 0 THEN 'empty' ELSE 'success' END AS status FROM runs""")
def run_status(s, d):
    counts = [F.col(c) for c in ("html_count", "yaml_count", "db_count")]
    return R.runs(s, d).select("run_id", M.run_status(F.col("error_message"), F.col("warning"), counts).alias("status"))


@query("ledger_rollup", f"""{WITH_RUNS}
SELECT scraper_id, count(*) AS total_runs, count(*) FILTER (status IN ('success','empty')) AS success_count,
  count(*) FILTER (status = 'error') AS error_count, count(*) FILTER (status = 'mismatch') AS mismatch_count,
  {sql_stamp("max(CASE WHEN status IN ('success','empty') THEN ts END)", "last_success")},
  {sql_stamp("max(CASE WHEN status = 'error' THEN ts END)", "last_error")},
  arg_max(error_message, ts) FILTER (status = 'error') AS last_error_message,
  coalesce(bool_or(status IN ('success','empty') AND greatest(html_count, yaml_count, db_count) > 0), false) AS verified
FROM runs GROUP BY scraper_id
UNION ALL SELECT 'idle/s' || s_suppkey, 0, 0, 0, 0, NULL, NULL, NULL, false FROM supplier""")
def ledger_rollup(s, d):
    runs = R.runs(s, d)
    idle = R.table(s, d, "supplier").select(F.concat(F.lit("idle/s"), "s_suppkey").alias("scraper_id"))
    out = M.rollup(runs, idle)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("last_success", "last_error")})


@query("last_n_runs", f"""{RANKED}
SELECT scraper_id, rn, run_id, status, yaml_count, {sql_stamp('ts')} FROM ranked WHERE rn <= 10""")
def last_n_runs(s, d):
    return M.recent(R.runs(s, d)).select("scraper_id", "rn", "run_id", "status", "yaml_count", stamp("ts"))


@query("ledger_flatten", f"""{RANKED}
SELECT scraper_id, rn - 1 AS position, status, html_count, yaml_count, db_count FROM ranked WHERE rn <= 10""")
def ledger_flatten(s, d):
    """The nested ledger (a map from scraper to its record) back to one row per run."""
    nested = M.history(R.runs(s, d)).select(F.create_map("scraper_id", F.struct("last_runs")).alias("scrapers"))
    from ..sources.ledger import flatten

    return flatten(nested).select("scraper_id", "position", "status", "html_count", "yaml_count", "db_count")


PROFILE = f"""{RANKED}, win AS (SELECT *, (yaml_count = 0 AND status <> 'error') AS z FROM ranked WHERE rn <= 5),
streaks AS (SELECT *, sum(CASE WHEN z THEN 0 ELSE 1 END) OVER (PARTITION BY scraper_id ORDER BY rn) AS br FROM win),
prof AS (SELECT scraper_id, count(*) FILTER (br = 0) AS streak, count(*) AS n, count(*) FILTER (status = 'error') AS errs,
  max(status) FILTER (rn = 1) AS st, max(error_message) FILTER (rn = 1) AS em, max(warning) FILTER (rn = 1) AS wn,
  coalesce(max(yaml_count) FILTER (rn = 1), 0) AS cur, coalesce(max(yaml_count) FILTER (rn = 2), 0) AS prev
  FROM streaks GROUP BY scraper_id),
issue AS (
  SELECT scraper_id, 'consecutive_zero' AS type, 'critical' AS severity, '直近' || streak || '回連続で0匹' AS message, 1 AS o FROM prof WHERE streak >= 3
  UNION ALL SELECT scraper_id, 'high_error_rate', 'critical',
    '直近' || n || '回中' || errs || '回エラー (' || CAST(floor(100.0 * errs / n + 0.5) AS BIGINT) || '%)', 2 FROM prof WHERE n >= 2 AND errs >= 0.5 * n
  UNION ALL SELECT scraper_id, 'latest_error', 'warning', '最新の実行がエラー: ' || coalesce(em, 'null'), 3 FROM prof WHERE st = 'error'
  UNION ALL SELECT scraper_id, 'sudden_drop', 'warning',
    '件数が急減 (' || prev || '→' || cur || '匹、' || CAST(floor(100.0 * (prev - cur) / prev + 0.5) AS BIGINT) || '%減)', 4
    FROM prof WHERE n >= 2 AND prev > 0 AND cur < prev * 0.5
  UNION ALL SELECT scraper_id, 'mismatch', 'warning', 'HTML→YAML変換で不整合: ' || coalesce(wn, 'null'), 5 FROM prof WHERE st = 'mismatch')"""


def _rule(name: str, kind: str):
    @query(name, f"{PROFILE} SELECT scraper_id, type, severity, message FROM issue WHERE type = '{kind}'")
    def rule(s, d):
        return M.anomalies(R.runs(s, d), kind=kind).drop("issue_no")

    rule.__doc__ = f"Scrapers with a {kind} issue."
    return rule


for _name, _kind in {
    "anomaly_zero_streak": "consecutive_zero", "anomaly_error_rate": "high_error_rate",
    "anomaly_latest_error": "latest_error", "anomaly_sudden_drop": "sudden_drop", "anomaly_mismatch": "mismatch",
}.items():
    _rule(_name, _kind)


@query("anomalies", f"{PROFILE} SELECT scraper_id, type, severity, message FROM issue WHERE starts_with(scraper_id, 'p3/')")
def anomalies(s, d):
    return M.anomalies(R.runs(s, d), target="p3").drop("issue_no")


@query("anomaly_report", f"""{PROFILE}, listed AS (
  SELECT scraper_id, string_agg(type, ',' ORDER BY o) AS issues, count(*) AS n_issues FROM issue GROUP BY 1),
cnt AS (SELECT scraper_id, string_agg(yaml_count || ':' || status, ',' ORDER BY rn) AS recent FROM ranked WHERE rn <= 5 GROUP BY 1)
SELECT l.scraper_id, issues, n_issues, recent, st AS latest_status
FROM listed l JOIN cnt c ON l.scraper_id = c.scraper_id JOIN prof p ON p.scraper_id = l.scraper_id""")
def anomaly_report(s, d):
    rep = M.anomaly_report(R.runs(s, d))
    shown = F.transform("recent_counts", lambda x: F.concat(x["yaml_count"], F.lit(":"), x["status"]))
    return rep.select(
        "scraper_id", F.array_join(F.col("issues.type"), ",").alias("issues"),
        F.size("issues").cast("bigint").alias("n_issues"), F.array_join(shown, ",").alias("recent"), "latest_status",
    )


@query("target_match", f"{WITH_RUNS} SELECT run_id, scraper_id FROM runs WHERE scraper_id = 'p5' OR starts_with(scraper_id, 'p5/')")
def target_match(s, d):
    from ..functions.urls import in_target

    return R.runs(s, d).filter(in_target("scraper_id", "p5")).select("run_id", "scraper_id")


@query("count_carry_forward", f"""{WITH_RUNS}, l AS (SELECT *,
  lag(html_count) OVER w AS h, lag(yaml_count) OVER w AS y, lag(db_count) OVER w AS b FROM runs
  WINDOW w AS (PARTITION BY scraper_id ORDER BY ts, run_id))
SELECT run_id, CASE WHEN h > 0 THEN h END AS inherited_html_count, CASE WHEN y > 0 THEN y END AS inherited_yaml_count,
  CASE WHEN b > 0 THEN b END AS inherited_db_count FROM l""")
def count_carry_forward(s, d):
    return M.carry_forward(R.runs(s, d)).select(
        "run_id", "inherited_html_count", "inherited_yaml_count", "inherited_db_count"
    )


@query("latest_run_status", f"""WITH {RUNS}, {LISTING}, {FACILITY}, {REGION}
SELECT facility_name, region_name, {sql_stamp('r.ts', 'last_run_at')}, r.status AS last_status, r.yaml_count AS last_found,
  (SELECT count(*) FROM listing l WHERE l.facility_id = f.facility_id AND l.status = 'available') AS active_listings
FROM facility f LEFT JOIN reg g ON f.region_id = g.region_id LEFT JOIN runs r ON r.facility_id = f.facility_id
WHERE r.run_id = (SELECT max(run_id) FROM runs x WHERE x.facility_id = f.facility_id)""")
def latest_run_status(s, d):
    out = M.latest_status(R.runs(s, d), R.facilities(s, d), R.regions(s, d), R.listings(s, d))
    return out.withColumn("last_run_at", F.date_format("last_run_at", "yyyy-MM-dd HH:mm:ss"))


@query("recent_runs", f"""WITH {RUNS}, {FACILITY}
SELECT run_id, facility_name, {sql_stamp('ts')}, status, yaml_count FROM runs r JOIN facility f ON r.facility_id = f.facility_id
ORDER BY r.ts DESC, run_id DESC LIMIT 50""")
def recent_runs(s, d):
    return M.newest_runs(R.runs(s, d), R.facilities(s, d), limit=50).select("run_id", "facility_name", stamp("ts"), "status", "yaml_count")


@query("run_kpis", f"""{WITH_RUNS}
SELECT count(*) AS total_runs, count(*) FILTER (status = 'success') AS successful_runs,
  count(*) FILTER (status = 'error') AS failed_runs, CAST(coalesce(sum(yaml_count), 0) AS BIGINT) AS total_found,
  CAST(coalesce(floor(sum(duration_ms) / count(*) + 0.5), 0) AS BIGINT) AS avg_duration_ms,
  round(100.0 * count(*) FILTER (status = 'success') / count(*), 1) AS success_rate, {sql_stamp('max(ts)', 'last_run')}
FROM runs WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY""")
def run_kpis(s, d):
    return M.kpis(R.runs(s, d), R.runs_as_of(), 20).withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss"))


@query("daily_runs", f"""{WITH_RUNS}
SELECT CAST(ts AS DATE) AS day, count(*) AS runs, count(*) FILTER (status = 'success') AS successes,
  CAST(sum(yaml_count) AS BIGINT) AS found, CAST(sum(added) AS BIGINT) AS added, CAST(sum(updated) AS BIGINT) AS updated,
  CAST(sum(removed) AS BIGINT) AS removed, CAST(floor(sum(duration_ms) / count(*) + 0.5) AS BIGINT) AS avg_duration_ms
FROM runs WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY GROUP BY 1""")
def daily_runs(s, d):
    return M.daily(R.runs(s, d), R.runs_as_of(), 14)


def _fleet(s, d):
    """Every scraper with runs, and suppliers as scrapers that never ran."""
    idle = R.table(s, d, "supplier").select(F.concat(F.lit("idle/s"), "s_suppkey").alias("scraper_id"))
    return R.runs(s, d).select("scraper_id").distinct().unionByName(idle)


PCT = ", ".join(
    f"CAST(floor(100.0 * count(*) FILTER (status = '{k}') / count(*) + 0.5) AS BIGINT) AS {k}_pct"
    for k in ("success", "mismatch", "error", "empty")
)


@query("fleet_summary", f"""{LAST}, fleet AS (SELECT scraper_id, status FROM latest
  UNION ALL SELECT 'idle/s' || s_suppkey, NULL FROM supplier)
SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'mismatch') AS mismatch,
  count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'empty') AS empty,
  count(*) FILTER (status IS NULL) AS not_run, {PCT} FROM fleet""")
def fleet_summary(s, d):
    return M.fleet_summary(R.runs(s, d), _fleet(s, d))


LISTED = f"""{LAST}
SELECT scraper_id, {sql_stamp('ts')}, html_count, yaml_count, db_count, error_message, warning,
  greatest(html_count - yaml_count, 0) AS lost_extracting, greatest(yaml_count - db_count, 0) AS lost_loading FROM latest"""


@query("fleet_mismatch_list", f"{LISTED} WHERE status = 'mismatch'")
def fleet_mismatch_list(s, d):
    return M.fleet_list(R.runs(s, d), "mismatch").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("fleet_error_list", f"{LISTED} WHERE status = 'error'")
def fleet_error_list(s, d):
    return M.fleet_list(R.runs(s, d), "error").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("fleet_empty_list", f"""{LAST}, e AS (SELECT scraper_id, ts FROM latest WHERE status = 'empty')
SELECT scraper_id, {sql_stamp('ts')}, (SELECT count(*) FROM e) AS list_length, (SELECT count(*) FROM e) > 5 AS hidden FROM e""")
def fleet_empty_list(s, d):
    return M.fleet_empty_list(R.runs(s, d)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("escalation_level", f"""{LAST}
SELECT count(*) FILTER (status = 'error') AS failing, CASE WHEN count(*) FILTER (status = 'error') = 0 THEN 0
  WHEN count(*) FILTER (status = 'error') <= 2 THEN 1 WHEN count(*) FILTER (status = 'error') <= 5 THEN 2 ELSE 3 END AS level
FROM latest""")
def escalation_level(s, d):
    return M.escalation(R.runs(s, d))


@query("stage_loss", f"""{WITH_RUNS}
SELECT run_id, nullif(concat_ws('; ',
  CASE WHEN html_count > 0 AND yaml_count < html_count THEN 'HTML→YAMLで' || (html_count - yaml_count) || '匹減少 (' || html_count || '→' || yaml_count || ')' END,
  CASE WHEN yaml_count > 0 AND db_count < yaml_count THEN 'YAML→DBで' || (yaml_count - db_count) || '匹減少 (' || yaml_count || '→' || db_count || ')' END), '') AS warning
FROM runs""")
def stage_loss(s, d):
    return R.runs(s, d).select("run_id", M.stage_warnings().alias("warning"))


@query("run_lifecycle", f"""{WITH_RUNS}
SELECT run_id, {sql_stamp('ts', 'started_at')},
  CASE WHEN status <> 'mismatch' THEN strftime(ts + to_milliseconds(duration_ms), '{STAMP}') END AS completed_at,
  CASE WHEN status = 'mismatch' THEN 'running' ELSE status END AS status,
  CASE WHEN status = 'mismatch' THEN 0 ELSE yaml_count END AS found, CASE WHEN status = 'mismatch' THEN 0 ELSE added END AS added,
  CASE WHEN status = 'mismatch' THEN 0 ELSE updated END AS updated, CASE WHEN status = 'mismatch' THEN 0 ELSE removed END AS removed,
  error_message FROM runs""")
def run_lifecycle(s, d):
    """Each run opens; all but the mismatch ones close again."""
    r = R.runs(s, d)
    none = F.lit(None)
    opened = r.select(
        "run_id", F.lit("open").alias("phase"), "ts", F.lit("running").alias("status"),
        *[none.cast("int").alias(c) for c in ("found", "added", "updated", "removed")], none.cast("string").alias("error_message"),
    )
    closed = r.filter(F.col("status") != "mismatch").select(
        "run_id", F.lit("close").alias("phase"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("duration_ms") * 1000).alias("ts"), "status",
        F.col("yaml_count").alias("found"), "added", "updated", "removed", "error_message",
    )
    out = M.lifecycle(opened.unionByName(closed)).drop("duration_ms")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "completed_at")})


@query("duration_label", f"""{WITH_RUNS}
SELECT run_id, CASE WHEN duration_ms // 1000 >= 60 THEN (duration_ms // 60000) || '分' || (duration_ms // 1000 % 60) || '秒'
    ELSE (duration_ms // 1000) || '秒' END AS label,
  CASE WHEN duration_ms = 0 THEN '—' WHEN duration_ms < 1000 THEN duration_ms || 'ms'
    ELSE ((duration_ms + 50) // 100 // 10) || '.' || ((duration_ms + 50) // 100 % 10) || '秒' END AS short_label FROM runs""")
def duration_label(s, d):
    return R.runs(s, d).select(
        "run_id", classify.duration_label("duration_ms").alias("label"), classify.duration_short("duration_ms").alias("short_label")
    )
