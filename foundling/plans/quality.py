"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from . import roles as R
from .registry import query

c = F.col
PATTERNS = {"gender": "the|and", "age": "[0-9]+", "images": "que"}

COUNTS = """WITH n AS (SELECT doc_id, source, lang, len(string_split(text, chr(10))) AS valid, len(regexp_extract_all(text, 'the|and')) AS g,
  len(regexp_extract_all(text, '[0-9]+')) AS a, len(regexp_extract_all(text, 'que')) AS i FROM documents),
w AS (SELECT *, CASE WHEN abs(valid - g) > 2 THEN '性別表記(' || g || ')と抽出数(' || valid || ')に' || abs(valid - g) || '個の差異' END AS w1,
  CASE WHEN a > valid * 1.5 THEN '年齢表記(' || a || ')が抽出数より大幅に多い - 取りこぼしの可能性' END AS w2,
  CASE WHEN valid > 0 AND i < valid * 0.5 THEN '画像数(' || i || ')が少なすぎる - HTML構造の問題の可能性' END AS w3 FROM n),
l AS (SELECT *, (w1 IS NOT NULL)::INT + (w2 IS NOT NULL)::INT + (w3 IS NOT NULL)::INT AS k FROM w)"""


def checked(s, d):
    docs = R.table(s, d, "documents").select(
        "doc_id", "source", "lang", F.size(F.split("text", "\n")).alias("valid"), *Q.mentions("text", PATTERNS)
    )
    return docs.withColumn("warnings", Q.warnings("valid", "gender", "age", "images"))


@query("crosscheck_warnings", f"{COUNTS} SELECT doc_id, concat_ws('|', w1, w2, w3) AS warnings, k AS n FROM l")
def crosscheck_warnings(s, d):
    return checked(s, d).select("doc_id", F.array_join("warnings", "|").alias("warnings"), F.size("warnings").alias("n"))


@query("count_checks", """
WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS v, len(regexp_extract_all(text, '<|the')) AS t, len(regexp_extract_all(text, 'que')) AS i FROM documents)
SELECT doc_id, concat_ws('|', CASE WHEN abs(v - t) > 1 THEN 'tables(' || t || ')≠(' || v || ')' END, CASE WHEN abs(v - i) > 0 THEN 'images(' || i || ')≠(' || v || ')' END) AS warnings
FROM n""")
def count_checks(s, d):
    docs = R.table(s, d, "documents").select(
        "doc_id", F.size(F.split("text", "\n")).alias("v"), *Q.mentions("text", {"t": "<|the", "i": "que"})
    )
    found = Q.count_warnings("v", [("tables", "t", 1), ("images", "i", 0)])
    return docs.select("doc_id", F.array_join(found, "|").alias("warnings"))


@query("confidence_level", f"""{COUNTS}
SELECT doc_id, CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'critical' END AS level,
  CASE WHEN doc_id % 7 = 0 THEN 'critical' WHEN k > 2 THEN 'low' WHEN k > 0 THEN 'medium' WHEN valid > 0 THEN 'high' ELSE 'low' END AS with_errors
FROM l""")
def confidence_level(s, d):
    errors = F.when(c("doc_id") % 7 == 0, 1).otherwise(0)
    return checked(s, d).select(
        "doc_id", Q.level("warnings").alias("level"), Q.level_with_errors("warnings", errors, "valid").alias("with_errors")
    )


@query("completeness_score", """
SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE 0.3 END + CASE WHEN p_size % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN p_size > 10 THEN 0.2 ELSE 0 END
  + 0.2 + CASE WHEN p_size % 4 > 0 THEN 0.1 ELSE 0 END AS DECIMAL(2,1)) AS score FROM part""")
def completeness_score(s, d):
    n = c("p_size")
    name = F.when(n % 6 == 0, "保護猫12").when(n % 3 == 0, "").otherwise(c("p_name"))
    score = Q.completeness(
        name, F.when(n % 2 == 0, "male").otherwise("unknown"), F.when(n > 10, "2歳"), c("p_brand"), n % 4
    )
    return R.table(s, d, "part").select("p_partkey", score.alias("score"))


@query("row_confidence", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'low' WHEN p_size % 3 = 0 THEN 'medium' ELSE 'high' END AS confidence_level,
  concat_ws('|', CASE WHEN p_size % 3 = 0 THEN '画像が見つかりませんでした' END, CASE WHEN p_size % 5 = 0 THEN '詳細情報テーブルが見つかりませんでした' END) AS notes FROM part""")
def row_confidence(s, d):
    rules = [
        (c("p_size") % 3 == 0, "medium", "画像が見つかりませんでした"), (c("p_size") % 5 == 0, "low", "詳細情報テーブルが見つかりませんでした"),
    ]
    r = R.table(s, d, "part").select("p_partkey", Q.row_confidence(rules).alias("r"))
    return r.select("p_partkey", "r.confidence_level", F.array_join("r.extraction_notes", "|").alias("notes"))


@query("dq_report", f"""{COUNTS}
SELECT source, count(*) AS total, count(*) FILTER (i > 0) AS with_images, count(*) FILTER (lang IN ('en', 'de')) AS known_type,
  count(*) FILTER (doc_id % 3 > 0) AS known_status, count(*) FILTER (k < 2) AS good_confidence FROM l GROUP BY source""")
def dq_report(s, d):
    rows = checked(s, d).select(
        "source", F.array_repeat(F.lit("x"), c("images")).alias("images"),
        F.when(c("lang") == "en", "cat").when(c("lang") == "de", "dog").alias("animal_type"),
        F.when(c("doc_id") % 3 == 0, "lost").when(c("doc_id") % 3 == 1, "available").otherwise("reserved").alias("status"),
        Q.level("warnings").alias("confidence_level"),
    )
    return Q.report(rows, "source")
