"""Normalisation and classification queries.

The test texts are in Latin script.  Queries on ``documents`` pass their own
word lists; queries on the Japanese rules first write each row of a table in
the Japanese spelling and read it back, and the SQL twin states what must come
out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, dates, records, text, urls
from ..session import dealt
from . import roles as R
from .registry import query


def docs(s, d):
    return R.table(s, d, "documents")


def parts(s, d):
    """Dealt, since each small row is written as a page or text and read back."""
    return dealt(R.table(s, d, "part"), "p_partkey")


def say(*pieces):
    """Concatenate columns and literal text."""
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in pieces])


c = F.col


# ---- classification -----------------------------------------------------------

@query("classify_species", """
SELECT doc_id, CASE WHEN contains(text, 'the') OR contains(text, 'and') THEN 'dog'
  WHEN contains(text, 'der') OR contains(text, 'die') THEN 'cat' ELSE 'unknown' END AS species,
  contains(text, 'the') OR contains(text, 'and') AS is_dog,
  NOT (contains(text, 'the') OR contains(text, 'and')) AND (contains(text, 'der') OR contains(text, 'die')) AS is_cat
FROM documents""")
def classify_species(s, d):
    words = {"dog": ["the", "and"], "cat": ["der", "die"]}
    return docs(s, d).select(
        "doc_id", classify.species("text", **words).alias("species"), classify.is_dog("text", **words).alias("is_dog"),
        classify.is_cat("text", **words).alias("is_cat"),
    )


@query("classify_header", """
WITH h AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS t FROM pages)
SELECT page_id, CASE WHEN contains(t, 'th') THEN 'dog' WHEN contains(t, 'ie') THEN 'cat'
  WHEN contains(t, 'de') THEN 'dog' WHEN contains(t, 'en') THEN 'cat' ELSE 'unknown' END AS species FROM h""")
def classify_header(s, d):
    heading = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    kind = classify.species_of_heading(heading, "unknown", ["th"], ["ie"], dog=["de"], cat=["en"])
    return R.table(s, d, "pages").select("page_id", kind.alias("species"))


@query("rule_cascade", """
SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'dog' WHEN contains(text, 'token') THEN 'cat'
  WHEN contains(text, 'the') THEN 'dog' ELSE 'unknown' END AS species,
  CASE WHEN contains(text, 'Version') THEN 'home without cats' WHEN contains(text, 'sh ') THEN 'gentle handling' END AS advice,
  trim(regexp_replace(trim(source), '1$', '')) AS plain_source
FROM documents""")
def rule_cascade(s, d):
    rules = [("dog", ["License"]), ("cat", ["token"]), ("dog", ["the"])]
    advice = [("home without cats", ["Version"]), ("gentle handling", ["sh "])]
    return docs(s, d).select(
        "doc_id", classify.cascade("text", rules, "unknown").alias("species"), classify.cascade("text", advice).alias("advice"),
        text.drop_honorific("source", "1$").alias("plain_source"),
    )


@query("adoption_status", """
SELECT doc_id, CASE WHEN contains(text, 'License') OR contains(text, 'shall') OR contains(text, 'thon')
  THEN 'adopted' ELSE 'available' END AS status FROM documents""")
def adoption_status(s, d):
    return docs(s, d).select("doc_id", classify.adoption_status("text", ["License", "shall", "thon"]).alias("status"))


@query("status_extended", """
SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'adopted' WHEN contains(text, 'token') THEN 'reserved'
  WHEN contains(text, 'with') THEN 'pending' ELSE 'available' END AS status FROM documents""")
def status_extended(s, d):
    return docs(s, d).select("doc_id", classify.extended_status("text", ["License"], ["token"], ["with"]).alias("status"))


@query("normalize_gender", """
SELECT p_partkey, CASE WHEN contains(p_name, 'old') THEN 'female' WHEN contains(p_name, 'red') OR contains(p_name, 'hot')
  THEN 'male' ELSE 'unknown' END AS gender,
  CASE p_size % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'male' WHEN 3 THEN 'female' ELSE 'unknown' END AS japanese
FROM part""")
def normalize_gender(s, d):
    n = c("p_size") % 5
    written = F.when(n == 0, "オス").when(n == 1, "女の子").when(n == 2, "♂（去勢済）").when(n == 3, "FEMALE").otherwise("不明")
    return parts(s, d).select(
        "p_partkey", classify.gender("p_name", ["red", "hot"], ["old"]).alias("gender"), classify.gender(written).alias("japanese")
    )


@query("gender_struct", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'male' ELSE 'female' END AS gender, p_size % 3 = 0 AS neutered,
  CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN '去勢済み' ELSE '避妊済み' END END AS phrase FROM part""")
def gender_struct(s, d):
    done = c("p_size") % 3 == 0
    written = F.when(c("p_size") % 2 == 0, say(F.when(done, "去勢").otherwise(""), "オス")).otherwise(
        say(F.when(done, "不妊").otherwise(""), "メス")
    )
    g = parts(s, d).select("p_partkey", classify.gender_and_neuter(written).alias("g"))
    return g.select("p_partkey", "g.gender", "g.neutered", classify.neuter_phrase("g.gender", "g.neutered").alias("phrase"))


@query("normalize_size", """
SELECT p_partkey, CASE WHEN p_type = 'LARGE' THEN 'large' WHEN p_type IN ('MEDIUM', 'STANDARD') THEN 'medium'
  WHEN p_type = 'SMALL' THEN 'small' END AS size,
  CASE p_size % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' WHEN 2 THEN 'small' END AS japanese FROM part""")
def normalize_size(s, d):
    n = c("p_size") % 4
    rules = [("large", ["LARGE"]), ("medium", ["MEDIUM", "STANDARD"]), ("small", ["SMALL"])]
    written = F.when(n == 0, "大型犬").when(n == 1, "中").when(n == 2, "小さい").otherwise("18kg")
    return parts(s, d).select("p_partkey", classify.size("p_type", rules).alias("size"), classify.size(written).alias("japanese"))


@query("parse_age", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '約' || p_size || '歳' WHEN 1 THEN '生後' || p_size || 'ヶ月'
    WHEN 2 THEN '子供' END AS age_text,
  CASE p_size % 4 WHEN 0 THEN p_size * 12 WHEN 1 THEN p_size END AS age_months FROM part""")
def parse_age(s, d):
    n = c("p_size") % 4
    written = (
        F.when(n == 0, say("推定 約", c("p_size"), "歳くらい")).when(n == 1, say("生後", c("p_size"), "ヶ月"))
        .when(n == 2, "かわいい子猫です").otherwise("不明")
    )
    return parts(s, d).select(
        "p_partkey", classify.age_text(written).alias("age_text"), classify.age_months(written).alias("age_months")
    )


@query("age_bucket", """
SELECT p_partkey, CASE WHEN p_size - 1 < 1 THEN 'kitten' WHEN p_size - 1 >= 7 THEN 'senior' ELSE 'adult' END AS bucket FROM part""")
def age_bucket(s, d):
    return parts(s, d).select("p_partkey", classify.age_bucket(c("p_size") - 1).alias("bucket"))


@query("tri_state", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'not_tested' ELSE 'unknown' END AS result,
  CASE WHEN p_type = 'LARGE' THEN 'positive' WHEN p_type = 'SMALL' THEN 'negative' ELSE 'unknown' END AS own FROM part""")
def tri_state(s, d):
    n = c("p_size") % 4
    written = F.when(n == 0, "FIV 陰性").when(n == 1, "FIV 陽性").when(n == 2, "検査 未実施")
    return parts(s, d).select(
        "p_partkey", classify.test_result(written).alias("result"),
        classify.test_result("p_type", [("positive", ["LARGE"]), ("negative", ["SMALL"])]).alias("own"),
    )


# ---- dates ----------------------------------------------------------------------

@query("parse_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def parse_dates(s, d):
    day, n = c("o_orderdate"), c("o_orderkey") % 6
    f = lambda p: F.date_format(day, p)
    written = (
        F.when(n == 0, f("'収容日 'yyyy年M月d日")).when(n == 1, f("yyyy-M-d")).when(n == 2, f("yyyy/MM/dd 10:00"))
        .when(n == 3, F.translate(f("yyyy年M月d日"), "0123456789", "０１２３４５６７８９"))
        .when(n == 4, say("平成", F.year(day) - 1988, f("年M月d日"))).otherwise(f("M-d"))
    )
    return R.table(s, d, "orders").select("o_orderkey", dates.parse_date(written).alias("parsed"))


@query("month_date", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def month_date(s, d):
    return R.table(s, d, "orders").select(
        "o_orderkey", dates.month_date(F.date_format("o_orderdate", "yyyy年M月'頃'")).alias("month")
    )


@query("era_date", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN CAST(o_orderdate + INTERVAL 30 YEAR AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day
FROM orders""")
def era_date(s, d):
    n = c("o_orderkey") % 3
    later = F.add_months("o_orderdate", 360)
    written = (
        F.when(n == 0, say("平成", F.year("o_orderdate") - 1988, F.date_format("o_orderdate", "年M月d日")))
        .when(n == 1, say("H", F.year("o_orderdate") - 1988, F.date_format("o_orderdate", ".M.d")))
        .otherwise(say("R", F.year(later) - 2018, F.date_format(later, ".M.d")))
    )
    return R.table(s, d, "orders").select("o_orderkey", dates.era_date(written).alias("day"))


@query("filename_date", """
SELECT page_id, CAST('2024-03-01' AS DATE) + CAST(page_id % 300 AS INTEGER) AS from_name,
  CAST('2024-03-01' AS DATE) + CAST(page_id % 300 AS INTEGER) AS from_code FROM pages""")
def filename_date(s, d):
    day = F.date_add(F.lit("2024-03-01").cast("date"), (c("page_id") % 300).cast("int"))
    name = say(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), "/jotof", F.date_format(day, "yyMMdd"), "01.jpg")
    code = say("nagoya-", F.date_format(day, "yyMMdd"))
    return R.table(s, d, "pages").select(
        "page_id", dates.code_date(name).alias("from_name"), dates.code_date(code, r"-([0-9]{6})$").alias("from_code")
    )


@query("fullwidth_digits", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '号' AS key FROM orders")
def fullwidth_digits(s, d):
    wide = F.translate(c("o_orderkey").cast("string"), "0123456789", "０１２３４５６７８９")
    return R.table(s, d, "orders").select("o_orderkey", text.half_width(say(wide, "号")).alias("key"))


@query("jst_stamp", """
SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d_%H%M%S') AS stamp,
  strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S.%g') || '+09:00' AS iso,
  CASE WHEN event_id % 7 > 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y%m%d_%H%M%S') END AS moved FROM events""")
def jst_stamp(s, d):
    legacy = F.when(c("event_id") % 7 == 0, "20240101-000000").otherwise(F.date_format("ts", "yyyyMMdd_HHmmss"))
    ts = c("ts").cast("timestamp")
    return R.table(s, d, "events").select(
        "event_id", dates.jst_stamp(ts).alias("stamp"), dates.jst_iso(ts).alias("iso"), dates.legacy_stamp_to_jst(legacy).alias("moved")
    )


# ---- text -----------------------------------------------------------------------

@query("clean_text", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS t FROM a),
f AS (SELECT page_id, regexp_replace(t, '(?s)<footer>.*?</footer>', '', 'g') AS t FROM b),
e AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM f)
SELECT page_id, trim(regexp_replace(t, '[ \t\r\n　]+', ' ', 'g')) AS clean FROM e""")
def clean_text(s, d):
    body = text.drop_block(text.strip_code("html"), "<footer>", "</footer>")
    return R.table(s, d, "pages").select(
        "page_id", text.collapse_spaces(text.strip_invisible(text.strip_tags(body))).alias("clean")
    )


@query("bracket_fields", """
SELECT p_partkey, p_brand AS inside, p_name AS outside, p_type AS note FROM part""")
def bracket_fields(s, d):
    t = say(c("p_name"), "（", c("p_brand"), "）", "【", c("p_type"), "】")
    rest = text.without_brackets(text.without_brackets(t), "【", "】")
    return parts(s, d).select(
        "p_partkey", text.bracketed(t).alias("inside"), rest.alias("outside"), text.bracketed(t, "【", "】").alias("note")
    )


@query("default_name", """
SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN CASE p_partkey % 3 WHEN 0 THEN '保護猫' WHEN 1 THEN '保護犬' ELSE '保護動物' END || p_partkey
  ELSE p_name END AS name FROM part""")
def default_name(s, d):
    from ..operators.load import default_name as named

    n, k = c("p_size") % 3, c("p_partkey") % 3
    written = F.when(n == 0, "").when(n == 1, "保護動物7号").otherwise(c("p_name"))
    kind = F.when(k == 0, "cat").when(k == 1, "dog").otherwise("unknown")
    return parts(s, d).select("p_partkey", named(written, kind, c("p_partkey")).alias("name"))


@query("slug_key", """
SELECT p_partkey, 'fx-' || lower(regexp_replace(p_name || '/' || p_brand, '[^a-zA-Z0-9]', '-', 'g')) AS key FROM part""")
def slug_key(s, d):
    return parts(s, d).select("p_partkey", text.slug("fx-", say(c("p_name"), "/", c("p_brand"))).alias("key"))


@query("basename_key", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)
SELECT page_id, regexp_replace(regexp_extract(u, '[^/]*$'), '\.[A-Za-z0-9]+$', '') AS key FROM p""")
def basename_key(s, d):
    return R.table(s, d, "pages").select("page_id", text.base_name("url").alias("key"))


@query("path_key", r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site,
  nullif(regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1), '') AS area,
  nullif(regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1), '') || '/f' || page_id AS partition_key FROM pages""")
def path_key(s, d):
    area = urls.path_part("url", 1)
    file = say("/srv/data/html/", area, "/f", c("page_id"), "/20240101_000000_page1.html")
    return R.table(s, d, "pages").select(
        "page_id", urls.site("url").alias("site"), area.alias("area"), urls.partition_key(file).alias("partition_key")
    )


@query("absolutize_url", r"""
WITH b AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, regexp_extract(url, '^[a-z]+', 0) AS scheme,
  regexp_extract(url, '^[a-z]+://[^/]+', 0) AS site FROM pages),
f AS (SELECT *, regexp_replace(u, '[^/]*$', '') AS folder FROM b),
v AS (SELECT *, CASE WHEN length(folder) > length(site) + 1 THEN regexp_replace(folder, '[^/]+/$', '') ELSE folder END AS up FROM f)
SELECT page_id, site || '/a/b.png' AS rooted, scheme || '://host.example/c.png' AS scheme_less, 'https://x.example/d.png' AS whole,
  folder || 'e.png' AS bare, folder || 'f.png' AS here, up || 'g.png' AS parent, u || '#top' AS anchor FROM v""")
def absolutize_url(s, d):
    link = lambda x: urls.absolute(F.lit(x), "url")
    return R.table(s, d, "pages").select(
        "page_id", link("/a/b.png").alias("rooted"), link("//host.example/c.png").alias("scheme_less"),
        link("https://x.example/d.png").alias("whole"), link("e.png").alias("bare"), link("./f.png").alias("here"),
        link("../g.png").alias("parent"), link("#top").alias("anchor"),
    )


@query("normalize_images", """
SELECT p_partkey, 'a' || p_partkey || '.jpg|b' || p_size || '.jpg' AS images, 2 AS n, 'a' || p_partkey || '.jpg' AS thumbnail,
  'b' || p_size || '.jpg' AS gallery FROM part""")
def normalize_images(s, d):
    raw = F.array(
        say("a", c("p_partkey"), ".jpg"), say('{"url":"b', c("p_size"), '.jpg","alt":""}'), F.lit(None).cast("string"),
        F.lit('{"alt":"x"}'), F.lit(""),
    )
    p = parts(s, d).select("p_partkey", urls.image_urls(raw).alias("urls"))
    return p.select(
        "p_partkey", F.array_join("urls", "|").alias("images"), F.size("urls").alias("n"),
        F.get("urls", F.lit(0)).alias("thumbnail"), F.array_join(F.slice("urls", 2, 3), "|").alias("gallery"),
    )


LINES_SQL = "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"


@query("array_cap", f"{LINES_SQL} SELECT doc_id, array_to_string(ls[1:5], '|') AS first_five, least(len(ls), 5) AS n FROM l")
def array_cap(s, d):
    five = F.slice(F.split("text", "\n"), 1, 5)
    return docs(s, d).select("doc_id", F.array_join(five, "|").alias("first_five"), F.size(five).alias("n"))


@query("array_pick", f"{LINES_SQL} SELECT doc_id, ls[1] AS first, array_to_string(ls[2:4], '|') AS next_three FROM l")
def array_pick(s, d):
    ls = F.split("text", "\n")
    return docs(s, d).select("doc_id", F.get(ls, F.lit(0)).alias("first"), F.array_join(F.slice(ls, 2, 3), "|").alias("next_three"))


@query("extract_quantity", """
SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN round(p_retailprice, 1) END AS kg, CASE WHEN p_size % 4 = 3 THEN '不明' ELSE 'given' END AS label
FROM part""")
def extract_quantity(s, d):
    n, kg = c("p_size") % 4, F.format_string("%.1f", F.round("p_retailprice", 1))
    written = F.when(n == 0, say("体重 ", kg, "kg")).when(n == 1, say("中型（", kg, "キログラム）")).when(n == 2, say(kg, " kg くらい")).otherwise("中型")
    return parts(s, d).select(
        "p_partkey", records.weight_kg(written).alias("kg"),
        F.when(records.weight_label(written) == "不明", "不明").otherwise("given").alias("label"),
    )


@query("flag_phrase", """
SELECT doc_id, nullif(concat_ws('、', CASE WHEN contains(text, 'the') THEN '去勢済' END, CASE WHEN contains(text, 'der') THEN 'チップ有' END,
  CASE WHEN contains(text, 'que') THEN 'ワクチン済' END), '') AS phrase FROM documents""")
def flag_phrase(s, d):
    return docs(s, d).select(
        "doc_id", text.flag_phrase("text", [("the", "去勢済"), ("der", "チップ有"), ("que", "ワクチン済")]).alias("phrase")
    )


@query("ocr_repair", """
SELECT p_partkey, '性別:メス ' || p_size || 'ヵ月 陰性 避妊 推定' AS fixed, p_size || '0' AS number,
  replace(replace(p_name, 'bolt', 'volt'), 'old', 'new') AS own FROM part""")
def ocr_repair(s, d):
    return parts(s, d).select(
        "p_partkey", text.repair(say("性別:メメス ", c("p_size"), "カ月 誰性 部妊 准定")).alias("fixed"),
        text.digits_misread_as_letters(say(c("p_size"), "O")).alias("number"),
        text.repair("p_name", [("bolt", "volt"), ("old", "new")]).alias("own"),
    )


@query("keyword_context", """
SELECT doc_id, nullif(trim(regexp_extract(text, '[^.]{0,20}with[^.]{0,20}')), '') AS around_with,
  coalesce(nullif(trim(regexp_extract(text, '[^.]{0,30}License[^.]{0,30}')), ''), nullif(trim(regexp_extract(text, '[^.]{0,30}thon[^.]{0,30}')), '')) AS first_found
FROM documents""")
def keyword_context(s, d):
    return docs(s, d).select(
        "doc_id", text.keyword_context("text", "with", 20, ".").alias("around_with"),
        text.first_context("text", ["License", "thon"], 30, ".").alias("first_found"),
    )


@query("fragment_concat", """
SELECT doc_id, nullif(concat_ws('; ', nullif(trim(regexp_extract(text, '[^.]{0,20}the[^.]{0,20}')), ''),
  nullif(trim(regexp_extract(text, '[^.]{0,20}der[^.]{0,20}')), ''), nullif(trim(regexp_extract(text, '[^.]{0,20}que[^.]{0,20}')), '')), '') AS fragments
FROM documents""")
def fragment_concat(s, d):
    return docs(s, d).select("doc_id", text.all_contexts("text", ["the", "der", "que"], 20, "; ", ".").alias("fragments"))


@query("first_keyword", """
SELECT doc_id, CASE WHEN contains(text, 'with') THEN 'with' WHEN contains(text, 'que') THEN 'que' WHEN contains(text, 'die') THEN 'die' END AS by_list,
  nullif(regexp_extract(text, '(with|que|die)'), '') AS by_text FROM documents""")
def first_keyword(s, d):
    words = ["with", "que", "die"]
    return docs(s, d).select(
        "doc_id", text.first_keyword("text", words).alias("by_list"), text.first_in_text("text", words).alias("by_text")
    )


@query("labelled_fields", """
SELECT p_partkey, p_name AS name, p_type AS breed, p_size || '歳' AS age, 'オス' AS gender, p_brand AS color, '日本' AS kept,
  CAST(NULL AS VARCHAR) AS cut FROM part""")
def labelled_fields(s, d):
    t = say("仮名", c("p_name"), "種類：", c("p_type"), "推定年齢", c("p_size"), "歳性別オス毛色: ", c("p_brand"), "更新日2025")
    get = lambda *names: text.labelled(t, names)
    other = say("品種日本毛色白")
    return parts(s, d).select(
        "p_partkey", get("仮名", "名前").alias("name"), get("種類", "品種").alias("breed"), get("推定年齢", "年齢").alias("age"),
        get("性別").alias("gender"), get("毛色").alias("color"), text.labelled(other, ["品種"]).alias("kept"),
        text.labelled(other, ["品種"], char_class_stop=True).alias("cut"),
    )


@query("label_lines", """
SELECT p_partkey, p_name AS name, p_type AS breed, p_brand AS color, CAST(NULL AS VARCHAR) AS age, 4 AS n FROM part""")
def label_lines(s, d):
    from ..functions import html

    t = say("性別：オス\n1. 名前／", c("p_name"), "\n【種類】", c("p_type"), "\nただの行\n毛色: ", c("p_brand"))
    p = parts(s, d).select("p_partkey", html.label_pairs(t).alias("e"))
    get = lambda *names: html.field("e", names)
    return p.select(
        "p_partkey", get("名前").alias("name"), get("種類").alias("breed"), get("毛色").alias("color"), get("年齢").alias("age"),
        F.size("e").alias("n"),
    )


@query("classify_parts", """
SELECT p_partkey, p_name AS breed, p_size || '才齢（推定）' AS age, CASE WHEN p_size % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
  p_brand AS color, CASE p_size % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' ELSE 'small' END AS size,
  CAST(p_size AS DOUBLE) + 0.5 AS weight_kg, CASE WHEN p_size % 2 = 0 THEN '去勢済み' ELSE '避妊済み' END AS neutered, p_type AS personality
FROM part""")
def classify_parts(s, d):
    n, even = c("p_size") % 3, c("p_size") % 2 == 0
    t = say(
        c("p_name"), "、", c("p_size"), "才齢（推定）、", F.when(even, "オス").otherwise("メス"), "、", c("p_brand"), "、",
        F.when(n == 0, "大型").when(n == 1, "中型").otherwise("小型"), "（", c("p_size"), ".5キログラム）、", c("p_type"), "、",
        F.when(even, "去勢済み").otherwise("避妊済み"),
    )
    return parts(s, d).select("p_partkey", records.delimited_attributes(t).alias("r")).select("p_partkey", "r.*")


@query("expand_counts", """
WITH g AS (SELECT p_partkey, p_size % 4 AS m, p_size % 3 AS f FROM part),
e AS (SELECT p_partkey, m, f, unnest(CASE WHEN m + f = 0 THEN ['male'] ELSE list_concat(list_transform(range(m), lambda x: 'male'), list_transform(range(f), lambda x: 'female')) END) AS gender,
  generate_subscripts(CASE WHEN m + f = 0 THEN ['male'] ELSE list_concat(list_transform(range(m), lambda x: 'male'), list_transform(range(f), lambda x: 'female')) END, 1) AS position FROM g)
SELECT p_partkey, CAST(position AS INTEGER) AS position, gender,
  CASE WHEN greatest(m + f, 1) <= 2 THEN CASE position WHEN 1 THEN 'HC' || p_partkey ELSE '99' END
       WHEN position = 2 THEN '99-2' ELSE 'HC' || p_partkey || '-' || position END AS external_id
FROM e UNION ALL SELECT p_partkey, 2, 'unknown', '99' FROM g WHERE greatest(m + f, 1) = 1""")
def expand_counts(s, d):
    m, f = c("p_size") % 4, c("p_size") % 3
    genders = records.gender_counts(F.when(m + f == 0, "オス").otherwise(say("オス：", m, "匹、メス:", f, "匹")))
    ids = records.id_list(say("管理番号：HC", c("p_partkey"), ".99(松岡)"))
    return parts(s, d).select("p_partkey", F.inline(records.zip_ids(ids, genders))).select("p_partkey", "position", "gender", "external_id")


@query("zip_lists", r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '') AS w FROM documents),
z AS (SELECT doc_id, len(w) AS n, unnest(w) AS id, generate_subscripts(w, 1) AS position FROM t)
SELECT doc_id, CAST(position AS INTEGER) AS position, CASE WHEN n = 1 THEN id || '-1' ELSE id END AS external_id,
  CASE WHEN position <= 2 THEN 'male' ELSE 'unknown' END AS gender FROM z
UNION ALL SELECT doc_id, 2, w[1] || '-2', 'male' FROM t WHERE len(w) = 1""")
def zip_lists(s, d):
    """The words of a text as ids, beside two genders."""
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    zipped = records.zip_ids(words, F.array(F.lit("male"), F.lit("male")))
    return docs(s, d).select("doc_id", F.inline(zipped)).select("doc_id", "position", "external_id", "gender")


@query("positional_record", """
SELECT p_partkey, '7東-C' || p_partkey AS external_id, CAST('2025-04-16' AS DATE) AS birth_date, '雑種' AS breed, p_brand AS color,
  CASE WHEN p_size % 2 = 0 THEN 'male' ELSE 'female' END AS gender, p_size % 2 = 0 AS neutered,
  CASE p_size % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'not_tested' ELSE 'positive' END AS felv,
  CASE WHEN p_size % 5 = 0 THEN 'negative' ELSE CASE p_size % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'not_tested' ELSE 'positive' END END AS fiv,
  '・' || p_name AS notes FROM part""")
def positional_record(s, d):
    n = c("p_size") % 3
    line = say(
        "7東-C", c("p_partkey"), "   R7.4.16   雑種 ", c("p_brand"),
        F.when(c("p_size") % 2 == 0, "  オス  去勢済 ").otherwise(" メス "),
        F.when(n == 0, "陰性 ").when(n == 1, "検査 未実施  ").otherwise(" 陽性 "),
        F.when(c("p_size") % 5 == 0, "陰性 ").otherwise(""), "・", c("p_name"),
    )
    both = parts(s, d).select("p_partkey", F.explode(F.array(line, F.lit("見出しの行"))).alias("line"))
    r = both.select("p_partkey", records.positional_record("line").alias("r")).filter(c("r").isNotNull())
    return r.select("p_partkey", "r.*")


@query("pair_split", """
SELECT p_partkey, p_size || 'ヵ月以下' AS age, '２０２５年８月７日頃' AS birth, CAST('2025-08-07' AS DATE) AS birth_date,
  p_type AS size, CASE WHEN p_size % 2 = 0 THEN p_size || '.5kg' END AS weight FROM part""")
def pair_split(s, d):
    p = parts(s, d).select(
        "p_partkey", records.outside_inside(say(c("p_size"), "ヵ月以下 (２０２５年８月７日頃)")).alias("a"),
        records.outside_inside(say(c("p_type"), F.when(c("p_size") % 2 == 0, say(" (", c("p_size"), ".5kg)")).otherwise(""))).alias("w"),
    )
    return p.select(
        "p_partkey", c("a.outside").alias("age"), c("a.inside").alias("birth"), dates.parse_date("a.inside").alias("birth_date"),
        c("w.outside").alias("size"), c("w.inside").alias("weight"),
    )


@query("preview", "SELECT doc_id, substring(text, 1, 200) AS preview FROM documents")
def preview(s, d):
    return docs(s, d).select("doc_id", text.preview("text", 200).alias("preview"))


@query("json_columns", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '["u' || user_id || '","' || event_type || '"]' AS images FROM events""")
def json_columns(s, d):
    parsed = F.from_json("props", "struct<k:int>")
    return R.table(s, d, "events").select(
        "event_id", parsed["k"].alias("k"), F.to_json(F.array(say("u", c("user_id")), c("event_type"))).alias("images")
    )


@query("json_map_explode", """
SELECT event_id, 'a' || user_id AS external_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type AS breed FROM events
UNION ALL SELECT event_id, 'b', NULL, 'mix' FROM events""")
def json_map_explode(s, d):
    from ..sources.snapshots import explode_json_map

    doc = say('{"a', c("user_id"), '":{"info":', c("props"), ',"breed":"', c("event_type"), '"},"b":{"breed":"mix"}}')
    e = R.table(s, d, "events").select("event_id", doc.alias("doc"))
    out = explode_json_map(e, "doc", "info:struct<k:int>,breed:string", "external_id")
    return out.select("event_id", "external_id", c("value.info.k").alias("k"), c("value.breed").alias("breed"))


@query("load_defaults", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'unknown' WHEN 'fr' THEN 'unknown' ELSE lang END AS animal_type, 'unknown' AS gender,
  CASE WHEN source = 'src1' THEN 'available' ELSE source END AS status, 'adoption' AS listing_type FROM documents""")
def load_defaults(s, d):
    from ..operators.load import with_defaults

    raw = docs(s, d).select(
        "doc_id", F.when(c("lang") == "fr", "").when(c("lang") != "en", c("lang")).alias("animal_type"),
        F.lit(None).cast("string").alias("gender"), F.when(c("source") != "src1", c("source")).alias("status"), F.lit("").alias("listing_type"),
    )
    return with_defaults(raw)


@query("line_rules", """
SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS external_id, p_name AS name,
  CASE p_size % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender FROM part""")
def line_rules(s, d):
    n = c("p_size") % 3
    t = say("No.", c("p_partkey"), "\n", c("p_name"), F.when(n == 0, "（オス）").when(n == 1, "\n").otherwise(""),
            "\n", F.when(n == 1, say(c("p_name"), " （メス）！")).otherwise(""))
    r = parts(s, d).select("p_partkey", records.card_lines(t).alias("r")).select("p_partkey", "r.*")
    return r.withColumn("name", F.replace("name", F.lit(" ！"), F.lit("")))


@query("mention_counts", """
SELECT doc_id, len(regexp_extract_all(text, 'the|and')) AS gender, len(regexp_extract_all(text, '[0-9]+')) AS age,
  len(regexp_extract_all(text, 'que|der')) AS breed FROM documents""")
def mention_counts(s, d):
    from ..operators.quality import mentions

    return docs(s, d).select("doc_id", *mentions("text", {"gender": "the|and", "age": "[0-9]+", "breed": "que|der"}))


@query("next_line_flag", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(contains(nxt, 'the') OR contains(nxt, 'License'), false) AS flag FROM n
WHERE regexp_matches(line, '^[A-D]')""")
def next_line_flag(s, d):
    found = records.next_line_flag("text", "^[A-D]", ["the", "License"])
    return docs(s, d).select("doc_id", F.inline(found)).select("doc_id", "line_no", "flag")


@query("line_segments", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
k AS (SELECT *, regexp_extract(line, '^([A-D][a-z]+)') AS id FROM l),
g AS (SELECT *, sum(CASE WHEN id <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS seg FROM k)
SELECT doc_id, CAST(seg AS INTEGER) AS segment_no, max(CASE WHEN id <> '' THEN id END) AS id,
  trim(regexp_replace(string_agg(CASE WHEN id <> '' THEN regexp_replace(line, '^[A-D][a-z]+', '') ELSE line END, ' ' ORDER BY no), '\s+', ' ', 'g')) AS body
FROM g WHERE seg > 0 GROUP BY doc_id, seg""")
def line_segments(s, d):
    return docs(s, d).select("doc_id", F.inline(records.segments("text", "[A-D][a-z]+"))).select("doc_id", "segment_no", "id", "body")


@query("text_sections", r"""
WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(the|der|que)', chr(1) || '\1', 'g'), chr(1))) AS section FROM documents)
SELECT doc_id, section FROM p WHERE regexp_matches(section, 'the|der|que') AND length(section) > 20 AND length(section) < 2000""")
def text_sections(s, d):
    found = records.keyword_sections("text", ["the", "der", "que"], longest=2000)
    return docs(s, d).select("doc_id", F.explode(found).alias("section"))


@query("labelled_sections", """
SELECT p_partkey, n AS section_no, p_name || n AS name, '推定' || p_size || '歳' AS age_estimate,
  CASE WHEN p_size % 2 = 0 THEN 'male' ELSE 'female' END AS gender, p_brand AS color,
  CASE WHEN p_size % 2 = 0 THEN '去勢手術済' ELSE '未避妊' END AS health_status, replace(p_type, ' ', '') AS personality
FROM part, (VALUES (0), (1)) t(n)""")
def labelled_sections(s, d):
    even = c("p_size") % 2 == 0
    wide = F.translate(c("p_size").cast("string"), "0123456789", "０１２３４５６７８９")
    one = lambda i: say(
        "\n  ", F.when(c("p_size") % 3 == 0, "年齢").otherwise("推定年齢"), "    推定", wide, "歳\n仮名 ", c("p_name"), str(i),
        " 性別 ", F.when(even, "オス").otherwise("メス"), "\n色柄 ", c("p_brand"), "\n", F.when(even, "去勢済").otherwise("未避妊"),
        "\n性格 ", c("p_type"), "\n",
    )
    t = say("見出し", one(0), one(1))
    e = parts(s, d).select("p_partkey", F.posexplode(records.labelled_sections(t)).alias("section_no", "section"))
    r = e.select("p_partkey", "section_no", records.document_section("section").alias("r"))
    return r.select(
        "p_partkey", "section_no", "r.name", "r.age_estimate", "r.gender", "r.color", "r.health_status", "r.personality"
    )


@query("ocr_text_records", """
SELECT p_partkey, 'labelled' AS layout, CAST(1000 + p_partkey % 9000 AS VARCHAR) AS inquiry_number, 'cat' AS animal_type, replace(p_type, ' ', '') AS breed,
  replace(p_brand, ' ', '') AS color, CASE WHEN p_size % 2 = 0 THEN 'female' ELSE 'male' END AS gender, p_size || 'ヵ月' AS age_estimate,
  '猫エイズ検査:陰性' AS health_status, '活発です' AS personality FROM part
UNION ALL SELECT p_partkey, 'prose', '10' || (p_partkey % 10), 'cat', NULL, NULL, CASE WHEN p_size % 2 = 0 THEN 'female' ELSE 'male' END,
  p_size || '歳', CASE WHEN p_size % 2 = 0 THEN '避妊手術済' ELSE '去勢手術済' END || '、ワクチン接種済',
  CASE WHEN p_size % 3 = 0 THEN '怖がりで静かな子です' ELSE '甘えん坊で活発な性格です' END FROM part
UNION ALL SELECT p_partkey, 'slashed', NULL, 'cat', p_brand, p_type, CASE WHEN p_size % 2 = 0 THEN 'female' ELSE 'male' END,
  '推定' || p_size || '歳', CASE WHEN p_size % 2 = 0 THEN '避妊手術済' ELSE '去勢手術済' END || '、FIV/FeLV陰性', NULL FROM part""")
def ocr_text_records(s, d):
    even, n = c("p_size") % 2 == 0, c("p_size")
    written = {
        "labelled": say("お 問 合 せ ", c("p_partkey") % 9000 + 1000, "\n猫 種: ", c("p_type"), "。\n毛 色: ", c("p_brand"), "\n性 別: ",
                        F.when(even, "メメス").otherwise("オス"), "\n年 齢: ", n, " カ月\n猫エイズ検査: 誰性\n性 格: 活発 です\n"),
        "prose": say("お 問 合 せ 番 号 一 1O", c("p_partkey") % 10, "\n推 定 ", n, " 歳 ", F.when(even, "避 妊 手 術 済 メ ス、オス猫は苦手").otherwise("去 勢 手 術 済 オ ス"),
                     "\n混 合 ワクチン\n", F.when(n % 3 == 0, "怖が り で静かな 子 で す。").otherwise("とても甘えん坊で 活発な 性 格 で す。")),
        "slashed": say("名前 ", c("p_brand"), " / ", F.when(even, "女 の 子 (部妊済)").otherwise("男の子 (去勢済)"), " / 准定 ", n, " 歳 / ", c("p_type"),
                       " FIV / FeLV 陰 性"),
    }
    p, out = parts(s, d), None
    for layout, t in written.items():
        r = p.select("p_partkey", F.lit(layout).alias("layout"), records.recognised(t, layout).alias("r")).select(
            "p_partkey", "layout", "r.inquiry_number", "r.animal_type", "r.breed", "r.color", "r.gender", "r.age_estimate",
            "r.health_status", "r.personality",
        )
        out = r if out is None else out.unionByName(r)
    return out
