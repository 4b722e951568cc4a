"""Page corpus queries.

The test pages have no tables, images or sub-headings.  Queries about those
write each row of a table as a small page and read it back; the SQL twin
states what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import classify, html as H, urls
from ..functions.text import strip_code
from ..operators import pages as P, quality as Q
from ..operators.containment import contains_join
from ..session import dealt
from . import roles as R
from .registry import query

c = F.col


def pages(s, d):
    return R.table(s, d, "pages")


def parts(s, d):
    """Dealt, since each small row is written as a page or text and read back."""
    return dealt(R.table(s, d, "part"), "p_partkey")


def say(*pieces):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in pieces])


CODELESS = r"""WITH code AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS h FROM pages)"""


def unnest(expr: str, keep: str, source: str, value: str = "x", pos: str = "n") -> str:
    return f"SELECT {keep}, unnest({expr}) AS {value}, generate_subscripts({expr}, 1) - 1 AS {pos} FROM {source}"


# ---- tokens, containers, sections --------------------------------------------------

@query("page_tokens", f"""{CODELESS}, t AS ({unnest("regexp_extract_all(h, '<[^>]+>|[^<]+')", "page_id", "code", "token", "pos")})
SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN starts_with(token, '</') THEN 'close' WHEN regexp_matches(token, '^<[a-zA-Z]') THEN 'open'
  WHEN starts_with(token, '<') THEN 'other' ELSE 'text' END AS kind, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag,
  length(token) AS n FROM t""")
def page_tokens(s, d):
    return P.token_table(pages(s, d)).select("page_id", "pos", "kind", "tag", F.length("token").alias("n"))


@query("select_elements", r"""
WITH e AS (SELECT page_id, 0 AS selector, regexp_extract(html, '(?s)<div class="ad">.*?</div>') AS element FROM pages
  UNION ALL SELECT page_id, 1, regexp_extract(html, '(?s)<article>.*?</article>') FROM pages)
SELECT page_id, selector, 0 AS n, element FROM e WHERE element <> ''""")
def select_elements(s, d):
    return P.select(pages(s, d), [("div", ["ad", "banner"]), ("article", [])])


@query("select_nested", """
SELECT p_partkey, n, element FROM (
  SELECT p_partkey, 0 AS n, '<div class="data_box x"><div>' || p_name || '</div><div class="pet-item">' || p_brand || '</div></div>' AS element FROM part
  UNION ALL SELECT p_partkey, 1, '<div class="pet-item">' || p_brand || '</div>' FROM part)""")
def select_nested(s, d):
    """A container ends at its own closing tag; one in another counts too."""
    body = say('<p>x</p><div><div class="data_box x"><div>', c("p_name"), '</div><div class="pet-item">', c("p_brand"), "</div></div></div>")
    page = parts(s, d).select("p_partkey", body.alias("html"))
    return P.first_selector(page, [("section", ["none"]), ("div", ["data_box", "pet-item"])], "p_partkey")


TEXT = lambda x: rf"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({x},
  '(?i)<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'),
  '[ \t\r\n　]+', ' ', 'g'))"""


@query("heading_sections", rf"""
WITH m AS (SELECT page_id, regexp_replace(html, '(?i)(<(?:h1|footer)[\s>/])', chr(1) || '\1', 'g') AS h FROM pages),
p AS ({unnest("string_split(h, chr(1))[2:]", "page_id", "m", "x", "section_no")})
SELECT page_id, CAST(section_no AS INTEGER) AS section_no,
  {TEXT("regexp_extract(x, '(?is)^<[^>]*>(.*?)(?:</(?:h1|footer)[ ]*>|$)', 1)")} AS heading,
  {TEXT("regexp_extract(x, '(?is)^<[^>]*>.*?</(?:h1|footer)[ ]*>(.*)$', 1)")} AS text, 0 AS images FROM p""")
def heading_sections(s, d):
    t = P.section_table(pages(s, d), "h1|footer")
    return t.select("page_id", "section_no", "heading", "text", F.size("images").alias("images"))


@query("section_state", """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS state FROM conversations""")
def section_state(s, d):
    """A user's turn sets the state, the turns after it inherit it."""
    rows = R.table(s, d, "conversations")
    value = F.when(c("role") == "user", c("text"))
    return P.inherit(rows, ["conv_id"], "turn", value, "state").select("conv_id", "turn", "role", "state")


@query("section_elements", """
SELECT p_partkey, 'dog' AS kind, p_name AS element FROM part UNION ALL SELECT p_partkey, 'dog', p_type FROM part
UNION ALL SELECT p_partkey, 'cat', p_brand FROM part""")
def section_elements(s, d):
    body = say("<li>menu</li><h2>譲渡犬紹介</h2><ul><li>", c("p_name"), "<li>", c("p_type"), "</ul><h2>保護猫</h2><ul><li>", c("p_brand"), "</li></ul>")
    e = P.section_elements(parts(s, d).select("p_partkey", body.alias("html")), "li", "h2", "p_partkey")
    return e.select("p_partkey", classify.species_of_heading("heading").alias("kind"), H.plain("element").alias("element"))


@query("preceding_element", """
SELECT p_partkey, n, anchor, preceding FROM (
  SELECT p_partkey, 0 AS n, '<table id="0">' AS anchor, CAST(NULL AS VARCHAR) AS preceding FROM part
  UNION ALL SELECT p_partkey, 1, '<table id="1">', '<img src="' || p_partkey || '.png">' FROM part
  UNION ALL SELECT p_partkey, 2, '<table id="2">', '<img src="' || p_size || '.png">' FROM part
  UNION ALL SELECT p_partkey, 3, '<table id="3">', '<img src="' || p_size || '.png">' FROM part)""")
def preceding_element(s, d):
    img = lambda x: say('<img src="', x, '.png">')
    body = say('<table id="0"></table>', img(c("p_partkey")), '<table id="1"><p>x</table>', img(F.lit("skipped")), img(c("p_size")),
               '<table id="2"></table><p>text</p><table id="3"></table>')
    return P.nearest_preceding(parts(s, d).select("p_partkey", body.alias("html")), "img", "table", "p_partkey")


# ---- tables on pages ----------------------------------------------------------------

@query("kv_table", """
SELECT p_partkey, p_name AS name, p_type AS breed, p_brand AS below, 'dl-' || p_size AS listed, CAST(NULL AS VARCHAR) AS absent FROM part""")
def kv_table(s, d):
    """th/td pairs, a key row above a value row, and dt/dd pairs."""
    th = say("<table><tr><th>仮名</th><td><b>", c("p_name"), "</b></td></tr><tr><th scope=row>種類 </th>\n<td>", c("p_type"), "</td></tr></table>")
    stacked = say("<table><tr><td>毛色<td>性別</tr><tr><td>", c("p_brand"), "</td><td>オス</td></tr></table>")
    dl = say("<dl><dt>年齢</dt><dd>dl-", c("p_size"), "</dd></dl>")
    p = parts(s, d).select(
        "p_partkey", H.pairs(th).alias("a"), H.stacked_pairs(stacked).alias("b"), H.pairs(dl, "dt", "dd").alias("l")
    )
    return p.select(
        "p_partkey", H.field("a", ["仮名", "名前"]).alias("name"), H.field("a", ["種類"]).alias("breed"), H.field("b", ["毛色"]).alias("below"),
        H.field("l", ["年齢"]).alias("listed"), H.field("a", ["体重"]).alias("absent"),
    )


@query("positional_table", """
SELECT p_partkey, 1 AS row_no, p_name AS name, p_type AS kind, p_brand AS note FROM part
UNION ALL SELECT p_partkey, 2, p_name || '2', NULL, p_brand FROM part""")
def positional_table(s, d):
    """A header row, rows of three cells, rows of two (no kind), too short rows."""
    body = say(
        "<table><tr><th>名<th>種<th>備考</tr><tr><td>", c("p_name"), "<td>", c("p_type"), "</td><td>", c("p_brand"), "</td></tr>",
        "<tr><td>", c("p_name"), "2</td><td>", c("p_brand"), "</td></tr><tr><td>空</td></tr></table>",
    )
    r = parts(s, d).select("p_partkey", F.posexplode(H.grid(body)).alias("row_no", "cells")).filter((c("row_no") > 0) & (F.size("cells") >= 2))
    three = F.size("cells") >= 3
    at = lambda i: F.get("cells", F.lit(i))
    return r.select(
        "p_partkey", "row_no", at(0).alias("name"), F.when(three, at(1)).alias("kind"), F.when(three, at(2)).otherwise(at(1)).alias("note")
    )


@query("table_transpose", """
SELECT p_partkey, n, CASE n WHEN 0 THEN p_name WHEN 1 THEN p_type END AS name, CASE n WHEN 0 THEN p_brand WHEN 1 THEN 'b' || p_size END AS color,
  CASE n WHEN 0 THEN 'male' ELSE 'unknown' END AS gender FROM part, (VALUES (0), (1)) t(n)""")
def table_transpose(s, d):
    """One row per attribute, one column per record; the last row is short."""
    body = say("<table><tr><td>", c("p_name"), "<td>", c("p_type"), "</tr><tr><td>", c("p_brand"), "</td><td>b", c("p_size"), "</td></tr><tr><td>オス</td></tr></table>")
    r = parts(s, d).select("p_partkey", F.posexplode(H.transpose(H.grid(body))).alias("n", "v"))
    at = lambda i: F.get("v", F.lit(i))
    return r.select("p_partkey", "n", at(0).alias("name"), at(1).alias("color"), classify.gender(F.coalesce(at(2), F.lit(""))).alias("gender"))


@query("table_merge", """
SELECT p_partkey, n, 'K' || n AS key, CASE n WHEN 1 THEN p_name ELSE p_type END AS name, CASE n WHEN 2 THEN p_brand || '.png' END AS photo
FROM part, (VALUES (1), (2)) t(n)""")
def table_merge(s, d):
    """An information table and a photo table of the same page, matched by key."""
    info = say("<table><tr><td>K1<td>", c("p_name"), "</tr><tr><td>K2</td><td>", c("p_type"), "</td></tr></table>")
    photo = say("<table><tr><td>K9<td>x.png</tr><tr><td>K2<td>", c("p_brand"), ".png</tr><tr><td>K2<td>late.png</tr></table>")
    m = parts(s, d).select("p_partkey", F.posexplode(P.merge_grids(H.grid(info), H.grid(photo))).alias("i", "m"))
    at = lambda x, i: F.get(c(x), F.lit(i))
    return m.select("p_partkey", (c("i") + 1).alias("n"), at("m.row", 0).alias("key"), at("m.row", 1).alias("name"), at("m.photo", 1).alias("photo"))


# ---- links, images, headings ---------------------------------------------------------

ANCHORS = unnest("""regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)""", "page_id, url, html", "pages", "href", "n")


@query("link_records", f"""WITH a AS ({ANCHORS}),
t AS ({unnest("regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)", "page_id", "pages", "text", "n")})
SELECT a.page_id, CAST(a.n AS INTEGER) AS n, regexp_extract(url, '^[a-z]+://[^/?#]+') || href AS href, trim(t.text) AS text
FROM a JOIN t ON a.page_id = t.page_id AND a.n = t.n""")
def link_records(s, d):
    return P.links(pages(s, d))


@query("harvest_links", f"""WITH a AS ({ANCHORS})
SELECT page_id, count(*) AS links, count(DISTINCT href) AS distinct_links, min(regexp_extract(url, '^[a-z]+://[^/?#]+') || href) AS first_link FROM a GROUP BY 1""")
def harvest_links(s, d):
    hrefs = F.transform(H.open_tags("html", "a"), lambda t: H.attr(t, "href"))
    p = pages(s, d).select("page_id", "url", hrefs.alias("h"))
    return p.filter(F.size("h") > 0).select(
        "page_id", F.size("h").cast("bigint").alias("links"), F.size(F.array_distinct("h")).cast("bigint").alias("distinct_links"),
        urls.absolute(F.array_min("h"), "url").alias("first_link"),
    )


@query("link_filter", f"""WITH a AS ({ANCHORS})
SELECT page_id, CAST(n AS INTEGER) AS n, href FROM a WHERE NOT regexp_matches(href, '(?i)the|tion')""")
def link_filter(s, d):
    a = pages(s, d).select("page_id", F.posexplode(F.transform(H.open_tags("html", "a"), lambda t: H.attr(t, "href"))).alias("n", "href"))
    return a.filter(~urls.is_decorative("href", ["the", "tion"]))


@query("image_list", """
SELECT p_partkey, n, src, alt FROM (
  SELECT p_partkey, 1 AS n, 'https://x.example/a/p' || p_partkey || '.png' AS src, p_name AS alt FROM part
  UNION ALL SELECT p_partkey, 3, 'https://x.example/r.jpg', NULL FROM part)""")
def image_list(s, d):
    body = say('<img src="/logo.png"><img alt="', c("p_name"), '" src=\'p', c("p_partkey"), '.png\'><img src=btn_BUTTON.gif><img src=/r.jpg>')
    p = parts(s, d).select("p_partkey", body.alias("html"), F.lit("https://x.example/a/b.html").alias("url"))
    return P.images(p, "p_partkey")


@query("image_records", """
SELECT p_partkey, 0 AS n, 'https://x.example/' || p_partkey || '.png' AS src, 'C' || p_size AS external_id FROM part""")
def image_records(s, d):
    """Only images between two headings are records; the id is in the alt text."""
    body = say('<img alt="No.1" src="/before.png"><h2>収容猫</h2><img alt="猫 No.C', c("p_size"), ' です" src="/', c("p_partkey"),
               '.png"><img src="/icon.png"><h2>その他</h2><img alt="No.9" src="/after.png">')
    p = parts(s, d).select("p_partkey", body.alias("html"), F.lit("https://x.example/").alias("url"))
    return P.image_records(p, "<h2>収容猫</h2>", "<h2>", r"No\.([A-Z0-9]+)", "p_partkey").select("p_partkey", "n", "src", "external_id")


@query("heading_stoplist", f"""
SELECT page_id, 0 AS n, {TEXT("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading FROM pages
WHERE {TEXT("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} <> '' AND NOT regexp_matches({TEXT("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, 'the|que')""")
def heading_stoplist(s, d):
    return P.headings(pages(s, d), ["the", "que"], "h1")


@query("distinct_matches", """
SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="(/[a-z]+)', 1))) AS n,
  array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="(/[a-z]+)', 1))), ',') AS ids FROM pages""")
def distinct_matches(s, d):
    found = P.distinct_matches("html", 'href="(/[a-z]+)')
    return pages(s, d).select("page_id", F.size(found).alias("n"), F.array_join(F.sort_array(found), ",").alias("ids"))


@query("fallback_ids", """
WITH a AS (SELECT page_id, unnest(generate_series(0, len(regexp_extract_all(html, '<li>')) - 1)) AS n FROM pages WHERE len(regexp_extract_all(html, '<li>')) > 0)
SELECT page_id, CAST(n AS INTEGER) AS n, 'page' || page_id || '_' || n AS external_id FROM a""")
def fallback_ids(s, d):
    li = pages(s, d).select("page_id", F.posexplode(H.elements("html", "li")).alias("n", "li"))
    return li.select("page_id", "n", P.fallback_id(say("page", c("page_id")), c("n")).alias("external_id"))


@query("review_template", """
SELECT 'page-' || page_id AS external_id, 'unknown' AS animal_type, 'unknown' AS gender, CAST(NULL AS VARCHAR) AS breed, url AS image,
  'available' AS status, 'low' AS confidence_level, true AS needs_review FROM pages""")
def review_template(s, d):
    shots = pages(s, d).select(say("page-", c("page_id")).alias("k"), "url")
    return Q.review_rows(shots, "k", "url").select(
        "external_id", "animal_type", "gender", "breed", F.get("images", F.lit(0)).alias("image"), "status", "confidence_level", "needs_review"
    )


# ---- counting and page signals -------------------------------------------------------

@query("count_fallback", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n FROM pages""")
def count_fallback(s, d):
    n = c("page_id") % 5
    extra = (
        F.when(n == 0, "<TR><td>h</tr><tr class=x></tr><tr></tr>").when(n == 1, '<div id="a" class="big card x"></div><tr>')
        .when(n == 2, '<a class="q" href="/detail/1">1</a><a href="detail?2">2</a>').when(n == 3, '<img src="a.png"><img src="icon.png">')
        .otherwise('<img src="logo.png">')
    )
    return pages(s, d).select("page_id", H.record_count(say(c("html"), extra)).alias("n"))


@query("count_best", """
SELECT page_id, greatest(len(regexp_extract_all(html, '<li>')), len(regexp_extract_all(html, '<p>')), len(regexp_extract_all(html, '<b>'))) AS n FROM pages""")
def count_best(s, d):
    return pages(s, d).select("page_id", H.best_count("html", ["<li>", "<p>", "<b>"]).alias("n"))


@query("scoped_count", r"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article>(.*?)</article>', 1) AS x FROM pages)
SELECT page_id, CASE WHEN len(regexp_extract_all(x, '<b>[A-M]')) > 0 THEN len(regexp_extract_all(x, '<b>[A-M]')) ELSE len(regexp_extract_all(x, '<p>')) END AS n FROM a""")
def scoped_count(s, d):
    return pages(s, d).select("page_id", H.scoped_count("html", "<article>", "</article>", "<b>[A-M]", "<p>").alias("n"))


@query("caption_count", """
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS x FROM pages)
SELECT p.page_id, coalesce(CAST(sum(CASE WHEN regexp_matches(x, 'th|de|au') THEN CASE WHEN contains(x, ',') THEN 2 ELSE 1 END ELSE 0 END) AS INTEGER), 0) AS n
FROM pages p LEFT JOIN t ON p.page_id = t.page_id GROUP BY p.page_id""")
def caption_count(s, d):
    return pages(s, d).select("page_id", P.caption_count("html", ["th", "de", "au"], ",").alias("n"))


@query("dynamic_site_score", r"""
WITH f AS (SELECT page_id, page_id % 4 = 0 AS empty_root, length(html) + CASE page_id % 4 WHEN 0 THEN 26 WHEN 1 THEN 36 ELSE 0 END < 5000 AS too_small,
  page_id % 4 = 1 OR regexp_matches(html, '(?i)react|vue|angular') AS spa_framework, true AS missing_content, false AS only_scripts FROM pages)
SELECT page_id, empty_root, too_small, spa_framework, missing_content, only_scripts,
  empty_root::INT + too_small::INT + spa_framework::INT + missing_content::INT + only_scripts::INT AS score,
  empty_root::INT + too_small::INT + spa_framework::INT + missing_content::INT + only_scripts::INT >= 2 AS needs_browser FROM f""")
def dynamic_site_score(s, d):
    n = c("page_id") % 4
    extra = F.when(n == 0, '<div id="__next">\n </div>\n').when(n == 1, '<script src="/react.js"></script>   ').otherwise("")
    p = pages(s, d).select("page_id", H.dynamic_signals(say(c("html"), extra), ["table"]).alias("x"))
    return p.select("page_id", "x.*")


@query("empty_page_flag", f"""SELECT page_id, regexp_matches({TEXT('html')}, 'the onble|que de') AS is_empty FROM pages""")
def empty_page_flag(s, d):
    return pages(s, d).select("page_id", H.is_empty_page("html", ["the onble", "que de"]).alias("is_empty"))


# ---- positions, containment ------------------------------------------------------------

@query("reading_order", r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '') AS ws FROM documents),
f AS (SELECT doc_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS i FROM w),
x AS (SELECT doc_id, text, i // 200 AS page, ((i * 7) % 10) * 100.0 AS x, 800 - (i % 200) // 10 * 12 AS y, i FROM f)
SELECT doc_id, CAST(page AS INTEGER) AS page, CASE WHEN x < 500 THEN 0 ELSE 1 END AS col_no, y AS line_y, string_agg(text, ' ' ORDER BY x) AS line
FROM x GROUP BY ALL""")
def reading_order(s, d):
    """Words of each document scattered on pages of twenty lines in two columns."""
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    # a document becomes hundreds of rows, which a task sorts by line before they are shuffled
    f = dealt(R.table(s, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(words).alias("i", "text"))
    frag = f.select(
        "doc_id", F.floor(c("i") / 200).cast("int").alias("page"), ((c("i") * 7) % 10 * 100.0).alias("x"),
        (800 - F.floor(c("i") % 200 / 10) * 12 + F.when(c("i") % 2 == 0, 0.3).otherwise(-0.4)).alias("y"), "text",
    )
    return P.reading_order(frag)


@query("contains_join", """
SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)
UNION ALL SELECT doc_id, 1000 + k FROM documents d, (VALUES (0, 'src1'), (1, 'the other'), (2, 'License, Version 2.0')) t(k, w) WHERE contains(d.text, w)""")
def contains_join_(s, d):
    """Benchmark passages, and short terms, found in documents."""
    terms = s.createDataFrame([(1000, "src1"), (1001, "the other"), (1002, "License, Version 2.0")], "item_id bigint, text string")
    needles = R.table(s, d, "benchmark").unionByName(terms).withColumnRenamed("text", "needle")
    return contains_join(R.table(s, d, "documents").select("doc_id", "text"), needles, "doc_id", "text", "item_id", "needle")


@query("image_of_record", """
SELECT c.conv_id, c.turn, i.turn AS id_turn FROM conversations c JOIN conversations i ON c.conv_id = i.conv_id
WHERE substring(i.text, 3, 9) <> '' AND contains(c.text, substring(i.text, 3, 9))""")
def image_of_record(s, d):
    """On each page (conversation) all pairs of a caption (turn) and an id of that page that stands in it; the ids are cut
    out of the captions, so each is found at least once."""
    conv = R.table(s, d, "conversations")
    caption = conv.select("conv_id", F.struct("conv_id", "turn").alias("k"), "text")
    ids = conv.select("conv_id", F.struct("conv_id", "turn").alias("r"), F.substring("text", 3, 9).alias("id")).filter("id <> ''")
    found = contains_join(caption, ids, "k", "text", "r", "id", within=["conv_id"])
    return found.select("k.conv_id", "k.turn", F.col("r.turn").alias("id_turn"))


FOOT = '<div class="foot"><p>譲渡しました</p><img src="foot.jpg"><table><tr><td>問合せ</td></tr></table></div></body></html>'
HEAD = '<html><body><div class="head"><img src="head.jpg"></div><div id="main">'


def _extracted(s, d, branches, *more):
    """Pages made of the rows of ``part``, one facility for each branch in turn, with a head and a foot around two records; read
    back by their layouts."""
    from ..operators import extract
    from ..sources import layouts

    n = c("p_partkey") % len(branches)
    which = lambda i: F.coalesce(*[F.when(n == k, v[i] if isinstance(v[i], Column) else F.lit(v[i])) for k, v in enumerate(branches)])
    page = parts(s, d).select(
        "p_partkey", F.lit("https://x.example/a/list.html").alias("url"), which(0).alias("facility"), say(HEAD, which(1), "</div>", FOOT).alias("html"),
    )
    out = extract.listings(page, layouts.catalogue(s))
    return out.select("p_partkey", "external_id", "gender", "status", F.regexp_extract(F.get("images", F.lit(0)), "[^/]+$", 0).alias("image"), F.size("images").alias("n_images"), *more)


def _part_text():
    k = c("p_partkey").cast("string")
    return k, F.when(c("p_size") % 2 == 0, "オス").otherwise("メス"), F.when(c("p_size") % 2 == 0, "メス").otherwise("オス")


BOTH = """WITH p AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CASE WHEN p_size % 2 = 0 THEN 'female' ELSE 'male' END AS other FROM part),
r AS (SELECT p.*, i, CASE WHEN i = 1 THEN sex ELSE other END AS gender FROM p, (VALUES (1), (2)) t(i))"""


@query("layout_extract_nesting", f"""{BOTH}
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'kochi-pref-k' || p_partkey || '-' || i WHEN 1 THEN '1D' || p_partkey || i ELSE 'fukuoka-pref-' || p_partkey || 'a' || i END AS external_id,
  gender, 'available' AS status, p_partkey || '-' || i || '.jpg' AS image, 1 AS n_images FROM r""")
def layout_extract_nesting(s, d):
    """A record ends with its own element (cards, links) or with the one around it (headings): the foot is none of it."""
    k, sex, other = _part_text()
    img = lambda i: say('<img src="', k, f'-{i}.jpg">')
    card = lambda i, x: say('<div class="tab-animal-card"><div><div>', img(i), "</div></div><table><tr><th>管理番号</th><td>K", k, f"-{i}</td></tr><tr><th>性別</th><td>", x, "</td></tr></table></div>")
    head = lambda i, x: say("<h3>1D", k, f"{i} (ポチ)</h3><p>種類：", c("p_type"), "<br>性別：", x, "</p><div>", img(i), "</div>")
    link = lambda i, x: say('<a href="/animals/center-detail/', k, f'a{i}">', img(i), "<dl><dt>性別</dt><dd>", x, "</dd></dl></a>")
    two = lambda f: say(f(1, sex), "<p>間</p>" if f is not head else "", f(2, other))
    return _extracted(s, d, [("kochi/kochi-pref", two(card)), ("okayama/okayama-city-dogs", two(head)), ("fukuoka/fukuoka-pref-cats", two(link))])


@query("layout_extract_pictures", f"""{BOTH}
SELECT p_partkey, CASE i WHEN 1 THEN 'K' || p_partkey ELSE 'kanazawa_2' END AS external_id, gender, 'available' AS status, p_partkey || '-' || i || '.jpg' AS image, 1 AS n_images, i = 2 AS needs_review FROM r""")
def layout_extract_pictures(s, d):
    """Each record's picture stands before it; a record without a number gets its place on the page."""
    k, sex, other = _part_text()
    one = lambda i, number, x: say('<figure class="img-item"><img src="', k, f'-{i}.jpg"></figure><div class="wysiwyg"><table><caption><p>', number, "</p></caption><thead><tr><th>種類</th></tr><tr><td>雑種</td><td>", c("p_brand"), "</td><td>", x, "</td><td>2歳</td></tr></thead></table></div>")
    body = say(one(1, say("動物番号：K", k), sex), one(2, "番号なし", other))
    out = _extracted(s, d, [("ishikawa/kanazawa-city-cats", body)], "needs_review", "record_no")
    return out.filter("record_no < 2").drop("record_no")  # the foot of these pages has a table too


@query("layout_extract_grid", f"""{BOTH}
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'mito-city-dog-' || p_partkey || i WHEN 1 THEN 'ehime-pref-cat-' || p_partkey || '-' || i ELSE 'tokushima-pref-t-' || p_partkey || '-' || i END AS external_id,
  gender, 'available' AS status, p_partkey || '-' || i || '.jpg' AS image, 1 AS n_images, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS color, CASE p_partkey % 3 WHEN 0 THEN 'dog' WHEN 1 THEN 'cat' ELSE 'dog' END AS animal_type FROM r""")
def layout_extract_grid(s, d):
    """Records side by side, in columns (a cell over both), and with labels above their values."""
    k, sex, other = _part_text()
    alt = lambda i: say('<img src="/uploaded/image/', k, f'-{i}.jpg" alt="', k, f'{i}の写真">')
    row = lambda label, a, b: say(f"<tr><th>{label}</th><td>", a, f"</td><th>{label}</th><td>", b, "</td></tr>")
    mito = say("<table>", row("管理番号", say("R7-", k, "1（ショウ）"), say("R7-", k, "2（名前：ハナ）")), row("写真", alt(1), alt(2)), row("毛色", c("p_brand"), c("p_brand")), row("性別", sex, other), "</table>")
    img = lambda i: say('<img src="/i/', k, f'-{i}.jpg">')
    ehime = say('<table class="datatable"><caption>譲渡猫</caption><tr><th>写真</th><td>', img(1), "</td><td>", img(2), "</td></tr><tr><th>年齢</th><td>2024年4月生</td><td>不明</td></tr><tr><th>毛色</th><td colspan=2>",
                c("p_brand"), "</td></tr><tr><th>性別</th><td>", sex, "</td><td>", other, "</td></tr></table>")
    one = lambda i, x: say('<table class="f_a3"><tr><td class="photo" rowspan="3">', img(i), "</td><th>番号</th></tr><tr><td>T-", k, f"-{i}</td></tr><tr><th>推定生年月日</th><th>性別</th></tr><tr><td>令和５年</td><td>", x, "</td></tr></table>")
    out = _extracted(s, d, [("ibaraki/mito-city-dogs", mito), ("ehime/ehime-pref", ehime), ("tokushima/tokushima-pref-dogs", say(one(1, sex), one(2, other)))], "color", "animal_type")
    return out


@query("layout_extract_many", f"""{BOTH}
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE i WHEN 1 THEN 'HC' || p_partkey ELSE CAST(p_partkey + 1 AS VARCHAR) END ELSE 'HC' || p_partkey || '-' || i END AS external_id,
  CASE i WHEN 1 THEN 'male' ELSE 'female' END AS gender, 'available' AS status, p_partkey || '.jpg' AS image, 1 AS n_images FROM r""")
def layout_extract_many(s, d):
    """Entries of two animals, with an id for each or one id for both."""
    k, _, _ = _part_text()
    ids = F.when(c("p_partkey") % 2 == 0, say(k, ".", (c("p_partkey") + 1).cast("string"))).otherwise(k)
    body = say('<article class="animal-item"><h2>管理番号：HC', ids, '(松岡)</h2><img src="', k, '.jpg"><dl class="spec"><dt>性別</dt><dd>オス：1匹、メス：1匹</dd></dl></article>')
    return _extracted(s, d, [("fukui/fukui-pref-cats", body)])


@query("layout_extract_gate", """
SELECT p_partkey, '2025-' || replace(p_brand, '#', '') AS external_id, 'unknown' AS gender, 'available' AS status, p_partkey || '.jpg' AS image, 1 AS n_images, p_type AS color FROM part WHERE p_size % 3 > 0""")
def layout_extract_gate(s, d):
    """Ids that are a bare year or too short are rejected, and their records with them."""
    k, _, _ = _part_text()
    number = F.when(c("p_size") % 3 > 0, F.concat(F.lit("2025-"), F.replace(c("p_brand"), F.lit("#"), F.lit("")))).when(c("p_size") % 2 == 0, "2025-").otherwise("A1")
    body = say("<table><tr><td>管理番号</td><td>", number, '</td></tr><tr><td>毛色</td><td>', c("p_type"), '</td></tr><tr><td>写真</td><td><img src="', k, '.jpg"></td></tr></table>')
    return _extracted(s, d, [("saitama/saitama-pref-cats", body)], "color")


@query("layout_extract", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'kochi-pref-k' || p_partkey WHEN 1 THEN 'aichi-' || p_partkey WHEN 2 THEN 'C' || p_partkey || '-X'
    ELSE 'kyoto_0' END AS external_id,
  CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 2 THEN NULL WHEN 3 THEN p_name END AS name,
  CASE WHEN p_size % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
  CASE p_partkey % 4 WHEN 1 THEN p_size || '歳' WHEN 3 THEN p_size || '歳' END AS age_estimate,
  CASE p_partkey % 4 WHEN 2 THEN p_brand END AS color, CASE WHEN p_size % 3 = 0 THEN 'adopted' ELSE 'available' END AS status,
  CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE 'cat' END AS animal_type, 'https://x.example/a/' || p_partkey || '.jpg' AS image,
  p_partkey % 4 = 3 AS needs_review FROM part""")
def layout_extract(s, d):
    """Rows of a table as pages of four facilities, read back by their layouts."""
    from ..operators import extract
    from ..sources import layouts

    n, k = c("p_partkey") % 4, c("p_partkey").cast("string")
    sex = F.when(c("p_size") % 2 == 0, "オス").otherwise("メス")
    age = say(c("p_size").cast("string"), "歳")
    gone = F.when(c("p_size") % 3 == 0, "譲渡しました").otherwise("募集中")
    img = say('<img src="', k, '.jpg"><img src="/icon.gif">')
    th = lambda a, b: say("<tr><th>", a, "</th><td>", b, "</td></tr>")
    kochi = say('<div class="tab-animal-card">', img, "<table>", th("管理番号", say("K", k)), th("仮名", c("p_name")), th("性別", sex), "</table>", gone, "</div>")
    aichi = say("<table><tr><th>写真<th>特徴</tr><tr><td>", img, "</td><td>管理No.", k, " 推定", age, " ", sex, " ", gone, "</td></tr></table>")
    osaka = say("<table>", th("管理番号", say("C", k, "-X")), th("毛色", c("p_brand")), th("性別", sex), "</table>", gone, img)
    kyoto = say('<div class="content clearfix"><h2>センター名：', c("p_name"), "（", gone, "）</h2>", img, "<table>", th("性別", sex), th("年齢", age), "</table></div>")
    page = parts(s, d).select(
        "p_partkey", F.lit("https://x.example/a/list.html").alias("url"),
        F.when(n == 0, "kochi/kochi-pref").when(n == 1, "aichi/aichi-pref-cats").when(n == 2, "osaka/osaka-pref-cats")
        .otherwise("kyoto/kyoto-pref-cats").alias("facility"),
        F.when(n == 0, kochi).when(n == 1, aichi).when(n == 2, osaka).otherwise(kyoto).alias("html"),
    )
    out = extract.listings(page, layouts.catalogue(s))
    return out.select(
        "p_partkey", "external_id", "name", "gender", "age_estimate", "color", "status", "animal_type",
        F.get("images", F.lit(0)).alias("image"), "needs_review",
    )
