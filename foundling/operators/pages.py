"""Page corpora as tables.  All steps are narrow (one page is one row) unless
they say otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H, urls
from ..functions.text import alternation, col, let
from .ordered import fixed_chunks, last_seen


def token_table(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """One row per tag or text run: position, kind, tag name, raw text."""
    from ..functions.text import strip_code

    t = pages.select(key, F.posexplode(H.tokens(strip_code(body))).alias("pos", "token"))
    return t.withColumns({"kind": H.token_kind("token"), "tag": H.tag_name("token")})


def select(pages: DataFrame, selectors: Sequence[tuple[str, Sequence[str]]], key: str = "page_id", body: str = "html") -> DataFrame:
    """Containers of each (tag, classes) selector with their number on the page."""
    out = None
    for no, (tag, classes) in enumerate(selectors):
        one = pages.select(key, F.lit(no).alias("selector"), F.posexplode(H.containers(body, tag, classes)).alias("n", "element"))
        out = one if out is None else out.unionByName(one)
    return out


def first_selector(pages: DataFrame, selectors: Sequence[tuple[str, Sequence[str]]], key: str = "page_id", body: str = "html") -> DataFrame:
    """Containers of the first selector that finds any on the page."""
    found = [H.containers(body, tag, classes) for tag, classes in selectors]
    chosen = F.coalesce(*[let(f, lambda x: F.when(F.size(x) > 0, x)) for f in found])
    return pages.select(key, F.posexplode(chosen).alias("n", "element"))


def section_table(pages: DataFrame, headings: str = "h1|h2|h3|h4|h5|h6", key: str = "page_id", body: str = "html") -> DataFrame:
    """One row per heading with the text and images up to the next one."""
    s = pages.select(key, F.posexplode(H.sections(body, headings)).alias("section_no", "s"))
    images = F.transform(H.open_tags(F.col("s.body"), "img"), lambda t: H.attr(t, "src"))
    return s.select(key, "section_no", F.col("s.heading").alias("heading"), H.plain("s.body").alias("text"), images.alias("images"))


def section_elements(
    pages: DataFrame, element: str, headings: str = "h1|h2|h3|h4|h5|h6", key: str = "page_id", body: str = "html"
) -> DataFrame:
    """Elements with the heading they stand under (the state a heading sets)."""
    s = pages.select(key, F.posexplode(H.sections(body, headings)).alias("section_no", "s"))
    return s.select(
        key, "section_no", F.col("s.heading").alias("heading"), F.posexplode(H.elements("s.body", element)).alias("n", "element")
    )


def inherit(rows: DataFrame, keys: Sequence[str], position: str, value: Column, out: str, chunk: int = 65_536) -> DataFrame:
    """Rows with the last value set at or before them.  For rows that already
    are a table; a long page or batch is split by position."""
    return last_seen(fixed_chunks(rows, position, chunk), list(keys), [position], value, out)


def nearest_preceding(pages: DataFrame, wanted: str, anchor: str, key: str = "page_id", body: str = "html") -> DataFrame:
    """Each ``anchor`` opening tag with the nearest ``wanted`` tag before it."""
    tags = H.open_tags(body, f"{wanted}|{anchor}")
    is_wanted = lambda t: t.rlike(rf"(?i)^<(?:{wanted})[\s>/]")
    start = F.struct(
        F.lit(None).cast("string").alias("last"), F.array().cast("array<struct<anchor:string,preceding:string>>").alias("out")
    )

    def step(acc: Column, t: Column) -> Column:
        pair = F.struct(t.alias("anchor"), acc["last"].alias("preceding"))
        return F.when(is_wanted(t), F.struct(t.alias("last"), acc["out"].alias("out"))).otherwise(
            F.struct(acc["last"].alias("last"), F.concat(acc["out"], F.array(pair)).alias("out"))
        )

    found = F.aggregate(tags, start, step)["out"]
    return pages.select(key, F.posexplode(found).alias("n", "_x")).select(key, "n", "_x.anchor", "_x.preceding")


def links(pages: DataFrame, key: str = "page_id", body: str = "html", url: str = "url") -> DataFrame:
    """Anchors with absolute target and readable text."""
    a = pages.select(key, url, F.posexplode(H.elements(body, "a", outer=True)).alias("n", "a"))
    return a.select(key, "n", urls.absolute(H.attr("a", "href"), url).alias("href"), H.plain("a").alias("text"))


def images(pages: DataFrame, key: str = "page_id", body: str = "html", url: str = "url", decorative: bool = False) -> DataFrame:
    """Images with absolute source and alternative text, decoration left out."""
    i = pages.select(key, url, F.posexplode(H.open_tags(body, "img")).alias("n", "t"))
    i = i.select(key, "n", urls.absolute(H.attr("t", "src"), url).alias("src"), H.attr("t", "alt").alias("alt"))
    return i if decorative else i.filter(~urls.is_decorative("src"))


def image_records(
    pages: DataFrame, start: str, end: str, id_pattern: str, key: str = "page_id", body: str = "html", url: str = "url"
) -> DataFrame:
    """Images of one area as records; the id is in the alternative text."""
    area = pages.withColumn(body, H.between(body, start, end))
    return images(area, key, body, url).withColumn("external_id", F.nullif(F.regexp_extract("alt", id_pattern, 1), F.lit("")))


def headings(pages: DataFrame, stops: Sequence[str], tags: str = "h3", key: str = "page_id", body: str = "html") -> DataFrame:
    """Headings that are not in the stop list."""
    from ..functions.text import strip_invisible

    h = pages.select(key, F.posexplode(H.elements(body, tags)).alias("n", "h"))
    h = h.select(key, "n", strip_invisible(H.plain("h")).alias("heading"))
    return h.filter((F.col("heading") != "") & ~F.col("heading").rlike(alternation(stops)))


def caption_count(body: str | Column, words: Sequence[str], joiner: str = "・") -> Column:
    """Estimated records from link captions: a caption with ``joiner`` is two."""
    captions = F.transform(H.elements(body, "a"), lambda a: H.plain(a))
    chosen = F.filter(captions, lambda t: t.rlike(alternation(words)))
    return F.aggregate(chosen, F.lit(0), lambda acc, t: acc + F.when(t.contains(joiner), 2).otherwise(1))


def distinct_matches(body: str | Column, pattern: str, group: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(body), F.lit(pattern), F.lit(group)))


def fallback_id(prefix: Column, index: Column) -> Column:
    """An id for a record without one: its prefix and its place on the page."""
    return F.concat(prefix, F.lit("_"), index)


def merge_grids(info: Column, photos: Column, info_key: int = 0, photo_key: int = 0) -> Column:
    """Rows of one table with the row of another that has the same key."""
    both = F.struct(info.alias("i"), photos.alias("p"))
    return let(both, lambda b: F.transform(
        b["i"],
        lambda r: F.struct(
            r.alias("row"), F.get(F.filter(b["p"], lambda p: F.get(p, F.lit(photo_key)) == F.get(r, F.lit(info_key))), F.lit(0)).alias("photo")
        ),
    ))


def reading_order(fragments: DataFrame, boundary: float = 500.0, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Positioned text fragments as lines: left column then right, top to
    bottom, left to right.  One shuffle by line; only one line's fragments are
    ever together."""
    line = fragments.withColumns(
        {"col_no": F.when(F.col("x") < boundary, 0).otherwise(1), "line_y": F.floor(F.col("y") + 0.5)}
    )
    words = F.array_sort(F.collect_list(F.struct("x", "text")))
    return (
        line.groupBy(*keys, "col_no", "line_y").agg(F.trim(F.array_join(words["text"], " ")).alias("line"))
        .filter(F.col("line") != "")
    )


def in_reading_order(lines: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    return lines.orderBy(doc, "col_no", page, F.col("line_y").desc())
