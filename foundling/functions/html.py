"""Page text to elements, without leaving the row.

A page is one string.  Every function here stays inside its row (regular
expressions and higher-order functions), so page extraction needs no shuffle.
Unclosed ``p``, ``li``, ``td`` and friends end where the next one of the same
name starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import ALL, alternation, col, collapse_spaces, let, strip_tags

MARK = "\x01"
TOKEN = r"<[^>]+>|[^<]+"


def tokens(html: str | Column) -> Column:
    """Tags and text runs in page order."""
    return F.regexp_extract_all(col(html), F.lit(TOKEN), F.lit(0))


def tag_name(token: str | Column) -> Column:
    """Lower-case tag name of a token, empty for text."""
    return F.lower(F.regexp_extract(col(token), r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))


def token_kind(token: str | Column) -> Column:
    t = col(token)
    return (
        F.when(t.rlike("^</"), "close")
        .when(t.rlike("^<[a-zA-Z]"), "open")
        .when(t.startswith("<"), "other")
        .otherwise("text")
    )


def attr(tag: str | Column, name: str) -> Column:
    """Attribute value in double, single or no quotes; null when absent."""
    pattern = rf"(?i)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    t = col(tag)
    joined = F.concat(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 3))
    return F.when(F.regexp_extract(t, pattern, 0) != "", joined)


def split_before(text: str | Column, pattern: str) -> Column:
    """Pieces that each start at a match of ``pattern``; the first piece is
    whatever comes before the first match."""
    return F.split(F.regexp_replace(col(text), f"({pattern})", MARK + "$1"), MARK)


def _open(tags: str) -> str:
    return rf"(?i)<(?:{tags})[\s>/]"


def elements(html: str | Column, tags: str, outer: bool = False) -> Column:
    """Inner (or outer) text of each element named in ``tags`` (``td|th``),
    for elements that do not contain their own kind."""
    pieces = F.slice(split_before(html, _open(tags)), 2, ALL)
    if outer:
        return F.transform(pieces, lambda p: F.regexp_extract(p, rf"(?is)^.*?(?:</(?:{tags})>|$)", 0))
    return F.transform(pieces, lambda p: F.regexp_extract(p, rf"(?is)^<[^>]*>(.*?)(?:</(?:{tags})>|$)", 1))


def open_tags(html: str | Column, tags: str) -> Column:
    """The opening tags themselves, for attributes."""
    return F.regexp_extract_all(col(html), F.lit(rf"(?i)<(?:{tags})(?:\s[^>]*)?/?>"), F.lit(0))


def plain(html: str | Column) -> Column:
    """Readable text: no tags, the usual entities decoded, spaces collapsed."""
    c = strip_tags(html)
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return collapse_spaces(c)


def block_text(html: str | Column) -> Column:
    """Readable text with a space where a cell, line or block ends."""
    return plain(F.regexp_replace(col(html), r"(?i)</(?:td|th|tr|caption|p|div|li|dt|dd|h[1-6]|figure|span)\s*>|<(?:td|th|dt|dd|li)[\s>]", " $0"))


def containers(html: str | Column, tag: str = "div", classes: Sequence[str] = ()) -> Column:
    """Outer text of each ``tag`` with one of ``classes`` (all when empty),
    with proper nesting: an element ends at its own closing tag."""
    opens = lambda p: p.rlike(rf"(?i)^<{tag}[\s>]")
    if classes:
        names = alternation(classes)
        wanted = lambda p: opens(p) & p.rlike(rf"(?i)^<[^>]*\sclass\s*=\s*[\"']?(?:[^\"'>]*\s)?(?:{names})[\s\"'>]")
    else:
        wanted = opens
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + F.when(opens(p), 1).when(p.rlike(rf"(?i)^</{tag}"), -1).otherwise(0)
        moved = F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), (depth <= 0).alias("done"))
        return F.when(acc["done"], acc).otherwise(moved)

    def found(pieces: Column) -> Column:
        indexed = F.transform(pieces, lambda p, i: F.struct((i + 1).alias("i"), wanted(p).alias("hit")))
        starts = F.filter(indexed, lambda x: x["hit"])

        def element(i: Column) -> Column:
            def text(end: Column) -> Column:
                # the last piece begins with the closing tag; what follows it is outside
                whole = F.array_join(F.slice(pieces, i, F.when(end["done"], end["n"] - 1).otherwise(end["n"])), "")
                closing = F.regexp_extract(F.get(pieces, i + end["n"] - 2), rf"(?i)^</{tag}\s*>", 0)
                return F.when(end["done"], F.concat(whole, closing)).otherwise(whole)

            return let(F.aggregate(F.slice(pieces, i, F.size(pieces)), start, step), text)

        return F.transform(starts, lambda s: element(s["i"]))

    return let(split_before(html, rf"(?i)</?{tag}[\s>]"), found)


#: Elements that are closed wherever they are used; their nesting tells where a part of a page ends.
NESTED = "div|article|section|main|body|table|ul|ol|dl|figure"


def _end(pieces: Column, closed: Column) -> Column:
    """Number of pieces before the first that brings the depth to ``closed``, and whether there is one.  Every piece
    starts with a tag; opening tags count one up, closing ones down."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        # what comes before the first tag is no tag
        depth = acc["depth"] + F.when(p.startswith("</"), -1).when(p.startswith("<"), 1).otherwise(0)
        moved = F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), (depth <= closed).alias("done"))
        return F.when(acc["done"], acc).otherwise(moved)

    return F.aggregate(pieces, start, step)


def own_element(html: str | Column) -> Column:
    """The text up to the closing tag of the element it starts with, elements of the same name inside counted; all of it when
    that element is never closed, the tag alone when it is one that has no content."""
    c = col(html)
    void = F.regexp_extract(c, r"(?is)^<(?:img|input|hr|br)\b[^>]*>", 0)

    def cut(parts: Column) -> Column:
        def text(end: Column) -> Column:
            closing = F.regexp_extract(F.get(parts, end["n"] - 1), r"(?s)^</[^>]*>", 0)
            return F.when(end["done"], F.concat(F.array_join(F.slice(parts, 1, end["n"] - 1), ""), closing)).otherwise(F.array_join(parts, ""))

        return let(_end(parts, F.lit(0)), text)

    name = F.regexp_extract(c, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1)
    whole = let(F.split(c, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s>/])"))), cut)
    return F.when(void != "", void).when(name == "", c).otherwise(whole)


def in_parent(html: str | Column, levels: Column) -> Column:
    """The text up to where the element around its start ends, or that many elements further out."""

    def cut(parts: Column) -> Column:
        return let(_end(parts, -levels), lambda end: F.array_join(F.when(end["done"], F.slice(parts, 1, end["n"] - 1)).otherwise(parts), ""))

    # a sign before the start: the first piece counts as no tag, and is taken off again
    return F.substring(let(F.split(F.concat(F.lit(MARK), html), rf"(?i)(?=</?(?:{NESTED})[\s>])"), cut), 2, ALL)


def stacked(html: str | Column, skip: str = "photo") -> Column:
    """Key cells (th) above value cells (td), row by row; cells of the class ``skip`` are no values, and a single key
    has the last of its row."""
    none = F.array().cast("array<string>")

    def row(r: Column) -> Column:
        cells = F.filter(elements(r, "td", outer=True), lambda x: ~x.rlike(rf"(?i)^<td[^>]*class\s*=\s*[\"'][^\"']*{skip}"))
        return F.struct(F.transform(elements(r, "th"), plain).alias("k"), F.transform(cells, plain).alias("v"))

    def paired(rows: Column) -> Column:
        below = F.concat(F.slice(rows, 2, ALL), F.array(F.struct(none.alias("k"), none.alias("v"))))
        both = F.filter(F.zip_with(rows, below, lambda a, b: F.struct(a["k"].alias("k"), b["k"].alias("other"), b["v"].alias("v"))), lambda x: (F.size(x["k"]) > 0) & (F.size(x["other"]) == 0))
        value = lambda x, i: F.when(F.size(x["k"]) == 1, F.try_element_at(x["v"], F.lit(-1))).otherwise(F.get(x["v"], i))
        return F.flatten(F.transform(both, lambda x: F.transform(x["k"], lambda k, i: F.struct(k.alias("key"), value(x, i).alias("value")))))

    return let(F.transform(elements(html, "tr"), row), paired)


def columns(html: str | Column) -> Column:
    """A table whose columns are records: each column's cells (td, with a cell over several columns in each of them) as
    one text, the caption before them."""

    def row(r: Column) -> Column:
        span = lambda x: F.greatest(F.coalesce(F.regexp_extract(x, r"(?i)^<td[^>]*\scolspan\s*=\s*[\"']?([0-9]{1,3})", 1).try_cast("int"), F.lit(1)), F.lit(1))
        return F.flatten(F.transform(elements(r, "td", outer=True), lambda x: F.array_repeat(x, span(x))))

    def turned(rows: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
        caption = F.regexp_extract(col(html), r"(?is)<caption[\s>].*?</caption\s*>", 0)
        one = lambda i: F.concat(caption, F.array_join(F.transform(rows, lambda r: F.coalesce(F.get(r, i), F.lit("<td></td>"))), ""))
        return F.transform(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), one)

    return let(F.filter(F.transform(elements(html, "tr"), row), lambda r: F.size(r) > 0), turned)


def side_by_side(html: str | Column, key: str) -> Column:
    """A table in which records stand beside each other as th/td pairs: one text of pairs for each pair whose th has
    ``key``; a row with fewer pairs gives its last.  The table's pictures go with every record."""
    pattern = r"(?is)<th[^>]*>.*?</th>\s*<td[^>]*>.*?</td>"

    def records(rows: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(F.filter(r, lambda x: F.regexp_extract(x, r"(?is)^(.*?)</th>", 1).contains(key))))), F.lit(0))
        pictures = F.array_join(open_tags(html, "img"), "")
        cells = lambda i: F.array_join(F.transform(rows, lambda r: F.coalesce(F.get(r, i), F.element_at(r, -1))), "")
        one = lambda i: F.concat(F.regexp_replace(cells(i), r"(?i)<img[^>]*>", ""), pictures)
        return F.transform(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), one)

    rows = F.transform(elements(html, "tr"), lambda r: F.regexp_extract_all(r, F.lit(pattern), F.lit(0)))
    return let(F.filter(rows, lambda r: F.size(r) > 0), records)


def pairs(html: str | Column, key_tag: str = "th", value_tag: str = "td") -> Column:
    """Neighbouring key and value cells as ``array<struct<key,value>>``."""
    pattern = rf"(?is)<{key_tag}[^>]*>(.*?)</{key_tag}>\s*<{value_tag}[^>]*>(.*?)</{value_tag}>"
    c = col(html)
    keys = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    return F.zip_with(keys, values, lambda k, v: F.struct(plain(k).alias("key"), plain(v).alias("value")))


def stacked_pairs(html: str | Column) -> Column:
    """Key row above value row: cell *i* of an odd row labels cell *i* of the next."""
    none = F.array().cast("array<string>")

    def paired(cells: Column) -> Column:
        below = F.concat(F.slice(cells, 2, F.size(cells)), F.array(none))
        both = F.zip_with(cells, below, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        odd = F.filter(F.transform(both, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda x: x["i"] % 2 == 0)
        return F.flatten(F.transform(
            odd, lambda o: F.zip_with(o["x"]["k"], o["x"]["v"], lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        ))

    return let(grid(html), paired)


def label_pairs(text: str | Column, separators: str = "：:／/") -> Column:
    """``label：value`` lines, optionally numbered or in 【】, as pairs."""
    pattern = rf"^\s*(?:[0-9０-９]+[.．、]\s*)?[【\[]?([^{separators}】\]]+)[】\]]?\s*[{separators}】\]]\s*(.*)$"
    rows = F.filter(F.split(col(text), r"\r?\n"), lambda x: x.rlike(pattern))
    return F.transform(
        rows,
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, pattern, 1)).alias("key"), F.trim(F.regexp_extract(x, pattern, 2)).alias("value")
        ),
    )


def field(entries: str | Column, labels: Sequence[str]) -> Column:
    """Value of the first pair whose key contains one of ``labels``."""
    names = alternation(labels)
    return F.get(F.filter(col(entries), lambda e: e["key"].rlike(names)), F.lit(0))["value"]


def grid(html: str | Column) -> Column:
    """Rows of cell texts: ``array<array<string>>``."""
    return F.transform(elements(html, "tr"), lambda r: F.transform(elements(r, "td|th"), plain))


def transpose(rows: str | Column) -> Column:
    """Columns of a grid as records; short rows give nulls."""

    def turned(rows: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
        columns = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(columns, lambda i: F.transform(rows, lambda r: F.get(r, i)))

    return let(col(rows), turned)


def sections(html: str | Column, heading_tags: str = "h1|h2|h3|h4|h5|h6") -> Column:
    """Heading-bounded sections as ``array<struct<heading,body>>``."""
    pieces = F.slice(split_before(html, _open(heading_tags)), 2, ALL)
    close = rf"</(?:{heading_tags})\s*>"
    return F.transform(
        pieces,
        lambda p: F.struct(
            plain(F.regexp_extract(p, rf"(?is)^<[^>]*>(.*?)(?:{close}|$)", 1)).alias("heading"),
            F.regexp_extract(p, rf"(?is)^<[^>]*>.*?{close}(.*)$", 1).alias("body"),
        ),
    )


def between(html: str | Column, start: str, end: str) -> Column:
    """Text between two patterns, null when there is no such area."""
    return F.nullif(F.regexp_extract(col(html), f"(?is){start}(.*?){end}", 1), F.lit(""))


def count(html: str | Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(col(html), F.lit(pattern)), F.lit(0))


# fixed values: record patterns tried by the counters
ROW_PATTERN = r"(?i)<tr[^>]*>"
CARD_PATTERNS = [
    r'(?i)<div[^>]*class="[^"]*card[^"]*"[^>]*>',
    r'(?i)<div[^>]*class="[^"]*box[^"]*"[^>]*>',
    r'(?i)<div[^>]*class="[^"]*item[^"]*"[^>]*>',
]
DETAIL_LINK_PATTERN = r'(?i)<a[^>]*href="[^"]*detail[^"]*"[^>]*>'
IMAGE_PATTERN = r'(?i)<img[^>]*src="[^"]*"[^>]*>'
BEST_PATTERNS = [
    r'(?i)<div[^>]*class="[^"]*data_box[^"]*"[^>]*>',
    r'(?i)<div[^>]*class="[^"]*animal-card[^"]*"[^>]*>',
    r'(?i)<div[^>]*class="[^"]*cat-card[^"]*"[^>]*>',
    r'(?i)<div[^>]*class="[^"]*pet-item[^"]*"[^>]*>',
]


def record_count(
    html: str | Column,
    row: str = ROW_PATTERN,
    cards: Sequence[str] = tuple(CARD_PATTERNS),
    detail: str = DETAIL_LINK_PATTERN,
    image: str = IMAGE_PATTERN,
    decorative: Sequence[str] = ("icon", "logo", "button"),
) -> Column:
    """Table rows without the header, else cards, else detail links, else
    pictures that are not decoration, else zero."""
    html = col(html)
    rows = count(html, row) - 1
    pictures = F.regexp_extract_all(html, F.lit(image), F.lit(0))
    real = F.size(F.filter(pictures, lambda x: ~x.rlike(alternation(decorative))))
    steps = [F.when(rows > 0, rows)]
    steps += [F.when(count(html, p) > 0, count(html, p)) for p in [*cards, detail]]
    return F.coalesce(*steps, F.when(real > 0, real), F.lit(0))


def best_count(html: str | Column, patterns: Sequence[str] = tuple(BEST_PATTERNS)) -> Column:
    counts = [count(html, p) for p in patterns]
    return F.greatest(*counts) if len(counts) > 1 else counts[0]


def scoped_count(html: str | Column, start: str, end: str, strict: str, loose: str) -> Column:
    """Count inside one area; the loose pattern counts only when the strict one finds nothing."""
    area = F.coalesce(between(html, start, end), F.lit(""))
    found = count(area, strict)
    return F.when(found > 0, found).otherwise(count(area, loose))


def is_empty_page(html: str | Column, phrases: Sequence[str]) -> Column:
    return F.coalesce(plain(html).rlike(alternation(phrases)), F.lit(False))


def dynamic_signals(html: str | Column, expected_tags: Sequence[str] = (), small: int = 5000) -> Column:
    """Five signs that a page is filled in by scripts, their sum and the verdict."""
    html = col(html)
    flag = lambda c: F.coalesce(c, F.lit(False))
    empty_root = flag(html.rlike(r'(?i)<div id="(app|root|__next)">\s*</div>'))
    too_small = flag(F.length(html) < small)
    framework = flag(html.rlike(r"(?i)react|vue|angular|__NEXT_DATA__|__nuxt__"))
    missing = flag(~html.rlike(_open(alternation(expected_tags)))) if expected_tags else F.lit(False)
    only_scripts = flag(
        html.rlike(r"""(?i)<script[^>]*src=["'][^"']*?(main|app|bundle|chunk)\.js""")
        & ~html.rlike(r"(?i)<table|<article|<ul")
    )
    signals = {
        "empty_root": empty_root, "too_small": too_small, "spa_framework": framework,
        "missing_content": missing, "only_scripts": only_scripts,
    }
    score = sum((v.cast("int") for v in signals.values()), F.lit(0))
    return F.struct(*[v.alias(k) for k, v in signals.items()], score.alias("score"), (score >= 2).alias("needs_browser"))
