"""Records out of pages by their facility's layout row.

One narrow pass over the pages, whatever the number of facilities: the layout
table is joined to the pages and its patterns are columns.  Nothing is
gathered per facility, so one facility may have any share of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify, dates, html as H, urls
from ..functions.records import gender_counts, keyword_sections, zip_ids
from ..functions.text import ALL, all_contexts, first_in_text, half_width, let, preview, slug, strip_code
from ..session import small_side
from ..sources.layouts import FIELDS

MARK = "\x01"


def _capture(text: Column, pattern: Column) -> Column:
    """Group 1 of a pattern held in a column, null when it does not match."""
    return F.nullif(F.trim(F.call_function("regexp_extract", text, pattern, F.lit(1))), F.lit(""))


def _last(text: Column, pattern: Column) -> Column:
    """Group 1 of the last match, null without one."""
    return F.try_element_at(F.call_function("regexp_extract_all", text, pattern, F.lit(1)), F.lit(-1))


def _found(text: Column, pattern: Column) -> Column:
    """Whether a pattern held in a column matches.  Of the functions for that, this one compiles it once for equal neighbours."""
    return F.call_function("regexp_instr", text, pattern) > 0


def pieces(pages: DataFrame, layouts: DataFrame, body: str = "html", facility: str = "facility") -> DataFrame:
    """One row per record: its number on the page, its HTML, what stands before and after it up to its neighbours, and the
    section it is in."""
    # the layout table is counted: a small one goes to every task, so that pages
    # are not shuffled; a large one is joined however Spark sees fit
    # pages of one facility lie together in a task: a pattern is compiled once for all of them
    joined = pages.join(small_side(layouts), facility).sortWithinPartitions(facility)
    scoped = F.when(F.col("area").isNotNull(), F.call_function("regexp_extract", F.col(body), F.col("area"), F.lit(1))).otherwise(F.col(body))
    marked = F.regexp_replace(F.translate(scoped, MARK, ""), F.col("mark"), F.lit(MARK + "$1"))
    section, up = F.col("section"), F.col("up")

    def record(x: Column) -> Column:
        # what follows a row's end (the page's foot, after the last row) is not the record's
        row = F.regexp_replace(x, r"(?is)</(?:tr|table)\s*>.*", "")
        own = F.when(F.col("row_record"), row).when(up < 0, x).when(up == 0, H.own_element(x)).otherwise(H.in_parent(x, up))
        return let(own, lambda r: F.struct(r.alias("piece"), F.substring(x, F.length(r) + 1, F.length(x)).alias("rest")))

    def bound(cut: Column) -> Column:
        """The page's text before the first record, its records, and the section each text leaves off in."""
        lead = F.get(cut, F.lit(0))
        ends = F.transform(cut, lambda x: _last(x, section))
        return F.struct(lead.alias("lead"), F.transform(F.slice(cut, 2, ALL), record).alias("parts"), F.when(section.isNotNull(), ends).alias("ends"))

    def placed(page: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            earlier = F.try_element_at(F.filter(F.slice(page["ends"], 1, i + 1), lambda x: x.isNotNull()), F.lit(-1))
            return F.struct(
                p["piece"].alias("piece"), F.when(i == 0, page["lead"]).otherwise(F.get(page["parts"], i - 1)["rest"]).alias("before"), p["rest"].alias("after"),
                F.when(section.isNotNull(), F.coalesce(_last(p["piece"], section), earlier)).alias("state"),
            )

        return F.transform(page["parts"], one)

    def spread(found: Column) -> Column:
        def of(split) -> Column:
            return F.flatten(F.transform(found, lambda r: F.transform(split(r["piece"]), lambda x: F.struct(x.alias("piece"), r["before"].alias("before"), r["after"].alias("after"), r["state"].alias("state")))))

        kind = F.col("spread")
        return F.when(kind == "columns", of(H.columns)).when(kind == "pairs", of(lambda x: H.side_by_side(x, "管理番号"))).otherwise(found)

    records = let(let(let(F.split(marked, MARK), bound), placed), spread)
    return joined.select(*[c for c in joined.columns if c != body], F.posexplode(records).alias("record_no", "r")).select("*", "r.*").drop("r")


def _entries(piece: Column, shape: Column) -> Column:
    """Label and value pairs of a record in its shape."""
    cells = F.transform(H.elements(piece, "tr"), lambda r: F.transform(H.elements(r, "td"), lambda x: H.plain(x)))
    two = F.transform(
        F.filter(cells, lambda r: F.size(r) >= 2), lambda r: F.struct(F.get(r, F.lit(0)).alias("key"), F.get(r, F.lit(1)).alias("value"))
    )
    line_text = F.regexp_replace(F.regexp_replace(piece, r"(?i)<br[^>]*>|</(?:p|div|h[1-6]|li)>", "\n"), r"<[^>]*>", "")
    return (
        F.when(shape == "pairs", H.pairs(piece)).when(shape == "rows", two).when(shape == "stacked", H.stacked(piece))
        .when(shape == "list", H.pairs(piece, "dt", "dd")).when(shape == "lines", H.label_pairs(line_text))
    )


def _field(rule: Column, r: Column, shape: Column) -> Column:
    kind, arg = rule["kind"], rule["arg"]
    labelled = F.get(F.filter(r["entries"], lambda e: _found(e["key"], arg)), F.lit(0))["value"]
    value = (
        F.when((kind == "label") & (shape == "run_on"), _capture(r["text"], rule["run_on"]))
        .when(kind == "label", labelled)
        .when(kind == "cell", F.get(r["cells"], arg.try_cast("int")))
        .when(kind == "text", _capture(r["text"], arg))
        .when(kind == "html", _capture(r["piece"], arg))
    )
    return F.when(rule.isNotNull(), F.nullif(F.trim(value), F.lit("")))


def raw_records(pages: DataFrame, layouts: DataFrame, body: str = "html", facility: str = "facility", url: str = "url") -> DataFrame:
    """Records with their fields as written on the page."""
    p = pieces(pages, layouts, body, facility)
    cells = F.transform(H.elements("piece", "td"), lambda x: H.plain(x))
    entries = _entries(F.col("piece"), F.col("shape"))
    # labels above their values read badly as text: they are written as pairs
    text = F.when(F.col("shape") == "stacked", F.concat_ws(" ", F.transform(entries, lambda e: F.concat_ws(" ", e["key"], e["value"])))).otherwise(H.block_text("piece"))
    parts = F.struct(F.col("piece").alias("piece"), F.concat_ws(" ", "state", text).alias("text"), cells.alias("cells"), entries.alias("entries"))
    tags = lambda c: H.open_tags(c, "img")
    # the nearest picture between two records, or those in the record
    pictures = (
        F.when(F.col("picture") == "before", F.slice(tags("before"), -1, 1)).when(F.col("picture") == "after", F.slice(tags("after"), 1, 1)).otherwise(tags("piece"))
    )

    def read(r: Column) -> Column:
        found = F.when(F.col("id_kind") == "html", _capture(r["piece"], F.col("id_pattern"))).otherwise(_capture(r["text"], F.col("id_pattern")))
        # a field is an expression of its own, which keeps its compiled pattern
        values = F.struct(*[_field(F.col("rules")[f], r, F.col("shape")).alias(f) for f in FIELDS])
        return F.struct(F.size(r["cells"]).alias("n_cells"), half_width(found).alias("found_id"), r["text"].alias("raw_text"), values.alias("values"))

    keep = [c for c in pages.columns if c != body]
    own = ["state", "id_prefix", "id_slug", "species", "listing_type", "iso_dates", "many", "fallback"]
    # the parts of a record are bound once; each field is then a reference.  Exploded, so that the filters below don't read a record again
    r = p.select(*keep, "record_no", *own, "id_required", "skip", "min_cells", "picture_alt", pictures.alias("pictures"), F.explode(F.transform(F.array(parts), read)).alias("r"))
    known = F.col("r.found_id").isNotNull() | ~F.col("id_required")
    wanted = F.col("skip").isNull() | ~_found(F.coalesce("r.values.name", F.lit("")), F.col("skip"))
    shown = F.filter("pictures", lambda t: ~F.col("picture_alt") | H.attr(t, "alt").contains(F.col("r.found_id")))
    images = F.filter(
        F.transform(shown, lambda t: urls.absolute(H.attr(t, "src"), F.col(url))), lambda x: x.isNotNull() & ~urls.is_decorative(x),
    )
    return r.filter(known & wanted & (F.col("r.n_cells") >= F.col("min_cells"))).select(*keep, "record_no", *own, "r.found_id", "r.raw_text", "r.values.*", images.alias("images"))


def _animals(found: Column, gender: Column, many: Column) -> Column:
    """The ids and genders of an entry; one of each unless it has many."""
    ids = F.filter(F.split(F.coalesce(found, F.lit("")), r"\."), lambda x: x != "")
    several = F.transform(zip_ids(ids, gender_counts(F.coalesce(gender, F.lit("")))), lambda x: F.struct(x["external_id"].alias("found"), x["gender"].alias("sex")))
    return F.when(many, several).otherwise(F.array(F.struct(found.alias("found"), classify.gender(F.coalesce(gender, F.lit(""))).alias("sex"))))


def listings(pages: DataFrame, layouts: DataFrame, body: str = "html", facility: str = "facility", url: str = "url") -> DataFrame:
    """Records in the listing's normal form; ``record_no`` is their place on the page, ``animal_no`` the place in an entry of several."""
    raw = raw_records(pages, layouts, body, facility, url)
    animals = _animals(F.col("found_id"), F.col("gender"), F.col("many"))
    raw = raw.select("*", F.posexplode(animals).alias("animal_no", "one")).withColumn("found_id", F.col("one.found"))
    iso = {d: F.coalesce(F.when(F.col("iso_dates"), F.date_format(dates.parse_date(d), "yyyy-MM-dd")), F.col(d)) for d in ("protection_date", "deadline_date")}
    kind = F.coalesce("species", classify.species("raw_text"))
    nth = lambda start: (F.col("record_no") + start).cast("string")
    named = F.coalesce("name", F.concat(F.lit("unknown-"), nth(0)))
    made = F.col("fallback")
    for hole, value in (("{k}", nth(0)), ("{n}", nth(1)), ("{name}", named), ("{slug}", F.regexp_replace(F.lower(named), r"\s+", "-"))):
        made = F.replace(made, F.lit(hole), value)
    prefix = F.replace("id_prefix", F.lit("{section}-"), F.coalesce(F.concat("state", F.lit("-")), F.lit("")))
    own_id = F.coalesce(F.when(F.col("id_slug"), slug("", "found_id")).otherwise(F.col("found_id")), made)
    return raw.withColumns({
        **iso,
        "external_id": F.concat(F.replace(prefix, F.lit("{type}"), kind), own_id),
        "animal_type": kind,
        "gender": F.col("one.sex"),
        "age_estimate": half_width("age_estimate"),
        "size": F.coalesce(classify.size(F.col("size")), F.col("size")),
        "status": classify.extended_status("raw_text"),
        "needs_review": F.col("found_id").isNull(),
        "source_url": F.col(url),
    }).drop("state", "id_prefix", "id_slug", "species", "iso_dates", "found_id", "many", "fallback", "one")


def text_fallback(
    pages: DataFrame, records: DataFrame, keywords: list[str] | None = None, key: str = "page_id", body: str = "html", url: str = "url"
) -> DataFrame:
    """Rows for pages on which no record was found: their text is cut before
    each species word.  Such rows are to be reviewed and have little confidence."""
    words = keywords or ["猫", "ネコ", "ねこ", "犬", "イヌ", "いぬ"]  # fixed values
    empty = pages.join(records.select(key).distinct(), key, "left_anti")
    cut = empty.select(key, url, F.posexplode(keyword_sections(H.block_text(strip_code(body)), words)).alias("record_no", "section"))
    return cut.select(
        key, "record_no", F.col(url).alias("source_url"), classify.species("section").alias("animal_type"),
        classify.age_text("section").alias("age_estimate"), classify.gender("section").alias("gender"),
        first_in_text("section").alias("color"), F.lit("medium").alias("size"),
        all_contexts("section").alias("health_status"), classify.adoption_status("section").alias("status"),
        preview("section", 300).alias("raw_text"), F.lit("text_fallback").alias("extraction_method"),
        F.lit(True).alias("needs_review"), F.lit("0.3").cast("decimal(2,1)").alias("confidence_score"),
    )
