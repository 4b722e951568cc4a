"""Faceted search: filters, sorting, pages, urgent lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SORT_COLUMNS = ("deadline_date", "created_at", "updated_at")
SORT_ORDERS = ("asc", "desc")
KEYWORD_COLUMNS = ("name", "breed", "personality", "color")


@dataclass(frozen=True)
class SearchParams:
    """A search request.  Empty and zero facets are skipped, except
    ``urgency_days`` and ``urgency_days_min``, where zero counts."""

    animal_type: str | None = None
    status: str | None = None
    region_id: int | None = None
    facility_id: int | None = None
    region_name: str | None = None
    gender: str | None = None
    age_estimate: str | None = None
    urgency_days: int | None = None
    urgency_days_min: int | None = None
    keyword: str | None = None
    traits: Sequence[str] = field(default_factory=tuple)
    sort_by: str | None = None
    sort_order: str | None = None
    limit: int | None = None
    offset: int | None = None

    @staticmethod
    def from_request(raw: Mapping[str, str]) -> "SearchParams":
        """A public request: defaults (available cats) and clamps applied."""
        number = lambda k: int(raw[k]) if str(raw.get(k, "")).lstrip("-").isdigit() else None
        traits = tuple(t.strip() for t in raw.get("traits", "").split(",") if t.strip())
        limit = number("limit")
        return SearchParams(
            animal_type=raw.get("animal_type") or "cat",
            status=raw.get("status") or "available",
            region_id=number("region_id"),
            facility_id=number("facility_id"),
            region_name=raw.get("region_name") or None,
            gender=raw.get("gender") or None,
            age_estimate=raw.get("age_estimate") or None,
            urgency_days=number("urgency_days"),
            urgency_days_min=number("urgency_days_min"),
            keyword=raw.get("keyword") or None,
            traits=traits,
            sort_by=raw.get("sort_by"),
            sort_order=raw.get("sort_order"),
            limit=min(limit or 20, 100),
            offset=max(number("offset") or 0, 0),
        )

    def page(self, number: int, size: int = 20) -> "SearchParams":
        return replace(self, limit=size, offset=(max(number, 1) - 1) * size)


FACETS = ("animal_type", "status", "region_id", "facility_id", "region_name", "gender", "age_estimate")


def keyword_match(columns: Sequence[str | Column], keyword: str) -> Column:
    """Case-insensitive substring in any column; ``%`` and ``_`` are plain signs."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    needle = keyword.lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in cols])


def trait_match(column: str | Column, traits: Sequence[str], terms: Mapping[str, str] | None = None) -> Column:
    """Any trait in the text; ``terms`` maps a form's code to the word to look for."""
    c = F.col(column) if isinstance(column, str) else column
    words = [(terms or {}).get(t, t) for t in traits]
    return keyword_match([c], words[0]) if len(words) == 1 else reduce(
        lambda a, b: a | b, [keyword_match([c], w) for w in words]
    )


def within_days(deadline: str, today: Column, days: int) -> Column:
    return F.col(deadline).between(today, F.date_add(today, days))


def beyond_days(deadline: str, today: Column, days: int) -> Column:
    return F.col(deadline) > F.date_add(today, days)


def matching(
    df: DataFrame,
    params: SearchParams,
    as_of: Column,
    keyword_columns: Sequence[str] = KEYWORD_COLUMNS,
    trait_column: str = "personality",
    trait_terms: Mapping[str, str] | None = None,
) -> DataFrame:
    """All filters of a request.  They are plain predicates, so Spark moves
    them below the joins and into the scan."""
    today = as_of.cast("date")
    for name in FACETS:
        value = getattr(params, name)
        if value:
            df = df.filter(F.col(name) == value)
    if params.urgency_days is not None:
        df = df.filter(within_days("deadline_date", today, params.urgency_days))
    if params.urgency_days_min is not None:
        df = df.filter(beyond_days("deadline_date", today, params.urgency_days_min))
    if params.keyword:
        df = df.filter(keyword_match(keyword_columns, params.keyword))
    if params.traits:
        df = df.filter(trait_match(trait_column, params.traits, trait_terms))
    return df


def ordering(params: SearchParams, key: str, allowed: Sequence[str] = SORT_COLUMNS, nulls: str | None = None) -> list[Column]:
    """Allow-listed sort with the key as tie-break; nulls are smallest unless told."""
    by = params.sort_by if params.sort_by in allowed else allowed[0]
    order = params.sort_order if params.sort_order in SORT_ORDERS else "asc"
    nulls = nulls or ("first" if order == "asc" else "last")
    return [getattr(F.col(by), f"{order}_nulls_{nulls}")(), F.col(key).asc()]


def page(
    matched: DataFrame, params: SearchParams, key: str, allowed: Sequence[str] = SORT_COLUMNS, nulls: str | None = None
) -> DataFrame:
    """One page in order.  Spark keeps only ``offset + limit`` rows per task."""
    limit, offset = params.limit or 20, params.offset or 0
    return matched.orderBy(*ordering(params, key, allowed, nulls)).offset(offset).limit(limit)


def page_after(matched: DataFrame, params: SearchParams, key: str, last_value, last_key) -> DataFrame:
    """The page after a seen row, for deep pages: a filter in place of an
    offset.  Ascending, nulls first; ``last_value`` None means the last row
    seen had none."""
    by = params.sort_by if params.sort_by in SORT_COLUMNS else SORT_COLUMNS[0]
    c, k = F.col(by), F.col(key)
    if last_value is None:
        later = c.isNotNull() | (k > last_key)
    else:
        later = (c > F.lit(last_value)) | ((c == F.lit(last_value)) & (k > last_key))
    return matched.filter(later).orderBy(c.asc_nulls_first(), k).limit(params.limit or 20)


def search(matched: DataFrame, params: SearchParams, key: str, allowed: Sequence[str] = SORT_COLUMNS) -> DataFrame:
    """The page with ``total`` and ``has_more`` on each row.  The total is a
    scalar subquery: one aggregate, no window over the whole result."""
    total = matched.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    limit, offset = params.limit or 20, params.offset or 0
    return page(matched, params, key, allowed).withColumn("total", total).withColumn(
        "has_more", F.col("total") > offset + limit
    )


def page_index(total: str | Column, size: int = 20) -> Column:
    """Number of pages."""
    t = F.col(total) if isinstance(total, str) else total
    return F.ceil(t / F.lit(size)).cast("bigint")


def urgent(detail: DataFrame, as_of: Column, limit: int = 10, key: str = "listing_id", cap: int | None = None) -> DataFrame:
    """Nearest deadlines that have not passed, available listings only; ``cap`` is the most that a caller allows."""
    today = as_of.cast("date")
    return (
        detail.filter((F.col("status") == "available") & (F.col("deadline_date") >= today))
        .orderBy(F.col("deadline_date").asc(), F.col(key).asc())
        .limit(limit if cap is None else min(limit, cap))
    )


def active_facilities(facilities: DataFrame, region_id: int | None = None) -> DataFrame:
    df = facilities.filter("is_active")
    return df.filter(F.col("region_id") == region_id) if region_id else df


def facility_text(df: DataFrame, text: str | None) -> DataFrame:
    """Facilities whose own or region name has the text, any case."""
    return df.filter(keyword_match(["facility_name", "region_name"], text)) if text else df
