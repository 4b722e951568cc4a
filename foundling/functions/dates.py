"""Dates in Japanese and ISO spelling, eras, stamps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from . import dictionaries as D
from .text import col, half_width, let


def _found(c: Column, pattern: str, year: Callable[[Column], Column]) -> Column:
    """A date from the first match of ``pattern``.  The text is searched once;
    the parts come out of the short match.  Null when it is not a real day."""

    def day(m: Column) -> Column:
        parts = F.concat_ws("-", year(m).cast("string"), F.regexp_extract(m, pattern, 2), F.regexp_extract(m, pattern, 3))
        return F.when(m != "", parts.try_cast("date"))

    return let(F.regexp_extract(c, pattern, 0), day)


def _common(c: Column) -> Column:
    pattern = r"([0-9]{4})(?:年|[-/])([0-9]{1,2})(?:月|[-/])([0-9]{1,2})"
    return _found(c, pattern, lambda m: F.regexp_extract(m, pattern, 1))


def parse_date(c: str | Column) -> Column:
    """First date found as ``Y年M月D日``, ``Y-M-D`` or ``Y/M/D``, else an era date."""
    return let(half_width(c), lambda t: F.coalesce(_common(t), _era(t, D.ERAS)))


def _era(c: Column, eras: Sequence[tuple[str, str, int]]) -> Column:
    names = "|".join(x for name, letter, _ in eras for x in (name, letter))
    pattern = rf"(?:{names})([0-9]{{1,2}}|元)(?:年|[.])([0-9]{{1,2}})(?:月|[.])([0-9]{{1,2}})"

    def year(m: Column) -> Column:
        base = F.lit(None).cast("int")
        for name, letter, before_first in eras:
            base = F.when(m.startswith(name) | m.startswith(letter), before_first).otherwise(base)
        return F.replace(F.regexp_extract(m, pattern, 1), F.lit("元"), F.lit("1")).try_cast("int") + base

    return _found(c, pattern, year)


def era_date(c: str | Column, eras: Sequence[tuple[str, str, int]] = tuple(D.ERAS)) -> Column:
    """``令和7年4月16日`` or ``R7.4.16``; a first year may be written 元."""
    return _era(half_width(c), eras)


def month_date(c: str | Column) -> Column:
    """First day of the month in ``Y年M月``."""
    text = half_width(F.regexp_extract(col(c), r"[0-9０-９]{4}年[0-9０-９]{1,2}月", 0))
    return F.concat(F.translate(text, "年月", "--"), F.lit("01")).try_cast("date")


def code_date(c: str | Column, pattern: str = r"jotof([0-9]{6})") -> Column:
    """Date from a six-digit ``YYMMDD`` code; the pattern's group 1 is the code."""
    digits = F.regexp_extract(col(c), pattern, 1)
    return F.when(digits != "", F.try_to_date(F.concat(F.lit("20"), digits), "yyyyMMdd"))


def jst_stamp(ts: str | Column) -> Column:
    """UTC instant as ``yyyyMMdd_HHmmss`` in Japan time."""
    return F.date_format(F.from_utc_timestamp(col(ts), "Asia/Tokyo"), "yyyyMMdd_HHmmss")


def jst_iso(ts: str | Column) -> Column:
    """UTC instant as ISO 8601 with the +09:00 offset."""
    return F.concat(F.date_format(F.from_utc_timestamp(col(ts), "Asia/Tokyo"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+09:00"))


def legacy_stamp_to_jst(stamp: str | Column) -> Column:
    """A compact UTC stamp moved to Japan time; null when it is not a stamp."""
    return jst_stamp(F.try_to_timestamp(col(stamp), F.lit("yyyyMMdd_HHmmss")))
