"""Classification by ordered rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import dictionaries as D
from .text import alternation, any_of, col, matched

Rule = tuple[str, Sequence[str]]


def cascade(c: str | Column, rules: Sequence[Rule], default: str | None = None) -> Column:
    """Label of the first rule with a word in the text."""
    out = F.lit(default) if default is not None else F.lit(None).cast("string")
    for label, words in reversed(list(rules)):
        out = F.when(any_of(c, words), F.lit(label)).otherwise(out)
    return out


def species(
    c: str | Column, default: str = "unknown", dog: Sequence[str] = tuple(D.DOG_WORDS), cat: Sequence[str] = tuple(D.CAT_WORDS)
) -> Column:
    """Dog words win over cat words when a text has both."""
    return cascade(c, [("dog", dog), ("cat", cat)], default)


def is_dog(c: str | Column, **words) -> Column:
    return species(c, **words) == "dog"


def is_cat(c: str | Column, **words) -> Column:
    return species(c, **words) == "cat"


def species_of_heading(
    c: str | Column,
    default: str = "unknown",
    dog_headings: Sequence[str] = tuple(D.DOG_HEADINGS),
    cat_headings: Sequence[str] = tuple(D.CAT_HEADINGS),
    **words,
) -> Column:
    return F.coalesce(
        cascade(c, [("dog", dog_headings), ("cat", cat_headings)]), species(c, default, **words)
    )


def is_adopted(c: str | Column, phrases: Sequence[str] = tuple(D.ADOPTED_PHRASES)) -> Column:
    return any_of(c, phrases)


def adoption_status(c: str | Column, phrases: Sequence[str] = tuple(D.ADOPTED_PHRASES)) -> Column:
    return F.when(is_adopted(c, phrases), "adopted").otherwise("available")


def extended_status(
    c: str | Column,
    adopted: Sequence[str] = tuple(D.ADOPTED_PHRASES),
    reserved: Sequence[str] = tuple(D.NEGOTIATION_PHRASES),
    pending: Sequence[str] = tuple(D.APPLICANT_PHRASES),
) -> Column:
    """Adopted beats reserved beats pending; otherwise available."""
    return cascade(c, [("adopted", adopted), ("reserved", reserved), ("pending", pending)], "available")


def gender(
    c: str | Column, male: Sequence[str] = tuple(D.MALE_WORDS), female: Sequence[str] = tuple(D.FEMALE_WORDS)
) -> Column:
    """Female is tested first: the word "female" contains "male"."""
    return cascade(F.lower(col(c)), [("female", female), ("male", male)], "unknown")


def gender_and_neuter(
    c: str | Column,
    male: Sequence[str] = tuple(D.MALE_WORDS),
    female: Sequence[str] = tuple(D.FEMALE_WORDS),
    neuter: Sequence[str] = tuple(D.NEUTER_WORDS),
) -> Column:
    return F.struct(gender(c, male, female).alias("gender"), any_of(c, neuter).alias("neutered"))


def neuter_phrase(gender_col: str | Column, neutered: str | Column) -> Column:
    """Gender-aware wording of the operation, null when not neutered."""
    g = col(gender_col)
    return F.when(
        col(neutered), F.when(g == "male", "去勢済み").when(g == "female", "避妊済み").otherwise("去勢・避妊済み")
    )


def size(c: str | Column, rules: Sequence[Rule] = tuple(D.SIZE_WORDS), default: str | None = None) -> Column:
    return cascade(c, rules, default)


def test_result(c: str | Column, rules: Sequence[Rule] = tuple(D.TEST_RESULTS)) -> Column:
    return cascade(c, rules, "unknown")


def age_text(c: str | Column, pattern: str = D.AGE_PATTERN, stages: Sequence[Rule] = tuple(D.AGE_STAGES)) -> Column:
    """The age wording itself, or the life stage named in the text."""
    return F.coalesce(matched(c, pattern), cascade(c, stages))


def age_months(c: str | Column, units: Sequence[tuple[str, int]] = tuple(D.AGE_UNITS_MONTHS)) -> Column:
    """The first age in the text as a number of months."""
    c = col(c)
    unit = alternation([u for u, _ in units])
    number = F.regexp_extract(c, f"([0-9]+)(?:{unit})", 1).try_cast("int")
    found = F.regexp_extract(c, f"[0-9]+({unit})", 1)
    factor = F.lit(None).cast("int")
    for name, months in units:
        factor = F.when(found == name, F.lit(months)).otherwise(factor)
    return number * factor


def age_bucket(years: str | Column) -> Column:
    """Under one: kitten; seven and more: senior; unknown counts as adult."""
    y = col(years)
    return F.when(y < 1, "kitten").when(y >= 7, "senior").otherwise("adult")


def urgency_level(deadline: str | Column, today: Column, steps: tuple[int, int, int] = (3, 7, 14)) -> Column:
    d = col(deadline)
    urgent, warning, caution = steps
    return (
        F.when(d <= F.date_add(today, urgent), "urgent")
        .when(d <= F.date_add(today, warning), "warning")
        .when(d <= F.date_add(today, caution), "caution")
        .otherwise("normal")
    )


def days_remaining(deadline: str | Column, as_of: Column) -> Column:
    """Whole days left, a started day does not count, never negative."""
    seconds = F.unix_timestamp(col(deadline).cast("timestamp")) - F.unix_timestamp(as_of)
    left = (seconds / F.lit(86400)).cast("int")
    return F.when(col(deadline).isNotNull(), F.greatest(F.lit(0), left))


def urgency_label(days: str | Column, zero_is_blank: bool = True) -> Column:
    """Badge text.  With ``zero_is_blank`` the last day has no badge."""
    d = col(days)
    # fixed values: badge texts
    label = F.when(d < 0, "期限切れ").when(d == 0, "今日まで").otherwise(F.format_string("あと%d日", d))
    return F.when(d.isNull() | ((d == 0) & F.lit(zero_is_blank)), F.lit(None).cast("string")).otherwise(label)


def duration_label(ms: str | Column) -> Column:
    """Minutes and seconds (``3分5秒``), seconds alone under a minute."""
    m = col(ms)
    seconds = F.floor(m / 1000)
    return F.when(seconds >= 60, F.format_string("%d分%d秒", F.floor(seconds / 60), seconds % 60)).otherwise(
        F.format_string("%d秒", seconds)
    )


def duration_short(ms: str | Column) -> Column:
    """Milliseconds under a second, then seconds to one decimal; a dash for none."""
    m = col(ms)
    tenths = F.floor((m + 50) / 100)
    return (
        F.when(m.isNull() | (m == 0), "—")
        .when(m < 1000, F.format_string("%dms", m))
        .otherwise(F.format_string("%d.%d秒", F.floor(tenths / 10), tenths % 10))
    )
