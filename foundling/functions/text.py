"""Text normalisation: Column in, Column out, all inside code generation."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from . import dictionaries as D

#: As many elements as an array can have.
ALL = 2**31 - 16


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.  A lambda of a higher-order
    function evaluates an outer expression again for every element; bound as a
    lambda variable it is a plain reference."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def alternation(words: Sequence[str]) -> str:
    """A regular expression that matches any of ``words`` literally."""
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def any_of(c: str | Column, words: Sequence[str]) -> Column:
    """True when the text contains one of ``words``; false for null."""
    c = col(c)
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(w) for w in words]), F.lit(False))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def matched(c: str | Column, pattern: str, group: int = 0) -> Column:
    """The match as text, null when there is none (Spark gives an empty string)."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def half_width(c: str | Column) -> Column:
    """Full-width digits to ASCII."""
    return F.translate(col(c), "０１２３４５６７８９", "0123456789")


def collapse_spaces(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), r"[ \t\r\n　]+", " "))


def strip_invisible(c: str | Column) -> Column:
    """Drop zero-width spaces and byte order marks."""
    return F.translate(col(c), "​﻿", "")


def strip_tags(c: str | Column) -> Column:
    """Line breaks to newlines, every other tag away."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?i)<br[^>]*>", "\n"), r"<[^>]*>", "")


def strip_code(c: str | Column) -> Column:
    """Remove comments, scripts and styles: their text is not page text."""
    c = F.regexp_replace(col(c), r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    return F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")


def drop_honorific(c: str | Column, pattern: str = D.HONORIFICS) -> Column:
    return F.regexp_replace(F.trim(col(c)), pattern, "")


def drop_block(c: str | Column, start: str, end: str) -> Column:
    """Remove boilerplate from ``start`` up to and with ``end`` (patterns)."""
    return F.regexp_replace(col(c), f"(?s){start}.*?{end}", "")


def bracketed(c: str | Column, opening: str = "（(", closing: str = "）)") -> Column:
    """Text inside the first pair of brackets, or null."""
    return matched(c, f"[{re.escape(opening)}]([^{re.escape(opening + closing)}]*)[{re.escape(closing)}]", 1)


def without_brackets(c: str | Column, opening: str = "（(", closing: str = "）)") -> Column:
    return F.trim(
        F.regexp_replace(col(c), f"[{re.escape(opening)}][^{re.escape(opening + closing)}]*[{re.escape(closing)}]", "")
    )


def preview(c: str | Column, n: int = 300) -> Column:
    return F.substring(col(c), 1, n)


def slug(prefix: str, c: str | Column) -> Column:
    """``prefix`` and the key with each non-alphanumeric sign as a dash, lower case."""
    return F.concat(F.lit(prefix), F.lower(F.regexp_replace(col(c), r"[^a-zA-Z0-9]", "-")))


def base_name(path: str | Column) -> Column:
    """File name without folder, query and extension."""
    name = F.element_at(F.split(F.regexp_replace(col(path), r"[?#].*$", ""), "/"), -1)
    return F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")


def repair(c: str | Column, table: Sequence[tuple[str, str]] = tuple(D.OCR_REPAIRS)) -> Column:
    """Apply a correction table in order."""
    return reduce(lambda acc, fix: F.replace(acc, F.lit(fix[0]), F.lit(fix[1])), table, col(c))


def digits_misread_as_letters(c: str | Column) -> Column:
    """Letter O between digits (or at the end of a number) is a zero."""
    return F.regexp_replace(col(c), r"(?<=[0-9])[OoＯ]", "0")


def keyword_context(c: str | Column, keyword: str, width: int, stop: str = "。") -> Column:
    """Up to ``width`` characters around ``keyword`` within one sentence."""
    # the pattern alone would try every place of a long text; the first keyword
    # is found by a plain search and the pattern sees only what is around it
    c = col(c)
    at = F.instr(c, keyword)
    start = F.greatest(at - width, F.lit(1))
    near = F.substring(c, start, at - start + F.lit(2 * width + len(keyword)))
    w = f"[^{stop}]{{0,{width}}}"
    return F.when(at > 0, F.nullif(F.trim(F.regexp_extract(near, f"{w}{re.escape(keyword)}{w}", 0)), F.lit("")))


def all_contexts(
    c: str | Column, keywords: Sequence[str] = tuple(D.HEALTH_WORDS), width: int = 20, sep: str = "; ", stop: str = "。"
) -> Column:
    """Every keyword's surroundings, joined in list order; null when none matches."""
    parts = F.array_compact(F.array(*[keyword_context(c, k, width, stop) for k in keywords]))
    return F.when(F.size(parts) > 0, F.array_join(parts, sep))


def first_context(
    c: str | Column, keywords: Sequence[str] = tuple(D.PERSONALITY_WORDS), width: int = 30, stop: str = "。"
) -> Column:
    return F.coalesce(*[keyword_context(c, k, width, stop) for k in keywords])


def first_keyword(c: str | Column, keywords: Sequence[str] = tuple(D.BREEDS)) -> Column:
    """First keyword of the *list* found in the text (not the first in the text)."""
    c = col(c)
    return F.coalesce(*[F.when(c.contains(k), F.lit(k)) for k in keywords])


def first_in_text(c: str | Column, keywords: Sequence[str] = tuple(D.COLOURS)) -> Column:
    """The keyword that appears first in the text."""
    return matched(c, f"({alternation(keywords)})", 1)


def labelled(
    c: str | Column, names: Sequence[str], labels: Sequence[str] = tuple(D.LABELS), char_class_stop: bool = False
) -> Column:
    """Value after the first of ``names`` in run-on text, up to the next label.

    ``char_class_stop`` stops at any single character of any label instead,
    which cuts values that contain such a character.
    """
    found = []
    for name in names:
        if char_class_stop:
            stop = "".join(sorted({ch for lab in labels for ch in lab}))
            pattern = f"{re.escape(name)}\\s*[:：]?\\s*([^\\s{re.escape(stop)}]+)"
        else:
            pattern = f"{re.escape(name)}\\s*[:：]?\\s*(.+?)\\s*(?:{alternation(labels)}|[\\r\\n]|$)"
        found.append(F.nullif(F.trim(F.regexp_extract(c if isinstance(c, Column) else F.col(c), pattern, 1)), F.lit("")))
    return F.coalesce(*found)


def flag_phrase(c: str | Column, flags: Sequence[tuple[str, str]], sep: str = "、") -> Column:
    """Phrases of the flags whose trigger is in the text, in order; null if none."""
    c = col(c)
    parts = F.array_compact(F.array(*[F.when(c.contains(t), F.lit(p)) for t, p in flags]))
    return F.when(F.size(parts) > 0, F.array_join(parts, sep))


def lines(c: str | Column) -> Column:
    """Trimmed non-empty lines."""
    split = F.transform(F.split(col(c), r"\r?\n"), lambda x: F.trim(x))
    return F.filter(split, lambda x: x != "")


def share_title(*parts: str | Column, sep: str = " / ") -> Column:
    return F.concat_ws(sep, *[blank_to_null(p) for p in parts])
