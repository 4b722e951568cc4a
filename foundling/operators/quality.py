"""Quality: mention counts, cross-checks, confidence, review rows, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dictionaries as D
from ..functions.text import col


def mentions(text: str | Column, patterns: Mapping[str, str] = D.MENTIONS) -> list[Column]:
    """Number of matches of each pattern, under the pattern's name."""
    return [F.coalesce(F.regexp_count(col(text), F.lit(p)), F.lit(0)).alias(name) for name, p in patterns.items()]


def warnings(
    valid: str | Column, gender: str | Column, age: str | Column, images: str | Column,
    tolerance: int = 2, age_factor: float = 1.5, image_factor: float = 0.5,
) -> Column:
    """Disagreements between extracted rows and what the page mentions."""
    v, g, a, i = col(valid), col(gender), col(age), col(images)
    # fixed values: wording of the warnings
    say = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    return F.array_compact(F.array(
        F.when(F.abs(v - g) > tolerance, say("性別表記(", g, ")と抽出数(", v, ")に", F.abs(v - g), "個の差異")),
        F.when(a > v * age_factor, say("年齢表記(", a, ")が抽出数より大幅に多い - 取りこぼしの可能性")),
        F.when((v > 0) & (i < v * image_factor), say("画像数(", i, ")が少なすぎる - HTML構造の問題の可能性")),
    ))


def count_warnings(valid: str | Column, checks: Sequence[tuple[str, str | Column, int]]) -> Column:
    """A warning for each expected count further from ``valid`` than its tolerance."""
    v = col(valid)
    return F.array_compact(F.array(*[
        F.when(F.abs(v - col(c)) > tolerance, F.concat(F.lit(f"{name}("), col(c), F.lit(")≠("), v, F.lit(")")))
        for name, c, tolerance in checks
    ]))


def level(warning_list: str | Column) -> Column:
    """No warning high, one medium, two low, more critical."""
    n = F.size(col(warning_list))
    return F.when(n == 0, "high").when(n == 1, "medium").when(n == 2, "low").otherwise("critical")


def level_with_errors(warning_list: str | Column, errors: str | Column, valid: str | Column, error_level: str = "critical") -> Column:
    """Any extraction error decides; then the warnings; then whether there are rows."""
    n = F.size(col(warning_list))
    return (
        F.when(col(errors) > 0, error_level).when(n > 2, "low").when(n > 0, "medium")
        .when(col(valid) > 0, "high").otherwise("low")
    )


# fixed values: weights of the completeness score and names that do not count
WEIGHTS = {"name": "0.3", "gender": "0.2", "age": "0.2", "color": "0.2", "images": "0.1"}
NO_NAME = "名前不明"
NO_NAME_PART = "保護"


def completeness(name: str | Column, gender: str | Column, age: str | Column, color: str | Column, images: str | Column) -> Column:
    """Weighted share of filled fields as an exact decimal."""
    n, g, a, c, i = col(name), col(gender), col(age), col(color), col(images)
    filled = lambda x: x.isNotNull() & (x != "")
    has = {
        "name": filled(n) & (n != NO_NAME) & ~n.contains(NO_NAME_PART), "gender": filled(g) & (g != "unknown"),
        "age": filled(a), "color": filled(c), "images": i > 0,
    }
    parts = [F.when(has[k], F.lit(w).cast("decimal(2,1)")).otherwise(F.lit("0").cast("decimal(2,1)")) for k, w in WEIGHTS.items()]
    return sum(parts[1:], parts[0]).cast("decimal(2,1)")


def row_confidence(rules: Sequence[tuple[Column, str, str]], start: str = "high") -> Column:
    """``rules`` are (condition, level, note) in order: the last that applies
    sets the level, every one that applies adds its note."""
    lvl = F.lit(start)
    for cond, to, _ in rules:
        lvl = F.when(cond, to).otherwise(lvl)
    notes = F.array_compact(F.array(*[F.when(cond, note) for cond, _, note in rules]))
    return F.struct(lvl.alias("confidence_level"), notes.alias("extraction_notes"))


def review_rows(images: DataFrame, key: str, image: str, note: str = "画像から情報を抽出してください") -> DataFrame:
    """Listings for images nobody has read yet: empty fields, low confidence, to be reviewed."""
    none = F.lit(None).cast("string")
    fields = ("name", "breed", "age_estimate", "color", "size", "health_status", "personality", "special_needs")
    return images.select(
        F.col(key).alias("external_id"), F.lit("unknown").alias("animal_type"), F.lit("unknown").alias("gender"),
        *[none.alias(c) for c in fields], F.array(F.col(image)).alias("images"), F.lit("available").alias("status"),
        F.lit("low").alias("confidence_level"), F.lit(True).alias("needs_review"), F.array(F.lit(note)).alias("extraction_notes"),
    )


# fixed values: domains of the checklist
TYPES = ("cat", "dog", "unknown")
STATUSES = ("available", "adopted", "removed", "pending", "reserved", "under_consideration")
GOOD_LEVELS = ("high", "medium")


def report(rows: DataFrame, by: str, types: Sequence[str] = TYPES, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Checklist counts per group."""
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.size("images") > 0).alias("with_images"),
        F.count_if(F.col("animal_type").isin(*types)).alias("known_type"),
        F.count_if(F.col("status").isin(*statuses)).alias("known_status"),
        F.count_if(F.col("confidence_level").isin(*GOOD_LEVELS)).alias("good_confidence"),
    )


def snapshot_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Containers, valid rows, errors, and rows per type of each snapshot."""
    bad = F.coalesce(F.col("extraction_error"), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("containers"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("errors"),
        F.count_if(F.col("animal_type") == "dog").alias("dogs"), F.count_if(F.col("animal_type") == "cat").alias("cats"),
    )
