"""Links: absolute form, keys in paths, image lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import dictionaries as D
from .text import alternation, col


def absolute(link: str | Column, page: str | Column) -> Column:
    """Absolute form of ``link`` found on ``page``.

    ``//host`` is tested before ``/path``.  ``./`` and ``../`` steps at the
    front of the link are resolved against the page's folder.
    """
    link, page = F.trim(col(link)), col(page)
    bare = F.regexp_replace(page, r"[?#].*$", "")
    scheme = F.regexp_extract(bare, r"^([a-zA-Z]+):", 1)
    site = F.regexp_extract(bare, r"^([a-zA-Z]+://[^/]+)", 1)
    path = F.regexp_replace(bare, r"^[a-zA-Z]+://[^/]+", "")
    folder = F.concat(site, F.when(path.contains("/"), F.regexp_replace(path, r"[^/]*$", "")).otherwise("/"))
    steps = F.floor(F.length(F.regexp_extract(link, r"^(?:\./)*((?:\.\./)*)", 1)) / 3).cast("int")
    tail = F.regexp_replace(link, r"^(?:\./)*(?:\.\./)*", "")
    # drop one folder per "../", but never the site itself
    parts = F.filter(F.split(F.regexp_replace(folder, r"^[a-zA-Z]+://[^/]+", ""), "/"), lambda x: x != "")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - steps, F.lit(0)))
    up = F.concat(site, F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(""), F.lit("/"), tail)
    return (
        F.when(link.isNull() | (link == ""), F.lit(None).cast("string"))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("#"), F.concat(bare, link))
        .when(link.startswith("?"), F.concat(bare, link))
        .otherwise(up)
    )


def path_part(url: str | Column, index: int) -> Column:
    """The ``index``-th folder of the path (from 1), null when missing."""
    path = F.regexp_replace(F.regexp_replace(col(url), r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]+", "")
    return F.nullif(F.get(F.split(path, "/"), F.lit(index)), F.lit(""))


def site(url: str | Column) -> Column:
    return F.regexp_extract(col(url), r"^[a-zA-Z]+://([^/?#]+)", 1)


def partition_key(path: str | Column, root: str = "data/html") -> Column:
    """``area/facility`` from ``root/area/facility/file``."""
    return F.regexp_extract(col(path), f"{re.escape(root)}/([^/]+/[^/]+)/", 1)


def in_target(key: str | Column, target: str | None) -> Column:
    """``a`` selects ``a`` and everything under ``a/``; no target selects all."""
    if not target:
        return F.lit(True)
    key = col(key)
    return (key == target) | key.startswith(target + "/")


def image_urls(images: str | Column) -> Column:
    """Elements are URLs or JSON objects with a ``url``; the rest is dropped."""
    urls = F.transform(col(images), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.url")).otherwise(x))
    return F.filter(urls, lambda x: x.isNotNull() & (x != ""))


def is_decorative(src: str | Column, words: Sequence[str] = tuple(D.DECORATIVE_IMAGES)) -> Column:
    return F.coalesce(col(src).rlike(f"(?i){alternation(words)}"), F.lit(False))
