"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("serve", "monitor", "normalize", "load", "sources", "pages", "quality")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def all_queries():
    """Queries by name; the session time zone is pinned to UTC before each."""
    _load()

    def in_utc(fn):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return run

    return {name: in_utc(fn) for name, fn in QUERIES.items()}


def all_oracles():
    _load()
    return dict(ORACLES)
