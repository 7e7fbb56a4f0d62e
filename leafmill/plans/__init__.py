"""The registered queries.  Each maps (spark, sf_dir) to a DataFrame."""

from functools import wraps
from importlib import import_module

from leafmill.session import configure

FAMILIES = ["blocks", "web", "sentences", "paged", "cleanup", "library", "layout", "streams"]


def _merge(package: str, attribute: str) -> dict:
    merged: dict = {}
    for family in FAMILIES:
        merged.update(getattr(import_module(f"leafmill.{package}.{family}"), attribute))
    return merged


def _configured(query):
    """The query on a session with the library's settings: the same before every query, so order never matters."""

    @wraps(query)
    def run(spark, sf_dir):
        return query(configure(spark), sf_dir)

    return run


def all_queries() -> dict:
    return {name: _configured(query) for name, query in _merge("plans", "QUERIES").items()}


def all_checks() -> dict:
    return _merge("checks", "CHECKS")
