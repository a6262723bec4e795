"""Queries: an operator applied to the tables, and the SQL that it must equal."""

from collections.abc import Callable


def _registered():
    from . import checks, claims, documents, elements, entities, extraction, graph, index, registry, requests, rest, streams, text  # noqa: F401

    return registry


def all_queries() -> dict[str, Callable]:
    return dict(_registered().QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_registered().SQL)
