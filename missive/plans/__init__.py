"""Registered queries over the given tables, and their SQL."""

from __future__ import annotations


def _modules() -> list:
    from missive.plans import import_queries, learn_queries, metric_queries, report_queries, similarity_queries, stream_queries, text_queries, vector_queries

    return [text_queries, metric_queries, report_queries, similarity_queries, vector_queries, learn_queries, stream_queries, import_queries, report_queries]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
