"""Queries of the graph engine and the SQL that checks them."""

from __future__ import annotations

from quadrille.plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
