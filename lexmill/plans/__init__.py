"""Registered queries over the given tables."""

from __future__ import annotations

from lexmill.plans import check_plans, io_queries, page_queries, score_queries, stat_queries, text_queries, token_queries
from lexmill.plans.registry import ORACLE, QUERIES
from lexmill.plans.text_queries import flagship

__all__ = ["all_queries", "check_plans", "flagship", "io_queries", "oracles", "page_queries", "score_queries", "stat_queries", "text_queries", "token_queries"]


def all_queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLE)
