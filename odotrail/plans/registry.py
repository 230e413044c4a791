"""All registered queries and their SQL twins."""

from __future__ import annotations

from . import model_queries, quality_queries, road_queries, telemetry_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (telemetry_queries, quality_queries, road_queries, model_queries):
    QUERIES |= _module.book.queries
    SQL |= _module.book.sql
