"""Every registered query and its SQL twin."""

from __future__ import annotations

from . import catalogue_queries, dataset_queries, note_queries, signal_queries, source_queries, track_queries

QUERIES: dict = {}
SQL: dict = {}
for _m in (track_queries, catalogue_queries, note_queries, dataset_queries, source_queries, signal_queries):
    QUERIES |= _m.Q.queries
    SQL |= _m.Q.sql
