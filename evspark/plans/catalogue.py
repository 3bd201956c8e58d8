"""Queries by name and the SQL that gives the same rows."""

from __future__ import annotations

from . import detect, jobs, platform, rules, search, store

QUERIES = search.QUERIES | store.QUERIES | detect.QUERIES | platform.QUERIES | rules.QUERIES | jobs.QUERIES
ORACLE_SQL = search.ORACLE_SQL | store.ORACLE_SQL | detect.ORACLE_SQL | platform.ORACLE_SQL | rules.ORACLE_SQL | jobs.ORACLE_SQL
