"""All queries of the library proper and their SQL."""

from __future__ import annotations

from terrazzo.plans import evidence, motion, spatial, tables, temporal

FAMILIES = (evidence, spatial, temporal, tables, motion)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
SQL = {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
