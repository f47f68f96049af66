"""Registry of the queries and their SQL."""

from __future__ import annotations

from functools import partial

from lorebase.plans import capture_queries, contextbook, continuity_queries, entity_queries, maintenance_queries, memory_queries, pack_queries, search_queries, sequence_queries, state_queries, textbook
from lorebase.plans.dialect import spelled
from lorebase.plans.sqlbook import BOOK
from lorebase.sources.views import run_sql, with_views

def _booked(spark, sf_dir, sql):
    return run_sql(spark, sf_dir, sql)


ALL = {**BOOK, **textbook.BOOK, **contextbook.BOOK}
_built = (capture_queries, continuity_queries, entity_queries, maintenance_queries, memory_queries, pack_queries, search_queries, sequence_queries, state_queries)
QUERIES: dict = {name: partial(_booked, sql=spelled(sql, 1)) for name, sql in ALL.items()}
ORACLE_SQL: dict[str, str] = {name: with_views(spelled(sql, 2)) for name, sql in ALL.items()}
for _book in _built:
    QUERIES |= _book.QUERIES
    ORACLE_SQL |= {k: with_views(v) for k, v in getattr(_book, "ORACLE_SQL", {}).items()}
