"""Queries over the standard tables, one or more for each operator, with the SQL that says the same."""

from __future__ import annotations

from . import iterations, markup, pages, scalars, spans, tables, texts, words

QUERIES = {**texts.QUERIES, **tables.QUERIES, **scalars.QUERIES, **markup.QUERIES, **spans.QUERIES, **pages.QUERIES, **iterations.QUERIES, **words.QUERIES}
ORACLE_SQL = {**texts.ORACLE_SQL, **tables.ORACLE_SQL, **scalars.ORACLE_SQL, **markup.ORACLE_SQL, **spans.ORACLE_SQL, **pages.ORACLE_SQL, **iterations.ORACLE_SQL, **words.ORACLE_SQL}
