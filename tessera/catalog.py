"""All catalogue queries by name, each with the DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from tessera.plans import analytics, period, relational, texts

QUERIES = {**period.QUERIES, **texts.QUERIES, **relational.QUERIES, **analytics.QUERIES}
SQL = {**period.SQL, **texts.SQL, **relational.SQL, **analytics.SQL}
