"""The modules with queries, for ``__spark_entry__.py`` and the tests."""

from __future__ import annotations

from cloakframe.plans import queries, queries_sql, queries_state

MODULES = [queries, queries_state, queries_sql]
