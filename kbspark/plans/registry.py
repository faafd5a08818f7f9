"""All of the library's own queries."""

from __future__ import annotations

from kbspark.plans import base, catalog, corpus, index, layout, models, retrieval  # noqa: F401  (importing registers)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
