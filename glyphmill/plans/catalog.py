"""All queries of the library."""

from glyphmill.plans import checks, documents, editing, evidence, tables  # noqa: F401  (they register themselves)
from glyphmill.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
