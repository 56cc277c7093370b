"""All registered queries of the library."""

from rankeval.plans import rank_queries, rung_queries, text_queries  # noqa: F401
from rankeval.plans.base import CATALOG


def queries() -> dict:
    return {name: f for name, (f, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
