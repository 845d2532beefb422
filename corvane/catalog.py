"""All queries of the engine outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from .plans import classification, compliance, curation, evaluation, generation, judging, records, texts, verification  # noqa: F401  (they register themselves)
from .plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
