"""Phrases put before a table's texts, by a row's key, so that every branch of a rule has rows; the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def said(key: str, phrases: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, phrases)), (F.col(key) % len(phrases) + 1).cast("int"))


def said_sql(key: str, phrases: list[str]) -> str:
    return "([" + ", ".join(quoted(p) for p in phrases) + f"])[{key} % {len(phrases)} + 1]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
