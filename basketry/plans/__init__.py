"""Queries of the domain over the synthetic tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, tuple[Query, str | None]]:
    from basketry.plans import changes, grocery, household, lines, prices, receipts, recognitions, records, resolution, stock, texts

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (changes, prices, household, records, grocery, stock, lines, receipts, recognitions, resolution, texts):
        found |= module.QUERIES
    return found
