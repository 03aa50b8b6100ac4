"""The registered queries and, where SQL can say it, the same result as SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            # The block row column is called ``by``, which SQL only takes quoted.
            ORACLES[name] = re.sub(r"\bby\b", '"by"', sql)
        return run

    return add
