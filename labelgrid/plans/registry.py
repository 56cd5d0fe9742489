"""Registry of named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 8


def query(name: str, sql: str | None = None, rounded: list[str] = (), digits: int = DIGITS, lists: list[str] = ()):
    """Register a query; ``rounded`` doubles are cut to ``digits`` digits on both sides.

    Engines add doubles in different orders, so the last bits of a sum differ.
    ``lists`` columns are compared as comma-separated text.
    """
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = fn(spark, sf)
            cols = {c: F.round(F.col(c).cast("double"), digits) for c in rounded}
            cols.update({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists})
            return out.withColumns(cols) if cols else out

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            cut = [f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in rounded] + [f"array_to_string(CAST({c} AS VARCHAR[]), ',') AS {c}" for c in lists]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(cut)}) FROM ({sql.strip()}) AS q" if cut else sql.strip()
        return run

    return wrap


def with_views(*views: str) -> str:
    """``WITH`` clause text from view definitions."""
    return "WITH " + ",\n".join(v.strip() for v in views) + "\n"
