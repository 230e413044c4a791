"""Registration of queries, and rounding for comparison with another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 4
#: Added before rounding, so that values half-way between two roundings go the same way in both engines.
NUDGE = "0.0000003"


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Register a function (spark, sf_dir) -> DataFrame under its name; its doubles are rounded to ``DIGITS``.

        ``sql`` is rounded in the same way: write r(x) for a double column's expression.
        """

        def register(f: Callable) -> Callable:
            key = name or f.__name__
            self.queries[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
            if sql:
                self.sql[key] = f"with {sql}" if not sql.lstrip().startswith(("with", "select")) else sql
            return f

        return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to ``DIGITS`` digits, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{c}`") + F.lit(float(NUDGE)), DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def r(expr: str) -> str:
    """The SQL twin of ``rounded``."""
    return f"round(({expr}) + {NUDGE}, {DIGITS}) + 0.0"
