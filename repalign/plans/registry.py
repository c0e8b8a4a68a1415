"""Named queries over the star-schema tables and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.scalars import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six digits, so that two engines' sums compare equal."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[tidy(df[c], DIGITS).alias(c) if isinstance(kinds[c], DoubleType) else df[c] for c in df.columns])


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable:
    """Register a query; ``doubles`` names the columns of ``sql`` to be rounded alike."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            fixes = ", ".join(f"round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            ORACLE[name] = f"SELECT * {f'REPLACE ({fixes}) ' if fixes else ''}FROM ({sql}) AS result"
        return fn

    return register
