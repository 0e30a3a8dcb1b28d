"""Names of the library's queries and of the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.plans import composed, corpus, oracles, stored


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The popular sample of every source."""
    return corpus.QUERIES["popular_sample"](spark, folder)


def queries() -> dict[str, corpus.Query]:
    return dict(corpus.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {**oracles.SQL, **stored.SQL, **composed.SQL}
