"""Named queries over the driver tables, with the SQL they must agree with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipledger.plans.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query taking ``Views``; ``sql`` may use the derived views."""

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return register
