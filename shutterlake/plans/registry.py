"""Collects the registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.plans.fixtures import Inputs, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# "Now" for every registered query; later rows are not seen.
AS_OF = "2024-01-30 18:00:00"


_INPUTS: dict[tuple, Inputs] = {}


def _inputs(spark: SparkSession, folder: str) -> Inputs:
    """The table definitions of a folder, made once per session; they hold no rows."""
    key = (spark.sparkContext.applicationId, id(spark), str(folder))
    return _INPUTS.setdefault(key, Inputs(spark, folder))


def _plain_times(df: DataFrame) -> DataFrame:
    """Timestamps as UTC wall time, whatever zone the caller shows them in."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`") for f in df.schema
    ])


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query; `uses` names the fixtures its checking SQL reads."""

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _plain_times(build(_inputs(spark, folder)))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            prefix = with_clause(uses.split())
            # The check's own WITH parts follow the fixtures' ones.
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE"):
                text = prefix.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + body[14:]
            elif body.upper().startswith("WITH"):
                text = prefix + ",\n" + body[4:]
            else:
                text = prefix + "\n" + body
            ORACLES[name] = text.replace(":as_of", f"TIMESTAMP '{AS_OF}'")
        return build

    return register
