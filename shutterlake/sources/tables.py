"""Stored tables: row defaults, layout, batch writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.text import or_else
from shutterlake.functions.times import as_column
from shutterlake.operators.decode import DATE_SOURCE
from shutterlake.schemas import TABLES
from shutterlake.sources import batches

# Column defaults that differ from '' and 0.
TEXT_DEFAULTS = {
    "events_raw": {"mime_type": "image/jpeg"},
    "events_enriched": {"detections": "[]", "inference_model": "yolov8n", "inference_version": "1.0.0"},
    "alerts": {"severity": "info", "status": "active", "metadata": "{}"},
}
# Columns set to "now" when missing, and those that may stay null.
NOW_COLUMNS = {"received_at", "processed_at", "triggered_at", "created_at"}
NULLABLE = {"acknowledged_at", "resolved_at"}
JDBC_BATCH = 1000


def insert_rows(df: DataFrame, table: str, now) -> DataFrame:
    """`df` as rows of `table`: all columns in order, defaults filled in."""
    texts = TEXT_DEFAULTS.get(table, {})

    def column(name: str, kind: str) -> Column:
        if name == "event_id" and name not in df.columns:
            # A hash of the row's key, so that a replayed batch gives the same ids.
            key = ("device_id", "timestamp", "shot_id", "image_url")
            return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in key)), 256)
        if name == "processing_date":
            return F.to_date(column(DATE_SOURCE[table], "timestamp"))
        value = F.col(name) if name in df.columns else F.lit(None)
        if kind == "string":
            return or_else(value.cast("string"), texts.get(name, ""))
        if name in NOW_COLUMNS:
            return F.coalesce(value.cast(kind), as_column(now))
        if kind in ("bigint", "int"):
            return F.coalesce(value.cast(kind), F.lit(0).cast(kind))
        return value.cast(kind)

    return df.select(*[
        column(f.name, f.dataType.simpleString()).alias(f.name) for f in TABLES[table].columns
    ])


def table_columns(df: DataFrame, table: str) -> DataFrame:
    """Only the columns the table has (topic envelope columns drop out)."""
    return df.select(*[name for name in TABLES[table].columns.names if name in df.columns])


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyyMM")


def laid_out(df: DataFrame, table: str) -> DataFrame:
    """`df` with its month column, clustered and sorted for the table's layout.

    Rows are rebalanced by month: small months share a task, and a large month
    is split over many by size, so neither a month nor a busy device is written
    by one task. Within a file rows are sorted by the table's key, which gives
    narrow min/max statistics per row group.
    """
    meta = TABLES[table]
    with_month = df.withColumn("month", month_of(F.col(meta.date_column)))
    keys = [name for name in meta.key if name in df.columns]
    folders = [*meta.partitions, "month"]
    return with_month.hint("rebalance", *folders).sortWithinPartitions(*folders, *keys)


def month_folders(spark: SparkSession, table: str, path: str) -> list[str]:
    """The folders of a dated table that hold files: those of its months, below its further partitions."""
    found = [path]
    for name in [*TABLES[table].partitions, "month"]:
        found = [f"{at}/{part}" for at in found for part in batches.names(spark, at) if part.startswith(f"{name}=")]
    return found


def write_table(
    df: DataFrame, table: str, path: str, mode: str = "append", columns: list[str] | None = None, staged: str | None = None,
) -> None:
    """Write month partitions with bloom filters on the lookup columns.

    `mode="overwrite"` replaces only the folders of months (and of a table's
    further partitions, as the grain of a rollup) that are present in `df`. Rows that this function has written
    to a `staged` folder beside the path have their layout already: their month folders are moved.
    """
    meta = TABLES[table]
    if staged:
        for at in month_folders(df.sparkSession, table, staged):
            batches.move(df.sparkSession, at, path + at[len(staged):])
        return
    chosen = df.select(*columns) if columns else table_columns(df, table)
    if meta.date_column is None:
        chosen.write.mode(mode).parquet(path)
        return
    writer = laid_out(chosen, table).write.mode(mode).partitionBy(*meta.partitions, "month")
    for name in meta.bloom_columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_table(spark: SparkSession, table: str, path: str, start=None, end=None) -> DataFrame:
    """A stored table with its own columns, optionally limited to days start..end.

    The month partitions to read are derived from the days, so the filter
    prunes folders before it reaches the files.
    """
    meta = TABLES[table]
    df = spark.read.parquet(path)
    for bound, keep_month, keep_day in (
        (start, lambda m: F.col("month") >= m, lambda d: F.col(meta.date_column) >= d),
        (end, lambda m: F.col("month") <= m, lambda d: F.col(meta.date_column) <= d),
    ):
        if bound is not None:
            text = str(bound)[:10]
            df = df.filter(keep_month(F.lit(int(text[:4] + text[5:7])))).filter(
                keep_day(F.lit(text).cast("date"))
            )
    return table_columns(df, table)


def write_jdbc(
    df: DataFrame, table: str, url: str, driver: str, mode: str = "append",
    batch_size: int = JDBC_BATCH, **options: str,
) -> None:
    """Append the table's columns over JDBC."""
    writer = table_columns(df, table).write.format("jdbc").mode(mode)
    writer = writer.option("url", url).option("driver", driver).option("dbtable", table)
    writer = writer.option("batchsize", batch_size).option("isolationLevel", "NONE")
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.save()


def fan_out(
    outputs: dict[str, DataFrame], write: Callable[[DataFrame, str], None], disabled: set[str] = frozenset()
) -> dict[str, bool]:
    """Write each enabled table; True per written table, False per disabled one.

    A failed write raises, so that a stream's checkpoint does not pass it.
    """
    written = {}
    for table, df in outputs.items():
        if table not in disabled:
            write(df, table)
        written[table] = table not in disabled
    return written
