"""Table upkeep: expiry, rebuilds."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.times import as_column
from shutterlake.operators import changes, rollups
from shutterlake.schemas import TABLES
from shutterlake.sources import batches, tables

READY = "_ready"


def keep_days(df: DataFrame, date_column: str, days: int, as_of) -> DataFrame:
    """Rows not older than `days` days."""
    return df.filter(F.to_date(date_column) >= F.date_sub(F.to_date(as_column(as_of)), days))


def unexpired(df: DataFrame, table: str, as_of) -> DataFrame:
    """Rows of a table within its retention."""
    meta = TABLES[table]
    if meta.retention_days is None:
        return df
    return keep_days(df, meta.date_column, meta.retention_days, as_of)


def expired_months(months: DataFrame, days: int, as_of) -> DataFrame:
    """Month partitions (column `month`, yyyyMM) that lie wholly outside the retention.

    These can be dropped as folders; only the month on the edge is rewritten (`expire`).
    """
    edge = F.date_format(F.date_sub(F.to_date(as_column(as_of)), days), "yyyyMM")
    return months.filter(F.col("month").cast("string") < edge)


def compact(spark, table: str, streamed: str, stored: str, before_batch: int, marks: str | None = None) -> int:
    """Fold the batches below `before_batch` of a streamed table into the stored one; the number of batch folders it took.

    With the folder of the job's `marks`, only batches below the first unfinished one are folded. The months
    that the batches touch are staged with them; then the staged months replace the stored ones, the
    stored table notes up to which batch it is folded, and the batch folders are deleted. A run that dies on the way is
    simply run again: what is staged whole is put in place, anything less is staged anew,
    and rows of a batch that is folded now never count as old ones. Equal rows are kept as they are.
    """
    staged = f"{stored.rstrip('/')}.staged"
    limit = before_batch if marks is None else min(before_batch, batches.unfinished_from(spark, marks))
    taken = sum(batch < limit for batch in batches.streamed(spark, streamed))
    _put_in_place(spark, table, streamed, stored, staged)
    folded = batches.folded_below(spark, stored)
    closed = {batch: at for batch, at in batches.streamed(spark, streamed).items() if folded <= batch < limit}
    if not closed:
        return taken
    rows = spark.read.option("basePath", streamed).parquet(*closed.values())
    dated = tables.TABLES[table].date_column is not None
    parts = [batches.columns_of(rows, table, "batch")]
    if any(not name.startswith("_") for name in batches.names(spark, stored)):
        old = spark.read.option("mergeSchema", "true").parquet(stored)
        if dated:
            months = rows.select(F.col("month").cast("int").alias("month")).distinct()
            old = old.join(F.broadcast(months), "month", "left_semi")  # a row per month
        if "batch" in old.columns:
            old = old.filter(F.col("batch").isNull() | (F.col("batch") < folded))
        parts.append(batches.columns_of(old, table, "batch"))
    added = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    tables.write_table(added, table, staged, mode="overwrite", columns=added.columns)
    batches.touch(spark, f"{staged}/{READY}/{max(closed) + 1}")
    _put_in_place(spark, table, streamed, stored, staged)
    return taken


def _put_in_place(spark, table: str, streamed: str, stored: str, staged: str) -> None:
    """Finish a fold that is staged whole, drop one that is not, and delete batches that are folded."""
    _replace(spark, table, stored, staged, lambda number: batches.touch(spark, f"{stored}/{batches.FOLDED}/{number}"))
    folded = batches.folded_below(spark, stored)
    for batch, at in batches.streamed(spark, streamed).items():
        if batch < folded:
            batches.delete(spark, at)


def _replace(spark, table: str, stored: str, staged: str, note=lambda number: None) -> None:
    """Put months that are staged whole in place of the stored ones; drop what is staged in part.

    A run that died on the way left the months it had not moved staged, and the next one moves those.
    """
    for number in batches.names(spark, f"{staged}/{READY}"):
        if TABLES[table].date_column is None:
            rows = spark.read.parquet(staged)
            tables.write_table(rows, table, stored, mode="overwrite", columns=rows.columns)
        else:
            rows = spark.read.schema(TABLES[table].columns).parquet(staged)
            tables.write_table(rows, table, stored, mode="overwrite", staged=staged)
        note(int(number))
    batches.delete(spark, staged)


def drop_expired(spark, table: str, stored: str, as_of) -> list[str]:
    """Delete the month folders that lie wholly outside a table's retention; the months deleted."""
    meta = TABLES[table]
    if meta.retention_days is None:
        return []
    months = [(at.rsplit("=", 1)[1], at) for at in tables.month_folders(spark, table, stored)]
    if not months:
        return []
    listed = spark.createDataFrame([(month,) for month in sorted({m for m, _ in months})], "month string")
    gone = {row["month"] for row in expired_months(listed, meta.retention_days, as_of).collect()}
    for month, at in months:
        if month in gone:
            batches.delete(spark, at)
    return sorted(gone)


def expire(spark, table: str, stored: str, as_of) -> list[str]:
    """Apply a table's retention to the day: delete its expired months, and rewrite the month on the edge without its expired days.

    This is what a daily upkeep job calls. The edge month is staged whole before it is replaced, and a run that
    died in between is finished by the next one. The months deleted.
    """
    meta = TABLES[table]
    staged = f"{stored.rstrip('/')}.edge"
    _replace(spark, table, stored, staged)
    gone = drop_expired(spark, table, stored, as_of)
    if meta.retention_days is None or not any(not name.startswith("_") for name in batches.names(spark, stored)):
        return gone
    edge = spark.range(1).select(F.date_sub(F.to_date(as_column(as_of)), meta.retention_days).alias("day")).first()["day"]
    rows = spark.read.option("mergeSchema", "true").parquet(stored).filter(F.col("month") == int(edge.strftime("%Y%m")))
    date = F.to_date(meta.date_column)
    if not rows.filter(date < F.lit(edge)).isEmpty():
        kept = rows.filter(date >= F.lit(edge))
        if kept.isEmpty():
            for at in _month_folders(spark, table, stored, edge.strftime("%Y%m")):
                batches.delete(spark, at)
        else:
            tables.write_table(kept, table, staged, mode="overwrite", columns=[c for c in rows.columns if c != "month"])
            batches.touch(spark, f"{staged}/{READY}/0")
            _replace(spark, table, stored, staged)
    return gone


def _month_folders(spark, table: str, stored: str, month: str) -> list[str]:
    return [at for at in tables.month_folders(spark, table, stored) if at.endswith(f"/month={month}")]


def upkeep(spark, out: str, stored: str, as_of) -> dict[str, tuple[int, list[str]]]:
    """The daily job over a streaming job's tables: fold what is finished, then apply each table's retention.

    Per table of the job's folder `out` the number of batch folders taken and the months deleted below `stored`.
    """
    limit = batches.sum_up_marks(spark, out)
    done = {}
    for table in sorted(set(batches.names(spark, out)) & set(TABLES)):
        taken = compact(spark, table, f"{out}/{table}", f"{stored}/{table}", limit, marks=out)
        done[table] = taken, expire(spark, table, f"{stored}/{table}", as_of)
    return done


def latest_per_key(df: DataFrame, table: str, version: list[str]) -> DataFrame:
    """The latest row per unique key of a table."""
    return changes.latest(df, TABLES[table].key, version)


def rebuild_table(spark, raw_path: str, rollup_path: str, window_type: str, start, end) -> None:
    """Recompute whole months of a stored rollup from stored raw rows.

    Months of that window type are the unit that is overwritten, so the range
    is widened to them; the other window type stays. Raw rows are stored by the
    day they were received, and a device's clock may run ahead or behind by any time, so no folder is
    left out by its month: the filter on the event time skips row groups by their statistics.
    """
    first = dt.date.fromisoformat(str(start)[:7] + "-01")
    after = (dt.date.fromisoformat(str(end)[:7] + "-01") + dt.timedelta(days=32)).replace(day=1)
    last = after - dt.timedelta(days=1)
    rebuilt = rollups.rebuild(tables.read_table(spark, "events_raw", raw_path), window_type, first, last)
    tables.write_table(rebuilt, "events_agg", rollup_path, mode="overwrite")
