"""Mutable documents as change rows: latest row, field patches, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_eq(df: DataFrame, **given) -> DataFrame:
    """Equality filters for the arguments that are not None."""
    for name, value in given.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each key.

    Spark limits each key on the map side before the shuffle, so a key holding
    most rows sends at most `n` of them per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, keys: list[str], version: list[str], deleted: Column | None = None) -> DataFrame:
    """The latest row per key; keys whose latest row is a deletion drop out."""
    rows = top_per_key(df, keys, [F.desc(v) for v in version], 1)
    return rows if deleted is None else rows.filter(~F.coalesce(deleted, F.lit(False)))


def patched(
    changes: DataFrame, key: str, version: list[str], fields: list[str], op: str = "op"
) -> DataFrame:
    """Documents after all changes: each field holds its last given value.

    `op` is create, update or delete. Updates of unknown keys are ignored, and
    a deleted document is absent.
    """
    at = F.struct(*version)
    document = changes.groupBy(key).agg(
        *(F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields),
        F.max_by(op, at).alias("_last"),
        F.bool_or(F.col(op) == "create").alias("_created"),
        F.min(F.when(F.col(op) == "create", F.col(version[0]))).alias("created_at"),
        F.max(version[0]).alias("updated_at"),
    )
    return document.filter(F.col("_created") & (F.col("_last") != "delete")).drop("_created", "_last")


def insert_absent(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is not present yet, one per key."""
    return rows.dropDuplicates(keys).join(present.select(*keys), keys, "left_anti")


def upsert(present: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """`incoming` replaces rows of `present` with the same key."""
    kept = present.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_by_days(
    df: DataFrame, time: str, order: list[Column], number: int, size: int, descending: bool = True, counts: DataFrame | None = None,
) -> DataFrame:
    """`page` of rows whose order begins with `time`, sorting only the days that the page lies in.

    The rows of each day are counted first, or taken from `counts` (day, n) where that is stored; the days
    before the page are skipped by their counts, so a deep page costs no more than one near the start.
    """
    day = F.to_date(time)
    days = df.groupBy(day.alias("day")).agg(F.count("*").alias("n")) if counts is None else counts
    skip = (number - 1) * size
    # One row per day in the window without a partition.
    upto = F.sum("n").over(Window.orderBy(F.desc("day") if descending else F.asc("day")))
    held = days.groupBy("day").agg(F.sum("n").alias("n")).withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    hit = held.filter((F.col("upto") > skip) & (F.col("before") < skip + size)).agg(
        F.min("day").alias("low"), F.max("day").alias("high"), F.min("before").alias("before"), F.count_if(F.col("day").isNull()).alias("unknown")).first()
    if hit["before"] is None:
        return df.limit(0)
    if hit["unknown"]:
        return page(df, order, number, size)
    inside = (F.col(time) >= F.lit(hit["low"]).cast("timestamp")) & (F.col(time) < F.date_add(F.lit(hit["high"]), 1).cast("timestamp"))
    return df.filter(inside).orderBy(*order).offset(skip - hit["before"]).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """One row: total rows and pages."""
    return df.agg(F.count("*").alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / F.lit(size)).cast("long")
    )
