"""Consecutive numbers within a group, without sorting the group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the digest that name a bucket: 16**3 buckets per group.
BUCKET_DIGITS = 3


def numbered(df: DataFrame, group: list[str], key: Column, ties: list[str]) -> DataFrame:
    """Add `rank` (from 1) and `group_size` by the order of md5(key) within `group`.

    The digest's first digits cut a group of any size into evenly filled
    buckets that are already in order. Rows are ranked within their bucket and
    shifted by the number of rows in earlier buckets, which a small table of
    bucket counts gives.
    """
    hashed = df.withColumn("_digest", F.md5(key)).withColumn(
        "_bucket", F.substring("_digest", 1, BUCKET_DIGITS)
    )
    counts = hashed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    in_order = Window.partitionBy(*group).orderBy("_bucket")
    offsets = counts.select(
        *group, "_bucket", (F.sum("_n").over(in_order) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("group_size"),
    )
    within = Window.partitionBy(*group, "_bucket").orderBy("_digest", *ties)
    return (
        hashed.join(offsets, [*group, "_bucket"])
        .withColumn("rank", F.row_number().over(within) + F.col("_offset"))
        .drop("_digest", "_bucket", "_offset")
    )
