"""Statistics from stored partials: whole days, whole hours, and the raw rows of the edges only.

Three families of partial rows are stored, each at an hourly and a daily grain:
`partials` by event time, `contacts` by the time a row was received, `detected`
by the time an image was scored. A range is answered from the daily rows of its whole days, the hourly
rows of the hours that are left, and raw rows of the hours that the range cuts; what
is read of the raw table does not grow with the range. Partial rows of one key add up, so rows of
batches that came late need no care.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.times import as_column
from shutterlake.operators import rollups, stats
from shutterlake.sources import tables

HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)
GRAINS = ("hourly", "daily")


@dataclass(frozen=True)
class Family:
    """Stored partials of one raw table by one time."""

    name: str
    raw: str
    time: str
    build: Callable[[DataFrame, str], DataFrame]
    # Whether the raw table's folders follow the same time, so that an edge prunes them.
    prunes: bool

    def tables(self) -> dict[str, str]:
        return {grain: f"{self.name}_{grain}" for grain in GRAINS}


def _contacts(events: DataFrame, grain: str) -> DataFrame:
    return rollups.partials(events, grain, "received_at")


FAMILIES = {
    "partials": Family("partials", "events_raw", "timestamp", rollups.partials, False),
    "contacts": Family("contacts", "events_raw", "received_at", _contacts, True),
    "detected": Family("detected", "events_enriched", "processed_at", rollups.detected, True),
}


def instant(value) -> dt.datetime:
    """A point in time given as text, date or datetime."""
    if isinstance(value, dt.datetime):
        return value
    return dt.datetime.fromisoformat(str(value))


def floor(at: dt.datetime, grain: dt.timedelta) -> dt.datetime:
    return dt.datetime.min + (at - dt.datetime.min) // grain * grain


def ceil(at: dt.datetime, grain: dt.timedelta) -> dt.datetime:
    down = floor(at, grain)
    return down if down == at else down + grain


def ranges(start: dt.datetime | None, end: dt.datetime | None) -> list[tuple[str, dt.datetime | None, dt.datetime | None]]:
    """(source, from, before) that make up all times from start to end, both inclusive; None is open.

    source is daily, hourly or raw.
    """
    after = None if end is None else end + dt.timedelta(microseconds=1)
    hours = start and ceil(start, HOUR), after and floor(after, HOUR)
    if start and after and hours[0] >= hours[1]:
        return [("raw", start, after)] if start < after else []
    days = hours[0] and ceil(hours[0], DAY), hours[1] and floor(hours[1], DAY)
    if hours[0] and hours[1] and days[0] >= days[1]:
        parts = [("raw", start, hours[0]), ("hourly", *hours), ("raw", hours[1], after)]
    else:
        parts = [
            ("raw", start, hours[0]), ("hourly", hours[0], days[0]), ("daily", *days),
            ("hourly", days[1], hours[1]), ("raw", hours[1], after),
        ]
    # An open end has no edge; an empty part needs no scan.
    return [(s, a, b) for s, a, b in parts if (s == "daily" or (a and b)) and not (a and b and a >= b)]


def _between(df: DataFrame, column: Column, low: dt.datetime | None, high: dt.datetime | None) -> DataFrame:
    for bound, keep in ((low, lambda b: column >= b), (high, lambda b: column < b)):
        if bound is not None:
            df = df.filter(keep(as_column(str(bound))))
    return df


class Stored:
    """The stored tables of a fleet below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str, start=None, end=None) -> DataFrame:
        return tables.read_table(self.spark, name, f"{self.root}/{name}", start, end)

    def covering(self, family: str, start=None, end=None) -> DataFrame:
        """Partial rows that make up the times from start to end, both inclusive."""
        meta = FAMILIES[family]
        names, found = meta.tables(), []
        for source, low, high in ranges(start and instant(start), end and instant(end)):
            last = high and high - dt.timedelta(microseconds=1)
            if source == "raw":
                rows = self.table(meta.raw, low, last) if meta.prunes else self.table(meta.raw)
                found.append(meta.build(_between(rows, F.col(meta.time), low, high), "hourly"))
            else:
                found.append(_between(self.table(names[source], low, last), F.col("aggregation_window"), low, high))
        if not found:
            return self.table(names["daily"]).limit(0)
        return reduce(DataFrame.unionByName, found)


def store(raw: DataFrame, table: str, root: str) -> None:
    """Write a raw table and the partials of all its families."""
    tables.write_table(raw, table, f"{root}/{table}")
    for family in FAMILIES.values():
        if family.raw == table:
            for grain, name in family.tables().items():
                tables.write_table(family.build(raw, grain), name, f"{root}/{name}")


def fleet_totals(stored: Stored, as_of) -> DataFrame:
    """`stats.fleet_totals` from stored partials."""
    now = as_column(as_of)
    parts = stats.without_test_devices(stored.covering("contacts", end=as_of))
    today = F.to_date("aggregation_window") == F.to_date(now)
    per_device = parts.groupBy("device_id").agg(
        F.sum("image_count").alias("images"), F.coalesce(F.sum(F.when(today, F.col("image_count"))), F.lit(0)).alias("today"),
        F.max("last_seen").alias("last"))
    return per_device.agg(
        F.count("*").alias("total_devices"), F.count_if(F.col("last") >= now - F.expr("INTERVAL 5 MINUTES")).alias("online_devices"),
        F.coalesce(F.sum("images"), F.lit(0)).alias("total_images"), F.coalesce(F.sum("today"), F.lit(0)).alias("today_images"))


def device_list(stored: Stored, as_of) -> DataFrame:
    """`stats.device_list` from stored partials."""
    parts = stats.without_test_devices(stored.covering("contacts", end=as_of))
    return (
        parts.groupBy("device_id").agg(F.max("last_seen").alias("last_seen"), F.sum("image_count").alias("image_count"))
        .withColumn("status", stats.recency_status(F.col("last_seen"), as_of)).orderBy("device_id")
    )


def device_profile(stored: Stored, device_id: str | None = None, start=None, end=None) -> DataFrame:
    """`stats.device_profile` from stored partials, optionally of a range of event times; distinct shots are estimated."""
    parts = stored.covering("partials", start, end)
    if device_id:
        parts = parts.filter(F.col("device_id") == device_id)
    return parts.groupBy("device_id").agg(
        F.sum("image_count").alias("total_images"), F.sum("total_size_bytes").alias("total_size"),
        (F.sum("total_size_bytes") / F.sum("sized")).alias("avg_size"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.hll_sketch_estimate(F.hll_union_agg("shots_sketch")).alias("unique_shots"))


def device_series(stored: Stored, as_of, days: int = 7, device_id: str | None = None) -> DataFrame:
    """`stats.device_series` from stored partials: no raw row is read, since its days are whole."""
    daily = stored.table("partials_daily")
    if device_id:
        daily = daily.filter(F.col("device_id") == device_id)
    last = F.to_date(as_column(as_of))
    first = F.date_sub(last, days - 1)
    day = F.to_date("aggregation_window")
    per_day = daily.groupBy("device_id", F.when(day.between(first, last), day).alias("date")).agg(F.sum("image_count").alias("n"))
    return stats.zero_filled(per_day, first, last)


def detection_totals(stored: Stored, as_of) -> DataFrame:
    """`stats.detection_totals` from stored partials."""
    today = F.to_date(as_column(as_of))
    parts = stored.covering("detected", end=as_of)
    objects, window = F.col("detection_count"), F.col("aggregation_window")
    images = F.sum("image_count")
    return parts.agg(
        F.coalesce(F.sum(objects), F.lit(0)).alias("total_detections"), F.coalesce(images, F.lit(0)).alias("total_images"),
        F.coalesce(F.round(F.sum(objects) / F.sum("counted"), 2), F.lit(0.0)).alias("avg_detections_per_image"),
        F.coalesce(F.sum(F.when(F.to_date(window) == today, objects)), F.lit(0)).alias("detections_today"),
        F.coalesce(F.sum(F.when(window >= F.date_sub(today, 7), objects)), F.lit(0)).alias("detections_this_week"))
