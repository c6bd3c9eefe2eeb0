"""Hourly and daily rollups, batch and streaming, and their mergeable partials.

A stored rollup holds partial states (count, sum, min, max, HLL sketch) that
can be added up across insert blocks; averages and distinct counts are computed
when it is read. Grouping always combines on the map side first, so one device
holding most of the rows costs one partial row per map task, not one hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import detections as D
from shutterlake.functions.text import megabytes
from shutterlake.functions.times import as_column, seconds_between

WINDOWS = {"hourly": "1 hour", "daily": "1 day"}
WATERMARKS = {"hourly": "1 hour", "daily": "1 day"}


def _bucket(events: DataFrame, window_type: str, time: str = "timestamp") -> tuple[DataFrame, Column]:
    """The grouping column for a grain; a watermarked window on a stream."""
    if window_type not in WINDOWS:
        raise ValueError(f"window_type must be one of {sorted(WINDOWS)}, not {window_type!r}")
    if events.isStreaming:
        events = events.withWatermark(time, WATERMARKS[window_type])
        return events, F.window(time, WINDOWS[window_type])
    return events, F.date_trunc("hour" if window_type == "hourly" else "day", time)


def _start(df: DataFrame, bucket: str) -> Column:
    is_window = df.schema[bucket].dataType.typeName() == "struct"
    return F.col(bucket)["start"] if is_window else F.col(bucket)


def _distinct_shots(streaming: bool) -> Column:
    """Exact in batch; streams only admit the sketch-based count."""
    return F.approx_count_distinct("shot_id") if streaming else F.count_distinct("shot_id")


def hourly_sizes(events: DataFrame) -> DataFrame:
    """Per device and hour: count, sum, average, greatest and least image size."""
    df, bucket = _bucket(events, "hourly")
    out = df.groupBy(bucket.alias("bucket"), "device_id").agg(
        F.count("*").alias("image_count"),
        F.sum("image_size").alias("total_size_bytes"),
        F.avg("image_size").alias("avg_size_bytes"),
        F.max("image_size").alias("max_size_bytes"),
        F.min("image_size").alias("min_size_bytes"),
    )
    start = _start(out, "bucket")
    return out.select(
        "device_id", start.alias("aggregation_window"), F.lit("hourly").alias("window_type"),
        "image_count", "total_size_bytes", "avg_size_bytes", "max_size_bytes", "min_size_bytes",
        F.to_date(start).alias("processing_date"),
    )


def events_agg(events: DataFrame, window_type: str) -> DataFrame:
    """The generic rollup at one grain."""
    df, bucket = _bucket(events, window_type)
    out = df.groupBy(bucket.alias("bucket"), "device_id").agg(
        F.count("*").alias("image_count"),
        F.sum("image_size").alias("total_size_bytes"),
        F.avg("image_size").alias("avg_size_bytes"),
        _distinct_shots(events.isStreaming).alias("unique_shots"),
    )
    start = _start(out, "bucket")
    return out.select(
        "device_id", start.alias("aggregation_window"), F.lit(window_type).alias("window_type"),
        "image_count", "total_size_bytes", "avg_size_bytes", "unique_shots",
        F.to_date(start).alias("processing_date"),
    )


def events_agg_all(events: DataFrame) -> DataFrame:
    """Both grains in one table."""
    return events_agg(events, "hourly").unionByName(events_agg(events, "daily"))


def events_hourly(events: DataFrame) -> DataFrame:
    """The hourly table."""
    return events_agg(events, "hourly").select(
        "device_id", F.col("aggregation_window").alias("hour"), "image_count",
        F.col("total_size_bytes").alias("total_size"), F.col("avg_size_bytes").alias("avg_size"),
        "unique_shots", "processing_date",
    )


def device_stats_daily(events: DataFrame) -> DataFrame:
    """Per device and day: count, MB, first, last and mean gap between images."""
    df, bucket = _bucket(events, "daily")
    out = df.groupBy(bucket.alias("bucket"), "device_id").agg(
        F.count("*").alias("total_images"),
        F.sum("image_size").alias("bytes"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    gaps = seconds_between(F.col("first_seen"), F.col("last_seen")) / (F.col("total_images") - 1)
    return out.select(
        "device_id", F.to_date(_start(out, "bucket")).alias("date"), "total_images",
        megabytes(F.col("bytes")).alias("total_size_mb"), "first_seen", "last_seen",
        F.when(F.col("total_images") > 1, gaps).otherwise(F.lit(0.0)).alias("avg_interval_seconds"),
    )


def detections_hourly(enriched: DataFrame) -> DataFrame:
    """Per device and hour with detections: events, objects, average, species set.

    Species are made distinct before they are gathered, so an array never grows
    with the number of events.
    """
    hour = F.date_trunc("hour", "timestamp")
    seen = enriched.filter(F.col("detection_count") > 0).select(
        "device_id", hour.alias("hour"), "detection_count",
        D.distinct_species(D.parse(F.col("detections"))).alias("species"),
    )
    # One pass: each event contributes its counts once and its species rows.
    flat = seen.select(
        "device_id", "hour", "detection_count", F.posexplode_outer("species").alias("pos", "species")
    )
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    per_species = flat.groupBy("device_id", "hour", "species").agg(
        F.count_if(first).alias("events"),
        F.sum(F.when(first, F.col("detection_count"))).alias("objects"),
    )
    out = per_species.groupBy("device_id", "hour").agg(
        F.sum("events").alias("event_count"),
        F.sum("objects").alias("total_detections"),
        F.array_sort(F.collect_set("species")).alias("unique_species"),
    )
    return out.select(
        "device_id", "hour", "event_count", "total_detections",
        (F.col("total_detections") / F.col("event_count")).alias("avg_detections_per_image"),
        "unique_species", F.to_date("hour").alias("processing_date"),
    )


def exploded_detections(enriched: DataFrame, *keep: str) -> DataFrame:
    """One row per detected object with `species` and `confidence`."""
    return (
        enriched.filter(F.col("detection_count") > 0)
        # The outer form, then a filter: a plain explode would parse twice.
        .select(*keep, F.explode_outer(D.parse(F.col("detections"))).alias("d"))
        .filter(F.col("d").isNotNull())
        .select(
            *keep, D.species_of(F.col("d")).alias("species"),
            D.confidence_of(F.col("d")).alias("confidence"),
        )
    )


def species_daily(enriched: DataFrame) -> DataFrame:
    """Per device, day and species: objects, average, least and greatest confidence."""
    objects = exploded_detections(enriched, "device_id", "timestamp")
    return objects.groupBy("device_id", F.to_date("timestamp").alias("date"), "species").agg(
        F.count("*").alias("detection_count"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
    )


def alerts_hourly(alerts: DataFrame) -> DataFrame:
    """Active alerts per device, severity and hour."""
    hour = F.date_trunc("hour", "triggered_at")
    return (
        alerts.filter(F.col("status") == "active")
        .groupBy("device_id", "severity", hour.alias("hour"))
        .agg(F.count("*").alias("alert_count"))
        .withColumn("processing_date", F.to_date("hour"))
    )


def alerts_daily(alerts: DataFrame) -> DataFrame:
    """Alerts per device and day, split by severity and status."""
    def counted(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    return alerts.groupBy("device_id", F.to_date("triggered_at").alias("date")).agg(
        F.count("*").alias("total_alerts"),
        counted("severity", "critical").alias("critical_count"),
        counted("severity", "warning").alias("warning_count"),
        counted("severity", "info").alias("info_count"),
        counted("status", "active").alias("active_count"),
        counted("status", "resolved").alias("resolved_count"),
    )


# ---- mergeable partials -------------------------------------------------

PARTIAL_KEY = ["device_id", "aggregation_window", "window_type"]


def partials(events: DataFrame, window_type: str, time: str = "timestamp") -> DataFrame:
    """Rollup rows of one insert block by event time or another one, holding states that can be added up."""
    df, bucket = _bucket(events, window_type, time)
    out = df.groupBy(bucket.alias("bucket"), "device_id").agg(
        F.count("*").alias("image_count"),
        F.count("image_size").alias("sized"),
        F.sum("image_size").alias("total_size_bytes"),
        F.min("image_size").alias("min_size_bytes"),
        F.max("image_size").alias("max_size_bytes"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        F.hll_sketch_agg("shot_id").alias("shots_sketch"),
    )
    start = _start(out, "bucket")
    return out.select(
        "device_id", start.alias("aggregation_window"), F.lit(window_type).alias("window_type"),
        *(c for c in out.columns if c not in ("bucket", "device_id")),
        F.to_date(start).alias("processing_date"),
    )


def detected(enriched: DataFrame, window_type: str) -> DataFrame:
    """Partial rows of scored images by the time they were scored: images, those with a count, objects, images with any."""
    start = F.date_trunc("hour" if window_type == "hourly" else "day", "processed_at")
    out = enriched.groupBy("device_id", start.alias("aggregation_window")).agg(
        F.count("*").alias("image_count"), F.count("detection_count").alias("counted"),
        F.sum("detection_count").alias("detection_count"), F.count_if(F.col("detection_count") > 0).alias("detected_images"))
    return out.withColumns({"window_type": F.lit(window_type), "processing_date": F.to_date("aggregation_window")})


def combine(parts: DataFrame) -> DataFrame:
    """Add up partial rows that share the order key."""
    return parts.groupBy(*PARTIAL_KEY, "processing_date").agg(
        F.sum("image_count").alias("image_count"),
        F.sum("sized").alias("sized"),
        F.sum("total_size_bytes").alias("total_size_bytes"),
        F.min("min_size_bytes").alias("min_size_bytes"),
        F.max("max_size_bytes").alias("max_size_bytes"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.hll_union_agg("shots_sketch").alias("shots_sketch"),
    )


def read_combined(combined: DataFrame) -> DataFrame:
    """Averages and distinct counts from combined partials."""
    return combined.withColumns({
        "avg_size_bytes": F.col("total_size_bytes") / F.col("sized"),
        "unique_shots": F.hll_sketch_estimate("shots_sketch"),
    }).drop("shots_sketch", "sized")


def rebuild(events: DataFrame, window_type: str, start_date, end_date) -> DataFrame:
    """The rollup recomputed from raw rows for days start..end, both inclusive.

    Written with dynamic partition overwrite it replaces exactly those days.
    """
    low = as_column(str(start_date))
    high = as_column(str(end_date)) + F.expr("INTERVAL 1 DAY")
    days = (F.col("timestamp") >= low) & (F.col("timestamp") < high)
    return events_agg(events.filter(days), window_type)


def query_rollup(
    rollup: DataFrame, window_type: str, device_id: str | None = None,
    start=None, end=None, limit: int = 1000,
) -> DataFrame:
    """Newest rows of a rollup table between two days, both inclusive."""
    dates = {"hourly": "processing_date", "daily": "date"}
    if window_type not in dates:
        raise ValueError(f"window_type must be one of {sorted(dates)}, not {window_type!r}")
    date = dates[window_type]
    if device_id:
        rollup = rollup.filter(F.col("device_id") == device_id)
    if start is not None:
        rollup = rollup.filter(F.col(date) >= F.to_date(as_column(start)))
    if end is not None:
        rollup = rollup.filter(F.col(date) <= F.to_date(as_column(end)))
    order = [F.desc(date), F.asc("device_id")]
    if window_type == "hourly":
        order.append(F.desc("hour"))
    return rollup.orderBy(*order).limit(limit)
