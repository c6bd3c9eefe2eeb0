"""Fleet, device and detection statistics as of a given time.

Every statistic is one conditional aggregate over one scan. `as_of` stands for
"now": rows received later are not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.text import not_test_device
from shutterlake.functions.times import as_column, monday, start_of_month
from shutterlake.operators.rollups import exploded_detections


def query_events(
    events: DataFrame, device_id: str | None = None, start=None, end=None, limit: int = 100
) -> DataFrame:
    """Newest events, optionally of one device and an inclusive time range."""
    if device_id:
        events = events.filter(F.col("device_id") == device_id)
    if start is not None:
        events = events.filter(F.col("timestamp") >= as_column(start))
    if end is not None:
        events = events.filter(F.col("timestamp") <= as_column(end))
    return events.orderBy(F.desc("timestamp"), "device_id", "shot_id", "image_url").limit(limit)


def without_test_devices(df: DataFrame) -> DataFrame:
    return df.filter(not_test_device(F.col("device_id")))


def fleet_totals(events: DataFrame, as_of) -> DataFrame:
    """Images, devices, images today and devices heard of in the last five minutes.

    Devices are counted from one row per device, so the wide pass combines on
    the map side and no distinct set is built.
    """
    now = as_column(as_of)
    per_device = (
        without_test_devices(events).filter(F.col("received_at") <= now)
        .groupBy("device_id")
        .agg(
            F.count("*").alias("images"),
            F.count_if(F.to_date("received_at") == F.to_date(now)).alias("today"),
            F.max("received_at").alias("last"),
        )
    )
    recent = F.col("last") >= now - F.expr("INTERVAL 5 MINUTES")
    return per_device.agg(
        F.count("*").alias("total_devices"),
        F.count_if(recent).alias("online_devices"),
        F.coalesce(F.sum("images"), F.lit(0)).alias("total_images"),
        F.coalesce(F.sum("today"), F.lit(0)).alias("today_images"),
    )


def recency_status(last_seen: Column, as_of) -> Column:
    """online under 5 minutes of silence, warning under 30, else offline."""
    now = as_column(as_of)
    return (
        F.when(last_seen > now - F.expr("INTERVAL 5 MINUTES"), "online")
        .when(last_seen > now - F.expr("INTERVAL 30 MINUTES"), "warning")
        .otherwise("offline")
    )


def device_list(events: DataFrame, as_of) -> DataFrame:
    """Devices with last contact, image count and status, in order of id."""
    seen = without_test_devices(events).filter(F.col("received_at") <= as_column(as_of))
    return (
        seen.groupBy("device_id")
        .agg(F.max("received_at").alias("last_seen"), F.count("*").alias("image_count"))
        .withColumn("status", recency_status(F.col("last_seen"), as_of))
        .orderBy("device_id")
    )


def device_profile(events: DataFrame, device_id: str | None = None) -> DataFrame:
    """Per device: images, bytes, average, first, last and distinct shots."""
    if device_id:
        events = events.filter(F.col("device_id") == device_id)
    return events.groupBy("device_id").agg(
        F.count("*").alias("total_images"),
        F.sum("image_size").alias("total_size"),
        F.avg("image_size").alias("avg_size"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count_distinct("shot_id").alias("unique_shots"),
    )


def device_series(events: DataFrame, as_of, days: int = 7, device_id: str | None = None) -> DataFrame:
    """Images per device and day over the last `days` days, zeros included.

    A device's counts are gathered as a map of at most `days` entries and laid
    over the day sequence; no join against a calendar is needed. Devices
    without any image in the range get a row of zeros per day as well.
    """
    if device_id:
        events = events.filter(F.col("device_id") == device_id)
    last = F.to_date(as_column(as_of))
    first = F.date_sub(last, days - 1)
    day = F.to_date("timestamp")
    daily = events.groupBy("device_id", F.when(day.between(first, last), day).alias("date")).agg(
        F.count("*").alias("n")
    )
    return zero_filled(daily, first, last)


def zero_filled(daily: DataFrame, first: Column, last: Column) -> DataFrame:
    """Counts `n` per device and `date` laid over all days of a range; a null date only names the device."""
    counted = F.collect_list(F.when(F.col("date").isNotNull(), F.struct("date", "n")))
    return (
        daily.groupBy("device_id").agg(F.map_from_entries(counted).alias("counts"))
        .select("device_id", "counts", F.explode(F.sequence(first, last)).alias("date"))
        .select("device_id", "date", F.coalesce(F.col("counts")[F.col("date")], F.lit(0)).alias("count"))
    )


def detection_totals(enriched: DataFrame, as_of) -> DataFrame:
    """Objects, images, average per image, objects today and since seven days before today."""
    now = as_column(as_of)
    today = F.to_date(now)
    seen = enriched.filter(F.col("processed_at") <= now)
    count = F.col("detection_count")
    return seen.agg(
        F.coalesce(F.sum(count), F.lit(0)).alias("total_detections"),
        F.count("*").alias("total_images"),
        F.coalesce(F.round(F.avg(count), 2), F.lit(0.0)).alias("avg_detections_per_image"),
        F.coalesce(F.sum(F.when(F.to_date("processed_at") == today, count)), F.lit(0)).alias("detections_today"),
        F.coalesce(
            F.sum(F.when(F.col("processed_at") >= F.date_sub(today, 7), count)), F.lit(0)
        ).alias("detections_this_week"),
    )


def species_distribution(enriched: DataFrame, device_id: str | None = None) -> DataFrame:
    """Objects and share in percent per species, most frequent first."""
    if device_id:
        enriched = enriched.filter(F.col("device_id") == device_id)
    counts = exploded_detections(enriched).groupBy("species").agg(F.count("*").alias("count"))
    # One row per species: a window over them all is as small as the result.
    share = F.round(F.col("count") / F.sum("count").over(Window.partitionBy()) * 100, 2)
    return counts.withColumn("percentage", share).orderBy(F.desc("count"), "species")


# Lower bounds and names of the confidence bins.
CONFIDENCE_BINS = [
    (0.9, "0.9-1.0"), (0.8, "0.8-0.9"), (0.7, "0.7-0.8"), (0.6, "0.6-0.7"), (0.5, "0.5-0.6"),
]
LOWEST_BIN = "0.0-0.5"


def confidence_bin(confidence: Column) -> Column:
    result = None
    for bound, name in CONFIDENCE_BINS:
        hit = confidence >= bound
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise(LOWEST_BIN)


def confidence_distribution(enriched: DataFrame, device_id: str | None = None) -> DataFrame:
    """Objects per confidence bin; empty bins are absent."""
    if device_id:
        enriched = enriched.filter(F.col("device_id") == device_id)
    objects = exploded_detections(enriched)
    return (
        objects.groupBy(confidence_bin(F.col("confidence")).alias("range"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("range"))
    )


def confidence_summary(enriched: DataFrame, device_id: str | None = None) -> DataFrame:
    """Average, least, greatest confidence (3 decimals) and number of objects."""
    if device_id:
        enriched = enriched.filter(F.col("device_id") == device_id)
    c = F.col("confidence")
    return exploded_detections(enriched).agg(
        *(
            F.coalesce(F.round(f(c), 3), F.lit(0.0)).alias(f"{name}_confidence")
            for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))
        ),
        F.count("*").alias("total_detections"),
    )


def detection_timeline(
    enriched: DataFrame, as_of, period: str = "day", device_id: str | None = None
) -> DataFrame:
    """Objects and images per day (7 days), week (56 days) or month (12 months)."""
    now = as_column(as_of)
    at = F.col("processed_at")
    periods = {
        "day": (now - F.expr("INTERVAL 7 DAYS"), F.to_date(at)),
        "week": (now - F.expr("INTERVAL 56 DAYS"), monday(at)),
        "month": (F.add_months(now, -12).cast("timestamp") + (now - F.date_trunc("day", now)), start_of_month(at)),
    }
    if period not in periods:
        raise ValueError(f"period must be one of {sorted(periods)}, not {period!r}")
    start, bucket = periods[period]
    if device_id:
        enriched = enriched.filter(F.col("device_id") == device_id)
    return (
        enriched.filter((at >= start) & (at <= now))
        .groupBy(bucket.alias("date"))
        .agg(F.sum("detection_count").alias("detection_count"), F.count("*").alias("image_count"))
        .orderBy("date")
    )


def detected_images(enriched: DataFrame) -> DataFrame:
    """Images with detections, their objects and the average over those images."""
    count = F.col("detection_count")
    return enriched.filter(count > 0).agg(
        F.count("*").alias("total_images"),
        F.coalesce(F.sum(count), F.lit(0)).alias("total_detections"),
        F.coalesce(F.avg(count), F.lit(0.0)).alias("avg_detections"),
    )
