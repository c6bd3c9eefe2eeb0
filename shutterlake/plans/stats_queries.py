"""Rollups and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions.times import as_column
from shutterlake.operators import grains, rollups, stats
from shutterlake.plans.registry import AS_OF, ORACLES, query

_HOUR = "CAST(date_trunc('hour', timestamp) AS TIMESTAMP)"
_DAY = "CAST(date_trunc('day', timestamp) AS TIMESTAMP)"
_DEVICE = "cam-000000000005"


def _agg(window_type: str, bucket: str, where: str = "") -> str:
    return f"""SELECT device_id, {bucket} AS aggregation_window, '{window_type}' AS window_type, count(*) AS image_count,
  CAST(sum(image_size) AS BIGINT) AS total_size_bytes, avg(image_size) AS avg_size_bytes,
  count(DISTINCT shot_id) AS unique_shots, CAST({bucket} AS DATE) AS processing_date
FROM events_raw {where} GROUP BY ALL"""


@query("a1_hourly_sizes", f"""
SELECT device_id, {_HOUR} AS aggregation_window, 'hourly' AS window_type, count(*) AS image_count,
  CAST(sum(image_size) AS BIGINT) AS total_size_bytes, avg(image_size) AS avg_size_bytes,
  max(image_size) AS max_size_bytes, min(image_size) AS min_size_bytes, CAST({_HOUR} AS DATE) AS processing_date
FROM events_raw GROUP BY ALL""", "events_raw")
def _(t):
    return rollups.hourly_sizes(t.events_raw)


@query("a2_hourly_rollup", f"""
SELECT device_id, {_HOUR} AS hour, count(*) AS image_count, CAST(sum(image_size) AS BIGINT) AS total_size,
  avg(image_size) AS avg_size, count(DISTINCT shot_id) AS unique_shots, CAST({_HOUR} AS DATE) AS processing_date
FROM events_raw GROUP BY ALL""", "events_raw")
def _(t):
    return rollups.events_hourly(t.events_raw)


@query("a3_daily_device_stats", """
SELECT device_id, CAST(timestamp AS DATE) AS date, count(*) AS total_images,
  CAST(sum(image_size) AS DOUBLE) / 1024.0::DOUBLE / 1024.0::DOUBLE AS total_size_mb,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  CASE WHEN count(*) > 1 THEN date_diff('second', min(timestamp), max(timestamp))::DOUBLE / (count(*) - 1) ELSE 0.0::DOUBLE END AS avg_interval_seconds
FROM events_raw GROUP BY ALL""", "events_raw")
def _(t):
    return rollups.device_stats_daily(t.events_raw)


@query("a4_events_agg", f"{_agg('hourly', _HOUR)} UNION ALL {_agg('daily', _DAY)}", "events_raw")
def _(t):
    return rollups.events_agg_all(t.events_raw)


@query("a5_detections_hourly", f"""
WITH e AS (SELECT device_id, {_HOUR} AS hour, count(*) AS event_count, CAST(sum(detection_count) AS BIGINT) AS total_detections
  FROM events_enriched WHERE detection_count > 0 GROUP BY ALL),
s AS (SELECT device_id, {_HOUR} AS hour, string_agg(DISTINCT species, ',' ORDER BY species) AS unique_species FROM objects GROUP BY ALL)
SELECT e.device_id, e.hour, event_count, total_detections, total_detections::DOUBLE / event_count AS avg_detections_per_image,
  unique_species, CAST(e.hour AS DATE) AS processing_date
FROM e JOIN s USING (device_id, hour)""", "events_enriched objects")
def _(t):
    out = rollups.detections_hourly(t.events_enriched)
    return out.withColumn("unique_species", F.array_join("unique_species", ","))


@query("a6_species_daily", """
SELECT device_id, CAST(timestamp AS DATE) AS date, species, count(*) AS detection_count,
  round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence
FROM objects GROUP BY ALL""", "objects")
def _(t):
    return rollups.species_daily(t.events_enriched).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("a7_alerts_hourly", """
SELECT device_id, severity, CAST(date_trunc('hour', triggered_at) AS TIMESTAMP) AS hour, count(*) AS alert_count,
  CAST(triggered_at AS DATE) AS processing_date
FROM alert_history WHERE status = 'active' GROUP BY ALL""", "alert_history")
def _(t):
    return rollups.alerts_hourly(t.alert_history)


@query("a8_alerts_daily", """
SELECT device_id, CAST(triggered_at AS DATE) AS date, count(*) AS total_alerts,
  count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'warning') AS warning_count,
  count(*) FILTER (severity = 'info') AS info_count, count(*) FILTER (status = 'active') AS active_count,
  count(*) FILTER (status = 'resolved') AS resolved_count
FROM alert_history GROUP BY ALL""", "alert_history")
def _(t):
    return rollups.alerts_daily(t.alert_history)


@query("a9_fleet_totals", """
SELECT count(DISTINCT device_id) AS total_devices,
  count(DISTINCT device_id) FILTER (received_at >= :as_of - INTERVAL 5 MINUTES) AS online_devices,
  count(*) AS total_images, count(*) FILTER (CAST(received_at AS DATE) = CAST(:as_of AS DATE)) AS today_images
FROM events_raw WHERE device_id NOT ILIKE '%test%' AND received_at <= :as_of""", "events_raw")
def _(t):
    return stats.fleet_totals(t.events_raw, AS_OF)


@query("a10_device_list", """
SELECT device_id, max(received_at) AS last_seen, count(*) AS image_count,
  CASE WHEN max(received_at) > :as_of - INTERVAL 5 MINUTES THEN 'online'
       WHEN max(received_at) > :as_of - INTERVAL 30 MINUTES THEN 'warning' ELSE 'offline' END AS status
FROM events_raw WHERE device_id NOT ILIKE '%test%' AND received_at <= :as_of GROUP BY device_id""", "events_raw")
def _(t):
    return stats.device_list(t.events_raw, AS_OF)


@query("a11_device_profile", """
SELECT device_id, count(*) AS total_images, CAST(sum(image_size) AS BIGINT) AS total_size, avg(image_size) AS avg_size,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(DISTINCT shot_id) AS unique_shots
FROM events_raw GROUP BY device_id""", "events_raw")
def _(t):
    return stats.device_profile(t.events_raw)


@query("a11_device_series", """
WITH days AS (SELECT CAST(unnest(generate_series(CAST(:as_of AS DATE) - INTERVAL 6 DAYS, CAST(:as_of AS DATE), INTERVAL 1 DAY)) AS DATE) AS date),
spine AS (SELECT device_id, date FROM (SELECT DISTINCT device_id FROM events_raw) d CROSS JOIN days)
SELECT s.device_id, s.date, count(e.device_id) AS count
FROM spine s LEFT JOIN events_raw e ON e.device_id = s.device_id AND CAST(e.timestamp AS DATE) = s.date
GROUP BY ALL""", "events_raw")
def _(t):
    return stats.device_series(t.events_raw, AS_OF)


@query("a12_query_rollup_hourly", f"""
SELECT * FROM (SELECT device_id, {_HOUR} AS hour, count(*) AS image_count, CAST(sum(image_size) AS BIGINT) AS total_size,
  avg(image_size) AS avg_size, count(DISTINCT shot_id) AS unique_shots, CAST({_HOUR} AS DATE) AS processing_date
  FROM events_raw GROUP BY ALL)
WHERE processing_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
ORDER BY processing_date DESC, device_id, hour DESC LIMIT 1000""", "events_raw")
def _(t):
    return rollups.query_rollup(
        rollups.events_hourly(t.events_raw), "hourly", start="2024-01-05", end="2024-01-20"
    )


@query("a12_query_rollup_daily", f"""
SELECT device_id, CAST(timestamp AS DATE) AS date, count(*) AS total_images,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM events_raw WHERE device_id = '{_DEVICE}' GROUP BY ALL ORDER BY date DESC LIMIT 1000""", "events_raw")
def _(t):
    daily = rollups.device_stats_daily(t.events_raw).drop("total_size_mb", "avg_interval_seconds")
    return rollups.query_rollup(daily, "daily", device_id=_DEVICE)


@query("a13_detection_totals", """
SELECT CAST(sum(detection_count) AS BIGINT) AS total_detections, count(*) AS total_images,
  round(avg(detection_count), 2) AS avg_detections_per_image,
  CAST(coalesce(sum(detection_count) FILTER (CAST(processed_at AS DATE) = CAST(:as_of AS DATE)), 0) AS BIGINT) AS detections_today,
  CAST(coalesce(sum(detection_count) FILTER (processed_at >= CAST(:as_of AS DATE) - INTERVAL 7 DAYS), 0) AS BIGINT) AS detections_this_week
FROM events_enriched WHERE processed_at <= :as_of""", "events_enriched")
def _(t):
    return stats.detection_totals(t.events_enriched, AS_OF)


@query("a14_species_distribution", """
SELECT species, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage
FROM objects GROUP BY species""", "objects")
def _(t):
    return stats.species_distribution(t.events_enriched)


@query("a14_species_distribution_one_device", f"""
SELECT species, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage
FROM objects WHERE device_id = '{_DEVICE}' GROUP BY species""", "objects")
def _(t):
    return stats.species_distribution(t.events_enriched, _DEVICE)


@query("a15_confidence_distribution", """
SELECT CASE WHEN confidence >= 0.9 THEN '0.9-1.0' WHEN confidence >= 0.8 THEN '0.8-0.9' WHEN confidence >= 0.7 THEN '0.7-0.8'
  WHEN confidence >= 0.6 THEN '0.6-0.7' WHEN confidence >= 0.5 THEN '0.5-0.6' ELSE '0.0-0.5' END AS range, count(*) AS count
FROM objects GROUP BY 1""", "objects")
def _(t):
    return stats.confidence_distribution(t.events_enriched)


@query("a15_confidence_summary", """
SELECT round(avg(confidence), 3) AS avg_confidence, round(min(confidence), 3) AS min_confidence,
  round(max(confidence), 3) AS max_confidence, count(*) AS total_detections FROM objects""", "objects")
def _(t):
    return stats.confidence_summary(t.events_enriched)


def _timeline(bucket: str, start: str) -> str:
    return f"""SELECT {bucket} AS date, CAST(sum(detection_count) AS BIGINT) AS detection_count, count(*) AS image_count
FROM events_enriched WHERE processed_at >= :as_of - INTERVAL {start} AND processed_at <= :as_of GROUP BY 1"""


@query("a16_timeline_day", _timeline("CAST(processed_at AS DATE)", "7 DAYS"), "events_enriched")
def _(t):
    return stats.detection_timeline(t.events_enriched, AS_OF, "day")


@query("a16_timeline_week", _timeline("CAST(date_trunc('week', processed_at) AS DATE)", "56 DAYS"), "events_enriched")
def _(t):
    return stats.detection_timeline(t.events_enriched, AS_OF, "week")


@query("a16_timeline_month", _timeline("CAST(date_trunc('month', processed_at) AS DATE)", "12 MONTHS"), "events_enriched")
def _(t):
    return stats.detection_timeline(t.events_enriched, AS_OF, "month")


@query("a20_detected_images", """
SELECT count(*) AS total_images, CAST(sum(detection_count) AS BIGINT) AS total_detections, avg(detection_count) AS avg_detections
FROM events_enriched WHERE detection_count > 0""", "events_enriched")
def _(t):
    return stats.detected_images(t.events_enriched)


@query("p7_event_range", """
SELECT device_id, timestamp, shot_id, image_url, image_size FROM events_raw
WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00'
ORDER BY timestamp DESC, device_id, shot_id, image_url LIMIT 100""", "events_raw")
def _(t):
    out = stats.query_events(t.events_raw, start="2024-01-10 00:00:00", end="2024-01-20 00:00:00")
    return out.select("device_id", "timestamp", "shot_id", "image_url", "image_size")


@query("t1_newest_of_device", f"""
SELECT device_id, timestamp, shot_id, image_size FROM events_raw WHERE device_id = '{_DEVICE}'
ORDER BY timestamp DESC, device_id, shot_id, image_url LIMIT 100""", "events_raw")
def _(t):
    out = stats.query_events(t.events_raw, _DEVICE)
    return out.select("device_id", "timestamp", "shot_id", "image_size")


@query("p8_without_test_devices", """
SELECT device_id, count(*) AS n FROM events_raw WHERE lower(device_id) NOT LIKE '%test%' GROUP BY device_id""", "events_raw")
def _(t):
    return stats.without_test_devices(t.events_raw).groupBy("device_id").agg(F.count("*").alias("n"))


@query("p14_recency_status", """
SELECT device_id, shot_id, timestamp, CASE WHEN received_at > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 5 MINUTES THEN 'online'
  WHEN received_at > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 30 MINUTES THEN 'warning' ELSE 'offline' END AS status
FROM events_raw""", "events_raw")
def _(t):
    status = stats.recency_status(F.col("received_at"), "2024-01-15 12:00:00")
    return t.events_raw.select("device_id", "shot_id", "timestamp", status.alias("status"))


@query("r1_combine_partials", f"""
SELECT device_id, {_HOUR} AS aggregation_window, 'hourly' AS window_type, CAST({_HOUR} AS DATE) AS processing_date,
  count(*) AS image_count, CAST(sum(image_size) AS BIGINT) AS total_size_bytes, min(image_size) AS min_size_bytes,
  max(image_size) AS max_size_bytes, min(timestamp) AS first_seen, max(timestamp) AS last_seen, avg(image_size) AS avg_size_bytes
FROM events_raw GROUP BY ALL""", "events_raw")
def _(t):
    # Two insert blocks: odd and even seconds of arrival.
    odd = F.second("received_at") % 2 == 1
    raw = t.events_raw
    blocks = rollups.partials(raw.filter(odd), "hourly").unionByName(rollups.partials(raw.filter(~odd), "hourly"))
    return rollups.read_combined(rollups.combine(blocks)).drop("unique_shots")


@query("r1_sketch_counts", f"SELECT DISTINCT device_id, {_DAY} AS aggregation_window, true AS close FROM events_raw", "events_raw")
def _(t):
    # A sketch estimates; it counts as right within 5 % of the exact count, or one.
    read = rollups.read_combined(rollups.combine(rollups.partials(t.events_raw, "daily")))
    exact = rollups.events_agg(t.events_raw, "daily").select("device_id", "aggregation_window", F.col("unique_shots").alias("exact"))
    close = F.abs(F.col("unique_shots") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)
    return read.join(exact, ["device_id", "aggregation_window"]).select("device_id", "aggregation_window", close.alias("close"))


@query("r5_rebuild_range", _agg("daily", _DAY, "WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-16'"), "events_raw")
def _(t):
    return rollups.rebuild(t.events_raw, "daily", "2024-01-10", "2024-01-15")


@query("r5_rebuild_stored", f"{_agg('hourly', _HOUR)} UNION ALL {_agg('daily', _DAY)}", "events_raw")
def _(t):
    # Both grains are stored, the daily one wrong; its rebuild must mend it and leave the hourly one.
    from shutterlake.operators import maintain
    from shutterlake.session import work_folder
    from shutterlake.sources import tables

    base = work_folder(t.spark, "rebuild")
    tables.write_table(tables.insert_rows(t.events_raw, "events_raw", AS_OF), "events_raw", f"{base}/raw")
    wrong = rollups.events_agg(t.events_raw, "daily").withColumn("image_count", F.lit(-1).cast("long"))
    tables.write_table(rollups.events_agg(t.events_raw, "hourly").unionByName(wrong), "events_agg", f"{base}/agg")
    days = t.events_raw.agg(F.min("timestamp"), F.max("timestamp")).first()
    maintain.rebuild_table(t.spark, f"{base}/raw", f"{base}/agg", "daily", days[0].date(), days[1].date())
    return tables.read_table(t.spark, "events_agg", f"{base}/agg")


@query("r5_rebuild_fast_clock", _agg("daily", _DAY.replace("timestamp", "(timestamp + INTERVAL 5 MONTH)")), "events_raw")
def _(t):
    # Every device's clock is five months ahead of the day its rows were received.
    from shutterlake.operators import maintain
    from shutterlake.session import work_folder
    from shutterlake.sources import tables

    base = work_folder(t.spark, "rebuild")
    rows = t.events_raw.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 5 MONTH"))
    tables.write_table(tables.insert_rows(rows, "events_raw", AS_OF), "events_raw", f"{base}/raw")
    days = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    maintain.rebuild_table(t.spark, f"{base}/raw", f"{base}/agg", "daily", days[0].date(), days[1].date())
    return tables.read_table(t.spark, "events_agg", f"{base}/agg")


def _stored(t, *names: str) -> grains.Stored:
    """The raw tables of the fixture with the partials of all their families, as stored tables."""
    from shutterlake.session import work_folder
    from shutterlake.sources import tables

    root = work_folder(t.spark, "stored")
    for name in names:
        grains.store(tables.insert_rows(getattr(t, name), name, AS_OF), name, root)
    return grains.Stored(t.spark, root)


def _from_rollups(name: str, base: str, build, table: str = "events_raw") -> None:
    """A statistic answered from stored partials, held against the SQL of its raw form."""
    query(name)(lambda t: build(_stored(t, table)))
    ORACLES[name] = ORACLES[base]


_from_rollups("a9_totals_from_rollups", "a9_fleet_totals", lambda s: grains.fleet_totals(s, AS_OF))
_from_rollups("a10_devices_from_rollups", "a10_device_list", lambda s: grains.device_list(s, AS_OF))
_from_rollups("a11_series_from_rollups", "a11_device_series", lambda s: grains.device_series(s, AS_OF))
_from_rollups("a13_totals_from_rollups", "a13_detection_totals", lambda s: grains.detection_totals(s, AS_OF), "events_enriched")


@query("a11_profile_from_rollups", """
SELECT device_id, count(*) AS total_images, CAST(sum(image_size) AS BIGINT) AS total_size, avg(image_size) AS avg_size,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM events_raw WHERE timestamp BETWEEN TIMESTAMP '2024-01-03 07:31:12' AND TIMESTAMP '2024-01-24 22:10:59' GROUP BY device_id""", "events_raw")
def _(t):
    stored = _stored(t, "events_raw")
    return grains.device_profile(stored, start="2024-01-03 07:31:12", end="2024-01-24 22:10:59").drop("unique_shots")


@query("f3_truncations", f"""
SELECT device_id, shot_id, timestamp, {_HOUR} AS hour, CAST(date_trunc('week', timestamp) AS DATE) AS monday,
  CAST(date_trunc('month', timestamp) AS DATE) AS month, CAST(timestamp AS DATE) AS day,
  date_diff('second', timestamp, :as_of) AS seconds
FROM events_raw""", "events_raw")
def _(t):
    from shutterlake.functions import times

    at = F.col("timestamp")
    return t.events_raw.select(
        "device_id", "shot_id", "timestamp", times.start_of_hour(at).alias("hour"),
        times.monday(at).alias("monday"), times.start_of_month(at).alias("month"),
        F.to_date(at).alias("day"), times.seconds_between(at, as_column(AS_OF)).alias("seconds"),
    )
