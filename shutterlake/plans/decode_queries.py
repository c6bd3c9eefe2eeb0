"""Decoding, defaults, contract check, processing dates, insert rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import decode
from shutterlake.plans.registry import AS_OF, query
from shutterlake.sources import tables

_SECOND = "CAST(date_trunc('second', ts) AS TIMESTAMP)"


@query("p1_decode_envelope", f"""
SELECT CASE WHEN bad IN ('json', 'device') THEN NULL ELSE device_id END AS device_id,
  CASE WHEN bad = 'json' OR seq % 19 = 0 THEN NULL ELSE {_SECOND} END AS timestamp,
  CASE WHEN bad = 'json' THEN NULL ELSE shot_id END AS shot_id,
  TRY_CAST(json_extract_string(CASE WHEN bad = 'json' THEN '{{}}' ELSE value END, '$.image_size') AS BIGINT) AS image_size,
  CAST(NULL AS TIMESTAMP) AS received_at
FROM raw_messages""", "raw_messages")
def _(t):
    return decode.parse_raw(t.raw_messages.select("value")).select(
        "device_id", "timestamp", "shot_id", "image_size", "received_at"
    )


@query("p2_valid_rows", f"""
SELECT device_id, {_SECOND} AS timestamp, shot_id FROM raw_messages
WHERE bad <> 'json' AND seq % 17 <> 0 AND seq % 19 <> 0""", "raw_messages")
def _(t):
    asked = ["device_id", "timestamp", "shot_id"]
    return decode.valid(decode.parse_raw(t.raw_messages.select("value"), asked)).select(*asked)


@query("p2_rejected_rows", """
SELECT value, CASE WHEN bad = 'json' THEN 'malformed_json' WHEN seq % 17 = 0 THEN 'missing_device' ELSE 'bad_timestamp' END AS reason
FROM raw_messages WHERE bad = 'json' OR seq % 17 = 0 OR seq % 19 = 0""", "raw_messages")
def _(t):
    return decode.rejects(decode.parse_raw(t.raw_messages.select("value"), ["device_id", "timestamp"]))


@query("p3_raw_defaults", f"""
SELECT device_id, {_SECOND} AS timestamp, shot_id,
  CASE WHEN seq % 29 = 0 THEN -5 ELSE seq + 1 END AS image_size,
  CASE WHEN seq % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime_type,
  CASE WHEN seq % 31 = 0 THEN 'short' ELSE md5(CAST(seq AS STRING)) END AS image_md5,
  concat('1.0.', CAST(seq % 3 AS STRING)) AS firmware_version, '' AS ip_address, '' AS extra,
  :as_of AS received_at
FROM raw_messages WHERE seq % 23 <> 0 AND seq % 17 <> 0 AND seq % 19 <> 0 AND seq % 13 <> 0""", "raw_messages")
def _(t):
    return decode.normalise_raw(decode.parse_raw(t.raw_messages.select("value")), AS_OF).drop("image_url")


@query("p4_enriched_defaults", f"""
SELECT device_id, {_SECOND} AS timestamp, '' AS shot_id, '' AS image_url,
  CAST(CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS INT) AS detection_count,
  CASE WHEN seq % 3 = 0 THEN '[]' ELSE '[{{"class":"ant","confidence":0.5}}]' END AS detections,
  CASE WHEN seq % 2 = 0 THEN {_SECOND} ELSE :as_of END AS processed_at,
  CASE WHEN seq % 5 = 0 THEN 'other' ELSE 'yolov8n' END AS inference_model, '1.0.0' AS inference_version
FROM enriched_messages WHERE seq % 23 <> 0 AND seq % 17 <> 0""", "enriched_messages")
def _(t):
    rows = decode.normalise_enriched(decode.parse_enriched(t.enriched_messages), AS_OF)
    return rows.drop("annotated_image_url", "processing_time_ms", "received_at")


@query("p5_contract_check", """
SELECT value, concat_ws(',', CASE WHEN seq % 17 = 0 OR seq % 23 = 0 THEN 'device_id' END,
  CASE WHEN seq % 13 = 0 OR seq % 23 = 0 THEN 'image_url' END, CASE WHEN seq % 29 = 0 OR seq % 23 = 0 THEN 'image_size' END,
  CASE WHEN seq % 31 = 0 OR seq % 23 = 0 THEN 'image_md5' END) AS violations
FROM raw_messages""", "raw_messages")
def _(t):
    checked = decode.check_contract(decode.parse_raw(t.raw_messages.select("value"), decode.CONTRACT_FIELDS))
    return checked.select("value", F.array_join("violations", ",").alias("violations"))


@query("p5_violation_summary", """
SELECT 'device_id' AS rule, count(*) AS violations FROM raw_messages WHERE seq % 17 = 0 OR seq % 23 = 0
UNION ALL SELECT 'image_url', count(*) FROM raw_messages WHERE seq % 13 = 0 OR seq % 23 = 0
UNION ALL SELECT 'image_size', count(*) FROM raw_messages WHERE seq % 29 = 0 OR seq % 23 = 0
UNION ALL SELECT 'image_md5', count(*) FROM raw_messages WHERE seq % 31 = 0 OR seq % 23 = 0""", "raw_messages")
def _(t):
    parsed = decode.parse_raw(t.raw_messages.select("value"), decode.CONTRACT_FIELDS)
    return decode.violation_summary(decode.check_contract(parsed))


@query("p6_processing_date", """
SELECT 'raw' AS kind, CAST(received_at AS DATE) AS processing_date, count(*) AS n FROM events_raw GROUP BY ALL
UNION ALL SELECT 'stream', CAST(timestamp AS DATE), count(*) FROM events_raw GROUP BY ALL
UNION ALL SELECT 'enriched', CAST(processed_at AS DATE), count(*) FROM events_enriched GROUP BY ALL
UNION ALL SELECT 'alert', CAST(triggered_at AS DATE), count(*) FROM alert_history GROUP BY ALL""",
       "events_raw events_enriched alert_history")
def _(t):
    def dated(df, table, kind):
        return decode.add_processing_date(df, table).select(F.lit(kind).alias("kind"), "processing_date")

    raw = t.events_raw.select("timestamp", "received_at")
    rows = (
        dated(raw, "events_raw", "raw")
        .unionByName(dated(raw, "events_raw_stream", "stream"))
        .unionByName(dated(t.events_enriched, "events_enriched", "enriched"))
        .unionByName(dated(t.alert_history, "alerts", "alert"))
    )
    return rows.groupBy("kind", "processing_date").agg(F.count("*").alias("n"))


@query("s7_insert_rows_raw", """
SELECT device_id, timestamp, shot_id, image_url, image_size, image_md5, mime_type, firmware_version, ip_address, extra,
  received_at, CAST(received_at AS DATE) AS processing_date
FROM events_raw""", "events_raw")
def _(t):
    return tables.insert_rows(t.events_raw, "events_raw", AS_OF).drop("event_id")


@query("s7_insert_rows_enriched", """
SELECT device_id, timestamp, shot_id, detection_count, detections, processing_time_ms, processed_at,
  inference_model, inference_version, :as_of AS received_at, CAST(processed_at AS DATE) AS processing_date
FROM events_enriched""", "events_enriched")
def _(t):
    return tables.insert_rows(t.events_enriched, "events_enriched", AS_OF).drop("image_url", "annotated_image_url")


@query("s7_insert_rows_alerts", """
SELECT alert_id, rule_id, '' AS rule_name, device_id, severity, '' AS message, triggered_at,
  CAST(NULL AS TIMESTAMP) AS acknowledged_at, '' AS acknowledged_by, CAST(NULL AS TIMESTAMP) AS resolved_at, '' AS resolved_by,
  status, '{}' AS metadata, :as_of AS created_at, CAST(triggered_at AS DATE) AS processing_date
FROM alert_history""", "alert_history")
def _(t):
    return tables.insert_rows(t.alert_history, "alerts", AS_OF)
