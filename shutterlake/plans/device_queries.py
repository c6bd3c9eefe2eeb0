"""Device messages, presence registry, feed, upload admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import admission, cooldown, devices, rules
from shutterlake.plans.registry import AS_OF, query

# What each message is, read off the rule that made it.
_FEED = """m AS (SELECT event_id AS seq, ts, device_id, event_type,
    CASE event_type WHEN 'view' THEN 'online' WHEN 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE 'offline' END
      WHEN 'click' THEN 'event' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 1 THEN 'ok' ELSE 'ack' END
      ELSE CASE WHEN event_id % 2 = 0 THEN 'warn' ELSE 'unknown' END END AS kind FROM dev WHERE copy = 0),
feed AS (SELECT seq, ts, device_id, 0 AS part, 'presence' AS category, kind AS type FROM m WHERE kind IN ('online', 'offline')
  UNION ALL SELECT seq, ts, device_id, 0, CASE WHEN seq % 4 = 1 THEN 'ota' ELSE 'event' END,
    CASE WHEN seq % 4 = 0 THEN 'upload_fail' WHEN seq % 4 = 1 THEN 'ota_progress' ELSE 'upload_ok' END FROM m WHERE kind = 'event'
  UNION ALL SELECT seq, ts, device_id, CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END, 'ack', CASE WHEN seq % 3 = 0 THEN 'ota_check' ELSE 'capture' END FROM m WHERE kind = 'ack'
  UNION ALL SELECT seq, ts, device_id, 0, 'ota', 'ota_check' FROM m WHERE kind = 'ack' AND seq % 3 = 0
  UNION ALL SELECT seq, ts, device_id, 0, 'warning', 'low_heap' FROM m WHERE kind = 'warn'
  UNION ALL SELECT seq, ts, device_id, 0, 'config', 'auto_config' FROM m WHERE kind = 'ok')"""
_USES = "dev device_messages"


@query("p17_device_messages", f"""
WITH {_FEED} SELECT seq, device_id, ts, category, type FROM feed
UNION ALL SELECT seq, device_id, ts, 'unknown', NULL FROM m WHERE kind = 'unknown'""", _USES)
def _(t):
    return devices.classified(t.device_messages).select("seq", "device_id", "ts", "category", "type")


@query("p18_activity_log", f"""
WITH {_FEED} SELECT device_id, CASE category WHEN 'presence' THEN 'device_' || type WHEN 'warning' THEN 'warn_' || type ELSE type END AS event_type, ts AS timestamp
FROM feed WHERE category IN ('presence', 'ota', 'warning') OR (category = 'event' AND type = 'upload_fail')""", _USES)
def _(t):
    return devices.activity_log(devices.feed(t.device_messages)).drop("metadata")


@query("s12_activity_rows", f"""
WITH {_FEED} SELECT device_id, CASE category WHEN 'presence' THEN 'device_' || type WHEN 'warning' THEN 'warn_' || type ELSE type END AS event_type,
  ts AS timestamp, payload AS metadata
FROM feed JOIN device_messages d USING (seq, ts) WHERE category IN ('presence', 'ota', 'warning') OR (category = 'event' AND type = 'upload_fail')""", _USES)
def _(t):
    return devices.activity_log(devices.feed(t.device_messages))


@query("p16_event_labels", f"""
WITH {_FEED} SELECT seq, part, CASE type WHEN 'online' THEN 'Online' WHEN 'offline' THEN 'Offline' WHEN 'upload_ok' THEN 'Upload OK'
  WHEN 'upload_fail' THEN 'Upload fail: no_wifi' WHEN 'ota_progress' THEN 'ota progress' WHEN 'ota_check' THEN 'ota check'
  WHEN 'capture' THEN 'ACK: capture' WHEN 'low_heap' THEN 'Warning: low_heap' ELSE type END AS label FROM feed""", _USES)
def _(t):
    label = devices.event_label(F.col("category"), F.col("type"), F.col("fields")["reason"])
    return devices.feed(t.device_messages).select("seq", "part", label.alias("label"))


@query("p12_feed_since", f"""
WITH {_FEED} SELECT seq, part, device_id, ts, category, type FROM feed WHERE ts > TIMESTAMP '2024-01-20 00:00:00'
ORDER BY ts DESC, seq DESC, part DESC LIMIT 500""", _USES)
def _(t):
    rows = devices.feed_events(devices.feed(t.device_messages), since="2024-01-20 00:00:00", limit=9999)
    return rows.select("seq", "part", "device_id", "ts", "category", "type")


@query("t7_bounded_feed", f"""
WITH {_FEED} SELECT seq, part, type FROM feed ORDER BY ts DESC, seq DESC, part DESC LIMIT 500""", _USES)
def _(t):
    rows = devices.feed_events(devices.feed(t.device_messages), limit=devices.FEED_SIZE)
    return rows.select("seq", "part", "type")


@query("u1_merged_feed", f"""
WITH {_FEED} SELECT seq, part, type FROM feed WHERE category IN ('event', 'ota', 'ack') ORDER BY ts DESC, seq DESC, part DESC LIMIT 100""", _USES)
def _(t):
    rows = devices.feed(t.device_messages).select("id", "seq", "part", "ts", "type", "category")
    held = rows.filter(F.col("category").isin("event", "ota"))
    polled = rows.filter(F.col("category").isin("ota", "ack"))
    return devices.merge_feed(held, polled).select("seq", "part", "type")


_STATE = """k AS (SELECT *, min(CASE WHEN kind = 'online' THEN (ts, seq) END) OVER (PARTITION BY device_id) AS first_on,
    max(CASE WHEN kind = 'offline' THEN (ts, seq) END) OVER (PARTITION BY device_id) AS last_off FROM m WHERE ts <= :as_of),
state AS (SELECT device_id, bool_or(kind = 'online' AND (last_off IS NULL OR (ts, seq) > last_off)) AS online,
    max(ts) AS last_seen_at, min(CASE WHEN kind = 'online' THEN ts END) AS first_seen_at,
    min(CASE WHEN kind = 'online' AND (last_off IS NULL OR (ts, seq) > last_off) THEN ts END) AS online_since,
    count(*) FILTER (kind = 'event' AND seq % 4 IN (2, 3) AND (ts, seq) > first_on) AS image_count,
    '1.0.' || CAST(arg_max(seq % 3, (ts, seq)) FILTER (kind = 'online') AS VARCHAR) AS firmware,
    arg_max(100000 + seq, (ts, seq)) FILTER (kind = 'online') AS heap
  FROM k WHERE first_on IS NOT NULL GROUP BY device_id),
reg AS (SELECT *, online AND :as_of - last_seen_at > INTERVAL 60 SECONDS AS stale FROM state)"""


@query("x11_device_registry", f"""
WITH {_FEED}, {_STATE} SELECT device_id, online, stale, last_seen_at, first_seen_at, online_since, image_count, firmware, heap,
  false AS auto_mode, CAST(30 AS BIGINT) AS interval_sec, CAST(0 AS BIGINT) AS uptime FROM reg""", _USES)
def _(t):
    return devices.registry(t.device_messages, AS_OF).drop("ip", "ssid")


@query("x12_stale_devices", f"""
WITH {_FEED}, {_STATE} SELECT device_id, last_seen_at FROM reg WHERE stale""", _USES)
def _(t):
    return devices.registry(t.device_messages, AS_OF).filter("stale").select("device_id", "last_seen_at")


@query("x13_image_counts", f"""
WITH {_FEED}, {_STATE} SELECT device_id, image_count FROM reg WHERE image_count > 0""", _USES)
def _(t):
    return devices.registry(t.device_messages, AS_OF).filter("image_count > 0").select("device_id", "image_count")


@query("p15_registry_status", f"""
WITH {_FEED}, {_STATE} SELECT device_id, CASE WHEN stale THEN 'stale' WHEN online THEN 'online' ELSE 'offline' END AS status FROM reg""", _USES)
def _(t):
    status = devices.status(F.col("stale"), F.col("online"))
    return devices.registry(t.device_messages, AS_OF).select("device_id", status.alias("status"))


@query("a22_registry_counts", f"""
WITH {_FEED}, {_STATE} SELECT count(*) AS total, count(*) FILTER (online) AS online, count(*) FILTER (NOT online) AS offline, count(*) FILTER (stale) AS stale FROM reg""", _USES)
def _(t):
    return devices.registry_counts(devices.registry(t.device_messages, AS_OF))


@query("t8_online_devices", f"""
WITH {_FEED}, {_STATE} SELECT device_id, online_since FROM reg WHERE online ORDER BY device_id""", _USES)
def _(t):
    return devices.all_devices(devices.registry(t.device_messages, AS_OF), online_only=True).select(
        "device_id", "online_since"
    )


@query("j9_device_with_events", f"""
WITH {_FEED}, {_STATE}, top AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC, part DESC) <= 30)
SELECT reg.device_id, reg.online, top.ts, top.category, top.type FROM reg LEFT JOIN top USING (device_id)""", _USES)
def _(t):
    registry = devices.registry(t.device_messages, AS_OF).select("device_id", "online")
    return devices.with_recent_events(registry, devices.feed(t.device_messages)).drop("id")


_SILENT = """g AS (SELECT device_id, ts, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, seq) AS next_ts FROM m)"""


@query("w_message_gaps", f"WITH {_FEED}, {_SILENT} SELECT device_id, ts, next_ts FROM g", _USES)
def _(t):
    return devices.gaps(t.device_messages).select("device_id", "ts", "next_ts")


def _offline_rules(t):
    """A rule on ten hours of silence for all, one on a day for one device."""
    return t.alert_rules.filter("rule_id in ('r1', 'r4')").withColumns({
        "cond_type": F.lit("device_offline"),
        "threshold": F.when(F.col("rule_id") == "r1", 36000.0).otherwise(86400.0),
        "cooldown_s": F.lit(172800),
        "species": F.lit(None).cast("array<string>"),
    })


_SILENT_CAND = f"""{_SILENT}, cand AS (SELECT 'r1' AS rule_id, device_id, ts + INTERVAL 10 HOURS AS triggered_at FROM g WHERE coalesce(next_ts, TIMESTAMP '2024-02-01') - ts > INTERVAL 10 HOURS
  UNION ALL SELECT 'r4', device_id, ts + INTERVAL 24 HOURS FROM g WHERE device_id = 'cam-000000000005' AND coalesce(next_ts, TIMESTAMP '2024-02-01') - ts > INTERVAL 24 HOURS)"""


@query("l10_device_offline", f"""
WITH RECURSIVE {_FEED}, {_SILENT_CAND}, fired AS (SELECT rule_id, device_id, min(triggered_at) AS triggered_at FROM cand GROUP BY ALL
  UNION ALL SELECT c.rule_id, c.device_id, min(c.triggered_at) FROM fired f JOIN cand c USING (rule_id, device_id)
  WHERE c.triggered_at > f.triggered_at + INTERVAL 2 DAYS GROUP BY c.rule_id, c.device_id, f.triggered_at)
SELECT DISTINCT rule_id, device_id, triggered_at FROM fired""", _USES)
def _(t):
    found = rules.silence_candidates(devices.gaps(t.device_messages), _offline_rules(t), "2024-02-01 00:00:00")
    return cooldown.apply_cooldown(found).select("rule_id", "device_id", "triggered_at")


_UP = """up AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY arrived_at, seq) AS n,
    CASE WHEN seq % 3 = 0 THEN CAST(date_trunc('second', arrived_at) AS TIMESTAMP)
      ELSE TIMESTAMP '2024-01-01' + to_seconds(CAST(seq * 60 AS DOUBLE)) END AS ts FROM uploads)"""


@query("x8_upload_admission", f"""
WITH RECURSIVE {_UP}, run AS (
  SELECT device_id, n, seq, copy, 'accepted' AS status, ts AS latest, CASE WHEN shot_id <> '' THEN [(shot_id, arrived_at)] ELSE [] END AS shots FROM up WHERE n = 1
  UNION ALL
  SELECT device_id, n, seq, copy, status, CASE WHEN status = 'accepted' THEN ts ELSE latest END,
    CASE WHEN status = 'accepted' AND shot_id <> '' THEN list_append(shots, (shot_id, arrived_at)) ELSE shots END
  FROM (SELECT u.*, r.latest, list_filter(r.shots, lambda x: x[2] >= u.arrived_at - INTERVAL 10 MINUTES) AS shots,
      CASE WHEN u.shot_id <> '' AND len(list_filter(r.shots, lambda x: x[1] = u.shot_id AND x[2] >= u.arrived_at - INTERVAL 10 MINUTES)) > 0 THEN 'duplicate'
        WHEN u.ts <= r.latest THEN 'stale' ELSE 'accepted' END AS status
    FROM run r JOIN up u ON u.device_id = r.device_id AND u.n = r.n + 1))
SELECT device_id, seq, copy, status FROM run""", "uploads")
def _(t):
    return admission.admit(t.uploads, AS_OF).select("device_id", "seq", "copy", "status")


@query("w2_running_latest", f"""
WITH {_UP} SELECT device_id, seq, copy, max(ts) OVER (PARTITION BY device_id ORDER BY arrived_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_before FROM up""", "uploads")
def _(t):
    return admission.running_latest(t.uploads, AS_OF).select("device_id", "seq", "copy", "latest_before")


@query("t9_device_lookup", """
SELECT device_id, max(ts) AS last_seen_at FROM device_messages d JOIN (SELECT event_id AS seq, device_id FROM dev WHERE copy = 0) USING (seq)
WHERE device_id = 'cam-000000000005' GROUP BY device_id""", _USES)
def _(t):
    known = devices.registry(t.device_messages, "2024-02-01 00:00:00")
    return devices.by_id(known, "cam-000000000005").select("device_id", "last_seen_at")
