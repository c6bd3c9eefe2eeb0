"""Camera tables derived from the `events` table.

Every fixture is one SQL text that Spark and DuckDB read alike, so a query and
its checking SQL start from the same rows. A fixture's text names the fixtures
it builds on; `with_clause` puts the needed ones in order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _choice(number: str, names: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names[:-1]))
    return f"CASE ({number}) % {len(names)} {cases} ELSE '{names[-1]}' END"


CLASSES = ["ant", "Bee", "beetle", "moth", "person"]
CLASSES_SQL = ", ".join(f"'{name}'" for name in CLASSES)


def _object(at_least: int, offset: int, bbox: str) -> str:
    comma = "," if at_least else ""
    return f"""CASE WHEN event_id % 4 > {at_least} THEN concat('{comma}{{"class":"', c{at_least},
        '","confidence":0.', lpad(CAST((event_id * 7 + {offset}) % 100 AS STRING), 2, '0'),
        ',"bbox":{bbox},"class_id":', CAST((event_id + {at_least}) % 5 AS STRING), '}}') ELSE '' END"""


_ISO = "concat(replace(substr(CAST({0} AS STRING), 1, 19), ' ', 'T'), 'Z')"
_URL = (
    "concat('http://minio:9000/iot-raw/raw/', CAST(CAST(ts AS DATE) AS STRING), '/', device_id, "
    "'/', CAST(event_id AS STRING), '.jpg')"
)

FIXTURES = {
    "src": """
        SELECT event_id, user_id, event_type, value, props, ts, 0 AS copy FROM events
        UNION ALL
        SELECT event_id, user_id, event_type, value, props, ts + INTERVAL 5 MINUTES AS ts, 1 AS copy
        FROM events WHERE event_id % 10 = 0""",
    "dev": """
        SELECT *,
          CASE WHEN user_id % 7 = 3 THEN concat('cam-test-', CAST(user_id AS STRING))
               ELSE concat('cam-', lpad(CAST(user_id AS STRING), 12, '0')) END AS device_id,
          CASE WHEN event_type = 'signup' THEN '' ELSE concat('shot-', CAST(event_id AS STRING)) END AS shot_id
        FROM src""",
    "cls": f"""
        SELECT *, {_choice("event_id", CLASSES)} AS c0, {_choice("event_id + 1", CLASSES)} AS c1,
          {_choice("event_id + 2", CLASSES)} AS c2
        FROM dev""",
    "events_raw": f"""
        SELECT device_id, ts AS timestamp, shot_id, {_URL} AS image_url,
          CAST(round(value * 1000) AS BIGINT) + 1 AS image_size,
          md5(CAST(event_id AS STRING)) AS image_md5,
          'image/jpeg' AS mime_type,
          concat('1.0.', CAST(event_id % 3 AS STRING)) AS firmware_version,
          concat('192.168.1.', CAST(user_id % 254 + 1 AS STRING)) AS ip_address,
          props AS extra,
          ts + INTERVAL 2 SECONDS AS received_at
        FROM dev""",
    "events_enriched": f"""
        SELECT device_id, ts AS timestamp, shot_id, {_URL} AS image_url,
          concat('http://minio:9000/iot-annotated/', device_id, '/', CAST(event_id AS STRING), '_annotated.jpg') AS annotated_image_url,
          CAST(event_id % 4 AS INT) AS detection_count,
          concat('[', {_object(0, 0, "[10,20,110,220]")}, {_object(1, 13, "[15,25,75,125]")}, {_object(2, 26, "[0,0,640,480]")}, ']') AS detections,
          CAST(event_id % 500 AS INT) AS processing_time_ms,
          ts + INTERVAL 10 SECONDS AS processed_at,
          'yolov8n' AS inference_model, '1.0.0' AS inference_version
        FROM cls WHERE copy = 0 AND event_type <> 'error'""",
    # One row per detected object, as plain columns: what the JSON text says.
    "objects": """
        SELECT device_id, ts AS timestamp, ts + INTERVAL 10 SECONDS AS processed_at, event_id, shot_id, 0 AS pos, c0 AS species, CAST((event_id * 7) % 100 AS DOUBLE) / 100 AS confidence
        FROM cls WHERE copy = 0 AND event_type <> 'error' AND event_id % 4 > 0
        UNION ALL SELECT device_id, ts, ts + INTERVAL 10 SECONDS, event_id, shot_id, 1, c1, CAST((event_id * 7 + 13) % 100 AS DOUBLE) / 100
        FROM cls WHERE copy = 0 AND event_type <> 'error' AND event_id % 4 > 1
        UNION ALL SELECT device_id, ts, ts + INTERVAL 10 SECONDS, event_id, shot_id, 2, c2, CAST((event_id * 7 + 26) % 100 AS DOUBLE) / 100
        FROM cls WHERE copy = 0 AND event_type <> 'error' AND event_id % 4 > 2""",
    "alert_rules": """
        SELECT 'r1' AS rule_id, 'many objects' AS name, true AS enabled, 'detection_count' AS cond_type, '>=' AS op, CAST(2 AS DOUBLE) AS threshold, CAST(NULL AS STRING) AS species, CAST(NULL AS STRING) AS device_id, 'warning' AS severity, 3600 AS cooldown_s
        UNION ALL SELECT 'r2', 'sure hit', true, 'confidence', '>', CAST(0.9 AS DOUBLE), NULL, NULL, 'critical', 300
        UNION ALL SELECT 'r3', 'bees', true, 'species', 'in', NULL, 'bee', NULL, 'info', 300
        UNION ALL SELECT 'r4', 'one camera', true, 'detection_count', '>=', CAST(1 AS DOUBLE), NULL, 'cam-000000000005', 'info', 60
        UNION ALL SELECT 'r5', 'switched off', false, 'detection_count', '>=', CAST(0 AS DOUBLE), NULL, NULL, 'critical', 60
        UNION ALL SELECT 'r6', 'no people', true, 'species', 'not_in', NULL, 'person', 'cam-000000000007', 'info', 86400""",
    "alert_history": """
        SELECT concat('alert-', CAST(event_id AS STRING)) AS alert_id,
          concat('r', CAST(event_id % 4 + 1 AS STRING)) AS rule_id, device_id,
          CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity,
          CASE event_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'acknowledged' ELSE 'active' END AS status,
          ts AS triggered_at
        FROM dev WHERE copy = 0 AND event_type IN ('error', 'purchase')""",
    "alert_changes": """
        SELECT alert_id, CASE status WHEN 'resolved' THEN 'resolved' ELSE 'acknowledged' END AS status,
          triggered_at + INTERVAL 1 MINUTE AS changed_at, 'operator' AS changed_by
        FROM alert_history WHERE status <> 'active'
        UNION ALL SELECT concat('none-', alert_id), 'resolved', triggered_at, 'operator' FROM alert_history WHERE status = 'active' AND severity = 'info'
        UNION ALL SELECT alert_id, 'resolved', triggered_at + INTERVAL 9 MINUTES, 'supervisor' FROM alert_history WHERE status = 'acknowledged' AND severity = 'info'""",
    "channels": """
        SELECT 'r1' AS rule_id, 'in_app' AS channel, '{}' AS config
        UNION ALL SELECT 'r1', 'email', '{"to":"a@b.example"}'
        UNION ALL SELECT 'r3', 'webhook', '{"url":"http://hook.example"}'
        UNION ALL SELECT 'r4', 'in_app', '{}'""",
    "in_app_notifications": """
        SELECT alert_id, rule_id AS rule_name, device_id, severity, concat('Alert ', alert_id) AS message,
          status <> 'active' AS "read", triggered_at AS created_at
        FROM alert_history""",
    "device_messages": """
        SELECT event_id AS seq, ts, concat('SITE/CAM/', device_id, '/status') AS topic,
          CASE event_type
            WHEN 'view' THEN concat('{"online":true,"device":"', device_id, '","fw":"1.0.', CAST(event_id % 3 AS STRING), '","heap":', CAST(100000 + event_id AS STRING), ',"auto":false,"intervalSec":30}')
            WHEN 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'plain text' ELSE '{"online":false}' END
            WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN '{"event":"upload_fail","reason":"no_wifi"}' WHEN event_id % 4 = 1 THEN '{"event":"ota_progress","pct":45}' ELSE '{"event":"upload_ok"}' END
            WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN '{"ack":"ota_check","current_fw":"1.2.3"}' WHEN event_id % 3 = 1 THEN '{"ok":true,"auto":true,"intervalSec":60}' ELSE '{"ack":"capture","busy":false}' END
            ELSE CASE WHEN event_id % 2 = 0 THEN '{"warn":"low_heap","heap":19800}' ELSE '{"other":1}' END END AS payload
        FROM dev WHERE copy = 0""",
    "uploads": """
        SELECT ts AS arrived_at, event_id AS seq, copy, device_id, shot_id,
          CASE event_id % 3 WHEN 0 THEN replace(replace(replace(substr(CAST(ts AS STRING), 1, 19), '-', ''), ':', ''), ' ', '')
            WHEN 1 THEN CAST(1704067200 + event_id * 60 AS STRING)
            ELSE CAST((1704067200 + event_id * 60) * 1000 AS STRING) END AS ts_raw,
          props AS extra_raw
        FROM dev""",
    "labeling_projects": f"""
        SELECT 'p0' AS project_id, 'garden' AS name, 'active' AS status, '{",".join(CLASSES)}' AS class_names
        UNION ALL SELECT 'p1', 'roof', 'draft', '{",".join(CLASSES)}'
        UNION ALL SELECT 'p2', 'hive', 'completed', '{",".join(CLASSES)}'""",
    "project_images": """
        SELECT concat('p', CAST(user_id % 3 AS STRING)) AS project_id, concat('img-', CAST(event_id AS STRING)) AS image_id,
          concat('http://localhost:9002/iot-raw/raw/', device_id, '/', CAST(event_id AS STRING), '.jpg') AS image_url, device_id,
          640 AS width, 480 AS height,
          CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'annotating' WHEN 2 THEN 'reviewing' WHEN 3 THEN 'completed' ELSE 'rejected' END AS status,
          ts AS created_at
        FROM dev WHERE copy = 0 AND event_id % 2 = 0""",
    "annotations": """
        SELECT concat('p', CAST(user_id % 3 AS STRING)) AS project_id, concat('img-', CAST(event_id AS STRING)) AS image_id,
          CASE WHEN event_id % 11 = 0 THEN 'unlisted' ELSE c0 END AS class,
          CAST(event_id % 300 AS DOUBLE) AS x1, CAST(event_id % 200 AS DOUBLE) AS y1,
          CAST(event_id % 300 + 64 AS DOUBLE) AS x2, CAST(event_id % 200 + 48 AS DOUBLE) AS y2,
          CASE event_id % 6 WHEN 0 THEN 'approved' WHEN 2 THEN 'submitted' ELSE 'draft' END AS status
        FROM cls WHERE copy = 0 AND event_id % 2 = 0""",
    # Topic messages with every kind of damage; `bad` says which one a row has.
    "raw_messages": f"""
        SELECT event_id AS seq, copy, device_id, ts, shot_id, event_type,
          CASE WHEN event_id % 23 = 0 THEN 'json' WHEN event_id % 17 = 0 THEN 'device'
               WHEN event_id % 19 = 0 THEN 'time' WHEN event_id % 13 = 0 THEN 'url'
               WHEN event_id % 29 = 0 THEN 'size' WHEN event_id % 31 = 0 THEN 'md5' ELSE '' END AS bad,
          CASE WHEN event_id % 23 = 0 THEN '{{"device_id":"cut' ELSE concat('{{',
            CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('"device_id":"', device_id, '",') END,
            '"timestamp":"', CASE WHEN event_id % 19 = 0 THEN 'not-a-time' ELSE {_ISO.format("ts")} END,
            '","shot_id":"', shot_id, '","image_url":"', CASE WHEN event_id % 13 = 0 THEN '' ELSE {_URL} END,
            '","image_size":', CASE WHEN event_id % 29 = 0 THEN '-5' ELSE CAST(event_id + 1 AS STRING) END,
            ',"image_md5":"', CASE WHEN event_id % 31 = 0 THEN 'short' ELSE md5(CAST(event_id AS STRING)) END,
            CASE WHEN event_id % 2 = 0 THEN '","mime_type":"image/png' ELSE '' END,
            '","firmware_version":"1.0.', CAST(event_id % 3 AS STRING), '"}}') END AS value
        FROM dev""",
    "enriched_messages": f"""
        SELECT event_id AS seq, device_id, ts,
          CASE WHEN event_id % 23 = 0 THEN '[1' ELSE concat('{{"device_id":"', CASE WHEN event_id % 17 = 0 THEN '' ELSE device_id END,
            '","timestamp":"', {_ISO.format("ts")},
            CASE WHEN event_id % 2 = 0 THEN concat('","processed_at":"', {_ISO.format("ts")}) ELSE '' END, '"',
            CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"detections":[{{"class":"ant","confidence":0.5}}],"detection_count":1' END,
            CASE WHEN event_id % 5 = 0 THEN ',"inference_model":"other"' ELSE '' END, '}}') END AS value
        FROM dev WHERE copy = 0""",
}


def _needed(names: list[str]) -> list[str]:
    """The named fixtures and those they build on, in order of definition."""
    wanted: set[str] = set()

    def visit(name: str) -> None:
        if name in wanted:
            return
        wanted.add(name)
        for other in FIXTURES:
            if other != name and re.search(rf"\bFROM {other}\b", FIXTURES[name]):
                visit(other)

    for name in names:
        visit(name)
    return [name for name in FIXTURES if name in wanted]


def with_clause(names: list[str], dialect: str = "duckdb", events: str = "events") -> str:
    """The WITH prefix defining the named fixtures over `events`."""
    parts = []
    for name in _needed(names):
        text = re.sub(r"\bFROM events\b", f"FROM {events}", FIXTURES[name])
        if dialect == "spark":
            text = text.replace('"read"', "read")
        parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts)


class Inputs:
    """Fixture tables of one data folder as DataFrames: `inputs.events_raw` …

    `events.ts` is stored without a zone; it is read as UTC.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")

    @property
    def source(self) -> str:
        """What the fixtures' SQL reads as `events`."""
        return f"parquet.`{self.folder}/events.parquet`"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FIXTURES:
            raise AttributeError(name)
        df = self.spark.sql(f"{with_clause([name], 'spark', self.source)} SELECT * FROM {name}")
        self.__dict__[name] = df = df.select(*[
            F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz"
            else F.col(f.name) for f in df.schema
        ])
        return df
