"""Table catalogue: columns, keys, retention and allowed values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def schema(ddl: str) -> T.StructType:
    """A StructType from `name type` pairs, without needing a session."""
    simple = {
        "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(),
        "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
        "timestamp": T.TimestampType(), "binary": T.BinaryType(), "strings": T.ArrayType(T.StringType()),
    }
    return T.StructType([
        T.StructField(name, simple[kind]) for name, kind in (part.split() for part in ddl.split(","))
    ])


DETECTIONS = T.ArrayType(T.StructType([
    T.StructField("class", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("conf", T.DoubleType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("class_id", T.IntegerType()),
]))

# JSON bodies of the two event topics; timestamps arrive as text.
RAW_MESSAGE = schema(
    "device_id string, timestamp string, shot_id string, image_url string, image_size long, "
    "image_md5 string, mime_type string, firmware_version string, ip_address string, "
    "extra string, received_at string"
)
ENRICHED_MESSAGE = schema(
    "device_id string, timestamp string, shot_id string, image_url string, "
    "annotated_image_url string, detection_count long, detections string, "
    "processing_time_ms long, processed_at string, inference_model string, "
    "inference_version string"
)

# Allowed values.
SEVERITIES = ["info", "warning", "critical"]
ALERT_STATUSES = ["active", "acknowledged", "resolved"]
IMAGE_STATUSES = ["pending", "annotating", "reviewing", "completed", "rejected"]
ANNOTATION_STATUSES = ["draft", "submitted", "approved", "rejected"]
ANNOTATION_FORMATS = ["coco", "yolo", "pascal_voc", "custom"]
PROJECT_STATUSES = ["draft", "active", "completed", "archived"]
ANNOTATION_TYPES = ["object_detection", "classification", "segmentation"]
CONDITION_TYPES = ["detection_count", "confidence", "species", "device_offline"]
OPERATORS = [">", "<", ">=", "<=", "==", "!=", "in", "not_in"]
CHANNEL_TYPES = ["email", "webhook", "in_app"]


@dataclass(frozen=True)
class Table:
    """One stored table: its columns, unique/order key and expiry.

    `partitions` are columns that folders are named by, above the month.
    """

    columns: T.StructType
    key: list[str]
    date_column: str | None = None
    retention_days: int | None = None
    bloom_columns: list[str] = field(default_factory=list)
    partitions: list[str] = field(default_factory=list)


TABLES = {
    "events_raw": Table(
        schema(
            "event_id string, device_id string, timestamp timestamp, shot_id string, image_url string, "
            "image_size long, image_md5 string, mime_type string, firmware_version string, "
            "ip_address string, extra string, received_at timestamp, processing_date date"
        ),
        ["device_id", "timestamp"], "processing_date", 90, ["shot_id"],
    ),
    "events_hourly": Table(
        schema(
            "device_id string, hour timestamp, image_count long, total_size long, avg_size double, "
            "unique_shots long, processing_date date"
        ),
        ["device_id", "hour"], "processing_date", 180,
    ),
    "device_stats_daily": Table(
        schema(
            "device_id string, date date, total_images long, total_size_mb double, "
            "first_seen timestamp, last_seen timestamp, avg_interval_seconds double"
        ),
        ["device_id", "date"], "date",
    ),
    "events_agg": Table(
        schema(
            "device_id string, aggregation_window timestamp, window_type string, image_count long, "
            "total_size_bytes long, avg_size_bytes double, unique_shots long, processing_date date"
        ),
        ["device_id", "aggregation_window", "window_type"], "processing_date", 180, partitions=["window_type"],
    ),
    "events_enriched": Table(
        schema(
            "device_id string, timestamp timestamp, shot_id string, image_url string, "
            "annotated_image_url string, detection_count int, detections string, "
            "processing_time_ms int, processed_at timestamp, inference_model string, "
            "inference_version string, received_at timestamp, processing_date date"
        ),
        ["device_id", "timestamp"], "processing_date", 180, ["shot_id"],
    ),
    "detections_hourly": Table(
        schema(
            "device_id string, hour timestamp, event_count long, total_detections long, "
            "avg_detections_per_image double, unique_species strings, processing_date date"
        ),
        ["device_id", "hour"], "processing_date", 180,
    ),
    "species_distribution_daily": Table(
        schema(
            "device_id string, date date, species string, detection_count long, "
            "avg_confidence double, min_confidence double, max_confidence double"
        ),
        ["device_id", "date", "species"], "date", 180,
    ),
    "alerts": Table(
        schema(
            "alert_id string, rule_id string, rule_name string, device_id string, severity string, "
            "message string, triggered_at timestamp, acknowledged_at timestamp, "
            "acknowledged_by string, resolved_at timestamp, resolved_by string, status string, "
            "metadata string, created_at timestamp, processing_date date"
        ),
        ["triggered_at", "device_id", "severity"], "processing_date", 180,
    ),
    "alerts_hourly": Table(
        schema("device_id string, severity string, hour timestamp, alert_count long, processing_date date"),
        ["device_id", "severity", "hour"], "processing_date", 180,
    ),
    "alerts_daily": Table(
        schema(
            "device_id string, date date, total_alerts long, critical_count long, warning_count long, "
            "info_count long, active_count long, resolved_count long"
        ),
        ["device_id", "date"], "date", 180,
    ),
    "alert_rules": Table(
        schema(
            "rule_id string, name string, enabled boolean, cond_type string, op string, "
            "threshold double, species strings, device_id string, severity string, cooldown_s long"
        ),
        ["name"],
    ),
    "rejects": Table(schema("value string, reason string, processing_date date"), [], "processing_date", 30),
    "job_counters": Table(
        schema("job string, number long, consumed long, processed long, errors long, detections long"), ["job", "number"],
    ),
    "notification_logs": Table(
        schema("type string, channel string, alert_id string, status string, created_at timestamp"), ["alert_id"], "created_at", 180,
    ),
    **{f"{family}_{grain}": Table(
        schema(
            "device_id string, aggregation_window timestamp, window_type string, image_count long, sized long, total_size_bytes long, "
            "min_size_bytes long, max_size_bytes long, first_seen timestamp, last_seen timestamp, shots_sketch binary, "
            "processing_date date"
        ),
        ["device_id", "aggregation_window"], "processing_date", 180,
    ) for family in ("partials", "contacts") for grain in ("hourly", "daily")},
    **{f"detected_{grain}": Table(
        schema(
            "device_id string, aggregation_window timestamp, window_type string, image_count long, counted long, "
            "detection_count long, detected_images long, processing_date date"
        ),
        ["device_id", "aggregation_window"], "processing_date", 180,
    ) for grain in ("hourly", "daily")},
    "devices": Table(
        schema(
            "device_id string, online boolean, stale boolean, firmware string, ip string, ssid string, "
            "heap long, auto_mode boolean, interval_sec long, uptime long, last_seen_at timestamp, "
            "online_since timestamp, first_seen_at timestamp, image_count long"
        ),
        ["device_id"],
    ),
    "activity_logs": Table(
        schema("device_id string, event_type string, metadata string, timestamp timestamp"),
        [], "timestamp", 30,
    ),
    "in_app_notifications": Table(
        schema(
            "alert_id string, rule_name string, device_id string, severity string, message string, "
            "read boolean, created_at timestamp, read_at timestamp"
        ),
        ["alert_id"],
    ),
    "labeling_projects": Table(
        schema(
            "project_id string, name string, description string, status string, "
            "annotation_type string, class_names strings, created_at timestamp, "
            "updated_at timestamp, created_by string"
        ),
        ["name"],
    ),
    "project_images": Table(
        schema(
            "project_id string, image_id string, image_url string, device_id string, width int, "
            "height int, status string, assigned_to string, reviewed_by string, created_at timestamp"
        ),
        ["project_id", "image_id"],
    ),
    "annotations": Table(
        schema(
            "project_id string, image_id string, class string, category string, x1 double, y1 double, "
            "x2 double, y2 double, annotation_format string, status string, annotated_by string, "
            "created_at timestamp, updated_at timestamp"
        ),
        ["project_id", "image_id"],
    ),
}
