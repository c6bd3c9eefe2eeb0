"""From topic messages to typed, defaulted and checked event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.functions.plans import once
from shutterlake.functions.text import given, or_else
from shutterlake.functions.times import as_column
from shutterlake.schemas import ENRICHED_MESSAGE, RAW_MESSAGE


def parse_raw(messages: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Decode JSON `value` into the raw-event columns, or only the given ones, times parsed.

    Malformed JSON or times become nulls, never a failed job. Envelope columns
    (kafka_timestamp, partition, offset) are kept when the source has them.
    """
    envelope = [name for name in ("partition", "offset") if name in messages.columns]
    stamped = "timestamp" in messages.columns
    out = messages.select(
        F.col("value").cast("string").alias("value"),
        *([F.col("timestamp").alias("kafka_timestamp")] if stamped else []), *envelope,
    )
    kept = out.columns
    body = T.StructType([f for f in RAW_MESSAGE if fields is None or f.name in fields])
    return _typed(once(out, body=F.from_json("value", body)), body.names).select(*body.names, *kept)


def _typed(rows: DataFrame, names: list[str]) -> DataFrame:
    """The fields of `body` as columns, times parsed."""
    times = {"timestamp", "received_at", "processed_at"}
    fields = {
        name: F.try_to_timestamp(F.col("body")[name]) if name in times else F.col("body")[name] for name in names
    }
    return once(rows, **fields).drop("body")


def valid(parsed: DataFrame) -> DataFrame:
    """Rows with a device and an event time."""
    return parsed.filter(F.col("device_id").isNotNull() & F.col("timestamp").isNotNull())


def rejects(parsed: DataFrame) -> DataFrame:
    """The other rows, each with its original text and a reason."""
    reason = (
        F.when(F.from_json("value", "map<string,string>").isNull(), "malformed_json")
        .when(F.col("device_id").isNull(), "missing_device")
        .otherwise("bad_timestamp")
    )
    bad = F.col("device_id").isNull() | F.col("timestamp").isNull()
    return parsed.filter(bad).select("value", reason.alias("reason"))


def normalise_raw(parsed: DataFrame, now) -> DataFrame:
    """Raw rows with required fields present and defaults filled in.

    Required: device_id, timestamp, image_url; empty text counts as missing.
    """
    required = given(F.col("device_id")).isNotNull() & given(F.col("image_url")).isNotNull()
    return parsed.filter(required & F.col("timestamp").isNotNull()).select(
        "device_id", "timestamp",
        or_else(F.col("shot_id"), "").alias("shot_id"),
        "image_url",
        F.coalesce("image_size", F.lit(0)).cast("long").alias("image_size"),
        or_else(F.col("image_md5"), "").alias("image_md5"),
        or_else(F.col("mime_type"), "image/jpeg").alias("mime_type"),
        or_else(F.col("firmware_version"), "").alias("firmware_version"),
        or_else(F.col("ip_address"), "").alias("ip_address"),
        or_else(F.col("extra"), "").alias("extra"),
        F.coalesce("received_at", as_column(now)).alias("received_at"),
    )


def parse_enriched(messages: DataFrame) -> DataFrame:
    """Decode enriched JSON `value`; `detections` stays JSON text."""
    body = F.from_json(F.col("value").cast("string"), ENRICHED_MESSAGE)
    rows = once(messages.select("value"), body=body).select("body")
    return _typed(rows, ENRICHED_MESSAGE.names)


def normalise_enriched(parsed: DataFrame, now) -> DataFrame:
    """Enriched rows with device and time present and defaults filled in."""
    required = given(F.col("device_id")).isNotNull() & F.col("timestamp").isNotNull()
    return parsed.filter(required).select(
        "device_id", "timestamp",
        or_else(F.col("shot_id"), "").alias("shot_id"),
        or_else(F.col("image_url"), "").alias("image_url"),
        or_else(F.col("annotated_image_url"), "").alias("annotated_image_url"),
        F.coalesce("detection_count", F.lit(0)).cast("int").alias("detection_count"),
        or_else(F.col("detections"), "[]").alias("detections"),
        F.coalesce("processing_time_ms", F.lit(0)).cast("int").alias("processing_time_ms"),
        F.coalesce("processed_at", as_column(now)).alias("processed_at"),
        or_else(F.col("inference_model"), "yolov8n").alias("inference_model"),
        or_else(F.col("inference_version"), "1.0.0").alias("inference_version"),
        as_column(now).alias("received_at"),
    )


# The fields that the contract looks at.
CONTRACT_FIELDS = ["device_id", "shot_id", "image_url", "image_size", "image_md5", "firmware_version"]


# The event contract, one predicate per broken rule.
def _contract() -> dict[str, Column]:
    c = F.col
    return {
        "device_id": c("device_id").isNull() | ~F.length("device_id").between(1, 100),
        "shot_id": F.length("shot_id") > 100,
        "image_url": ~F.coalesce(c("image_url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), F.lit(False)),
        "image_size": ~F.coalesce(c("image_size") > 0, F.lit(False)),
        "image_md5": ~F.coalesce(F.length("image_md5") == 32, F.lit(False)),
        "firmware_version": F.length("firmware_version") > 50,
    }


def check_contract(events: DataFrame) -> DataFrame:
    """Add `violations`, the names of the broken rules; no row is dropped."""
    flags = [F.when(broken, F.lit(name)) for name, broken in _contract().items()]
    return events.withColumn("violations", F.array_compact(F.array(*flags)))


def violation_summary(checked: DataFrame) -> DataFrame:
    """Rows per broken rule; rules nobody breaks are absent."""
    rules = _contract()
    names = list(rules)
    counts = checked.agg(*[F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in rules.items()])
    return counts.unpivot([], names, "rule", "violations").filter(F.col("violations") > 0)


# The column each table's processing_date is taken from.
DATE_SOURCE = {
    "events_raw": "received_at", "events_raw_stream": "timestamp",
    "events_enriched": "processed_at", "alerts": "triggered_at",
}


def add_processing_date(df: DataFrame, table: str) -> DataFrame:
    return df.withColumn("processing_date", F.to_date(DATE_SOURCE[table]))
