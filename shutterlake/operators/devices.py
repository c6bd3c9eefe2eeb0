"""Device messages: classification, feed, activity log, presence registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.plans import once
from shutterlake.functions.text import given, json_object
from shutterlake.functions.times import as_column
from shutterlake.operators import changes

STALE_AFTER_S = 60
FEED_SIZE = 500
DEFAULT_INTERVAL_S = 30


def device_of(topic: Column) -> Column:
    """Second-to-last topic segment, else `unknown`."""
    parts = F.split(topic, "/")
    return F.coalesce(given(F.get(parts, F.size(parts) - 2)), F.lit("unknown"))


def _has(payload: Column, key: str) -> Column:
    return F.map_contains_key(payload, key)


def truthy(value: Column) -> Column:
    """A JSON scalar held as text counts as true unless false, 0, empty or null."""
    return F.coalesce(~value.isin("false", "0", "", "null"), F.lit(False))


def parsed(messages: DataFrame) -> DataFrame:
    """One row per message: seq, ts, device_id, payload map, kind.

    kind is online, offline, ack, event, warn, ok or unknown, by the first key
    present; text that is no JSON object is unknown.
    """
    p = F.col("fields")
    kind = (
        F.when(p.isNull(), "unknown")
        .when(_has(p, "online"), F.when(truthy(p["online"]), "online").otherwise("offline"))
        .when(_has(p, "ack"), "ack").when(_has(p, "event"), "event")
        .when(_has(p, "warn"), "warn").when(_has(p, "ok"), "ok")
        .otherwise("unknown")
    )
    named = messages.select("seq", "ts", device_of(F.col("topic")).alias("device_id"), "payload")
    return once(once(named, fields=json_object(F.col("payload"))), kind=kind)


def classified(messages: DataFrame) -> DataFrame:
    """Feed rows with category and type; an `ota…` acknowledgement yields two rows."""
    p, kind = F.col("fields"), F.col("kind")
    ota_ack = (kind == "ack") & p["ack"].startswith("ota")
    ota_event = (kind == "event") & p["event"].startswith("ota_")
    category = (
        F.when(kind.isin("online", "offline"), F.array(F.lit("presence")))
        .when(ota_ack, F.array(F.lit("ota"), F.lit("ack")))
        .when(kind == "ack", F.array(F.lit("ack")))
        .when(ota_event, F.array(F.lit("ota")))
        .when(kind == "event", F.array(F.lit("event")))
        .when(kind == "warn", F.array(F.lit("warning")))
        .when(kind == "ok", F.array(F.lit("config")))
        .otherwise(F.array(F.lit("unknown")))
    )
    rows = parsed(messages).select("*", F.posexplode(category).alias("part", "category"))
    label = F.col("category")
    type_ = (
        F.when(label == "presence", kind)
        .when(label == "ack", p["ack"])
        .when(label == "event", F.coalesce(given(p["event"]), F.lit("unknown")))
        .when(label == "ota", F.coalesce(given(p["event"]), given(p["ack"]), F.lit("ota_unknown")))
        .when(label == "warning", p["warn"])
        .when(label == "config", F.lit("auto_config"))
    )
    return rows.withColumn("type", type_)


def feed(messages: DataFrame) -> DataFrame:
    """The event feed: classified rows without unknown ones, each with an id."""
    return classified(messages).filter(F.col("category") != "unknown").withColumn(
        "id", F.concat_ws("-", "seq", "part")
    )


def newest_first() -> list[Column]:
    return [F.desc("ts"), F.desc("seq"), F.desc("part")]


def feed_events(rows: DataFrame, since=None, device_id: str | None = None, limit: int = 50) -> DataFrame:
    """Newest feed rows strictly after `since`, at most 500."""
    if since is not None:
        rows = rows.filter(F.col("ts") > as_column(since))
    if device_id:
        rows = rows.filter(F.col("device_id") == device_id)
    return rows.orderBy(*newest_first()).limit(min(limit, FEED_SIZE))


def merge_feed(held: DataFrame, polled: DataFrame, keep: int = 100) -> DataFrame:
    """A poll merged into the held rows, one row per id, newest `keep`."""
    merged = held.unionByName(polled).dropDuplicates(["id"])
    return merged.orderBy(*newest_first()).limit(keep)


def event_label(category: Column, type_: Column, reason: Column) -> Column:
    """Display text of a feed row."""
    why = F.coalesce(reason, F.lit(""))
    # Labels of the plain types.
    return (
        F.when(type_ == "online", "Online").when(type_ == "offline", "Offline")
        .when(type_ == "captured", "Captured").when(type_ == "upload_ok", "Upload OK")
        .when(type_ == "upload_fail", F.concat(F.lit("Upload fail: "), why))
        .when(type_ == "capture_fail", F.concat(F.lit("Capture fail: "), why))
        .when(type_.startswith("ota_"), F.replace(type_, F.lit("_"), F.lit(" ")))
        .when(category == "ack", F.concat(F.lit("ACK: "), type_))
        .when(category == "warning", F.concat(F.lit("Warning: "), type_))
        .otherwise(F.coalesce(given(type_), F.lit("Unknown")))
    )


def activity_log(rows: DataFrame) -> DataFrame:
    """Feed rows that are logged, with the logged event type."""
    category, type_ = F.col("category"), F.col("type")
    logged = (
        F.when(category == "presence", F.concat(F.lit("device_"), type_))
        .when((category == "event") & type_.isin("capture_fail", "upload_fail"), type_)
        .when(category == "ota", type_)
        .when(category == "warning", F.concat(F.lit("warn_"), type_))
    )
    return rows.select(
        "device_id", logged.alias("event_type"), F.col("payload").alias("metadata"),
        F.col("ts").alias("timestamp"),
    ).filter(F.col("event_type").isNotNull())


def status(stale: Column, online: Column) -> Column:
    """stale before online before offline; unknown when nothing is known."""
    return (
        F.when(stale, "stale").when(online, "online").when(~online, "offline").otherwise("unknown")
    )


# ---- presence registry --------------------------------------------------

def _order() -> Column:
    return F.struct("ts", "seq")


def _whole(value: Column) -> Column:
    """A number without its decimals; none beyond what a long holds."""
    number = value.try_cast("double")
    return F.when(F.abs(number) < float(1 << 62), number.cast("long"))


def presence_fields(kind: Column, payload: Column) -> dict[str, Column]:
    """What a message says of its device, typed; null where it says nothing that can be read."""
    text = lambda key: F.when(truthy(payload[key]), payload[key])
    return {
        "firmware": text("fw"), "ip": text("ip"), "ssid": text("ssid"), "heap": _whole(payload["heap"]),
        "auto_mode": F.when(payload["auto"].isNotNull(), truthy(payload["auto"])),
        "interval_sec": _whole(payload["intervalSec"]), "uptime": _whole(payload["uptime"]),
        "uploaded": (kind == "event") & (payload["event"] == "upload_ok"),
    }


def registry(messages: DataFrame, as_of) -> DataFrame:
    """Each known device's state after all its messages up to `as_of`.

    A device is known from its first online message on. Messages are reduced to
    one row per device and hour, with map-side combining aggregates, and those
    to one per device. The two facts that depend on an order within the device
    (uploads after the first online message, start of the present online run)
    follow from the hours, except inside the one hour each where that order
    matters: only those hours' messages are looked at again. No task receives a
    whole device.
    """
    rows = parsed(messages).filter(F.col("ts") <= as_column(as_of)).withColumn(
        "hour", F.date_trunc("hour", "ts")
    )
    kind, p, at = F.col("kind"), F.col("fields"), _order()
    online, offline = kind == "online", kind == "offline"
    given_fields = presence_fields(kind, p)
    uploaded = given_fields.pop("uploaded")
    # The last given value of an online message, with its place.
    fields = {
        name: F.max(F.when(online & value.isNotNull(), F.struct(at.alias("at"), value.alias("value"))))
        for name, value in given_fields.items()
    }
    hourly = rows.groupBy("device_id", "hour").agg(
        F.min(F.when(online, at)).alias("first_on"),
        F.max(F.when(online, at)).alias("last_on"),
        F.max(F.when(offline, at)).alias("last_off"),
        F.max("ts").alias("last_seen_at"),
        F.count_if(uploaded).alias("uploads"),
        *(column.alias(name) for name, column in fields.items()),
    )
    # The hours of a device are bounded by the time span, not by its messages.
    state = hourly.groupBy("device_id").agg(
        F.min("first_on").alias("first_on"), F.max("last_on").alias("last_on"),
        F.max("last_off").alias("last_off"), F.max("last_seen_at").alias("last_seen_at"),
        F.collect_list(F.struct("hour", "uploads", F.col("first_on.ts").alias("first_online"))).alias("hours"),
        *(F.max(name)["value"].alias(name) for name in fields),
    ).filter(F.col("first_on").isNotNull())
    first_hour, off_hour = F.date_trunc("hour", "first_on.ts"), F.date_trunc("hour", "last_off.ts")
    later_uploads = F.aggregate(
        F.filter("hours", lambda h: h["hour"] > first_hour), F.lit(0).cast("long"), lambda n, h: n + h["uploads"]
    )
    after_off = F.filter("hours", lambda h: off_hour.isNull() | (h["hour"] > off_hour))
    state = state.withColumns({
        "later_uploads": later_uploads,
        "later_online": F.array_min(F.transform(after_off, lambda h: h["first_online"])),
    }).drop("hours")

    edges = state.select(
        "device_id", "first_on", "last_off",
        F.explode(F.array_distinct(F.array_compact(F.array(first_hour, off_hour)))).alias("hour"),
    )
    inside = rows.join(edges, ["device_id", "hour"]).groupBy("device_id").agg(
        F.count_if(uploaded & (F.col("hour") == first_hour) & (at > F.col("first_on"))).alias("edge_uploads"),
        F.min(F.when(online & (F.col("hour") == off_hour) & (at > F.col("last_off")), F.col("ts"))).alias("edge_online"),
    )
    is_online = F.col("last_off").isNull() | (F.col("last_on") > F.col("last_off"))
    silent = F.unix_micros(as_column(as_of)) - F.unix_micros("last_seen_at")
    return state.join(inside, "device_id", "left").select(
        "device_id", is_online.alias("online"),
        (is_online & (silent > STALE_AFTER_S * 1_000_000)).alias("stale"),
        "firmware", "ip", "ssid", "heap",
        F.coalesce("auto_mode", F.lit(False)).alias("auto_mode"),
        F.coalesce("interval_sec", F.lit(DEFAULT_INTERVAL_S)).alias("interval_sec"),
        F.coalesce("uptime", F.lit(0)).alias("uptime"),
        "last_seen_at",
        F.when(is_online, F.coalesce("edge_online", "later_online")).alias("online_since"),
        F.col("first_on")["ts"].alias("first_seen_at"),
        (F.col("later_uploads") + F.coalesce("edge_uploads", F.lit(0))).alias("image_count"),
    )


def by_id(devices: DataFrame, device_id: str) -> DataFrame:
    """One device's state; no row for an unknown one."""
    return devices.filter(F.col("device_id") == device_id)


def registry_counts(devices: DataFrame) -> DataFrame:
    """One row: total, online, offline and stale devices."""
    return devices.agg(
        F.count("*").alias("total"), F.count_if("online").alias("online"),
        F.count_if(~F.col("online")).alias("offline"), F.count_if("stale").alias("stale"),
    )


def all_devices(devices: DataFrame, online_only: bool = False) -> DataFrame:
    """Devices in order of id."""
    kept = devices.filter("online") if online_only else devices
    return kept.orderBy("device_id")


def with_recent_events(devices: DataFrame, rows: DataFrame, n: int = 30) -> DataFrame:
    """Each device with its newest `n` feed rows; a device without any keeps one row."""
    recent = changes.top_per_key(rows, ["device_id"], newest_first(), n)
    events = recent.select("device_id", "id", "ts", "category", "type")
    return devices.join(events, "device_id", "left")


def gaps(messages: DataFrame) -> DataFrame:
    """Each message with the time of the device's next one (null for the last).

    Neighbours are found within device-hours; the last message of an hour takes
    the start of the device's next hour with messages, from a table of one row
    per device and hour.
    """
    rows = parsed(messages).select("device_id", "ts", "seq", F.date_trunc("hour", "ts").alias("hour"))
    hours = rows.groupBy("device_id", "hour").agg(F.min("ts").alias("first_ts"))
    following = hours.select(
        "device_id", "hour",
        F.lead("first_ts").over(Window.partitionBy("device_id").orderBy("hour")).alias("_next_hour"),
    )
    within = Window.partitionBy("device_id", "hour").orderBy("ts", "seq")
    return (
        rows.withColumn("_next", F.lead("ts").over(within))
        .join(following, ["device_id", "hour"])
        .select("device_id", "ts", "seq", F.coalesce("_next", "_next_hour").alias("next_ts"))
    )
