"""Alert life cycle, dashboards, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.times import as_column
from shutterlake.operators import changes
from shutterlake.schemas import SEVERITIES

# Salts of the rows of one hour.
SPREAD = 16


def newest_first() -> list[Column]:
    return [F.desc("triggered_at"), F.asc("alert_id")]


def with_status(alerts: DataFrame, status_changes: DataFrame) -> DataFrame:
    """Alerts after acknowledge/resolve rows; changes of unknown ids have no effect.

    `status_changes` has alert_id, status, changed_at, changed_by.
    """
    at = F.struct("changed_at", "status")

    def last(column: str, status: str | None = None) -> Column:
        when = at if status is None else F.when(F.col("status") == status, at)
        return F.max_by(column, when)

    latest = status_changes.groupBy("alert_id").agg(
        last("status").alias("_status"),
        *(
            last(source, status).alias(f"{status}_{suffix}")
            for status in ("acknowledged", "resolved")
            for source, suffix in (("changed_at", "at"), ("changed_by", "by"))
        ),
    )
    added = ["acknowledged_at", "acknowledged_by", "resolved_at", "resolved_by"]
    kept = alerts.drop(*added)
    return kept.join(latest, "alert_id", "left").withColumn(
        "status", F.coalesce("_status", "status")
    ).drop("_status")


def history_page(alerts: DataFrame, number: int = 1, size: int = 20, deep: int = 10_000, **given) -> DataFrame:
    """A page of alerts, newest first; one that skips more than `deep` rows is located by counts per day."""
    rows = changes.where_eq(alerts, **given)
    if (number - 1) * size > deep:
        return changes.page_by_days(rows, "triggered_at", newest_first(), number, size)
    return changes.page(rows, newest_first(), number, size)


def by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    """One alert; no row for an unknown one."""
    return alerts.filter(F.col("alert_id") == alert_id)


def recent_active(alerts: DataFrame, n: int = 10, **given) -> DataFrame:
    active = changes.where_eq(alerts, status="active", **given)
    return active.orderBy(*newest_first()).limit(n)


def _count_of(column: str, value: str) -> Column:
    return F.count_if(F.col(column) == value)


def statistics(alerts: DataFrame) -> DataFrame:
    """One row: total and count per status and per severity."""
    return alerts.agg(
        F.count("*").alias("total"),
        *(_count_of("status", s).alias(s) for s in ("active", "acknowledged", "resolved")),
        *(_count_of("severity", s).alias(s) for s in SEVERITIES),
    )


def _active_by_severity() -> list[Column]:
    active = F.col("status") == "active"
    return [
        F.count_if(active & (F.col("severity") == s)).alias(f"active_{s}") for s in SEVERITIES
    ]


def overview(alerts: DataFrame, rules: DataFrame, notifications: DataFrame) -> DataFrame:
    """Dashboard numbers as (metric, value) rows, zeros included."""
    counts = alerts.agg(_count_of("status", "active").alias("active"), *_active_by_severity())
    parts = [
        counts, rules.agg(F.count_if("enabled").alias("enabled_rules")),
        notifications.agg(F.count_if(~F.col("read")).alias("unread_notifications")),
    ]
    long = None
    for part in parts:
        rows = part.unpivot([], part.columns, "metric", "value")
        long = rows if long is None else long.unionByName(rows)
    return long


def summary(alerts: DataFrame) -> DataFrame:
    """One row: count per status, their total, active count per severity."""
    statuses = ("active", "acknowledged", "resolved")
    row = alerts.agg(
        *(_count_of("status", s).alias(s) for s in statuses), *_active_by_severity(),
    )
    return row.withColumn("total", sum((F.col(s) for s in statuses), F.lit(0)))


def busiest_devices(alerts: DataFrame, n: int = 5) -> DataFrame:
    """Devices with most active alerts."""
    counted = alerts.filter(F.col("status") == "active").groupBy("device_id").agg(
        F.count("*").alias("alert_count")
    )
    return counted.orderBy(F.desc("alert_count"), "device_id").limit(n)


def dashboard_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(_count_of("status", "active").alias("active"), F.count("*").alias("total"))


# ---- notifications ------------------------------------------------------

def outbox(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per alert and channel of its rule; rules without channels send nothing."""
    return alerts.join(channels, "rule_id")


def in_app(outbox_rows: DataFrame, now) -> DataFrame:
    """In-app notification rows."""
    return outbox_rows.filter(F.col("channel") == "in_app").select(
        "alert_id", "rule_name", "device_id", "severity", "message",
        F.lit(False).alias("read"), as_column(now).alias("created_at"),
        F.lit(None).cast("timestamp").alias("read_at"),
    )


def delivery_log(outbox_rows: DataFrame, now) -> DataFrame:
    """One log row per delivery."""
    return outbox_rows.select(
        F.col("channel").alias("type"), "channel", "alert_id", F.lit("sent").alias("status"),
        as_column(now).alias("created_at"),
    )


def notifications_page(notifications: DataFrame, number: int = 1, size: int = 20, **given) -> DataFrame:
    order = [F.desc("created_at"), F.asc("alert_id")]
    return changes.page(changes.where_eq(notifications, **given), order, number, size)


def notifications_totals(notifications: DataFrame, size: int = 20, **given) -> DataFrame:
    """Total rows and pages under the same filters as the page."""
    return changes.page_totals(changes.where_eq(notifications, **given), size)


def unread_count(notifications: DataFrame) -> DataFrame:
    return notifications.filter(~F.col("read")).agg(F.count("*").alias("count"))


def after_actions(notifications: DataFrame, actions: DataFrame) -> DataFrame:
    """Notifications after read / read_all / delete rows (alert_id, action, acted_at).

    A read_all row has no alert_id and marks everything created up to its time.
    """
    named = actions.filter(F.col("alert_id").isNotNull()).groupBy("alert_id").agg(
        F.min(F.when(F.col("action") == "read", F.col("acted_at"))).alias("_read"),
        F.bool_or(F.col("action") == "delete").alias("_deleted"),
    )
    kept = notifications.join(named, "alert_id", "left").filter(~F.coalesce("_deleted", F.lit(False)))
    read_at = F.least(F.col("_read"), F.col("_swept"))
    return _with_next_sweep(kept, actions.filter(F.col("action") == "read_all").select("acted_at")).withColumns({
        "read_at": F.when(~F.col("read"), read_at),
        "read": F.col("read") | read_at.isNotNull(),
    }).drop("_read", "_deleted", "_swept")


def _with_next_sweep(notifications: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Notifications with `_swept`, the first sweep (acted_at) at or after their creation.

    An as-of join by hours: each hour holds its own sweeps in order, in which a notification of that hour is
    looked up, and the first sweep of a later hour. The hours are one row each; notifications are never ordered, and
    those of a busy hour meet it under `SPREAD` salts.
    """
    hour = lambda at: F.date_trunc("hour", at)
    held = sweeps.distinct().groupBy(hour("acted_at").alias("_hour")).agg(F.sort_array(F.collect_list("acted_at")).alias("_sweeps"))
    hours = notifications.select(hour("created_at").alias("_hour")).distinct().join(held, "_hour", "full")
    after = Window.orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    known = hours.withColumn("_following", F.min(F.get("_sweeps", F.lit(0))).over(after)).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    salted = notifications.withColumns({"_hour": hour("created_at"), "_salt": F.pmod(F.xxhash64("alert_id", "created_at"), F.lit(SPREAD)).cast("int")})
    within = F.get(F.filter("_sweeps", lambda at: at >= F.col("created_at")), F.lit(0))
    return (
        salted.join(known, ["_hour", "_salt"], "left").withColumn("_swept", F.coalesce(within, "_following"))
        .drop("_hour", "_salt", "_sweeps", "_following")
    )
