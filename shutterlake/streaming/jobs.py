"""The streaming jobs: ingest, rollups, enrichment, alerts, presence.

A job writes each micro-batch under its batch number, so that a batch replayed
after a failure replaces itself. A failed write raises; the checkpoint then
stays before the batch. When all tables of a batch are written it is marked as finished
(see sources.batches), which is what readers of several tables go by.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shutterlake.functions.times import as_column
from shutterlake.operators import alerts, cooldown, decode, grains, rollups, rules, scoring
from shutterlake.sources import batches, tables
from shutterlake.streaming import metrics, state

INTERVAL = "10 seconds"
RETRIES = 3
FIRST_WAIT_S = 0.1


def with_retries(write: Callable[[], None], retries: int = RETRIES, first_wait_s: float = FIRST_WAIT_S) -> None:
    """Run `write`, again after 0.1, 0.2, 0.4 s on failure; the last failure is raised."""
    for attempt in range(retries + 1):
        try:
            return write()
        except Exception:
            if attempt == retries:
                raise
            time.sleep(first_wait_s * 2**attempt)


def write_batch(df: DataFrame, table: str, path: str, batch_id: int) -> None:
    """Write a micro-batch of a table under batch=<id>/month=<yyyyMM>, replacing itself."""
    date = tables.TABLES[table].date_column
    rows = tables.table_columns(df, table).withColumn("batch", F.lit(batch_id))
    parts = ["batch"]
    if date is not None:
        rows = rows.withColumn("month", tables.month_of(F.col(date)))
        parts.append("month")
    with_retries(
        lambda: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts).parquet(path)
    )


def start(
    df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, *,
    interval: str | None = INTERVAL, mode: str = "append", name: str | None = None,
) -> StreamingQuery:
    """Run `each` per micro-batch; without an interval, drain what is there and stop."""
    writer = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def drain(query: StreamingQuery) -> None:
    """Finish the rows that have arrived, then stop."""
    query.processAllAvailable()
    query.stop()


def ingest(
    messages: DataFrame, out: str, checkpoint: str, now, *, disabled: set[str] = frozenset(),
    interval: str | None = INTERVAL, counters: str = "ingest",
) -> StreamingQuery:
    """Raw topic → events_raw, rejects and the partial hourly/daily rollups of each batch by event time and by receipt.

    Rollup rows are partial states (`rollups.combine` adds them up), since a
    later batch may bring more rows of the same hour.
    """
    valid = F.col("device_id").isNotNull() & F.col("timestamp").isNotNull()
    parsed = metrics.counted(decode.parse_raw(messages), counters, valid)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            # Times of a replayed batch must not move, so rows without one take `now`.
            raw = tables.insert_rows(decode.normalise_raw(batch, now), "events_raw", now)
            outputs = {"events_raw": raw}
            for family in (grains.FAMILIES["partials"], grains.FAMILIES["contacts"]):
                for grain, name in family.tables().items():
                    outputs[name] = family.build(raw, grain)
            outputs["rejects"] = decode.rejects(batch).withColumn("processing_date", F.to_date(as_column(now)))
            outputs["job_counters"] = metrics.batch_row(batch, counters, batch_id, valid)
            tables.fan_out(outputs, lambda df, table: write_batch(df, table, f"{out}/{table}", batch_id), disabled)
            batches.finish(messages.sparkSession, out, batch_id)
        finally:
            batch.unpersist()

    return start(parsed, each, checkpoint, interval=interval, name=counters)


def rollup(
    events: DataFrame, kind: str, out: str, checkpoint: str, *, interval: str | None = INTERVAL,
    counters: str = "rollup",
) -> StreamingQuery:
    """A windowed rollup of an event stream; windows are written once the watermark passes them.

    kind is sizes (hourly), hourly, daily (generic rollup) or device_daily.
    """
    build = {
        "sizes": rollups.hourly_sizes, "device_daily": rollups.device_stats_daily,
        "hourly": lambda e: rollups.events_agg(e, "hourly"), "daily": lambda e: rollups.events_agg(e, "daily"),
    }[kind]
    writer = build(events).writeStream.format("parquet").outputMode("append").queryName(counters)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def enrich(
    raw: DataFrame, out: str, checkpoint: str, now, *, load: Callable[[], scoring.Detector],
    interval: str | None = INTERVAL, counters: str = "enrich",
) -> StreamingQuery:
    """Raw events → scored events_enriched; unreadable images go to rejects."""
    scored = scoring.enrich(raw, now, load)
    observed = metrics.counted(scored, counters, F.col("detections").isNotNull(), F.col("detection_count"))

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            rows = tables.insert_rows(scoring.scored(batch), "events_enriched", now)
            write_batch(rows, "events_enriched", f"{out}/events_enriched", batch_id)
            for grain, name in grains.FAMILIES["detected"].tables().items():
                write_batch(rollups.detected(rows, grain), name, f"{out}/{name}", batch_id)
            rejected = scoring.unscored(batch)
            with_retries(lambda: rejected.write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}"))
            found = metrics.batch_row(batch, counters, batch_id, F.col("detections").isNotNull(), F.col("detection_count"))
            write_batch(found, "job_counters", f"{out}/job_counters", batch_id)
            batches.finish(raw.sparkSession, out, batch_id)
        finally:
            batch.unpersist()

    return start(observed, each, checkpoint, interval=interval, name=counters)


def enriched_topic(
    messages: DataFrame, rule_rows: DataFrame, channels: DataFrame, out: str, checkpoint: str, now, *,
    interval: str | None = INTERVAL,
) -> list[StreamingQuery]:
    """Enriched topic (JSON `value`) → events_enriched, and its alerts and notifications.

    Two queries over the same messages, each with a checkpoint of its own: one
    stores the rows, the other runs the rules and their cooldown.
    """
    rows = decode.normalise_enriched(decode.parse_enriched(messages), now)

    def each(batch: DataFrame, batch_id: int) -> None:
        stored = tables.insert_rows(batch, "events_enriched", now)
        write_batch(stored, "events_enriched", f"{out}/events_enriched", batch_id)

    return [
        start(rows, each, f"{checkpoint}/rows", interval=interval),
        alert(rows, rule_rows, channels, out, f"{checkpoint}/alerts", now, interval=interval),
    ]


def alert(
    enriched: DataFrame, rule_rows: DataFrame, channels: DataFrame, out: str, checkpoint: str, now, *,
    history: DataFrame | None = None, resolutions: DataFrame | None = None, interval: str | None = INTERVAL,
) -> StreamingQuery:
    """Enriched events → rules → cooldown → alerts, in-app notifications and delivery log.

    Rules are read when the job starts (see `alert_as_of` for rules that change while it runs). Open alerts of `history`, stored before the job began, block;
    a row of the `resolutions` stream ends the block of its alert.
    """
    fired = state.cooldown_stream(rules.candidates(enriched, rule_rows), history, resolutions)
    made = rules.as_alerts(fired, now)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_batch(batch, "alerts", f"{out}/alerts", batch_id)
            outbox = alerts.outbox(batch, channels)
            write_batch(alerts.in_app(outbox, now), "in_app_notifications", f"{out}/in_app_notifications", batch_id)
            write_batch(alerts.delivery_log(outbox, now), "notification_logs", f"{out}/notification_logs", batch_id)
            batches.finish(enriched.sparkSession, out, batch_id)
        finally:
            batch.unpersist()

    return start(made, each, checkpoint, interval=interval)


def alert_as_of(
    enriched: DataFrame, rule_changes: Callable[[], DataFrame], channels: DataFrame, out: str, checkpoint: str, now, *,
    history: Callable[[], DataFrame] | None = None, interval: str | None = INTERVAL,
) -> StreamingQuery:
    """As `alert`, by rules that change while the job runs: an event meets the version that held at its time.

    `rule_changes` gives the log of changes as it is now (rule_id, changed_at, seq, action and the rule's
    fields), and is asked for every micro-batch. What the pairs fired before is read from the alerts that finished
    batches of this job have written, or from `history`, which also knows what was resolved since; so the job
    has no state but its tables, and a batch replayed gives the same alerts by the same log.
    """
    spark = enriched.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        versions = rules.versions(rule_changes())
        found = rules.candidates_as_of(batch, versions)
        batches.sum_up_marks(spark, out)
        before = history() if history else batches.read(spark, "alerts", f"{out}/alerts", marks=out)
        made = rules.as_alerts(cooldown.apply_cooldown(found, before), now).persist()
        try:
            write_batch(made, "alerts", f"{out}/alerts", batch_id)
            outbox = alerts.outbox(made, channels)
            write_batch(alerts.in_app(outbox, now), "in_app_notifications", f"{out}/in_app_notifications", batch_id)
            write_batch(alerts.delivery_log(outbox, now), "notification_logs", f"{out}/notification_logs", batch_id)
            batches.finish(spark, out, batch_id)
        finally:
            made.unpersist()

    return start(enriched, each, checkpoint, interval=interval)


def presence(
    messages: DataFrame, out: str, checkpoint: str, *, interval: str | None = INTERVAL, timers: bool | None = None,
    delay: str = state.DELAY,
) -> StreamingQuery:
    """Device messages → device states, one row per changed device and batch.

    Silent devices are reported by timers, by default in a job that runs on.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, "devices", out, batch_id)

    states = state.presence_stream(messages, timers=interval is not None if timers is None else timers, delay=delay)
    return start(states, each, checkpoint, interval=interval, mode="update")


def offline(
    messages: DataFrame, rule_rows: DataFrame, out: str, checkpoint: str, *, interval: str | None = INTERVAL,
    timers: bool | None = None, delay: str = state.DELAY,
) -> StreamingQuery:
    """Device messages → alerts for silences beyond the device_offline rules' thresholds.

    Silences that last are reported by timers, by default in a job that runs on.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        with_retries(lambda: batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    fired = state.offline_stream(messages, rule_rows, interval is not None if timers is None else timers, delay)
    return start(fired, each, checkpoint, interval=interval)


def admission(uploads: DataFrame, out: str, checkpoint: str, now, *, interval: str | None = INTERVAL) -> StreamingQuery:
    """Uploads → verdicts."""

    def each(batch: DataFrame, batch_id: int) -> None:
        with_retries(lambda: batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    return start(state.admit_stream(uploads, now), each, checkpoint, interval=interval)
