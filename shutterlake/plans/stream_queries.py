"""The streaming jobs run to completion over the given events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import changes, maintain, rollups
from shutterlake.plans import alert_queries, device_queries, labeling_queries  # noqa: F401
from shutterlake.plans.fixtures import Inputs
from shutterlake.plans.stand_in import stub_detector
from shutterlake.plans.registry import AS_OF, ORACLES, query
from shutterlake.session import work_folder
from shutterlake.sources import batches, streams, tables
from shutterlake.streaming import jobs, metrics


class Streams(Inputs):
    """The fixtures over a stream of the events file."""

    def __init__(self, inputs: Inputs):
        super().__init__(inputs.spark, inputs.folder)
        path = f"{self.folder}/events.parquet"
        schema = self.spark.read.parquet(path).schema
        self.view = f"events_{uuid.uuid4().hex}"
        # A stream's path must be a folder or a pattern.
        pattern = f"{self.folder}/event[s].parquet"
        streams.source(self.spark, "parquet", path=pattern, schema=schema).createOrReplaceTempView(self.view)

    @property
    def source(self) -> str:
        return self.view


def _folders(t: Inputs) -> tuple[str, str]:
    base = work_folder(t.spark, "job")
    return f"{base}/out", f"{base}/checkpoint"


def _finished(started) -> None:
    started.awaitTermination()


_CLOSED = "(SELECT max(ts) FROM dev)"


@query("x4_streamed_ingest", """
SELECT device_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp, shot_id, :as_of AS received_at
FROM raw_messages WHERE seq % 23 <> 0 AND seq % 17 <> 0 AND seq % 19 <> 0 AND seq % 13 <> 0""", "raw_messages")
def _(t):
    out, checkpoint = _folders(t)
    _finished(jobs.ingest(Streams(t).raw_messages.select("value"), out, checkpoint, AS_OF, interval=None))
    return t.spark.read.parquet(f"{out}/events_raw").select("device_id", "timestamp", "shot_id", "received_at")


@query("s6_streamed_rejects", """
SELECT value, CASE WHEN bad = 'json' THEN 'malformed_json' WHEN seq % 17 = 0 THEN 'missing_device' ELSE 'bad_timestamp' END AS reason
FROM raw_messages WHERE bad = 'json' OR seq % 17 = 0 OR seq % 19 = 0""", "raw_messages")
def _(t):
    out, checkpoint = _folders(t)
    messages = Streams(t).raw_messages.select("value")
    _finished(jobs.ingest(messages, out, checkpoint, AS_OF, interval=None, disabled={"partials_hourly"}))
    return t.spark.read.parquet(f"{out}/rejects").select("value", "reason")


@query("s6_streamed_partials", """
SELECT device_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS aggregation_window, count(*) AS image_count
FROM raw_messages WHERE seq % 23 <> 0 AND seq % 17 <> 0 AND seq % 19 <> 0 AND seq % 13 <> 0 GROUP BY ALL""", "raw_messages")
def _(t):
    out, checkpoint = _folders(t)
    _finished(jobs.ingest(Streams(t).raw_messages.select("value"), out, checkpoint, AS_OF, interval=None))
    parts = batches.read(t.spark, "partials_daily", f"{out}/partials_daily", marks=out)
    return rollups.read_combined(rollups.combine(parts)).select("device_id", "aggregation_window", "image_count")


BLOCKS = 4


def _block(t: Inputs, number: int) -> DataFrame:
    """One block of the raw rows, each twice over, as two equal uploads are two events."""
    rows = tables.insert_rows(t.events_raw, "events_raw", AS_OF).filter(F.pmod(F.xxhash64("event_id"), F.lit(BLOCKS)) == number)
    return rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")


def _in_blocks(t: Inputs, out: str) -> None:
    """The raw rows as batches of an ingest job."""
    raw = f"{out}/events_raw"
    for batch in range(BLOCKS):
        jobs.write_batch(_block(t, batch), "events_raw", raw, batch)
        if batch < BLOCKS - 1:  # the last batch dies between its two tables
            written = batches.columns_of(t.spark.read.parquet(batches.streamed(t.spark, raw)[batch]), "events_raw")
            jobs.write_batch(rollups.partials(written, "daily"), "partials_daily", f"{out}/partials_daily", batch)
            batches.finish(t.spark, out, batch)


_BLOCKS = """
SELECT device_id, aggregation_window, 2 * CAST(sum(n) AS BIGINT) AS image_count FROM (
  SELECT device_id, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS aggregation_window, count(*) AS n FROM events_raw GROUP BY ALL) GROUP BY ALL"""


@query("x5_compacted_partials", _BLOCKS, "events_raw")
def _(t):
    # Folded in two steps with a run between that died before it deleted its batches; the raw rows tell the same.
    out, _ = _folders(t)
    _in_blocks(t, out)
    raw, parts = f"{out}/events_raw", f"{out}/partials_daily"
    maintain.compact(t.spark, "events_raw", raw, f"{out}/stored_raw", 2, marks=out)
    maintain.compact(t.spark, "partials_daily", parts, f"{out}/stored_partials", 9, marks=out)
    jobs.write_batch(_block(t, 1), "events_raw", raw, 1)
    maintain.compact(t.spark, "events_raw", raw, f"{out}/stored_raw", 9, marks=out)
    rows = batches.read(t.spark, "events_raw", raw, stored=f"{out}/stored_raw")
    seen = rollups.combine(batches.read(t.spark, "partials_daily", parts, out, f"{out}/stored_partials"))
    whole = rows.groupBy("device_id", F.date_trunc("day", "timestamp").alias("aggregation_window")).agg(F.count("*").alias("image_count"))
    left = batches.read(t.spark, "events_raw", raw).groupBy("device_id", F.date_trunc("day", "timestamp").alias("aggregation_window")).agg(
        F.count("*").alias("open"))
    key = ["device_id", "aggregation_window"]
    # What is folded as partials, and the rows of the batch that is not finished.
    told = seen.select(*key, "image_count").join(left, key, "full").select(
        *key, (F.coalesce("image_count", F.lit(0)) + F.coalesce("open", F.lit(0))).alias("image_count"))
    return whole.intersectAll(told)


@query("x9_visible_batches", """
SELECT 'raw' AS kind, device_id, count(*) * 2 AS images FROM events_raw WHERE false GROUP BY ALL
UNION ALL SELECT kind, '', 0 FROM (VALUES ('same')) v(kind)""", "events_raw")
def _(t):
    # Readers of two tables see the same events in both, also while a batch is half written.
    out, _ = _folders(t)
    _in_blocks(t, out)
    raw = batches.read(t.spark, "events_raw", f"{out}/events_raw", marks=out).groupBy("device_id").agg(F.count("*").alias("images"))
    parts = batches.read(t.spark, "partials_daily", f"{out}/partials_daily", marks=out).groupBy("device_id").agg(F.sum("image_count").alias("images"))
    odd = raw.exceptAll(parts).unionByName(parts.exceptAll(raw)).select(F.lit("raw").alias("kind"), "device_id", "images")
    seen = raw.agg(F.lit("same").alias("kind"), F.lit("").alias("device_id"), F.lit(0).cast("long").alias("images"))
    return odd.unionByName(seen)


@query("x2_streamed_hourly", f"""
SELECT device_id, CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS aggregation_window, count(*) AS image_count,
  CAST(sum(image_size) AS BIGINT) AS total_size_bytes, max(image_size) AS max_size_bytes, min(image_size) AS min_size_bytes
FROM events_raw WHERE date_trunc('hour', timestamp) + INTERVAL 1 HOUR <= {_CLOSED} - INTERVAL 1 HOUR GROUP BY ALL""", "events_raw dev")
def _(t):
    out, checkpoint = _folders(t)
    _finished(jobs.rollup(Streams(t).events_raw, "sizes", out, checkpoint, interval=None))
    rows = t.spark.read.parquet(out)
    return rows.select(
        "device_id", "aggregation_window", "image_count", "total_size_bytes", "max_size_bytes", "min_size_bytes"
    )


@query("x2_streamed_daily", f"""
SELECT device_id, CAST(timestamp AS DATE) AS date, count(*) AS total_images, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM events_raw WHERE date_trunc('day', timestamp) + INTERVAL 1 DAY <= {_CLOSED} - INTERVAL 1 DAY GROUP BY ALL""", "events_raw dev")
def _(t):
    out, checkpoint = _folders(t)
    _finished(jobs.rollup(Streams(t).events_raw, "device_daily", out, checkpoint, interval=None))
    return t.spark.read.parquet(out).select("device_id", "date", "total_images", "first_seen", "last_seen")


def _same_check(name: str, as_name: str) -> None:
    """A streamed query is checked by its batch form's SQL."""
    ORACLES[name] = ORACLES[as_name]


@query("x8_streamed_admission")
def _(t):
    out, checkpoint = _folders(t)
    # A copy arrives five minutes after its original, under the same number.
    uploads = Streams(t).uploads
    _finished(jobs.admission(uploads, out, checkpoint, AS_OF, interval=None))
    verdicts = t.spark.read.parquet(out)
    known = t.uploads.select("device_id", "seq", "arrived_at", "copy")
    return verdicts.join(known, ["device_id", "seq", "arrived_at"]).select("device_id", "seq", "copy", "status")


@query("x11_streamed_registry")
def _(t):
    out, checkpoint = _folders(t)
    messages = Streams(t).device_messages.filter(F.col("ts") <= F.lit(AS_OF).cast("timestamp"))
    _finished(jobs.presence(messages, out, checkpoint, interval=None))
    rows = changes.latest(t.spark.read.parquet(out), ["device_id"], ["batch", "last_seen_at"])
    silent = F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("last_seen_at")
    return rows.withColumn("stale", F.col("online") & (silent > 60_000_000)).drop("ip", "ssid", "batch")


@query("l4_streamed_alerts")
def _(t):
    out, checkpoint = _folders(t)
    started = jobs.alert(
        Streams(t).events_enriched, alert_queries._listed(t.alert_rules), t.channels, out, checkpoint, AS_OF, interval=None
    )
    _finished(started)
    return t.spark.read.parquet(f"{out}/alerts").select("rule_id", "device_id", "triggered_at")


_ENDS = "CASE WHEN (epoch_us(f.triggered_at) // 1000000) % 3 = 0 THEN f.triggered_at + INTERVAL 60 SECONDS END"


@query("l4_streamed_resolved", f"""
WITH RECURSIVE {alert_queries._CAND}, fired AS (
  SELECT rule_id, device_id, cooldown_s, min(triggered_at) AS triggered_at FROM cand GROUP BY ALL
  UNION ALL
  SELECT c.rule_id, c.device_id, c.cooldown_s, min(c.triggered_at) FROM fired f JOIN cand c
    ON c.rule_id = f.rule_id AND c.device_id = f.device_id AND c.triggered_at > f.triggered_at
    AND (c.triggered_at > f.triggered_at + to_seconds(CAST(f.cooldown_s AS DOUBLE)) OR c.triggered_at >= {_ENDS})
  GROUP BY c.rule_id, c.device_id, c.cooldown_s, f.triggered_at)
SELECT DISTINCT rule_id, device_id, triggered_at FROM fired""", alert_queries._ALL)
def _(t):
    # Every alert of a third of all instants is resolved after a minute.
    from shutterlake.operators import rules

    out, checkpoint = _folders(t)
    listed = alert_queries._listed(t.alert_rules)
    stream = Streams(t).events_enriched
    resolutions = rules.candidates(stream, listed).filter(F.unix_seconds("triggered_at") % 3 == 0).select(
        "rule_id", "device_id", "triggered_at", (F.col("triggered_at") + F.expr("INTERVAL 60 SECONDS")).alias("resolved_at"))
    _finished(jobs.alert(stream, listed, t.channels, out, checkpoint, AS_OF, resolutions=resolutions, interval=None))
    return t.spark.read.parquet(f"{out}/alerts").select("rule_id", "device_id", "triggered_at")


@query("s2_streamed_enriched_topic", """
SELECT 'event' AS kind, device_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp,
  CAST(CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS INT) AS detection_count FROM enriched_messages WHERE seq % 23 <> 0 AND seq % 17 <> 0
UNION ALL SELECT 'alert', device_id, CAST(date_trunc('second', min(ts)) AS TIMESTAMP), NULL
  FROM enriched_messages WHERE seq % 23 <> 0 AND seq % 17 <> 0 AND seq % 3 <> 0 GROUP BY device_id""", "enriched_messages")
def _(t):
    # One rule with a cooldown longer than all events: each device alerts at its first detection.
    out, checkpoint = _folders(t)
    rule = t.spark.createDataFrame(
        [("r", "any", "detection_count", ">", 0.0, None, "info", 10**9, True, None)],
        "rule_id string, name string, cond_type string, op string, threshold double, species array<string>, "
        "severity string, cooldown_s long, enabled boolean, device_id string")
    for started in jobs.enriched_topic(Streams(t).enriched_messages.select("value"), rule, t.channels, out, checkpoint, AS_OF, interval=None):
        _finished(started)
    events = t.spark.read.parquet(f"{out}/events_enriched").select(F.lit("event").alias("kind"), "device_id", "timestamp", "detection_count")
    made = t.spark.read.parquet(f"{out}/alerts").select(
        F.lit("alert").alias("kind"), "device_id", F.col("triggered_at").alias("timestamp"), F.lit(None).cast("int").alias("detection_count"))
    return events.unionByName(made)


@query("l10_streamed_offline", f"""
WITH RECURSIVE {device_queries._FEED}, {device_queries._SILENT_CAND.replace("coalesce(next_ts, TIMESTAMP '2024-02-01')", "next_ts")},
fired AS (SELECT rule_id, device_id, min(triggered_at) AS triggered_at FROM cand GROUP BY ALL
  UNION ALL SELECT c.rule_id, c.device_id, min(c.triggered_at) FROM fired f JOIN cand c USING (rule_id, device_id)
  WHERE c.triggered_at > f.triggered_at + INTERVAL 2 DAYS GROUP BY c.rule_id, c.device_id, f.triggered_at)
SELECT DISTINCT rule_id, device_id, triggered_at FROM fired""", device_queries._USES)
def _(t):
    out, checkpoint = _folders(t)
    rules_ = device_queries._offline_rules(t)
    _finished(jobs.offline(Streams(t).device_messages, rules_, out, checkpoint, interval=None))
    return t.spark.read.parquet(out).select("rule_id", "device_id", "triggered_at")


@query("l10_streamed_silences", f"""
WITH RECURSIVE {device_queries._FEED}, w AS (SELECT max(ts) - INTERVAL 1 HOUR AS edge FROM m),
{device_queries._SILENT_CAND.replace("FROM m)", "FROM m WHERE ts <= (SELECT edge FROM w))").replace("TIMESTAMP '2024-02-01'", "(SELECT edge FROM w)")},
fired AS (SELECT rule_id, device_id, min(triggered_at) AS triggered_at FROM cand GROUP BY ALL
  UNION ALL SELECT c.rule_id, c.device_id, min(c.triggered_at) FROM fired f JOIN cand c USING (rule_id, device_id)
  WHERE c.triggered_at > f.triggered_at + INTERVAL 2 DAYS GROUP BY c.rule_id, c.device_id, f.triggered_at)
SELECT DISTINCT rule_id, device_id, triggered_at FROM fired""", device_queries._USES)
def _(t):
    # A replay: the silences that last when it ends are those of an hour before its last message.
    out, checkpoint = _folders(t)
    started = jobs.offline(
        Streams(t).device_messages, device_queries._offline_rules(t), out, checkpoint, interval=None, timers=True, delay="1 hour")
    _finished(started)
    return t.spark.read.parquet(out).select("rule_id", "device_id", "triggered_at")


@query("x12_streamed_stale", f"""
WITH {device_queries._FEED}, {device_queries._STATE}
SELECT device_id, online AND last_seen_at + INTERVAL 60 SECONDS < (SELECT max(ts) FROM m WHERE ts <= :as_of) - INTERVAL 60 SECONDS AS stale, last_seen_at
FROM state""", device_queries._USES)
def _(t):
    out, checkpoint = _folders(t)
    messages = Streams(t).device_messages.filter(F.col("ts") <= F.lit(AS_OF).cast("timestamp"))
    _finished(jobs.presence(messages, out, checkpoint, interval=None, timers=True))
    return changes.latest(t.spark.read.parquet(out), ["device_id"], ["batch", "last_seen_at"]).select("device_id", "stale", "last_seen_at")


@query("l7_streamed_rule_change", """
WITH c AS (
  SELECT 'r' AS rule_id, device_id, timestamp AS triggered_at FROM events_enriched WHERE detection_count > 0 AND timestamp < TIMESTAMP '2024-01-15'
  UNION ALL SELECT 'q', device_id, timestamp FROM events_enriched WHERE timestamp >= TIMESTAMP '2024-01-10' AND detection_count >= 2
  UNION ALL SELECT 'q', device_id, timestamp FROM events_enriched WHERE timestamp >= TIMESTAMP '2024-01-20' AND detection_count >= 1)
SELECT rule_id, device_id, min(triggered_at) AS triggered_at FROM c GROUP BY ALL""", "events_enriched")
def _(t):
    # One rule is deleted, another made and changed; each fires once for a device.
    out, checkpoint = _folders(t)
    log = t.spark.createDataFrame([
        ("r", "2024-01-01", 0, "create", "any", "detection_count", ">", 0.0, 10**9), ("r", "2024-01-15", 1, "delete", None, None, None, None, None),
        ("q", "2024-01-10", 0, "create", "many", "detection_count", ">=", 2.0, 10**9), ("q", "2024-01-20", 1, "update", None, None, None, 1.0, None),
    ], "rule_id string, changed string, seq int, action string, name string, cond_type string, op string, threshold double, cooldown_s long")
    changed = log.withColumn("changed_at", F.col("changed").cast("timestamp")).withColumns({
        "severity": F.lit("info"), "enabled": F.lit(None).cast("boolean"), "species": F.lit(None).cast("array<string>"), "device_id": F.lit(None).cast("string")})
    _finished(jobs.alert_as_of(Streams(t).events_enriched, lambda: changed, t.channels, out, checkpoint, AS_OF, interval=None))
    return t.spark.read.parquet(f"{out}/alerts").select("rule_id", "device_id", "triggered_at")


@query("a24_job_counters", """
SELECT 'ingest' AS job, count(*) AS consumed, count(*) FILTER (NOT (bad = 'json' OR seq % 17 = 0 OR seq % 19 = 0)) AS processed,
  count(*) FILTER (bad = 'json' OR seq % 17 = 0 OR seq % 19 = 0) AS errors, 0 AS detections, 2 AS batches FROM raw_messages""", "raw_messages")
def _(t):
    # The job stops after one half of the messages; what starts again from its checkpoint goes on counting.
    out, checkpoint = _folders(t)
    folder = f"{work_folder(t.spark, 'topic')}/in"
    for half in range(2):
        _in_files(t.raw_messages.filter(F.pmod("seq", F.lit(2)) == half), folder)
        messages = streams.source(t.spark, "parquet", path=folder, schema="value string", files_per_trigger=None)
        _finished(jobs.ingest(messages, out, checkpoint, AS_OF, interval=None))
    return metrics.totals(batches.read(t.spark, "job_counters", f"{out}/job_counters", marks=out)).drop("healthy")


# Messages to a file; one task writes a file.
FILE_ROWS = 250_000


def _in_files(messages: DataFrame, folder: str, parts: int = 1) -> int:
    """The messages' values as files of a topic folder, in so many equal parts; the number of files to a part."""
    files = 1 + messages.count() // (parts * FILE_ROWS)
    messages.select("value").repartition(parts * files).write.mode("append").parquet(folder)
    return files


@query("x6_bounded_batches", "SELECT 3 AS batches, count(*) AS consumed FROM raw_messages", "raw_messages")
def _(t):
    # Five parts, two to a batch.
    out, checkpoint = _folders(t)
    folder = f"{work_folder(t.spark, 'topic')}/in"
    files = _in_files(t.raw_messages, folder, 5)
    messages = streams.source(t.spark, "parquet", path=folder, schema="value string", files_per_trigger=2 * files)
    _finished(jobs.ingest(messages, out, checkpoint, AS_OF, interval=None))
    return metrics.totals(batches.read(t.spark, "job_counters", f"{out}/job_counters", marks=out)).select("batches", "consumed")


_KEPT = """
SELECT device_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp, shot_id FROM raw_messages
WHERE seq % 23 <> 0 AND seq % 17 <> 0 AND seq % 19 <> 0 AND seq % 13 <> 0"""


@query("x7_retried_writes", _KEPT, "raw_messages")
def _(t):
    # Every write fails twice after it has written, so what it wrote must be replaced.
    from shutterlake.operators import decode

    out, _ = _folders(t)
    rows = tables.insert_rows(decode.normalise_raw(decode.parse_raw(t.raw_messages.select("value")), AS_OF), "events_raw", AS_OF)
    for batch in range(2):
        part, attempts = rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == batch), []

        def write(part=part, batch=batch, attempts=attempts):
            jobs.write_batch(part, "events_raw", f"{out}/events_raw", batch)
            attempts.append(batch)
            if len(attempts) < 3:
                raise OSError("the store went away")

        jobs.with_retries(write)
        batches.finish(t.spark, out, batch)
    return batches.read(t.spark, "events_raw", f"{out}/events_raw", marks=out).select("device_id", "timestamp", "shot_id")


@query("x14_drained_job", _KEPT, "raw_messages")
def _(t):
    # A job that runs on is told to finish what has come and to stop; started again it finds nothing new.
    out, checkpoint = _folders(t)
    folder = f"{work_folder(t.spark, 'topic')}/in"
    files = _in_files(t.raw_messages, folder, 3)
    for _ in range(2):
        messages = streams.source(t.spark, "parquet", path=folder, schema="value string", files_per_trigger=files)
        jobs.drain(jobs.ingest(messages, out, checkpoint, AS_OF, interval="1 second"))
    return batches.read(t.spark, "events_raw", f"{out}/events_raw", marks=out).select("device_id", "timestamp", "shot_id")


@query("x10_late_rows", """
SELECT device_id, CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS aggregation_window, count(*) AS image_count,
  CAST(sum(image_size) AS BIGINT) AS total_size_bytes, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM events_raw GROUP BY ALL""", "events_raw")
def _(t):
    # Hours come in three batches, each as old as the others: two of three are behind any watermark, and count.
    out, _ = _folders(t)
    rows = tables.insert_rows(t.events_raw, "events_raw", AS_OF)
    hour = F.expr("unix_seconds(timestamp) div 3600")
    for batch in range(3):
        jobs.write_batch(rollups.partials(rows.filter(F.pmod(hour, F.lit(3)) == 2 - batch), "hourly"), "partials_hourly", f"{out}/partials_hourly", batch)
        batches.finish(t.spark, out, batch)
    seen = rollups.combine(batches.read(t.spark, "partials_hourly", f"{out}/partials_hourly", marks=out))
    return seen.select("device_id", "aggregation_window", "image_count", "total_size_bytes", "first_seen", "last_seen")


@query("s8_stored_days", """
SELECT device_id, shot_id, timestamp, image_url FROM events_raw WHERE CAST(received_at AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'""", "events_raw")
def _(t):
    base = work_folder(t.spark, "stored")
    tables.write_table(tables.insert_rows(t.events_raw, "events_raw", AS_OF), "events_raw", base)
    return tables.read_table(t.spark, "events_raw", base, "2024-01-08", "2024-01-12").select("device_id", "shot_id", "timestamp", "image_url")


@query("r4_lookup_by_shot", """
SELECT device_id, shot_id, timestamp FROM events_raw WHERE shot_id IN (SELECT min(shot_id) FROM events_raw WHERE shot_id <> '' GROUP BY device_id)""", "events_raw")
def _(t):
    base = work_folder(t.spark, "stored")
    tables.write_table(tables.insert_rows(t.events_raw, "events_raw", AS_OF), "events_raw", base)
    wanted = t.events_raw.filter("shot_id <> ''").groupBy("device_id").agg(F.min("shot_id").alias("shot_id")).select("shot_id").distinct()
    return tables.read_table(t.spark, "events_raw", base).join(wanted, "shot_id", "left_semi").select("device_id", "shot_id", "timestamp")


@query("x15_streamed_enrichment")
def _(t):
    out, checkpoint = _folders(t)
    _finished(jobs.enrich(Streams(t).events_raw, out, checkpoint, AS_OF, load=stub_detector, interval=None))
    return t.spark.read.parquet(f"{out}/events_enriched").select(
        "device_id", "timestamp", "shot_id", "detection_count", "processed_at", "inference_model", "annotated_image_url"
    )


@query("x8_streamed_cheap_dedup", """
SELECT device_id, seq, copy, shot_id FROM uploads WHERE shot_id = ''
UNION ALL SELECT device_id, seq, 0, shot_id FROM uploads WHERE shot_id <> '' GROUP BY ALL""", "uploads")
def _(t):
    from shutterlake.streaming.state import drop_repeated_shots

    out, checkpoint = _folders(t)
    kept = drop_repeated_shots(Streams(t).uploads)
    writer = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    _finished(writer.trigger(availableNow=True).start())
    rows = t.spark.read.parquet(out)
    # Which of two copies stays is open when both come in one batch.
    copy = F.when(F.col("shot_id") == "", F.col("copy")).otherwise(F.lit(0))
    return rows.select("device_id", "seq", copy.alias("copy"), "shot_id")


_same_check("x8_streamed_admission", "x8_upload_admission")
_same_check("x11_streamed_registry", "x11_device_registry")
_same_check("l4_streamed_alerts", "l4_alert_cooldown")
_same_check("x15_streamed_enrichment", "x15_enriched_events")
