"""Stored layout, file sources, streaming jobs: replay, counters, batch = stream."""

import datetime as dt
import glob
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shutterlake.operators import grains, maintain, rollups
from shutterlake.plans.catalogue import QUERIES
from shutterlake.sources import batches, images, streams, tables
from shutterlake.streaming import jobs, metrics, state
from tests.conftest import DATA

NOW = "2024-02-01 00:00:00"


def test_table_layout_and_pruned_read(spark, inputs, tmp_path):
    path = str(tmp_path / "raw")
    rows = tables.insert_rows(inputs.events_raw, "events_raw", NOW)
    tables.write_table(rows, "events_raw", path)
    assert glob.glob(f"{path}/month=202401/*.parquet")
    back = tables.read_table(spark, "events_raw", path, start="2024-01-10", end="2024-01-12")
    expected = rows.filter("processing_date between date'2024-01-10' and date'2024-01-12'")
    assert back.count() == expected.count() > 0
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(processing_date)" in plan
    assert rows.select("event_id").distinct().count() == rows.count()


def test_rebuild_replaces_only_its_months(spark, inputs, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "agg")
    tables.write_table(tables.insert_rows(inputs.events_raw, "events_raw", NOW), "events_raw", raw)
    other = rollups.events_agg(inputs.events_raw, "daily").limit(5).withColumn("processing_date", F.lit("2023-05-01").cast("date"))
    wrong = rollups.events_agg(inputs.events_raw, "daily").withColumn("image_count", F.lit(-1).cast("long"))
    tables.write_table(other.unionByName(wrong), "events_agg", out)
    maintain.rebuild_table(spark, raw, out, "daily", "2024-01-03", "2024-01-20")
    back = tables.read_table(spark, "events_agg", out)
    assert back.filter("image_count = -1").count() == 0
    assert back.filter("processing_date = date'2023-05-01'").count() == 5
    assert back.count() == 5 + rollups.events_agg(inputs.events_raw, "daily").count()


def test_rebuild_of_one_grain_keeps_the_other(spark, inputs, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "agg")
    tables.write_table(tables.insert_rows(inputs.events_raw, "events_raw", NOW), "events_raw", raw)
    tables.write_table(rollups.events_agg_all(inputs.events_raw), "events_agg", out)
    before = tables.read_table(spark, "events_agg", out).groupBy("window_type").count().orderBy("window_type").collect()
    maintain.rebuild_table(spark, raw, out, "daily", "2024-01-01", "2024-01-31")
    back = tables.read_table(spark, "events_agg", out)
    assert back.groupBy("window_type").count().orderBy("window_type").collect() == before and len(before) == 2
    assert back.columns == [f.name for f in tables.TABLES["events_agg"].columns]


def test_compaction_folds_closed_batches(spark, inputs, tmp_path):
    streamed, stored = str(tmp_path / "streamed"), str(tmp_path / "stored")
    rows = tables.insert_rows(inputs.events_raw, "events_raw", NOW)
    for batch in range(4):
        part = rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == batch)
        jobs.write_batch(part, "events_raw", streamed, batch)
    assert tables.read_table(spark, "events_raw", streamed).columns == rows.columns
    assert maintain.compact(spark, "events_raw", streamed, stored, 2) == 2
    # A run that died before it deleted its batches is run again.
    jobs.write_batch(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == 1), "events_raw", streamed, 1)
    assert maintain.compact(spark, "events_raw", streamed, stored, 3) == 2
    assert not os.path.exists(f"{streamed}/batch=2") and os.path.exists(f"{streamed}/batch=3")
    back = tables.read_table(spark, "events_raw", stored)
    expected = rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) < 3)
    assert back.count() == expected.count() and back.exceptAll(expected).isEmpty()
    assert maintain.compact(spark, "events_raw", streamed, stored, 0) == 0


def test_compaction_keeps_equal_rows(spark, inputs, tmp_path):
    streamed, stored = str(tmp_path / "streamed"), str(tmp_path / "stored")
    row = tables.insert_rows(inputs.events_raw, "events_raw", NOW).limit(1)
    for batch in range(2):
        jobs.write_batch(row.crossJoin(spark.range(5)), "events_raw", streamed, batch)
    assert maintain.compact(spark, "events_raw", streamed, stored, 2) == 2
    assert tables.read_table(spark, "events_raw", stored).count() == 10
    jobs.write_batch(row.crossJoin(spark.range(3)), "events_raw", streamed, 2)
    assert maintain.compact(spark, "events_raw", streamed, stored, 9) == 1
    assert tables.read_table(spark, "events_raw", stored).count() == 13


@pytest.mark.parametrize("died", ["staging", "replacing", "noting", "deleting"])
def test_a_fold_that_died_is_finished(spark, inputs, tmp_path, monkeypatch, died):
    streamed, stored = str(tmp_path / "streamed"), str(tmp_path / "stored")
    rows = tables.insert_rows(inputs.events_raw, "events_raw", NOW)
    part = lambda k: rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k)
    jobs.write_batch(part(0), "events_raw", streamed, 0)
    assert maintain.compact(spark, "events_raw", streamed, stored, 9) == 1
    jobs.write_batch(part(1), "events_raw", streamed, 1)

    class Died(Exception):
        pass

    def dying(call, when):
        def run(*args, **given):
            if when(args):
                raise Died
            return call(*args, **given)
        return run

    with monkeypatch.context() as patch:
        if died == "staging":
            patch.setattr(maintain.batches, "touch", dying(maintain.batches.touch, lambda a: maintain.READY in a[1]))
        elif died == "replacing":
            patch.setattr(tables, "write_table", dying(tables.write_table, lambda a: a[2] == stored))
        elif died == "noting":
            patch.setattr(maintain.batches, "touch", dying(maintain.batches.touch, lambda a: maintain.batches.FOLDED in a[1]))
        else:
            patch.setattr(maintain.batches, "delete", dying(maintain.batches.delete, lambda a: "batch=" in a[1]))
        with pytest.raises(Died):
            maintain.compact(spark, "events_raw", streamed, stored, 9)
    seen = batches.read(spark, "events_raw", streamed, stored=stored)
    both = rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) < 2)
    assert seen.count() == both.count() and seen.exceptAll(both).isEmpty()
    jobs.write_batch(part(2), "events_raw", streamed, 2)
    maintain.compact(spark, "events_raw", streamed, stored, 9)
    back = tables.read_table(spark, "events_raw", stored)
    assert back.count() == rows.count() and back.exceptAll(rows).isEmpty()
    assert not os.path.exists(f"{streamed}/batch=2") and not os.path.exists(f"{stored}.staged")


def test_only_finished_batches_are_seen_and_folded(spark, inputs, tmp_path):
    out = str(tmp_path)
    rows = tables.insert_rows(inputs.events_raw, "events_raw", NOW)
    for batch in (0, 1, 2, 4):
        jobs.write_batch(rows.limit(batch + 1), "events_raw", f"{out}/events_raw", batch)
        if batch != 2:
            batches.finish(spark, out, batch)
    assert batches.unfinished_from(spark, out) == 2 == batches.sum_up_marks(spark, out)
    read = lambda: batches.read(spark, "events_raw", f"{out}/events_raw", out, f"{out}/stored").count()
    assert read() == 3 and sorted(batches.names(spark, f"{out}/_finished")) == ["4", "below-2"]
    assert maintain.compact(spark, "events_raw", f"{out}/events_raw", f"{out}/stored", 9, marks=out) == 2 and read() == 3
    batches.finish(spark, out, 2)
    assert read() == 6
    batches.finish(spark, out, 3)  # a batch without rows
    assert maintain.compact(spark, "events_raw", f"{out}/events_raw", f"{out}/stored", 9, marks=out) == 2 and read() == 11


@pytest.mark.parametrize("table", ["rejects", "partials_hourly", "partials_daily", "notification_logs", "alerts", "devices"])
def test_every_streamed_table_is_compacted(spark, tmp_path, table):
    streamed, stored = str(tmp_path / "streamed"), str(tmp_path / "stored")
    schema = tables.TABLES[table].columns
    when = {"date": dt.date(2024, 1, 3), "timestamp": dt.datetime(2024, 1, 3), "string": "x", "binary": b"x", "boolean": True, "bigint": 1, "double": 1.0}
    row = tuple(when[f.dataType.simpleString()] for f in schema)
    for batch in range(2):
        jobs.write_batch(spark.createDataFrame([row, row], schema), table, streamed, batch)
    assert maintain.compact(spark, table, streamed, stored, 2) == 2
    back = tables.read_table(spark, table, stored)
    assert back.count() == 4 and back.columns == schema.names


def test_expired_folders_are_dropped(spark, inputs, tmp_path):
    path = str(tmp_path / "agg")
    rows = rollups.events_agg_all(inputs.events_raw)
    old = rows.withColumn("processing_date", F.lit("2023-05-01").cast("date"))
    tables.write_table(rows.unionByName(old), "events_agg", path)
    assert maintain.drop_expired(spark, "events_agg", path, "2024-02-01") == ["202305"]
    assert tables.read_table(spark, "events_agg", path).count() == rows.count()
    assert maintain.drop_expired(spark, "devices", path, "2024-02-01") == []


@pytest.mark.parametrize("start, end", [
    (None, "2024-01-30 18:00:00"), (None, "2024-01-29 23:59:59.999999"), ("2024-01-03 07:31:12", "2024-01-24 22:10:59"), ("2024-01-03 07:31:12", None),
    ("2024-01-05 10:10:00", "2024-01-05 10:20:00"), ("2024-01-05 10:10:00", "2024-01-05 11:20:00"), ("2024-01-05", "2024-01-05 23:59:59.999999"), ("2024-01-05", "2024-01-05"), (None, None),
    ("2024-01-05 22:59:00", "2024-01-07 01:00:00"), ("2024-01-06", "2024-01-05"),
])
def test_a_range_is_made_up_of_whole_grains_and_edges(start, end):
    found = grains.ranges(start and grains.instant(start), end and grains.instant(end))
    first, last = grains.instant(start or "2023-12-30"), grains.instant(end or "2024-02-02")
    at, step = grains.instant("2023-12-30"), dt.timedelta(minutes=10)
    while at < grains.instant("2024-02-02"):
        for moment in (at, at - dt.timedelta(microseconds=1)):
            hits = [s for s, a, b in found if (a is None or a <= moment) and (b is None or moment < b)]
            assert len(hits) == (first <= moment <= last or (start is None and moment < first) or (end is None and moment > last)), (moment, found)
        at += step
    for source, a, b in found:
        whole = {"raw": dt.timedelta(microseconds=1), "hourly": grains.HOUR, "daily": grains.DAY}[source]
        assert all(x is None or grains.floor(x, whole) == x for x in (a, b))
        assert source != "raw" or b - a <= grains.HOUR + dt.timedelta(minutes=20)


def test_statistics_read_raw_rows_of_the_edges_only(spark, inputs, tmp_path):
    rows = tables.insert_rows(inputs.events_raw, "events_raw", NOW)
    grains.store(rows, "events_raw", str(tmp_path))
    stored = grains.Stored(spark, str(tmp_path))
    plan = grains.fleet_totals(stored, "2024-01-20 13:45:00")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    raw = [line for line in scans if "received_at:timestamp" in line]
    assert len(scans) == 3 and len(raw) == 1 and "image_url" not in raw[0]
    assert "PartitionFilters: [isnotnull(month" in raw[0] and "PushedFilters: []" not in raw[0]
    whole = grains.device_series(stored, "2024-01-20")._jdf.queryExecution().executedPlan().toString()
    assert "events_raw" not in whole


def test_retention_is_applied_to_the_day(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    schema = tables.TABLES["activity_logs"].columns
    rows = spark.createDataFrame([("d", "e", "{}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k)) for k in range(200)], schema)
    tables.write_table(rows, "activity_logs", path)
    expected = rows.filter("to_date(timestamp) >= date'2024-01-16'")

    def died(*args, **given):
        raise OSError("died")

    with monkeypatch.context() as patch:
        patch.setattr(maintain, "_replace", lambda *a, real=maintain._replace, calls=[]: died() if calls else (calls.append(1), real(*a)))
        with pytest.raises(OSError):
            maintain.expire(spark, "activity_logs", path, "2024-02-15")
    for _ in range(2):
        assert maintain.expire(spark, "activity_logs", path, "2024-02-15") == []
        back = tables.read_table(spark, "activity_logs", path)
        assert back.count() == expected.count() < rows.count() and back.exceptAll(expected).isEmpty()
    assert maintain.expire(spark, "activity_logs", path, "2024-03-04") == ["202401"]
    assert tables.read_table(spark, "activity_logs", path).agg(F.min(F.to_date("timestamp"))).first()[0] == dt.date(2024, 2, 3)
    assert maintain.expire(spark, "devices", path, "2024-03-04") == []


def test_daily_upkeep_of_a_job(spark, inputs, tmp_path):
    out, stored = str(tmp_path / "out"), str(tmp_path / "stored")
    src = str(tmp_path / "src")
    inputs.raw_messages.select("value").repartition(3).write.parquet(src)
    messages = streams.source(spark, "parquet", path=src, schema="value string", files_per_trigger=1)
    jobs.ingest(messages, out, str(tmp_path / "cp"), NOW, interval=None).awaitTermination()
    before = {name: batches.read(spark, name, f"{out}/{name}", marks=out).count() for name in ("events_raw", "partials_daily", "rejects", "job_counters")}
    done = maintain.upkeep(spark, out, stored, "2024-02-02")
    assert {"events_raw", "partials_daily", "contacts_hourly", "rejects", "job_counters"} <= set(done) and all(n == 3 for n, _ in done.values())
    for name, n in before.items():
        assert batches.read(spark, name, f"{out}/{name}", out, f"{stored}/{name}").count() == n == tables.read_table(spark, name, f"{stored}/{name}").count()
    assert maintain.upkeep(spark, out, stored, "2024-02-02")["events_raw"] == (0, [])
    assert maintain.upkeep(spark, out, stored, "2024-09-30")["events_raw"] == (0, ["202402"])


def test_a_deep_page_sorts_its_own_days_only(spark, inputs):
    from shutterlake.operators import changes, gallery

    raw, enriched = inputs.events_raw, inputs.events_enriched
    for descending in (True, False):
        order = gallery._order("timestamp", descending)
        for number in (1, 2, 17, 53, 10**6):
            got = changes.page_by_days(raw, "timestamp", order, number, 13, descending).collect()
            assert got == changes.page(raw, order, number, 13).collect()
    counts = raw.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
    assert changes.page_by_days(raw, "timestamp", order, 9, 13, False, counts).collect() == changes.page(raw, order, 9, 13).collect()
    plan = changes.page_by_days(raw, "timestamp", order, 40, 13, False)._jdf.queryExecution().optimizedPlan().toString()
    assert "2024-01" in plan and "Filter" in plan
    unknown = raw.withColumn("timestamp", F.when(F.col("shot_id") != "", F.col("timestamp")))
    assert len(changes.page_by_days(unknown, "timestamp", order, 1, 13, False).collect()) == 13
    with pytest.raises(ValueError):
        gallery.page(raw, enriched, size=gallery.LARGEST_PAGE + 1)


def test_expired_months(spark):
    months = spark.createDataFrame([(202310,), (202311,), (202401,)], "month int")
    assert [r.month for r in maintain.expired_months(months, 90, "2024-02-15").collect()] == [202310]


def test_disabled_tables_and_failing_writes():
    written = []
    done = tables.fan_out({"a": 1, "b": 2}, lambda df, table: written.append(table), disabled={"b"})
    assert done == {"a": True, "b": False} and written == ["a"]

    def fail(df, table):
        raise OSError("disk")

    with pytest.raises(OSError):
        tables.fan_out({"a": 1}, fail)


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")

    jobs.with_retries(flaky, first_wait_s=0)
    assert len(calls) == 3
    with pytest.raises(OSError):
        jobs.with_retries(lambda: (_ for _ in ()).throw(OSError("no")), first_wait_s=0)


def make_images(root):
    for device, day, name, sidecar in [
        ("cam-1", "2024/01/02", "20240102_030405_cam-1.jpg", True), ("cam-1", "2024/01/02", "5_-77.jpg", True),
        ("cam-2", "2024/01/03", "x.jpeg", False), ("cam-TEST", "2024/01/03", "y.jpg", False),
    ]:
        folder = os.path.join(root, device, day)
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, name), "wb") as f:
            f.write(b"x" * 10)
        if sidecar:
            with open(os.path.join(folder, os.path.splitext(name)[0] + ".json"), "w") as f:
                json.dump({"deviceId": device, "ts": "1704164645", "shotId": None}, f, indent=2)


def test_inventory_and_sidecars(spark, tmp_path):
    make_images(str(tmp_path))
    files = images.scan(spark, str(tmp_path))
    rows = {r.filename: r for r in images.inventory(files).collect()}
    assert set(rows) == {"20240102_030405_cam-1.jpg", "5_-77.jpg", "x.jpeg"}
    assert rows["20240102_030405_cam-1.jpg"].created_at == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert rows["x.jpeg"].url == "/uploads/cam-2/2024/01/03/x.jpeg" and rows["x.jpeg"].size == 10
    assert images.inventory(files, search="X.J").count() == 1
    paired = images.with_sidecars(files, images.read_sidecars(spark, str(tmp_path))).collect()
    assert {r.object_key for r in paired} == {
        "raw/2024/01/02/cam-1/20240102_030405_cam-1.jpg", "raw/2024/01/02/cam-1/5_-77.jpg",
    }
    assert "cam-1-1704164645--77" in {r.shot_id for r in paired}


def test_ingest_replay_and_counters(spark, inputs, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    inputs.raw_messages.select("value").repartition(3).write.text(src)
    counters = metrics.JobCounters("ingest")
    spark.streams.addListener(counters)
    try:
        for run in range(2):
            # A new checkpoint replays the same batches over the same output.
            stream = streams.source(spark, "text", path=src)
            jobs.ingest(stream, out, str(tmp_path / f"cp{run}"), NOW, interval=None).awaitTermination()
        for _ in range(50):
            if counters.totals["consumed"] >= 2200:
                break
            import time
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert spark.read.parquet(f"{out}/events_raw").count() == 866
    assert spark.read.parquet(f"{out}/rejects").count() == 162
    assert counters.totals["consumed"] == 2200 and counters.totals["errors"] == 2 * 162
    assert not counters.healthy()
    assert "ingest_consumed 2200" in metrics.exposition(counters.totals, "ingest")


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    src = tmp_path / "in"
    schema = "device_id string, timestamp timestamp, image_size long, shot_id string"

    def put(name, *hours):
        rows = [("d", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1, "s") for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))

    put("a", 0.5, 9.5)
    stream = streams.source(spark, "parquet", path=f"{src}/*", schema=spark.createDataFrame([], schema).schema, files_per_trigger=1)
    query = rollups.events_agg(stream, "hourly").writeStream.outputMode("update").foreachBatch(
        lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))
    ).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    put("b", 1.5, 9.75)
    query.processAllAvailable()
    dropped = metrics.dropped_late(query)
    jobs.drain(query)
    assert dropped == 1
    latest = spark.read.parquet(str(tmp_path / "out")).groupBy("aggregation_window").agg(F.max("image_count").alias("n"))
    assert {r.aggregation_window.hour: r.n for r in latest.collect()} == {0: 1, 9: 2}
    # The rebuild from stored rows has no such bound.
    whole = spark.read.schema(schema).parquet(f"{src}/a", f"{src}/b")
    assert rollups.rebuild(whole, "hourly", "2024-01-01", "2024-01-01").count() == 3


class FakeState:
    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timeout = value, timed_out, None
        self.exists = value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True

    watermark = 0

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, ms):
        assert ms > self.watermark
        self.timeout = ms


def test_presence_timer_marks_a_silent_device_stale():
    rows = pd.DataFrame({"at": [1_000_000], "seq": [1], "kind": ["online"], "fields": ['{"online":"true"}']})
    st = FakeState()
    assert list(state._timed_presence_group(("d",), iter([rows]), st))[0].online[0]
    assert st.timeout == 61_000
    silent = FakeState(st.value, timed_out=True)
    silent.watermark = 61_001
    out = list(state._timed_presence_group(("d",), iter([]), silent))[0]
    assert out.stale[0] and silent.timeout is None
    # A message whose minute is over when it comes, as one of an old batch.
    late = FakeState()
    late.watermark = 100_000
    assert list(state._timed_presence_group(("d",), iter([rows]), late))[0].stale[0] and late.timeout is None


def silence(*at):
    return pd.DataFrame({"at": [a * 1_000_000 for a in at], "threshold": 10.0, "cooldown_s": 5, "name": "n", "severity": "info"})


def test_offline_timer_fires_once_per_silence():
    group, st = state._silence_group(True), FakeState()
    fired = lambda rows=(): [int(a) // 1_000_000 for f in group(("r", "d"), iter(rows), st) for a in f["at"]]
    assert fired([silence(0)]) == [] and st.timeout == 10_000
    st.watermark, st.hasTimedOut = 10_001, True
    assert fired() == [10]
    st.hasTimedOut = False
    # Out of order within the delay: the message at 33 comes after those at 45 and 60.
    assert fired([silence(45, 30, 60)]) == []
    assert fired([silence(33)]) == [] and st.timeout == 30_000
    st.watermark, st.hasTimedOut = 61_000, True
    assert fired() == [43, 55] and st.timeout == 70_000
    st.watermark = 70_000
    assert fired() == []
    st.watermark = 70_001
    assert fired() == [70] and fired() == []


def test_silences_without_timers_need_the_next_message():
    group, st = state._silence_group(False), FakeState()
    fired = lambda *at: [int(a) // 1_000_000 for f in group(("r", "d"), iter([silence(*at)]), st) for a in f["at"]]
    assert fired(0) == [] and fired(30, 12) == [10, 22] and fired(31) == [] and st.timeout is None


def test_a_replayed_day_gives_the_silences_of_the_day(spark, inputs, tmp_path):
    """Messages in files of hours, taken one by one with timers, against the batch rule as of the last watermark."""
    from shutterlake.operators import devices, rules

    schema = inputs.device_messages.schema
    messages = inputs.device_messages.filter("ts < timestamp'2024-01-12'")
    edges = [dt.datetime(2024, 1, 1) + k * dt.timedelta(days=1) for k in range(12)]
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        part = messages.filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k:02d}"))
    rule = inputs.alert_rules.filter("rule_id = 'r1'").withColumns({
        "cond_type": F.lit("device_offline"), "threshold": F.lit(20_000.0), "cooldown_s": F.lit(60).cast("long"), "species": F.lit(None).cast("array<string>")})
    stream = streams.source(spark, "parquet", path=str(tmp_path / "in/*"), schema=schema, files_per_trigger=1)
    jobs.offline(stream, rule, str(tmp_path / "out"), str(tmp_path / "cp"), interval=None, timers=True, delay="2 hours").awaitTermination()
    found = {(r.device_id, r.triggered_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    as_of = messages.agg(F.max("ts")).first()[0] - dt.timedelta(hours=2)
    from shutterlake.operators import cooldown
    known = rules.silence_candidates(devices.gaps(messages.filter(F.col("ts") <= F.lit(as_of))), rule, as_of)
    expected = {(r.device_id, r.triggered_at) for r in cooldown.apply_cooldown(known).collect()}
    assert found == expected and len(expected) > 10


def test_a_rule_changed_in_mid_stream_acts_from_then_on(spark, inputs, tmp_path):
    event = lambda minute, count: ("d", dt.datetime(2024, 1, 1, 0, minute), "", "", count, "[]")
    schema = "device_id string, timestamp timestamp, shot_id string, image_url string, detection_count int, detections string"
    log = [("r", dt.datetime(2024, 1, 1), 0, "create", "n", True, "detection_count", ">", 5.0, None, None, "info", 60)]
    fields = ("rule_id string, changed_at timestamp, seq int, action string, name string, enabled boolean, cond_type string, op string, "
              "threshold double, species array<string>, device_id string, severity string, cooldown_s long")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    arrive(event(0, 3), event(1, 6))
    stream = streams.source(spark, "parquet", path=src, schema=schema)
    query = jobs.alert_as_of(stream, lambda: spark.createDataFrame(log, fields), inputs.channels, out, str(tmp_path / "cp"), NOW, interval="1 second")
    try:
        query.processAllAvailable()
        # The running job is not restarted; an event from before the change comes late and meets the old version.
        log.append(("r", dt.datetime(2024, 1, 1, 0, 10), 1, "update", None, None, None, None, 2.0, None, None, "critical", None))
        arrive(event(9, 3), event(10, 3), event(12, 1))
        query.processAllAvailable()
        log.append(("r", dt.datetime(2024, 1, 1, 0, 20), 2, "delete", *[None] * 9))
        arrive(event(10, 4), event(19, 3), event(20, 9))
        query.processAllAvailable()
    finally:
        query.stop()
    made = batches.read(spark, "alerts", f"{out}/alerts", marks=out).select("triggered_at", "severity").collect()
    assert sorted((r.triggered_at.minute, r.severity) for r in made) == [(1, "info"), (10, "critical"), (19, "critical")]


def test_batches_of_files_are_bounded_by_number_and_bytes(spark, tmp_path):
    for k in range(6):
        spark.range(1000).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    size = sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / "in/*.json"))) // 6

    def sizes(name, **bound):
        found = []
        rows = streams.source(spark, "json", path=str(tmp_path / "in"), schema="id long", **bound)
        jobs.start(rows, lambda b, _: found.append(b.count()), str(tmp_path / name), interval=None).awaitTermination()
        return [n for n in found if n]

    assert sizes("a", files_per_trigger=4) == [4000, 2000]
    by_bytes = sizes("b", bytes_per_trigger=str(2 * size + 10))
    assert sum(by_bytes) == 6000 and len(by_bytes) == 3
    assert streams.size_or_time(500, "2s") == {"minOffsetsPerTrigger": "500", "maxTriggerDelay": "2s"} and streams.size_or_time(None, None) == {}


def test_datasets_are_written_and_read(spark, inputs, tmp_path):
    from shutterlake.operators import labeling
    from shutterlake.sources import datasets

    projects = inputs.labeling_projects.withColumn("class_names", F.split("class_names", ","))
    pictures, marks = inputs.project_images, inputs.annotations
    datasets.write_coco(pictures, marks, projects, str(tmp_path / "coco"), NOW)
    assert [json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "coco/project_id=p0/relation=licenses")).collect()] == [1]
    lines = spark.read.text(str(tmp_path / "coco/project_id=p0/relation=images"))
    ids = sorted(json.loads(r.value)["id"] for r in lines.collect())
    assert ids == list(range(1, pictures.filter("project_id = 'p0'").count() + 1))
    datasets.write_yolo(pictures, marks, projects, str(tmp_path / "yolo"))
    assert spark.read.parquet(str(tmp_path / "yolo")).count() == pictures.count()
    datasets.write_split(pictures, marks, str(tmp_path / "split"))
    assert {os.path.basename(p) for p in glob.glob(str(tmp_path / "split/images/split=*"))} == {"split=train", "split=val", "split=test"}
    datasets.write_tasks(pictures, str(tmp_path / "tasks"))
    assert spark.read.text(str(tmp_path / "tasks")).count() == pictures.count()

    export = [{"result": [{"value": {"x": 1, "y": 2, "width": 3, "height": 4, "rectanglelabels": ["fox"]}}, {"value": {"x": 5}}],
               "task": {"id": 7, "data": {"image": "http://x"}}}]
    (tmp_path / "export.json").write_text(json.dumps(export, indent=1))
    rows = labeling.imported_annotations(datasets.read_labelstudio(spark, str(tmp_path / "export.json"), lines=False))
    assert [(r.image_id, r.x2, r.y2, r["class"]) for r in rows.orderBy("pos").collect()] == [("7", 4.0, 6.0, "fox"), ("7", 5.0, 0.0, "object")]


def test_admission_state_spans_batches(spark, inputs, tmp_path):
    """Many small micro-batches in order of arrival give the batch verdicts."""
    from shutterlake.operators import admission

    src, out = tmp_path / "in", str(tmp_path / "out")
    uploads = inputs.uploads
    for i, (low, high) in enumerate([(1, 8), (8, 15), (15, 22), (22, 32)]):
        part = uploads.filter(F.dayofmonth("arrived_at").between(low, high - 1))
        part.coalesce(1).write.parquet(str(src / f"part{i}"))
        stream = streams.source(spark, "parquet", path=f"{src}/*", schema=uploads.schema)
        jobs.admission(stream, out, str(tmp_path / "cp"), NOW, interval=None).awaitTermination()
    streamed = spark.read.parquet(out).groupBy("device_id", "status").count()
    batch = admission.admit(uploads, NOW).groupBy("device_id", "status").count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_unknown_source_kind(spark):
    with pytest.raises(ValueError):
        streams.source(spark, "carrier-pigeon")


def test_topic_rows(spark, inputs):
    row = streams.topic_rows(inputs.events_raw.limit(1), key="device_id", now=NOW).first()
    assert json.loads(row.value)["device_id"] == row.key
    assert [h.key for h in row.headers] == ["source", "timestamp"]
    assert streams.topic_rows(inputs.events_raw, now=NOW).columns == ["value", "headers"]


def test_a_fold_moves_what_it_has_staged(spark, tmp_path, monkeypatch):
    streamed, stored = str(tmp_path / "streamed"), str(tmp_path / "stored")
    schema = tables.TABLES["activity_logs"].columns
    rows = spark.createDataFrame([("d", "e", "{}", dt.datetime(2024, 1 + k % 3, 5)) for k in range(30)], schema)
    jobs.write_batch(rows, "activity_logs", streamed, 0)
    laid, moved = [], []
    monkeypatch.setattr(tables, "laid_out", lambda *a, real=tables.laid_out: (laid.append(1), real(*a))[1])

    def dying(*args, real=batches.move):
        if moved:
            raise OSError("died")
        moved.append(args)
        real(*args)

    with monkeypatch.context() as patch:
        patch.setattr(batches, "move", dying)
        with pytest.raises(OSError):
            maintain.compact(spark, "activity_logs", streamed, stored, 9)
    assert batches.read(spark, "activity_logs", streamed, stored=stored).count() == 30
    maintain.compact(spark, "activity_logs", streamed, stored, 9)
    back = tables.read_table(spark, "activity_logs", stored)
    assert len(laid) == 1 and back.count() == 30 and back.exceptAll(rows).isEmpty()
    assert not os.path.exists(f"{stored}.staged") and not os.path.exists(f"{streamed}/batch=0")


@pytest.mark.parametrize("name", ["x6_bounded_batches", "x14_drained_job", "a24_job_counters"])
def test_topic_files_are_bounded(spark, monkeypatch, name):
    from shutterlake.plans import stream_queries

    written, count = [], {"x6_bounded_batches": 5 * 5, "x14_drained_job": 3 * 8, "a24_job_counters": 2 * 12}[name]

    def in_files(messages, folder, *parts, real=stream_queries._in_files):
        written.append(folder)
        return real(messages, folder, *parts)

    monkeypatch.setattr(stream_queries, "FILE_ROWS", 50)
    monkeypatch.setattr(stream_queries, "_in_files", in_files)
    found = QUERIES[name](spark, DATA)
    rows = [r["count"] for r in spark.read.parquet(written[0]).groupBy(F.input_file_name()).count().collect()]
    assert len(rows) == count and max(rows) <= 60 and sum(rows) == 1100
    if name != "x14_drained_job":
        row = found.first()
        assert (row["batches"], row["consumed"]) == (3 if name[0] == "x" else 2, 1100)


def test_pairs_that_share_a_shard_keep_their_own_cooldown(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SHARDS", 2)
    start = dt.datetime(2024, 1, 1, 0, 0, 0, 123457)
    kinds = "rule_id string, device_id string, triggered_at timestamp, cooldown_s long, shot_id string, top double, species array<string>, seen timestamp"
    rows = [
        (f"r{k % 3}", None if k % 5 == 4 else f"d{k % 5}", None if k % 29 == 7 else start + dt.timedelta(seconds=k * 7 % 400), 60 + k % 3,
         None if k % 4 == 0 else f"s{k}", float("nan") if k % 6 == 0 else k / 7, None if k % 2 else ['a "', None], start + dt.timedelta(microseconds=k))
        for k in range(300)]
    path = str(tmp_path / "in")
    expected, blocked = [], {}
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(path)
        for row in sorted((r for r in part if r[2]), key=lambda r: (r[2], r[4] is not None, r[4] or "")):
            if row[2] > blocked.get(row[:2], dt.datetime.min):
                expected.append(row)
                blocked[row[:2]] = row[2] + dt.timedelta(seconds=row[3])
        stream = streams.source(spark, "parquet", path=path, schema=kinds)
        fired = state.cooldown_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        fired.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.columns == [part.split()[0] for part in kinds.split(", ")]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
