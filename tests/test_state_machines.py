"""The distributed state machines against a plain loop, on hot and hostile inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import admission, cooldown

T0 = dt.datetime(2024, 1, 1)


def seconds(n):
    return T0 + dt.timedelta(seconds=n)


def greedy(candidates, resolved=None):
    """candidates: (rule, device, second, cooldown) → the firing ones."""
    blocked, fired = {}, set()
    for rule, device, at, wait in sorted(candidates, key=lambda c: c[2]):
        if at > blocked.get((rule, device), -1):
            fired.add((rule, device, at))
            until = at + wait
            if resolved and (rule, device, at) in resolved:
                until = min(until, max(at, resolved[(rule, device, at)] - 1e-6))
            blocked[(rule, device)] = until
    return fired


def candidate_rows(spark, rows):
    return spark.createDataFrame(
        [(r, d, seconds(s), w, f"shot-{i}") for i, (r, d, s, w) in enumerate(rows)],
        "rule_id string, device_id string, triggered_at timestamp, cooldown_s long, shot_id string",
    )


def as_set(df):
    return {
        (r.rule_id, r.device_id, (r.triggered_at - T0).total_seconds()) for r in df.collect()
    }


@pytest.mark.parametrize("chunk_s, chunk_rows", [(60, 0), (600, 0), (21600, 0), (600, 1000), (600, 100_000)])
def test_cooldown_equals_loop_with_one_hot_pair(spark, chunk_s, chunk_rows):
    rng = random.Random(1)
    rows = [("r1", "hot", float(s), 300) for s in range(0, 7200)]
    rows += [(f"r{rng.randint(1, 3)}", f"d{rng.randint(1, 5)}", float(rng.randint(0, 40000)), 0) for _ in range(500)]
    rows = [(r, d, s, {"r1": 300, "r2": 60, "r3": 3600}[r]) for r, d, s, _ in rows]
    fired = cooldown.apply_cooldown(candidate_rows(spark, rows), chunk_s=chunk_s, chunk_rows=chunk_rows)
    assert as_set(fired) == greedy(rows)
    assert fired.count() == len(greedy(rows))


@pytest.mark.parametrize("wait", [60, 3600, 86_400])
def test_long_cooldown_of_a_busy_pair(spark, wait):
    """A million instants of one pair; firings equal a loop over them."""
    step = 0.7
    rows = spark.range(1_000_000).select(
        F.lit("r").alias("rule_id"), F.lit("d").alias("device_id"), (F.lit(T0.timestamp()) + F.floor(F.col("id") * step) + F.col("id") / 1e6).cast("timestamp").alias("triggered_at"),
        F.lit(wait).cast("long").alias("cooldown_s"))
    times = [r[0] for r in rows.select(F.unix_micros("triggered_at")).orderBy("triggered_at").collect()]
    expected, blocked = [], -1
    for at in times:
        if at > blocked:
            expected.append(at)
            blocked = at + wait * 1_000_000
    fired = cooldown.apply_cooldown(rows)
    assert sorted(r[0] for r in fired.select(F.unix_micros("triggered_at")).collect()) == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolutions_of_a_busy_pair_equal_the_loop(spark, seed):
    """Alerts resolved early, many at one instant, with cooldowns longer than a chunk and gaps between chunks."""
    rng = random.Random(seed)
    rows = [("r", rng.choice(["d", "e"]), float(rng.choice([rng.randint(0, 9000), rng.randint(90_000, 95_000), 400_000])), 5000) for _ in range(2500)]
    resolved = {(r, d, s): rng.choice([s + rng.randint(0, 4000), 9000.0 if s < 9000 else s + 1]) for r, d, s, _ in rows if rng.random() < 0.5}
    resolutions = spark.createDataFrame(
        [(r, d, seconds(s), seconds(e)) for (r, d, s), e in resolved.items()],
        "rule_id string, device_id string, triggered_at timestamp, resolved_at timestamp")
    fired = cooldown.apply_cooldown(candidate_rows(spark, rows), resolutions=resolutions, chunk_s=600, chunk_rows=100)
    assert as_set(fired) == greedy(rows, resolved)


def test_cooldown_boundary_is_inclusive_and_one_fires_per_instant(spark):
    rows = [("r", "d", 0.0, 300), ("r", "d", 300.0, 300), ("r", "d", 300.001, 300), ("r", "d", 300.001, 300)]
    fired = cooldown.apply_cooldown(candidate_rows(spark, rows)).collect()
    assert sorted((r.triggered_at - T0).total_seconds() for r in fired) == [0.0, 300.001]


def test_resolved_alert_ends_its_cooldown(spark):
    rows = [("r", "d", float(s), 300) for s in (0, 100, 150, 200, 440, 500)]
    resolutions = spark.createDataFrame(
        [("r", "d", seconds(0), seconds(120))],
        "rule_id string, device_id string, triggered_at timestamp, resolved_at timestamp",
    )
    fired = cooldown.apply_cooldown(candidate_rows(spark, rows), resolutions=resolutions)
    expected = greedy(rows, {("r", "d", 0.0): 120.0})
    assert expected == {("r", "d", 0.0), ("r", "d", 150.0), ("r", "d", 500.0)}
    assert as_set(fired) == expected


def test_stored_alerts_block_and_resolved_ones_do_not(spark):
    rows = [("r", "d", 100.0, 300), ("r", "d", 301.0, 300), ("q", "d", 100.0, 300)]
    history = spark.createDataFrame(
        [("r", "d", seconds(0), "acknowledged"), ("q", "d", seconds(50), "resolved")],
        "rule_id string, device_id string, triggered_at timestamp, status string",
    )
    fired = cooldown.apply_cooldown(candidate_rows(spark, rows), history=history)
    assert as_set(fired) == {("r", "d", 301.0), ("q", "d", 100.0)}


def admit_loop(uploads):
    """uploads: (device, at, seq, shot, ts) seconds → {(device, seq): status}."""
    latest, shots, out = {}, {}, {}
    for device, at, seq, shot, ts in sorted(uploads, key=lambda u: (u[1], u[2])):
        seen = shots.get((device, shot))
        if shot and seen is not None and at - seen <= 600:
            out[device, seq] = "duplicate"
        elif ts <= latest.get(device, -1e18):
            out[device, seq] = "stale"
        else:
            out[device, seq] = "accepted"
            latest[device] = ts
            if shot:
                shots[device, shot] = at
    return out


def upload_rows(spark, uploads):
    base = 1_704_067_200
    return spark.createDataFrame(
        [(d, seconds(at), seq, shot, str(int(base + ts))) for d, at, seq, shot, ts in uploads],
        "device_id string, arrived_at timestamp, seq long, shot_id string, ts_raw string",
    )


def hostile_uploads(seed):
    """A busy device, idle ones, repeats with later times near chunk edges, old times."""
    rng = random.Random(seed)
    rows, seq = [], 0
    for at in range(0, 50_000, 7):
        seq += 1
        rows.append(("busy", at, seq, f"b{seq}", at))
        if rng.random() < 0.3:
            rows.append(("busy", at + rng.randint(1, 900), 1_000_000 + seq, f"b{seq}", at + rng.randint(-50, 2000)))
    for device in ("idle", "odd"):
        for _ in range(60):
            seq += 1
            at = rng.randint(0, 200_000)
            shot = rng.choice(["", "x", f"{device}{seq // 3}"])
            rows.append((device, at, seq, shot, at + rng.choice([0, 0, 3000, -3000])))
    edge = 6 * 3600
    for k in range(1, 8):
        # The last row before an edge is a repeat with the greatest time.
        seq += 10
        rows += [("edge", k * edge - 900, seq, f"e{k}", k * edge), ("edge", k * edge - 400, seq + 1, f"e{k}", k * edge + 5000)]
        rows += [("edge", k * edge + 60, seq + 2, f"f{k}", k * edge + 1000), ("edge", k * edge + 120, seq + 3, "", k * edge + 6000 * k)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_equals_loop(spark, seed):
    uploads = hostile_uploads(seed)
    verdicts = admission.admit(upload_rows(spark, uploads), "2024-02-01 00:00:00")
    found = {(r.device_id, r.seq): r.status for r in verdicts.collect()}
    assert found == admit_loop(uploads)
    assert set(found.values()) == {"accepted", "duplicate", "stale"}


@pytest.mark.parametrize("chunk_s", [1200, 3600])
@pytest.mark.parametrize("seed", [3, 4, 5])
def test_admission_in_short_chunks_equals_loop(spark, monkeypatch, seed, chunk_s):
    """Chunks that start from any maximum: clocks that jump ahead, repeats that are in flight over whole chunks."""
    monkeypatch.setattr(admission, "CHUNK_US", chunk_s * 1_000_000)
    rng, uploads, seq = random.Random(seed), [], 0
    for device, ahead in (("jumps", 40_000), ("steady", 30), ("back", -5000)):
        top = 0
        for _ in range(700):
            seq += 1
            at = rng.randint(0, 30_000)
            top = max(top, at + (ahead if rng.random() < 0.02 else 0))
            uploads.append((device, at, seq, rng.choice(["", f"s{seq // 5}", f"t{rng.randint(0, 30)}"]), rng.choice([at, top + rng.randint(-50, 50), at + rng.randint(-900, 900)])))
    # Every ten minutes the same shot again: no instant of this device is free of repeats.
    uploads += [("flight", 300 * k, 100_000 + k, f"r{k % 2}", 300 * k + rng.randint(-900, 900)) for k in range(100)]
    # The greatest time before each edge is a repeat's, so that it never counts.
    uploads += [("wrong", k * chunk_s - d, 200_000 + 3 * k + i, f"w{k}", k * chunk_s + t) for k in range(1, 15) for i, (d, t) in enumerate([(500, 0), (100, 900), (-30, 300)])]
    verdicts = admission.admit(upload_rows(spark, uploads), "2024-02-01 00:00:00")
    assert {(r.device_id, r.seq): r.status for r in verdicts.collect()} == admit_loop(uploads)


def test_repeat_after_a_stale_rejection_is_not_a_duplicate(spark):
    uploads = [("d", 0, 1, "a", 100), ("d", 10, 2, "b", 50), ("d", 20, 3, "b", 200), ("d", 30, 4, "b", 300)]
    verdicts = admission.admit(upload_rows(spark, uploads), "2024-02-01 00:00:00")
    assert [r.status for r in verdicts.orderBy("seq").collect()] == ["accepted", "stale", "accepted", "duplicate"]


def test_uploads_of_one_instant_stay_single_rows(spark):
    """Equal arrival and sequence, or none: one row each, in the order of the stream."""
    base = 1_704_067_200
    rows = [
        ("d", seconds(0), 1, "a", str(base + 100)), ("d", seconds(0), 1, "b", str(base + 200)), ("d", seconds(0), None, "c", str(base + 50)),
        ("d", seconds(0), None, "", str(base + 60)), ("d", seconds(5), 2, "a", str(base + 300)), ("d", seconds(5), 2, "a", str(base + 300)),
        ("d", seconds(9), None, "z", "1e300"),
    ]
    uploads = spark.createDataFrame(rows, "device_id string, arrived_at timestamp, seq long, shot_id string, ts_raw string")
    batch = [(r.seq, r.shot_id, r.ts, r.status) for r in admission.admit(uploads, "2024-02-01 00:00:00").collect()]
    assert len(batch) == 6

    import pandas as pd

    from shutterlake.functions.times import device_timestamp
    from shutterlake.streaming import state

    timed = uploads.withColumns({"ts": device_timestamp(F.col("ts_raw"), "2024-02-01 00:00:00"), "tie": admission.tie(uploads)}).filter("ts is not null")
    light = timed.select("device_id", "tie", "arrived_at", "seq", "shot_id", "ts", F.unix_micros("arrived_at").alias("at"), F.unix_micros("ts").alias("ts_us"))

    class Empty:
        exists = False

        def update(self, value):
            pass

    out = pd.concat(state._admit_group(("d",), iter([light.toPandas()]), Empty()))
    stream = [(None if pd.isna(q) else int(q), shot, ts.to_pydatetime(), status) for q, shot, ts, status in zip(out.seq, out.shot_id, out.ts, out.status)]
    assert sorted(map(repr, batch)) == sorted(map(repr, stream))


def test_presence_reads_what_devices_send(spark):
    """Decimals, numbers for booleans, infinite and unreadable numbers: batch and stream agree on every column."""
    import json

    from shutterlake.operators import devices
    from shutterlake.streaming import state

    payloads = [
        '{"online":true,"fw":"1.0","ip":"10.0.0.1","ssid":"net","heap":12.5,"auto":1,"intervalSec":"60","uptime":3.9}',
        '{"event":"upload_ok"}', '{"online":true,"heap":"inf","auto":0,"uptime":1e300,"ip":""}', '{"online":true,"heap":"NaN","intervalSec":"soon","fw":null}',
        '{"event":"upload_ok"}', '{"online":0}', '{"online":"yes","ssid":"other","heap":-7.9}',
    ]
    rows = spark.createDataFrame(
        [(i, seconds(10 * i), "site/d/status", p) for i, p in enumerate(payloads)], "seq long, ts timestamp, topic string, payload string")
    batch = devices.registry(rows, "2024-01-01 00:01:30").first().asDict()
    device = None
    parsed = devices.parsed(rows)
    typed = parsed.select("kind", F.unix_micros("ts").alias("at"), F.to_json(F.struct(
        *[c.alias(n) for n, c in devices.presence_fields(F.col("kind"), F.col("fields")).items()])).alias("fields")).orderBy("seq")
    for r in typed.collect():
        device = state.step_device(device, r.kind, json.loads(r.fields), r.at)
    assert batch["heap"] == -7 and batch["auto_mode"] is False and batch["interval_sec"] == 60 and batch["uptime"] == 3 and batch["ssid"] == "other"
    for name in ("online", "firmware", "ip", "ssid", "heap", "auto_mode", "interval_sec", "uptime", "image_count"):
        assert batch[name] == device[name], name
    late = state.step_device(device, "online", {}, device["last_seen_at"] - 5_000_000)
    assert late["last_seen_at"] == device["last_seen_at"]


def test_running_latest_crosses_hours(spark):
    uploads = [("d", 0, 1, "", 500), ("d", 4000, 2, "", 100), ("d", 4001, 3, "", 900), ("d", 9000, 4, "", 1)]
    rows = admission.running_latest(upload_rows(spark, uploads), "2024-02-01").orderBy("seq")
    latest = [r.latest_before and (r.latest_before - T0).total_seconds() for r in rows.collect()]
    assert latest == [None, 500.0, 500.0, 900.0]


def test_candidates_with_payload_survive(spark):
    rows = candidate_rows(spark, [("r", "d", 5.0, 60)]).withColumn("tags", F.array(F.lit("x")))
    assert cooldown.apply_cooldown(rows).first().tags == ["x"]
