"""State machines on streams: admission, alert cooldown, device presence.

Each keeps a small state per key and sees a micro-batch's rows of that key in
order of time. A micro-batch is bounded by the source's rows per trigger.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from shutterlake.operators.admission import LONG_AGO, Admission, tie
from shutterlake.operators.cooldown import NEVER, PAIR, not_suppressed
from shutterlake.operators.devices import DEFAULT_INTERVAL_S, STALE_AFTER_S, parsed, presence_fields
from shutterlake.functions.plans import once
from shutterlake.functions.times import device_timestamp
from shutterlake.operators.rules import pairs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How late a device's message may come.
DELAY = "1 minute"
# Pairs of a rule and a device are kept in so many states; a stream's checkpoint holds for one number only.
SHARDS = 1 << 16
# Times within a JSON payload keep their microseconds.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    # A stable sort by several columns, a missing value first.
    return rows.sort_values(by, kind="stable", na_position="first")


# ---- upload admission ---------------------------------------------------

def _admit_group(key, batches, state):
    latest, shots, times = state.get if state.exists else (LONG_AGO, [], [])
    device = Admission(latest, zip(shots, times))
    rows = _in_order(batches, ["at", "seq", "tie"])
    verdicts = [device.offer(at, shot, ts) for at, shot, ts in zip(rows["at"], rows.shot_id, rows.ts_us)]
    recent = list(device.recent)
    state.update((device.latest, [shot for shot, _ in recent], [at for _, at in recent]))
    yield pd.DataFrame({
        "device_id": key[0], "arrived_at": rows.arrived_at, "seq": rows.seq, "shot_id": rows.shot_id,
        "ts": rows.ts, "status": verdicts,
    })


def admit_stream(uploads: DataFrame, now) -> DataFrame:
    """Streaming form of `admission.admit`."""
    timed = uploads.withColumns({"ts": device_timestamp(F.col("ts_raw"), now), "tie": tie(uploads)})
    rows = timed.filter(F.col("ts").isNotNull()).select(
        "device_id", "tie", "arrived_at", "seq", F.coalesce("shot_id", F.lit("")).alias("shot_id"), "ts",
        F.unix_micros("arrived_at").alias("at"), F.unix_micros("ts").alias("ts_us"),
    )
    return rows.groupBy("device_id").applyInPandasWithState(
        _admit_group,
        "device_id string, arrived_at timestamp, seq bigint, shot_id string, ts timestamp, status string",
        "latest bigint, shots array<string>, times array<bigint>", "append", GroupStateTimeout.NoTimeout,
    )


def drop_repeated_shots(uploads: DataFrame, time: str = "arrived_at", within: str = "10 minutes") -> DataFrame:
    """Cheap variant: repeated shots within the time dropped, whether accepted or not.

    Uploads without a shot are kept apart, since they would count as repeats of
    one another.
    """
    timed = uploads.withWatermark(time, within)
    named = timed.filter(F.col("shot_id") != "").dropDuplicatesWithinWatermark(["device_id", "shot_id"])
    return named.unionByName(timed.filter(F.coalesce("shot_id", F.lit("")) == ""))


# ---- alert cooldown -----------------------------------------------------

def _cooldown_shard(key, batches, state):
    told = zip(*state.get) if state.exists else ()
    known = {pair: (blocked, fired_at) for pair, blocked, fired_at in told}
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    codes, pairs_ = pd.factorize(rows.pair)
    # Pair by pair in order of time; a resolution before a candidate of its instant, then by shot, a missing one first.
    order = np.lexsort((pd.factorize(rows.shot_id, sort=True)[0], rows["_candidate"], rows["_at"], codes))
    columns = (rows[name].to_numpy()[order].tolist() for name in ("_at", "_candidate", "_of", "cooldown_s"))
    last, keep = None, []
    for row, code, at, candidate, of, cooldown in zip(order.tolist(), codes[order].tolist(), *columns):
        if code != last:
            if last is not None:
                known[pairs_[last]] = blocked, fired_at
            last = code
            blocked, fired_at = known.get(pairs_[code], (NEVER, NEVER))
        if candidate:
            if at > blocked:
                keep.append(row)
                fired_at, blocked = at, at + int(cooldown) * 1_000_000
        elif of == fired_at:
            # The alert that blocks is resolved: from this instant on the next may fire.
            blocked = max(fired_at, min(blocked, at - 1))
    if last is not None:
        known[pairs_[last]] = blocked, fired_at
    state.update((list(known), *map(list, zip(*known.values()))))
    if keep:
        yield rows[["_at", "item"]].take(keep)


def cooldown_stream(
    candidates: DataFrame, history: DataFrame | None = None, resolutions: DataFrame | None = None,
) -> DataFrame:
    """Streaming form of `cooldown.apply_cooldown`: two instants of state per (rule, device).

    `history` is a table of alerts stored before the stream began, `resolutions`
    a stream (rule_id, device_id, triggered_at, resolved_at). A resolution that
    arrives in a later batch than the candidates after it does not bring those back. What has no time neither fires nor resolves.

    A call of the state function costs much more than a row, so pairs share the state of one of `SHARDS` shards, and
    a candidate passes through it as few columns: its payload is a JSON text, read again for those that fire.
    """
    if history is not None:
        candidates = not_suppressed(candidates, history)
    schema = candidates.schema
    payload = [name for name in schema.names if name != "triggered_at"]

    def sharded(rows: DataFrame, at: str, candidate: bool, of: Column, cooldown: Column, shot: Column, item: Column) -> DataFrame:
        return rows.select(
            F.pmod(F.xxhash64(*PAIR), F.lit(SHARDS)).cast("int").alias("shard"), F.to_json(F.struct(*PAIR)).alias("pair"),
            F.unix_micros(at).alias("_at"), F.lit(candidate).alias("_candidate"), of.alias("_of"), cooldown.cast("long").alias("cooldown_s"),
            shot.cast("string").alias("shot_id"), item.alias("item"),
        ).filter("_at is not null and _of is not null")

    text = F.to_json(F.struct(*payload), _EXACT)
    rows = sharded(candidates, "triggered_at", True, F.lit(0).cast("long"), F.col("cooldown_s"), F.col("shot_id"), text)
    if resolutions is not None:
        rows = rows.unionByName(sharded(
            resolutions, "resolved_at", False, F.unix_micros("triggered_at"), F.lit(0), F.lit(None), F.lit(None).cast("string")))
    fired = rows.groupBy("shard").applyInPandasWithState(
        _cooldown_shard, "_at bigint, item string", "pairs array<string>, blocked array<bigint>, fired_at array<bigint>",
        "append", GroupStateTimeout.NoTimeout,
    )
    kinds = T.StructType([schema[name] for name in payload])
    read = once(fired, _item=F.from_json("item", kinds, _EXACT))
    return read.select(*[
        (F.timestamp_micros("_at") if name == "triggered_at" else F.col(f"_item.`{name}`")).alias(name) for name in schema.names])


# ---- device presence ----------------------------------------------------

FIELDS = ["firmware", "ip", "ssid", "heap", "auto_mode", "interval_sec", "uptime"]
_STATE = (
    "online boolean, stale boolean, firmware string, ip string, ssid string, heap bigint, "
    "auto_mode boolean, interval_sec bigint, uptime bigint, last_seen_at bigint, online_since bigint, "
    "first_seen_at bigint, image_count bigint"
)
_NAMES = [part.split()[0] for part in _STATE.split(",")]


def _goes_online(device: dict | None, fields: dict, at: int) -> dict:
    """Given values win over earlier ones, earlier ones over defaults."""
    old = device or {}
    defaults = {"auto_mode": False, "interval_sec": DEFAULT_INTERVAL_S, "uptime": 0}
    return {
        "online": True, "stale": False,
        **{name: fields.get(name, old.get(name, defaults.get(name))) for name in FIELDS},
        "last_seen_at": max(at, old.get("last_seen_at", at)),
        "online_since": old["online_since"] if old.get("online") else at,
        "first_seen_at": old.get("first_seen_at", at),
        "image_count": old.get("image_count", 0),
    }


def step_device(device: dict | None, kind: str, fields: dict, at: int) -> dict | None:
    """A device's state after one message; unknown devices appear with their first online one.

    `fields` are those of `devices.presence_fields`, without the missing ones.
    """
    if kind == "online":
        return _goes_online(device, fields, at)
    if device is None:
        return None
    device = {**device, "last_seen_at": max(at, device["last_seen_at"]), "stale": False}
    if kind == "offline":
        device.update(online=False, online_since=None)
    elif fields.get("uploaded"):
        device["image_count"] += 1
    return device


def _presence_group(key, batches, state):
    device = dict(zip(_NAMES, state.get)) if state.exists else None
    if state.hasTimedOut:
        device["stale"] = bool(device["online"])
        state.update(tuple(device[name] for name in _NAMES))
    else:
        rows = _in_order(batches, ["at", "seq"])
        for kind, fields, at in zip(rows.kind, rows.fields, rows["at"]):
            device = step_device(device, kind, json.loads(fields) if fields else {}, int(at))
        if device is None:
            return
        state.update(tuple(device[name] for name in _NAMES))
    yield pd.DataFrame({"device_id": [key[0]], **{name: [device[name]] for name in _NAMES}})


def _timed_presence_group(key, batches, state):
    for out in _presence_group(key, batches, state):
        device = dict(zip(_NAMES, state.get))
        if device["online"] and not device["stale"]:
            due = (device["last_seen_at"] + STALE_AFTER_S * 1_000_000) // 1000
            now = state.getCurrentWatermarkMs()
            if due < now:  # an older message than others of its batch: the minute is over already
                device["stale"] = True
                state.update(tuple(device[name] for name in _NAMES))
                out = out.assign(stale=True)
            else:
                state.setTimeoutTimestamp(max(due, now + 1))
        yield out


def presence_stream(messages: DataFrame, timers: bool = True, delay: str = DELAY) -> DataFrame:
    """One row per device whose state changed in the micro-batch.

    Rows of later batches replace earlier ones (`changes.latest` by batch and
    last_seen_at). With `timers` an online device silent for a minute is
    reported stale. The minute is measured in the messages' own time, behind a
    watermark of `delay`, so a replay of a day tells what the day itself told.
    """
    timed = messages.withWatermark("ts", delay) if timers else messages
    rows = parsed(timed).select(
        "device_id", "ts", F.unix_micros("ts").alias("at"), "seq", "kind",
        F.to_json(F.struct(*[c.alias(n) for n, c in presence_fields(F.col("kind"), F.col("fields")).items()])).alias("fields"),
    )
    states = rows.groupBy("device_id").applyInPandasWithState(
        _timed_presence_group if timers else _presence_group,
        f"device_id string, {_STATE}", _STATE, "update",
        GroupStateTimeout.EventTimeTimeout if timers else GroupStateTimeout.NoTimeout,
    )
    times = ("last_seen_at", "online_since", "first_seen_at")
    return states.withColumns({name: F.timestamp_micros(name) for name in times})


# ---- silence alerts -----------------------------------------------------

def _silence_group(timers: bool):
    """State function of a (rule, device) pair: alerts for silences of the device beyond the rule's threshold.

    The state is the last message's time, whether its silence is judged, until when the pair is
    blocked, and the messages that are not behind the watermark yet: they are taken in order of
    time once it has passed them, so what comes out of order within the delay does no harm. A silence is noticed by the
    next message or when the watermark passes its threshold.
    """

    def group(key, batches, state):
        last, judged, blocked, pending, threshold, cooldown, name, severity = (
            state.get if state.exists else (None, False, NEVER, [], 0, 0, None, None))
        pending = [int(at) for at in pending]
        if not state.hasTimedOut:
            for rows in batches:
                pending += [int(at) for at in rows["at"]]
                threshold, cooldown, name, severity = (rows[c].iloc[0] for c in ("threshold", "cooldown_s", "name", "severity"))
        wait, rest, out = int(float(threshold) * 1_000_000), int(cooldown) * 1_000_000, []
        now = state.getCurrentWatermarkMs() * 1000 if timers else None

        def judge(until):
            nonlocal judged, blocked
            if last is not None and not judged and until > last + wait:
                judged = True
                if last + wait > blocked:
                    blocked = last + wait + rest
                    out.append((key[0], name, severity, key[1], last + wait))

        pending.sort()
        ready = len(pending) if now is None else next((i for i, at in enumerate(pending) if at > now), len(pending))
        for at in pending[:ready]:
            judge(at)
            if last is None or at > last:
                last, judged = at, False
        del pending[:ready]
        if now is not None:
            judge(now)
        state.update((last, judged, blocked, pending, float(threshold), int(cooldown), name, severity))
        due = [*pending[:1], *([last + wait] if last is not None and not judged else [])]
        if timers and due:
            state.setTimeoutTimestamp(max(min(due) // 1000, now // 1000 + 1))
        yield pd.DataFrame(out, columns=["rule_id", "name", "severity", "device_id", "at"])

    return group


def offline_stream(messages: DataFrame, rule_rows: DataFrame, timers: bool = True, delay: str = DELAY) -> DataFrame:
    """Streaming form of `rules.silence_candidates` with its cooldown: a state per rule and device it watches.

    With `timers` a silence is also reported while it lasts, when a watermark of `delay` behind the messages of
    all devices passes the rule's threshold.
    """
    watching = rule_rows.filter(F.col("cond_type") == "device_offline")
    timed = messages.withWatermark("ts", delay) if timers else messages
    rows = pairs(parsed(timed).select("device_id", "ts"), watching)
    fired = rows.select(
        "rule_id", "device_id", "ts", F.unix_micros("ts").alias("at"), "threshold", "cooldown_s", "name", "severity",
    ).groupBy("rule_id", "device_id").applyInPandasWithState(
        _silence_group(timers), "rule_id string, name string, severity string, device_id string, at bigint",
        "last bigint, judged boolean, blocked bigint, pending array<bigint>, threshold double, cooldown bigint, name string, severity string", "append",
        GroupStateTimeout.EventTimeTimeout if timers else GroupStateTimeout.NoTimeout,
    )
    return fired.withColumn("triggered_at", F.timestamp_micros("at")).drop("at")
