"""Upload admission: drop repeated shots and stale images, in order of arrival.

Per device, an upload is a duplicate when its shot was accepted within the last
ten minutes, and stale when its time is not later than every accepted one. Only
accepted uploads change what follows, so the decision is a state machine and
not a window over neighbours.

In batch a device's uploads are cut into segments of about six hours, only at
instants that no repeat spans: where no shot uploaded before comes again after
within ten minutes of its last upload. At such an instant the shots seen before do not matter, and the
greatest accepted time is the whole state. A segment is then a function of
that time. It changes only at the prefix maxima of the segment's times, since a
start below one and above the one before it first accepts the same upload; and
starts whose runs come to the same state are run as one from there on, which is
all of them but those told apart by repeats still to come. One pass over the
uploads gives each its verdict as steps of the segment's start; the segments' own step
functions are followed in order, a row or two per segment, and each verdict is
read off. So there are as many passes whatever the data, and no start is guessed. Rows
stream through a task in sorted batches.

Uploads of a device that arrive at the same instant are taken by sequence number
(none first), then by a hash of all their columns, here as on the stream.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.times import device_timestamp
from shutterlake.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TTL_US = 10 * 60 * 1_000_000
CHUNK_US = 6 * 3600 * 1_000_000
LONG_AGO = -(1 << 62)


class Admission:
    """The state of one device: greatest accepted time and recent accepted shots."""

    def __init__(self, latest: int = LONG_AGO, shots=()):
        self.latest = latest
        self.recent = deque(shots)
        self.accepted_at = dict(self.recent)

    def forget(self, now: int) -> None:
        """Drop shots accepted more than ten minutes before `now`."""
        while self.recent and now - self.recent[0][1] > TTL_US:
            shot, at = self.recent.popleft()
            if self.accepted_at.get(shot) == at:
                del self.accepted_at[shot]

    def offer(self, at: int, shot: str, ts: int) -> str:
        self.forget(at)
        if shot and shot in self.accepted_at:
            return "duplicate"
        if ts <= self.latest:
            return "stale"
        self.latest = ts
        if shot:
            self.recent.append((shot, at))
            self.accepted_at[shot] = at
        return "accepted"


class Segment:
    """A segment's machine for all start maxima at once.

    `bounds[i]` is the first start maximum that run i does not cover; run i covers those from the bound before it on.
    Starts from the last bound on have accepted nothing yet. A run's state is the greatest accepted time and
    the accepted shots that come again, with their times.
    """

    def __init__(self):
        self.bounds: list[int] = []
        self.runs: list[tuple[int, dict[str, int]]] = []

    def offer(self, at: int, shot: str, ts: int, again: bool) -> tuple[list[int], list[str]]:
        """The upload's verdict as steps: from bounds[i-1] up to below bounds[i] it is verdicts[i]; `again`: the shot comes again in time."""
        bounds, verdicts, runs = [], [], []
        for bound, (latest, shots) in zip(self.bounds, self.runs):
            seen = shots.get(shot) if shot else None
            if seen is not None and at - seen <= TTL_US:
                verdict = "duplicate"
            elif ts <= latest:
                verdict = "stale"
            else:
                verdict, latest = "accepted", ts
                if shot and again:
                    shots = {**shots, shot: at}
            if not again and shot in shots:
                shots = {s: t for s, t in shots.items() if s != shot}
            runs.append((latest, shots))
            bounds.append(bound)
            verdicts.append(verdict)
        if not bounds or ts > bounds[-1]:
            runs.append((ts, {shot: at} if shot and again else {}))
            bounds.append(ts)
            verdicts.append("accepted")
        self._merge(bounds, runs)
        verdicts.append("stale")
        kept = [i for i in range(len(bounds)) if verdicts[i] != verdicts[i + 1]]
        return [bounds[i] for i in kept], [verdicts[i] for i in [*kept, len(bounds)]]

    def _merge(self, bounds: list[int], runs: list[tuple[int, dict[str, int]]]) -> None:
        """Neighbouring runs in one state go on as one."""
        kept = [i for i in range(len(runs)) if i + 1 == len(runs) or runs[i] != runs[i + 1]]
        self.bounds, self.runs = [bounds[i] for i in kept], [runs[i] for i in kept]

    def ends(self) -> tuple[list[int], list[int]]:
        """The segment's function: a start below bounds[i] ends in ends[i], one beyond all stays."""
        return self.bounds, [latest for latest, _ in self.runs]


_COLUMNS = ["device_id", "segment", "chunk", "place", "bounds", "verdicts", "ends"]
_STEPS = (
    "device_id string, segment bigint, chunk bigint, place bigint, bounds array<bigint>, "
    "verdicts array<string>, ends array<bigint>"
)
# The place of the row that holds a segment's function.
FUNCTION = -1


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verdicts in steps for rows sorted by device, segment and arrival, and one row per segment with its function."""
    key, machine = None, Segment()

    def closing(out):
        if key is not None:
            bounds, ends = machine.ends()
            out.append((*key, key[1], FUNCTION, bounds, None, ends))

    for batch in batches:
        out = []
        for device, segment, chunk, place, at, shot, ts, again in zip(
            batch.device_id, batch.segment, batch.chunk, batch.place, batch["at"], batch.shot_id, batch.ts, batch.again
        ):
            if (device, segment) != key:
                closing(out)
                key, machine = (device, segment), Segment()
            out.append((device, segment, chunk, place, *machine.offer(at, shot, ts, again), None))
        yield pd.DataFrame(out, columns=_COLUMNS)
    last = []
    closing(last)
    yield pd.DataFrame(last, columns=_COLUMNS)


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Start maximum of each segment; segments arrive by device and in order."""
    device, latest = None, LONG_AGO
    for batch in batches:
        starts = []
        for own, bounds, ends in zip(batch.device_id, batch.bounds, batch.ends):
            if own != device:
                device, latest = own, LONG_AGO
            starts.append(latest)
            i = bisect_right(bounds, latest)
            latest = int(ends[i]) if i < len(bounds) else latest
        yield batch[["device_id", "segment"]].assign(start=starts)


def _repeats(light: DataFrame) -> DataFrame:
    """The uploads whose shot comes again in time: device_id, chunk, place, at, `comes` (when it comes again)."""
    shots = light.filter(F.col("shot_id") != "").select("device_id", "chunk", "place", "at", "shot_id", F.lit(False).alias("peek"))
    # The first ten minutes of a chunk are also seen from the chunk before.
    head = shots.filter(F.col("at") - F.col("chunk") * CHUNK_US <= TTL_US).withColumns({"chunk": F.col("chunk") - 1, "peek": F.lit(True)})
    by_shot = Window.partitionBy("device_id", "chunk", "shot_id").orderBy("at", "peek", "place")
    following = shots.unionByName(head).withColumn("comes", F.lead("at").over(by_shot))
    return following.filter(~F.col("peek") & (F.col("comes") - F.col("at") <= TTL_US)).drop("shot_id", "peek")


def _segments(light: DataFrame, repeats: DataFrame) -> DataFrame:
    """(device_id, chunk, opens, before): a chunk's uploads later than `opens` are the segment of that number, others belong to the one before.

    `opens` is the first instant from the chunk's edge on that no repeat spans; null if the chunk has none.
    """
    edge = F.col("chunk") * CHUNK_US - 1
    reaching = repeats.filter(F.col("comes") >= (F.col("chunk") + 1) * CHUNK_US).withColumn("chunk", F.col("chunk") + 1)
    spans = repeats.unionByName(reaching).groupBy("device_id", "chunk", "at").agg(F.max("comes").alias("comes"))
    upto = Window.partitionBy("device_id", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.max("comes").over(upto), edge)
    free = (
        spans.withColumn("covered", covered).groupBy("device_id", "chunk")
        .agg(F.min(F.when(F.col("at") > F.col("covered"), F.col("covered"))).alias("gap"), F.max("comes").alias("last"))
        .select("device_id", "chunk", F.coalesce("gap", F.greatest("last", edge)).alias("free"))
    )
    by_chunk = Window.partitionBy("device_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = light.groupBy("device_id", "chunk").agg(F.max("at").alias("latest")).join(free, ["device_id", "chunk"], "left")
    opens = F.coalesce("free", edge)
    return (
        chunks.withColumn("opens", F.when(opens < F.col("latest"), opens))
        .withColumn("before", F.coalesce(F.last(F.when(F.col("opens").isNotNull(), F.col("chunk")), True).over(by_chunk), F.first("chunk").over(by_chunk), F.col("chunk")))
        .select("device_id", "chunk", "opens", "before")
    )


def tie(uploads: DataFrame) -> Column:
    """What orders uploads of one instant and sequence number: a hash of all columns."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(uploads.columns)])


def admit(uploads: DataFrame, now) -> DataFrame:
    """Each upload with its event time `ts` and its `status`: accepted, duplicate or stale.

    `uploads` has arrived_at, seq, device_id, shot_id, ts_raw and further
    columns. Uploads whose time cannot be read are left out. The work table is
    written to the shared folder once, since several steps read it.
    """
    ts = device_timestamp(F.col("ts_raw"), now)
    at = F.unix_micros("arrived_at")
    # An upload is known by its place within its device's chunk. Only equal rows
    # could change places, and for those it does not matter.
    in_chunk = Window.partitionBy("device_id", "chunk").orderBy("at", F.asc_nulls_first("seq"), "_tie")
    marked = (
        uploads.withColumns({"ts": ts, "at": at, "_tie": tie(uploads)}).filter(F.col("ts").isNotNull())
        .withColumn("chunk", F.floor(F.col("at") / F.lit(CHUNK_US)))
        .withColumn("place", F.row_number().over(in_chunk).cast("long")).drop("_tie")
    )
    light = materialise(marked.select(
        "device_id", "at", F.coalesce("shot_id", F.lit("")).alias("shot_id"), F.unix_micros("ts").alias("ts"), "place", "chunk",
    ), "uploads")
    repeats = materialise(_repeats(light), "repeats")
    placed = (
        light.join(_segments(light, repeats), ["device_id", "chunk"])
        .withColumn("segment", F.when(F.col("at") > F.col("opens"), F.col("chunk")).otherwise(F.col("before")))
        .join(repeats.select("device_id", "chunk", "place", F.lit(True).alias("again")), ["device_id", "chunk", "place"], "left")
        # No numeric column may hold nulls: pandas would turn it into floats.
        .select("device_id", "segment", "chunk", "place", "at", "shot_id", "ts", F.coalesce("again", F.lit(False)).alias("again"))
    )
    found = materialise(
        placed.repartition("device_id", "segment").sortWithinPartitions("device_id", "segment", "at", "place").mapInPandas(_judge, _STEPS), "admission")
    starts = (
        found.filter(F.col("place") == FUNCTION).select("device_id", "segment", "bounds", "ends")
        .repartition("device_id").sortWithinPartitions("device_id", "segment")
        .mapInPandas(_follow, "device_id string, segment bigint, start bigint")
    )
    verdicts = found.filter(F.col("place") != FUNCTION).join(starts, ["device_id", "segment"]).select(
        "device_id", "chunk", "place", F.get("verdicts", F.size(F.filter("bounds", lambda b: b <= F.col("start")))).alias("status"))
    return marked.join(verdicts, ["device_id", "chunk", "place"]).drop("chunk", "place", "at")


def accepted(uploads: DataFrame, now) -> DataFrame:
    """Only the accepted uploads."""
    return admit(uploads, now).filter(F.col("status") == "accepted").drop("status")


def running_latest(uploads: DataFrame, now) -> DataFrame:
    """Each upload with the greatest time among the device's earlier uploads.

    The cheap form of the stale guard, which lets dropped uploads count as
    well. Hours before the present one enter as one maximum each.
    """
    rows = uploads.withColumns({
        "ts": device_timestamp(F.col("ts_raw"), now), "hour": F.date_trunc("hour", "arrived_at"),
    })
    hours = rows.groupBy("device_id", "hour").agg(F.max("ts").alias("_top"))
    per_device = Window.partitionBy("device_id").orderBy("hour")
    earlier = hours.select(
        "device_id", "hour",
        F.max("_top").over(per_device.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
    )
    within = Window.partitionBy("device_id", "hour").orderBy("arrived_at", "seq")
    inside = F.max("ts").over(within.rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("_inside", inside).join(earlier, ["device_id", "hour"])
        .withColumn("latest_before", F.greatest("_inside", "_earlier"))
        .drop("_inside", "_earlier", "hour")
    )
