"""Greedy cooldown: a rule fires for a device only when it is not cooling down.

After a firing at t the pair is blocked through t + cooldown (inclusive), or
until the alert is resolved. Which candidates fire depends on the whole chain
before them, so the rule cannot be written as a window over neighbours.

To spread one busy pair over many tasks its candidates are cut into time
chunks. Each candidate points to the next one that fires after it. Pointers are
first followed within a chunk, so that each candidate knows where its chain leaves
the chunk; the place where a chain enters a later chunk is looked up by an
as-of search in the chunk of that instant. Which entries the pair's own chain
really takes follows from its first candidate by pointer doubling: in each
round, what has been reached reaches as far again, so the rounds grow with the logarithm
of the pair's chunks. A chain enters a chunk once at most, and the firings are read off
chunk by chunk. No task holds more than one chunk of candidates, however long
the cooldown is, and candidates of one instant are reduced to one beforehand.
Pairs of few candidates are a single chunk and need no rounds.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.session import materialise

# Executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_S = 3600
# A pair of at most so many instants is one chunk.
CHUNK_ROWS = 50_000
PAIR = ["rule_id", "device_id"]
NEVER = -(1 << 62)


def exits(times: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Per instant of a chunk: until when the last firing of its chain in the chunk blocks."""
    n = len(times)
    after = np.searchsorted(times, until, side="right")
    final = np.where(after < n, after, np.arange(n))
    while True:
        further = final[final]
        if np.array_equal(further, final):
            return until[final]
        final = further


def firings(times: np.ndarray, until: np.ndarray, entry: int) -> list[int]:
    """Indices of the instants that fire from the one where the chain enters the chunk."""
    after = np.searchsorted(times, until, side="right")
    i, fired = int(np.searchsorted(times, entry, side="left")), []
    while i < len(times):
        fired.append(i)
        i = int(after[i])
    return fired


def _exits_batch(times: pd.Series, until: pd.Series) -> pd.Series:
    return pd.Series([exits(t, u).tolist() for t, u in zip(times, until)])


def _firings_batch(times: pd.Series, until: pd.Series, entry: pd.Series) -> pd.Series:
    return pd.Series([firings(t, u, int(e)) for t, u, e in zip(times, until, entry)])


def _landings(instants: DataFrame, left: DataFrame, width: int) -> DataFrame:
    """(pair, out, next): the first instant after each instant `out` at which a chain leaves a chunk, if there is one.

    Instants and exits of one chunk meet in one window; what has no instant after it
    in its chunk lands on the first one of the next chunk that has any.
    """
    chunk = F.expr(f"_t div {width}L")
    asked = left.select(*PAIR, F.col("out").alias("_t"), F.lit(None).cast("long").alias("_at")).distinct()
    both = instants.select(*PAIR, F.col("_at").alias("_t"), "_at").unionByName(asked).withColumn("chunk", chunk)
    # Backwards in time; an exit comes before an instant of the same time, which it still blocks.
    back = Window.partitionBy(*PAIR, "chunk").orderBy(F.desc("_t"), F.asc_nulls_first("_at"))
    found = both.withColumn("_next", F.last("_at", True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    # One row per chunk in the window over a pair.
    chunks = both.groupBy(*PAIR, "chunk").agg(F.min("_at").alias("first"))
    later = Window.partitionBy(*PAIR).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    following = chunks.withColumn("following", F.last("first", True).over(later)).drop("first")
    return (
        found.filter(F.col("_at").isNull()).join(following, [*PAIR, "chunk"])
        .select(*PAIR, F.col("_t").alias("out"), F.coalesce("_next", "following").alias("next")).filter("next is not null")
    )


def _entries(spans: DataFrame, instants: DataFrame, width: int) -> DataFrame:
    """(pair, at): where the chain of each pair enters its chunks, by pointer doubling.

    `spans` has (pair, chunk, times, leave): per instant of a chunk the instant at which its chain leaves.
    """
    links = materialise(
        spans.select(*PAIR, F.explode(F.arrays_zip("times", "leave")).alias("x"))
        .select(*PAIR, F.col("x.times").alias("at"), F.col("x.leave").alias("out")), "links")
    landings = materialise(_landings(instants, links.select(*PAIR, "out"), width), "landings")
    heads = instants.groupBy(*PAIR).agg(F.min("_at").alias("at"))
    reached = materialise(heads, "reached")
    # Only instants on which a chain can land are ever asked for.
    nodes = landings.select(*PAIR, F.col("next").alias("at")).unionByName(reached).distinct()
    jump = materialise(links.join(nodes, [*PAIR, "at"], "left_semi").join(landings, [*PAIR, "out"]).select(*PAIR, "at", "next"), "jump")
    most = spans.groupBy(*PAIR).count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most))):
        further = reached.join(jump, [*PAIR, "at"]).select(*PAIR, F.col("next").alias("at"))
        reached = materialise(reached.unionByName(further).distinct(), "reached")
        jump = materialise(
            jump.join(jump.select(*PAIR, F.col("at").alias("next"), F.col("next").alias("far")), [*PAIR, "next"])
            .select(*PAIR, "at", F.col("far").alias("next")), "jump")
    return reached


def apply_cooldown(
    candidates: DataFrame, history: DataFrame | None = None,
    resolutions: DataFrame | None = None, chunk_s: int = CHUNK_S, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The candidates that fire.

    `candidates` has rule_id, device_id, triggered_at, cooldown_s and any
    payload. `history` holds alerts stored earlier. `resolutions` (rule_id,
    device_id, triggered_at, resolved_at) ends a block early. Pairs of more than
    `chunk_rows` instants are cut into chunks of `chunk_s` seconds. The candidates are
    evaluated when this is called and kept in the shared folder.
    """
    if history is not None:
        candidates = not_suppressed(candidates, history)
    payload = [c for c in candidates.columns if c not in PAIR]
    rows = candidates.withColumn("_at", F.unix_micros("triggered_at"))
    block = F.col("_at") + F.col("cooldown_s") * 1_000_000
    if resolutions is not None:
        ended = resolutions.groupBy(*PAIR, F.unix_micros("triggered_at").alias("_at")).agg(
            F.min(F.unix_micros("resolved_at")).alias("_resolved")
        )
        rows = rows.join(ended, [*PAIR, "_at"], "left")
        block = F.greatest("_at", F.least(block, F.col("_resolved") - 1))
    # Of candidates at the same instant only one can fire: the first by payload.
    # Read several times below: written once, so that the events are not evaluated again.
    instants = materialise(
        rows.select(*PAIR, "_at", F.struct(block.alias("_until"), *payload).alias("item"))
        .groupBy(*PAIR, "_at").agg(F.min("item").alias("item")),
        "cooldown",
    )
    width = chunk_s * 1_000_000
    busy = materialise(
        instants.groupBy(*PAIR).agg(F.count("*").alias("n")).filter(F.col("n") > chunk_rows).select(*PAIR, F.lit(True).alias("busy")), "busy")
    # Only instants are gathered, 16 bytes each; the payload is joined to the firings.
    cut = instants.select(*PAIR, "_at", F.col("item")["_until"].alias("until")).join(busy, PAIR, "left")
    chunks = cut.withColumn("chunk", F.when(F.col("busy"), F.expr(f"_at div {width}L")).otherwise(0)).groupBy(*PAIR, "busy", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("_at", "until"))).alias("spans"))
    chunks = chunks.withColumns({"times": F.transform("spans", lambda x: x["_at"]), "untils": F.transform("spans", lambda x: x["until"])})
    as_firings = F.pandas_udf(_firings_batch, "array<int>")

    def fire(entered: DataFrame) -> DataFrame:
        return entered.select(*PAIR, "times", F.explode(as_firings("times", "untils", "entry")).alias("i")).select(
            *PAIR, F.get("times", F.col("i")).alias("_at"))

    fired = fire(chunks.filter("busy is null").withColumn("entry", F.get("times", F.lit(0))))
    if not busy.isEmpty():
        parts = materialise(chunks.filter("busy"), "chunks")
        as_exits = F.pandas_udf(_exits_batch, "array<bigint>")
        own = materialise(cut.filter("busy").select(*PAIR, "_at"), "instants")
        entries = _entries(parts.select(*PAIR, "times", as_exits("times", "untils").alias("leave")), own, width)
        entered = entries.select(*PAIR, F.expr(f"at div {width}L").alias("chunk"), F.col("at").alias("entry"))
        fired = fired.unionByName(fire(parts.join(entered, [*PAIR, "chunk"])))
    return instants.join(fired, [*PAIR, "_at"]).select(*PAIR, *(F.col("item")[c].alias(c) for c in payload))


def blocked_since(history: DataFrame) -> DataFrame:
    """Per pair the latest instant of an alert that is not resolved."""
    open_alerts = history.filter(F.col("status").isin("active", "acknowledged"))
    return open_alerts.groupBy(*PAIR).agg(F.max(F.unix_micros("triggered_at")).alias("_last"))


def not_suppressed(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Candidates without an open stored alert of their pair at or after t − cooldown.

    There is no upper bound on the stored alert's time, so the latest one per
    pair decides and a plain equi join is enough.
    """
    start = F.unix_micros("triggered_at") - F.col("cooldown_s") * 1_000_000
    joined = candidates.join(blocked_since(history), PAIR, "left")
    return joined.filter(F.col("_last").isNull() | (F.col("_last") < start)).drop("_last")
