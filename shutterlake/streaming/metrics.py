"""Job counters: consumed, processed, errors, detections, batches; late rows."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

COUNTERS = ["consumed", "processed", "errors", "detections"]


def counted(df: DataFrame, name: str, valid: Column, detections: Column | None = None) -> DataFrame:
    """Observe a stream's counters as its rows pass; no extra pass over the data."""
    found = F.lit(0) if detections is None else F.coalesce(detections, F.lit(0))
    return df.observe(
        name, F.count(F.lit(1)).alias("consumed"), F.count_if(valid).alias("processed"),
        F.count_if(~valid).alias("errors"), F.coalesce(F.sum(found), F.lit(0)).alias("detections"),
    )


def batch_row(batch: DataFrame, job: str, batch_id: int, valid: Column, detections: Column | None = None) -> DataFrame:
    """A micro-batch's counters as the row that is stored with it under its number; a replayed batch replaces it."""
    found = F.lit(0) if detections is None else F.coalesce(detections, F.lit(0))
    return batch.agg(
        F.count(F.lit(1)).alias("consumed"), F.count_if(valid).alias("processed"), F.count_if(~valid).alias("errors"),
        F.coalesce(F.sum(found), F.lit(0)).cast("long").alias("detections"),
    ).select(F.lit(job).alias("job"), F.lit(batch_id).cast("long").alias("number"), *COUNTERS)


def totals(counters: DataFrame) -> DataFrame:
    """Per job the sums over all stored batches: what it has done in all its runs."""
    return counters.groupBy("job").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count(F.lit(1)).alias("batches")).withColumn(
        "healthy", F.col("errors") < F.col("processed") / 10)


class JobCounters(StreamingQueryListener):
    """Adds up the observed counters of one job over all its batches."""

    def __init__(self, name: str):
        self.name = name
        self.totals = dict.fromkeys([*COUNTERS, "batches", "late"], 0)
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(event.progress)

    def onQueryTerminated(self, event) -> None:
        pass

    def add(self, progress) -> None:
        """Add a batch; late rows also of jobs that are only named so and observe nothing, as the rollups."""
        row = progress.observedMetrics.get(self.name)
        if row is None and progress.name != self.name:
            return
        with self._lock:
            if row is not None:
                for counter in COUNTERS:
                    self.totals[counter] += row[counter] or 0
            self.totals["batches"] += 1
            self.totals["late"] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def healthy(self) -> bool:
        """Fewer errors than a tenth of the processed rows."""
        return self.totals["errors"] < self.totals["processed"] / 10


def dropped_late(query: StreamingQuery) -> int:
    """Rows that the batches still in the query's short memory dropped behind the watermark.

    `JobCounters` listens to every batch and forgets none; this is for a look at a running query.
    """
    return sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )


def exposition(totals: dict[str, int], prefix: str = "inference") -> str:
    """Counters in the text form that metric scrapers read."""
    lines = []
    for name, value in totals.items():
        lines += [f"# TYPE {prefix}_{name} counter", f"{prefix}_{name} {value}"]
    return "\n".join(lines) + "\n"
