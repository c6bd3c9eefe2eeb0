"""Helpers that several operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, separator: str = SPACE) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def content_key(*columns: Column) -> list[Column]:
    """Two 64-bit hashes of a row's content, with seeds of their own: equal rows share them, others do not."""
    return [F.xxhash64(*columns).alias("key_a"), F.xxhash64(F.lit("second"), *columns).alias("key_b")]


KEY = ["key_a", "key_b"]


def text_key() -> list[Column]:
    """The content key of column `text`, where null counts as empty."""
    return content_key(F.coalesce(F.col("text"), F.lit("")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names.

    Where it is unset a session in one process, as in tests, gets a folder of its own; any other session must set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder, deleted when the session's process ends."""
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a Parquet table in a scratch folder: for wide or many rows, which pack better than a checkpoint."""
    path = scratch_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def settled(frame: DataFrame) -> DataFrame:
    """The frame written once to the shared checkpoint folder, so that later plans read it instead of redoing it.

    Spark removes the files with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    context = frame.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that only a few long texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: A side of at most so many rows of a few numbers each may be sent to every executor.
BROADCAST_ROWS = 200_000


def small_side(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled frame of narrow rows, marked for broadcast if counting shows it small; else Spark shuffles."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def ranged(frame: DataFrame, order: list[str], rows: int, purpose: str) -> DataFrame:
    """A settled frame written in the order of some columns, about so many rows to a range.

    Adds `part`, the number of a row's range, and `place`, its place in it. The order must tell hot keys apart, or
    their rows stay in one range.
    """
    parts = 1 + frame.count() // rows
    sorted_rows = frame.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return written(sorted_rows.withColumn("part", F.shiftright("place", 33).cast("int")).withColumn("place", F.expr(f"place & {(1 << 33) - 1}")), purpose)


#: DuckDB SQL of a common table `crc` whose `t` is the table of the CRC-32 checksum, and of the checksum of a text of ASCII digits.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list(c ORDER BY k) AS t FROM (
  SELECT k, list_reduce(list_prepend(k, range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256)) AS k)))"""


def crc_sql(value: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a number's decimal digits, where `crc` is in scope."""
    digits = f"list_transform(string_split(({value})::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"
