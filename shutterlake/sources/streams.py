"""Topic sources and sinks: Kafka, or files of JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.functions.times import as_column

RAW_TOPIC = "events.raw"
ENRICHED_TOPIC = "events.enriched"
# Fixed value: the source named in message headers.
SOURCE_HEADER = "iot-backend"
# Defaults of what one trigger takes: rows of a topic, files of a folder. They
# bound a micro-batch, lose nothing, and None lifts them. A topic may also wait
# for a least number of rows, but no longer than a given time; files are also
# bounded by their bytes.
ROWS_PER_TRIGGER = 1_000_000
FILES_PER_TRIGGER = 1_000


def size_or_time(least_rows: int | None, longest_wait: str | None) -> dict[str, str]:
    """Options of a topic whose batches wait for rows, but not for ever."""
    if least_rows is None:
        return {}
    return {"minOffsetsPerTrigger": str(least_rows), "maxTriggerDelay": longest_wait or "5s"}


def source(
    spark: SparkSession, kind: str, *, topic: str = RAW_TOPIC, path: str | None = None,
    schema: T.StructType | str | None = None, servers: str | None = None,
    group_id: str | None = None, starting: str = "latest", rows_per_trigger: int | None = ROWS_PER_TRIGGER,
    files_per_trigger: int | None = FILES_PER_TRIGGER, least_rows: int | None = None, longest_wait: str | None = None,
    bytes_per_trigger: str | None = None, **options: str,
) -> DataFrame:
    """A stream of messages with a `value` column.

    kind `kafka` subscribes to `topic` and tolerates expired offsets. `text`
    reads each line of the files under `path` as one message. `parquet` and
    `json` read files with the given schema.
    """
    reader = spark.readStream
    if kind == "kafka":
        reader = (
            reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("startingOffsets", starting).option("failOnDataLoss", "false")
        )
        if rows_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", rows_per_trigger)
        for name, value in size_or_time(least_rows, longest_wait).items():
            reader = reader.option(name, value)
        if group_id:
            reader = reader.option("kafka.group.id", group_id)
    elif kind in ("text", "json", "parquet"):
        reader = reader.format(kind)
        if schema is not None:
            reader = reader.schema(schema)
        # The source knows one of the two bounds.
        if bytes_per_trigger:
            reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
        elif files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        raise ValueError(f"kind must be kafka, text, json or parquet, not {kind!r}")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path) if path else reader.load()


def topic_rows(events: DataFrame, key: str | None = None, now=None) -> DataFrame:
    """Rows for a topic: JSON value, optional key, headers `source` and `timestamp`."""
    at = F.current_timestamp() if now is None else as_column(now)

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))

    headers = F.array(
        header("source", F.lit(SOURCE_HEADER)), header("timestamp", F.unix_millis(at).cast("string"))
    )
    columns = [F.to_json(F.struct("*")).alias("value"), headers.alias("headers")]
    if key:
        columns.insert(0, F.col(key).cast("string").alias("key"))
    return events.select(*columns)


def write_topic(rows: DataFrame, servers: str, topic: str) -> None:
    """Publish a batch of topic rows."""
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).option("includeHeaders", "true").save()


def stream_topic(rows: DataFrame, servers: str, topic: str, checkpoint: str, interval: str = "10 seconds"):
    """Publish a stream of topic rows."""
    return (
        rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("includeHeaders", "true").option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval).start()
    )
