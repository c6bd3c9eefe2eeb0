"""Image stores: inventory, sidecar files, object listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import names
from shutterlake.functions.text import not_test_device
from shutterlake.functions.times import as_column
from shutterlake.functions.urls import RAW_BUCKET
from shutterlake.operators import changes

_DATED = r"/([^/]+)/(\d{4})/(\d{1,2})/(\d{1,2})/([^/]+)$"
SIDECAR = "deviceId string, ts string, shotId string, size bigint, mime string, sha256 string"


def scan(spark: SparkSession, root: str, pattern: str = "*.{jpg,jpeg}") -> DataFrame:
    """path, length and modificationTime of image files; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
    )
    return files.select("path", "modificationTime", "length")


def inventory(files: DataFrame, *, device_id=None, search=None, start=None, end=None) -> DataFrame:
    """Files under device/yyyy/mm/dd as images; test devices left out.

    The time in the file name counts as creation time, else the file's own.
    """
    def part(i: int) -> Column:
        return F.regexp_extract("path", _DATED, i)

    images = files.filter(F.col("path").rlike(_DATED)).select(
        names.base_name(F.col("path")).alias("filename"), part(1).alias("device_id"),
        F.concat(F.lit("/uploads/"), F.concat_ws("/", *(part(i) for i in range(1, 6)))).alias("url"),
        F.col("path").alias("file_path"), F.col("length").alias("size"),
        F.coalesce(names.name_parts(names.base_name(F.col("path")))["taken_at"], "modificationTime").alias("created_at"),
        F.col("modificationTime").alias("updated_at"),
    ).filter(not_test_device(F.col("device_id")))
    if device_id:
        images = images.filter(F.col("device_id") == device_id)
    if search:
        images = images.filter(F.lower("filename").contains(search.lower()))
    if start is not None and end is not None:
        images = images.filter(F.col("created_at").between(as_column(start), as_column(end)))
    return images.withColumns({"has_detections": F.lit(False), "detection_count": F.lit(0)})


def inventory_page(
    images: DataFrame, number: int = 1, size: int = 12, sort_by: str = "created_at", descending: bool = True
) -> DataFrame:
    """One page of the inventory in the order of any of its columns."""
    first = F.desc(sort_by) if descending else F.asc(sort_by)
    return changes.page(images, [first, F.asc("file_path")], number, size)


def dated_key(path: Column, device_id: Column) -> Column:
    """`raw/yyyy/mm/dd/device/file` for a file below a dated folder."""
    def part(i: int) -> Column:
        return F.regexp_extract(path, _DATED, i)

    return F.concat_ws("/", F.lit("raw"), part(2), part(3), part(4), device_id, part(5))


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Sidecar JSON files below `root`, one row per file with its path."""
    rows = (
        spark.read.schema(SIDECAR).option("multiLine", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json").json(root)
    )
    return rows.select("*", F.col("_metadata.file_path").alias("path"))


def with_sidecars(files: DataFrame, sidecars: DataFrame, base_url: str = f"http://localhost:9002/{RAW_BUCKET}") -> DataFrame:
    """Images that have a sidecar, with their object key and URL."""
    def stem(column: str) -> Column:
        return F.regexp_replace(column, r"\.[^./]*$", "")

    left = files.withColumn("_stem", stem("path"))
    right = sidecars.withColumn("_stem", stem("path")).drop("path")
    key = dated_key(F.col("path"), F.col("deviceId"))
    joined = left.join(right, "_stem").withColumn("object_key", key)
    # A sidecar without a shot id: device, time and the last part of the name.
    tail = F.element_at(F.split(names.stem(F.col("path")), "_"), -1)
    shot = F.coalesce("shotId", F.concat_ws("-", F.col("deviceId"), F.col("ts"), tail))
    return joined.select(
        "path", F.col("deviceId").alias("device_id"), "ts", shot.alias("shot_id"), "object_key",
        F.concat(F.lit(base_url + "/"), "object_key").alias("image_url"),
    )


def objects_of_day(
    objects: DataFrame, device_id: str, year: str, month: str, day: str, limit: int = 100,
    base_url: str = f"http://localhost:9002/{RAW_BUCKET}",
) -> DataFrame:
    """Objects (`object_key`) of one device and day, in key order, as project images."""
    prefix = f"raw/{year}/{month}/{day}/{device_id}/"
    found = objects.filter(F.col("object_key").startswith(prefix)).orderBy("object_key").limit(limit)
    return found.select(
        names.stem(F.col("object_key")).alias("image_id"),
        F.concat(F.lit(base_url + "/"), "object_key").alias("image_url"), "object_key",
    )
