"""Streamed batches: which are finished, which are folded into a stored table.

A job writes the tables of a micro-batch one after the other and then the batch's
mark. Readers and upkeep that are given the marks' folder see marked batches only, so a
batch is visible with all of its tables or not at all; one that died half-way is
replayed by its stream, replaces itself and is marked then.

A stored table names in its `_folded` folder the batch below which all batches are part of
it. Its rows keep their batch's number until then, so that a reader who comes
while months are being replaced takes each batch from one place only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.schemas import TABLES

MARKS, FOLDED, BELOW = "_finished", "_folded", "below-"


def files_of(spark: SparkSession, path: str):
    """The file system of a path and the path as it knows it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    fs, place = files_of(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, in one step."""
    fs, place = files_of(spark, path)
    fs.create(place, True).close()


def delete(spark: SparkSession, path: str) -> None:
    fs, place = files_of(spark, path)
    fs.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """A folder in place of another one of the same file system."""
    fs, place = files_of(spark, path)
    target = files_of(spark, to)[1]
    fs.mkdirs(target.getParent())
    fs.delete(target, True)
    if not fs.rename(place, target):
        raise OSError(f"cannot move {path} to {to}")


def finish(spark: SparkSession, marks: str, batch: int) -> None:
    """Mark a batch whose tables are all written."""
    touch(spark, f"{marks}/{MARKS}/{batch}")


def unfinished_from(spark: SparkSession, marks: str) -> int:
    """The first batch without a mark: all batches below are finished."""
    held = names(spark, f"{marks}/{MARKS}")
    first = max([0, *(int(name[len(BELOW):]) for name in held if name.startswith(BELOW))])
    marked = {int(name) for name in held if name.isdigit()}
    while first in marked:
        first += 1
    return first


def sum_up_marks(spark: SparkSession, marks: str) -> int:
    """Replace the marks of all batches below the first unfinished one by a single mark."""
    first = unfinished_from(spark, marks)
    old = names(spark, f"{marks}/{MARKS}")
    touch(spark, f"{marks}/{MARKS}/{BELOW}{first}")
    for name in old:
        if name != f"{BELOW}{first}" and (name.startswith(BELOW) or int(name) < first):
            delete(spark, f"{marks}/{MARKS}/{name}")
    return first


def folded_below(spark: SparkSession, stored: str) -> int:
    """The batches below this are part of a stored table."""
    return max([0, *(int(name) for name in names(spark, f"{stored}/{FOLDED}") if name.isdigit())])


def streamed(spark: SparkSession, path: str) -> dict[int, str]:
    """The batch folders of a streamed table by number."""
    return {int(name[6:]): f"{path}/{name}" for name in names(spark, path) if name.startswith("batch=")}


def columns_of(df: DataFrame, table: str, *more: str) -> DataFrame:
    return df.select(*[name for name in [*TABLES[table].columns.names, *more] if name in df.columns])


def read(spark: SparkSession, table: str, path: str, marks: str | None = None, stored: str | None = None) -> DataFrame:
    """A streamed table: its finished batches, and what of them is folded into the stored table already."""
    folded = folded_below(spark, stored) if stored else 0
    limit = unfinished_from(spark, marks) if marks else None
    live = [at for batch, at in streamed(spark, path).items() if batch >= folded and (limit is None or batch < limit)]
    parts = []
    if stored and any(not name.startswith("_") for name in names(spark, stored)):
        rows = spark.read.option("mergeSchema", "true").parquet(stored)
        if "batch" in rows.columns:
            rows = rows.filter(F.col("batch").isNull() | (F.col("batch") < folded))
        parts.append(columns_of(rows, table))
    if live:
        parts.append(columns_of(spark.read.option("basePath", path).parquet(*live), table))
    if not parts:
        return spark.createDataFrame([], TABLES[table].columns)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
