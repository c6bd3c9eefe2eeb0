"""Training sets and labelling files: written and read by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators import labeling


def write_coco(
    images: DataFrame, annotations: DataFrame, projects: DataFrame, path: str, now, mode: str = "overwrite"
) -> None:
    """COCO relations as JSON lines under project_id=…/relation=info|licenses|images|annotations|categories."""
    lines = labeling.coco_lines(images, annotations, projects, now)
    lines.write.mode(mode).partitionBy("project_id", "relation").text(path)


def write_yolo(
    images: DataFrame, annotations: DataFrame, projects: DataFrame, path: str, mode: str = "overwrite"
) -> None:
    """One row per image and its label text, as Parquet under project_id=…

    A label file per image would be millions of tiny files; a loader reads the
    rows, or writes a project's files where it needs them.
    """
    labels = labeling.yolo_labels(images, annotations, projects)
    labels.write.mode(mode).partitionBy("project_id").parquet(path)


def write_split(
    images: DataFrame, annotations: DataFrame, path: str, mode: str = "overwrite", **ratios: float
) -> None:
    """Images and annotations under split=train|val|test; annotations follow their image."""
    parts = labeling.split(images, **ratios)
    parts.write.mode(mode).partitionBy("split").parquet(f"{path}/images")
    labeling.split_annotations(annotations, parts).write.mode(mode).partitionBy("split").parquet(f"{path}/annotations")


def read_labelstudio(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Label Studio exports (`result`, `task`).

    JSON lines are read by many tasks. The tool's default export is one array
    per file; with `lines=False` each such file is read whole by one task, so
    large projects should be exported in parts.
    """
    reader = spark.read.schema(labeling.LABELSTUDIO_EXPORT)
    return reader.option("multiLine", str(not lines).lower()).json(path)


def write_tasks(images: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Labelling tasks as JSON lines under project_id=…"""
    tasks = labeling.labelling_tasks(images).select("project_id", F.col("task").alias("value"))
    tasks.write.mode(mode).partitionBy("project_id").text(path)
