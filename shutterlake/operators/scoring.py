"""Batch scoring of images with a pluggable detector."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.text import given
from shutterlake.functions.times import as_column
from shutterlake.functions.urls import ANNOTATED_BUCKET, annotated_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.25
RESULT = "array<struct<class:string,confidence:double,bbox:array<double>,class_id:int>>"
# A detector maps image references to a list of detection dicts per image; a
# reference it cannot read gives None.
Detector = Callable[[list[str]], list[list[dict] | None]]


def score(images: DataFrame, load: Callable[[], Detector], threshold: float = THRESHOLD) -> DataFrame:
    """Add detections above the threshold and the time taken per image.

    `load` runs once per task and gives the detector for all its batches. An
    unreadable image gets null detections.
    """

    @F.pandas_udf(f"struct<detections:{RESULT},processing_time_ms:int>")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = load()
        for batch in batches:
            begun = time.perf_counter()
            found = detector(batch.tolist())
            each = int((time.perf_counter() - begun) * 1000 / max(len(batch), 1))
            kept = [
                None if objects is None else [o for o in objects if o["confidence"] >= threshold] for objects in found
            ]
            yield pd.DataFrame({"detections": kept, "processing_time_ms": each})

    return images.withColumn("_scored", detect("image_url")).select(
        "*", "_scored.detections", "_scored.processing_time_ms"
    ).drop("_scored")


def enrich(
    raw: DataFrame, now, load: Callable[[], Detector], threshold: float = THRESHOLD,
    model: str = "yolov8n", version: str = "1.0.0", endpoint: str = "http://minio:9000",
) -> DataFrame:
    """Raw events → enriched rows; unreadable images have null `detections`."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = annotated_key(F.col("device_id"), iso, F.coalesce(given(F.col("shot_id")), F.lit("unknown")))
    return score(raw, load, threshold).select(
        "device_id", "timestamp", "shot_id", "image_url",
        F.concat(F.lit(f"{endpoint}/{ANNOTATED_BUCKET}/"), key).alias("annotated_image_url"),
        F.size("detections").alias("detection_count"), F.to_json("detections").alias("detections"),
        "processing_time_ms", as_column(now).alias("processed_at"),
        F.lit(model).alias("inference_model"), F.lit(version).alias("inference_version"),
    )


def scored(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.col("detections").isNotNull())


def unscored(enriched: DataFrame) -> DataFrame:
    """The reject branch: events whose image could not be read."""
    return enriched.filter(F.col("detections").isNull()).select("device_id", "timestamp", "shot_id", "image_url")
