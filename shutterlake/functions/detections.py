"""Columns over the detection array of an enriched event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.text import given, json_array
from shutterlake.schemas import DETECTIONS


def parse(detections: Column) -> Column:
    """Detections text → array of structs; blank or malformed text → empty array."""
    return F.coalesce(json_array(detections, DETECTIONS), F.array().cast(DETECTIONS))


def species_of(detection: Column) -> Column:
    """class, else name, else `unknown`."""
    return F.coalesce(given(detection["class"]), given(detection["name"]), F.lit("unknown"))


def confidence_of(detection: Column) -> Column:
    """confidence, else conf, else 0; a zero confidence falls through like a missing one."""
    return F.coalesce(F.nullif(detection["confidence"], F.lit(0.0)), detection["conf"], F.lit(0.0))


def max_confidence(detections: Column) -> Column:
    """Greatest confidence, a missing one counting 0; null without detections."""
    return F.array_max(F.transform(detections, lambda d: F.coalesce(d["confidence"], F.lit(0.0))))


def classes_lower(detections: Column) -> Column:
    return F.transform(detections, lambda d: F.lower(F.coalesce(d["class"], F.lit(""))))


def distinct_species(detections: Column) -> Column:
    """Sorted distinct class names."""
    return F.array_sort(F.array_distinct(F.transform(detections, species_of)))


def class_list(detections: Column) -> Column:
    """Class names joined with `, `, blanks left out."""
    names = F.transform(detections, lambda d: given(d["class"]))
    return F.array_join(F.filter(names, lambda n: n.isNotNull()), ", ")


def any_confident(detections: Column, threshold: float) -> Column:
    return F.exists(detections, lambda d: d["confidence"] >= threshold)


def any_species(detections: Column, species: str | list[str]) -> Column:
    """True when a class is in the list (comma-separated or list), ignoring case."""
    names = species.split(",") if isinstance(species, str) else species
    wanted = [name.strip().lower() for name in names]
    return F.exists(detections, lambda d: F.lower(d["class"]).isin(wanted))
