"""File names: extension, image test, device and time in the name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that count as images.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp"]


def base_name(path: Column) -> Column:
    """Last path segment."""
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; '' when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def is_image(name: Column) -> Column:
    return extension(name).isin(IMAGE_EXTENSIONS)


def name_parts(name: Column) -> Column:
    """struct(device_id, taken_at) of `yyyyMMdd_HHmmss_device.ext`, else null."""
    parts = F.split(name, "_")
    day, time = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    device = F.regexp_replace(F.get(parts, F.lit(2)), r"(?<=.)\.[^.]*$", "")
    fits = (F.size(parts) >= 3) & (F.length(day) == 8) & (F.length(time) == 6)
    taken_at = F.try_to_timestamp(F.concat(day, time), F.lit("yyyyMMddHHmmss"))
    return F.when(fits, F.struct(device.alias("device_id"), taken_at.alias("taken_at")))


def unique_name(original: Column, device_id: Column, at: Column) -> Column:
    """`yyyyMMdd_HHmmss_device.ext` for a new file."""
    kept = F.regexp_extract(original, r"[^/](\.[^./]*)$", 1)
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), device_id, kept)
