"""Bounding-box conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corner_to_size(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(x, y, width, height, area) of a box given by its corners."""
    width, height = x2 - x1, y2 - y1
    return F.struct(
        x1.alias("x"), y1.alias("y"), width.alias("width"), height.alias("height"),
        (width * height).alias("area"),
    )


def corner_to_centre(
    x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column
) -> Column:
    """struct(xc, yc, w, h) relative to the image size."""
    return F.struct(
        ((x1 + x2) / 2.0 / width).alias("xc"), ((y1 + y2) / 2.0 / height).alias("yc"),
        ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h"),
    )


def size_to_corner(value: Column) -> Column:
    """[x, y, x+width, y+height]; a missing number counts 0."""
    x, y, width, height = (F.coalesce(value[n], F.lit(0.0)) for n in ("x", "y", "width", "height"))
    return F.array(x, y, x + width, y + height)


def yolo_line(class_id: Column, centre: Column) -> Column:
    """`class xc yc w h` with six decimals."""
    return F.format_string(
        "%d %.6f %.6f %.6f %.6f", class_id, centre["xc"], centre["yc"], centre["w"], centre["h"]
    )
