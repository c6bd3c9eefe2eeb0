"""The image gallery: raw events with their detections, filtered and paged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import detections as D
from shutterlake.functions.names import base_name
from shutterlake.functions.plans import once
from shutterlake.functions.text import given, not_test_device
from shutterlake.functions.times import as_column, end_of_day
from shutterlake.functions.urls import to_public
from shutterlake.operators import changes

ENRICHED_COLUMNS = [
    "annotated_image_url", "detection_count", "detections", "inference_model",
    "inference_version", "processing_time_ms", "processed_at",
]


def latest_enriched(enriched: DataFrame) -> DataFrame:
    """The latest detection result per (device, shot); rows without a shot cannot be matched."""
    return changes.latest(
        enriched.filter(F.col("shot_id") != ""), ["device_id", "shot_id"],
        ["processed_at", "detection_count", "image_url"],
    ).select("device_id", "shot_id", *ENRICHED_COLUMNS)


def with_detections(
    raw: DataFrame, enriched: DataFrame, keep: Callable[[Column], Column] | None = None, few: bool = False,
) -> DataFrame:
    """Raw events left-joined with their latest detection result.

    With `keep`, a predicate over the parsed detections, only the raw events
    whose result passes remain.

    An empty shot matches nothing. Such rows get a key of their own, so that a
    device which never names its shots does not send them all to one task.
    With `few`, the enriched events are those of a page's shots, and their results are broadcast.
    """
    spread = F.concat(F.lit("-"), F.xxhash64("image_url", "timestamp").cast("string"))
    keyed = raw.withColumn("_key", F.when(F.col("shot_id") != "", F.col("shot_id")).otherwise(spread))
    found = latest_enriched(enriched).withColumnRenamed("shot_id", "_key")
    if keep is not None:
        found = once(found.filter(F.col("detection_count") > 0), _d=D.parse(F.col("detections")))
        found = found.filter(keep(F.col("_d"))).drop("_d")
    left, right = keyed.alias("r"), (F.broadcast(found) if few else found).alias("e")
    matched = left.join(
        right,
        (F.col("r.device_id") == F.col("e.device_id")) & (F.col("r._key") == F.col("e._key"))
        & (F.col("r.shot_id") != ""),
        "left" if keep is None else "inner",
    )
    return matched.select(
        "r.*", F.coalesce("e.detection_count", F.lit(0)).alias("detection_count"),
        *(f"e.{c}" for c in ENRICHED_COLUMNS if c != "detection_count"),
    ).drop("_key")


def _raw_filter(device_id, start_date, end_date, search) -> Column:
    keep = not_test_device(F.col("device_id"))
    if device_id:
        keep = keep & (F.col("device_id") == device_id)
    if start_date and end_date:
        keep = keep & (F.col("timestamp") >= as_column(start_date)) & (F.col("timestamp") <= end_of_day(end_date))
    if search:
        keep = keep & F.lower(base_name(F.col("image_url"))).contains(search.lower())
    return keep


def _object_filter(min_confidence, species) -> Callable[[Column], Column] | None:
    """The predicate over parsed detections, if one is asked for."""
    if min_confidence is None and not species:
        return None

    def keep(parsed: Column) -> Column:
        sure = F.lit(True) if min_confidence is None else D.any_confident(parsed, min_confidence)
        return sure & D.any_species(parsed, species) if species else sure

    return keep


def matching(
    raw: DataFrame, enriched: DataFrame, *, device_id=None, start_date=None, end_date=None,
    search=None, has_detections=None, min_confidence=None, species=None,
) -> DataFrame:
    """All gallery rows passing the filters, before paging."""
    kept = raw.filter(_raw_filter(device_id, start_date, end_date, search))
    rows = with_detections(kept, enriched, _object_filter(min_confidence, species))
    if has_detections is None:
        return rows
    some = F.col("detection_count") > 0
    return rows.filter(some if has_detections else ~some)


# No page is larger, since its rows pass the driver; and pages that skip more rows than this are located by days.
LARGEST_PAGE = 1000
DEEP = 10_000

SORT_COLUMNS = {"timestamp": "timestamp", "detections": "detection_count", "size": "image_size"}


def _order(sort_by: str, descending: bool) -> list[Column]:
    column = SORT_COLUMNS.get(sort_by, "timestamp")
    first = F.desc(column) if descending else F.asc(column)
    return [first, F.asc("device_id"), F.asc("shot_id"), F.asc("image_url"), F.asc("timestamp")]


def page(
    raw: DataFrame, enriched: DataFrame, *, number: int = 1, size: int = 12,
    sort_by: str = "timestamp", descending: bool = True, public_domain: str | None = None, deep: int = DEEP,
    days: DataFrame | None = None, **filters,
) -> DataFrame:
    """One page of shaped gallery rows.

    A page by time that skips more than `deep` rows is located by counts per day (`days` if they are stored
    under the same filters), so that only its own days are sorted.

    When neither filter nor order looks at detections, the page is cut from the
    raw events at once and only its few shots are looked up among the enriched
    ones, so the large join never happens.
    """
    if size > LARGEST_PAGE:
        raise ValueError(f"a page has at most {LARGEST_PAGE} rows, not {size}")

    def cut_page(rows: DataFrame) -> DataFrame:
        if SORT_COLUMNS.get(sort_by, "timestamp") == "timestamp" and (number - 1) * size > deep:
            return changes.page_by_days(rows, "timestamp", order, number, size, descending, days)
        return changes.page(rows, order, number, size)

    by_detections = sort_by == "detections" or any(
        filters.get(name) is not None for name in ("has_detections", "min_confidence", "species")
    )
    order = _order(sort_by, descending)
    if by_detections:
        rows = cut_page(matching(raw, enriched, **filters))
    else:
        kept = raw.filter(_raw_filter(
            filters.get("device_id"), filters.get("start_date"), filters.get("end_date"), filters.get("search")
        ))
        # At most `size` rows, whatever the data: taken once, so that their shots reach the scan of the
        # enriched table as values, and with them its statistics and bloom filters.
        taken = cut_page(kept).collect()
        cut = kept.sparkSession.createDataFrame(taken, kept.schema)
        shots, owners = ({row[name] for row in taken if row["shot_id"]} for name in ("shot_id", "device_id"))
        few = enriched.filter(F.col("shot_id").isin(shots) & F.col("device_id").isin(owners))
        rows = with_detections(cut.coalesce(1), few, few=True).sortWithinPartitions(*order)
    return shaped(rows, public_domain)


def totals(raw: DataFrame, enriched: DataFrame, *, size: int = 12, **filters) -> DataFrame:
    """Total rows and pages under the same filters as the page.

    Each raw row joins at most one result, so without a detection filter the
    count needs no join.
    """
    if any(filters.get(name) is not None for name in ("has_detections", "min_confidence", "species")):
        rows = matching(raw, enriched, **filters)
    else:
        rows = raw.filter(_raw_filter(
            filters.get("device_id"), filters.get("start_date"), filters.get("end_date"), filters.get("search")
        ))
    return changes.page_totals(rows, size)


def shaped(rows: DataFrame, public_domain: str | None = None) -> DataFrame:
    """Gallery columns: id, file name, public URLs and detection fields."""
    some = F.col("detection_count") > 0
    stamp = F.unix_millis("timestamp").cast("string")
    keep = [c for c in ("firmware_version", "ip_address") if c in rows.columns]
    return rows.select(
        F.coalesce(given(F.col("shot_id")), F.concat("device_id", F.lit("_"), stamp)).alias("id"),
        "device_id", base_name(F.col("image_url")).alias("filename"),
        to_public(F.col("image_url"), public_domain).alias("url"),
        F.col("image_size").alias("size"), "timestamp", F.col("image_md5").alias("md5"), "mime_type", *keep,
        some.alias("has_detections"),
        "detection_count",
        F.when(some, to_public(F.col("annotated_image_url"), public_domain)).alias("annotated_url"),
        *(F.when(some, F.col(c)).alias(c) for c in ("inference_model", "inference_version", "processing_time_ms", "processed_at")),
        D.parse(F.when(some, F.col("detections"))).alias("detections"),
    )


def image(raw: DataFrame, enriched: DataFrame, shot_id: str, public_domain: str | None = None) -> DataFrame:
    """One image by its shot; the key filter reaches both scans."""
    found = raw.filter(F.col("shot_id") == shot_id).orderBy(*_order("timestamp", True)).limit(1)
    return shaped(with_detections(found, enriched.filter(F.col("shot_id") == shot_id)), public_domain)


def image_detections(raw: DataFrame, enriched: DataFrame, shot_id: str) -> DataFrame:
    """An image's detections with the model that made them."""
    return image(raw, enriched, shot_id).select(
        "id", "has_detections", "detection_count", "detections", "inference_model",
        "inference_version", "processing_time_ms", "processed_at", "annotated_url",
    )
