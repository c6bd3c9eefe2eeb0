"""Gallery join, predicates, paging and lookup; URL and name columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import names, text, times, urls
from shutterlake.operators import gallery
from shutterlake.plans.registry import AS_OF, query

_BOTH = "events_raw events_enriched objects"
_ORDER = "device_id, shot_id, image_url, timestamp"
_JOINED = """j AS (SELECT r.*, coalesce(e.detection_count, 0) AS detection_count, e.detections, e.annotated_image_url
  FROM events_raw r LEFT JOIN events_enriched e ON r.device_id = e.device_id AND r.shot_id = e.shot_id AND r.shot_id <> '')"""
_ID = "coalesce(nullif(shot_id, ''), concat(device_id, '_', CAST(epoch_us(timestamp) // 1000 AS VARCHAR)))"
_FILE = "regexp_extract(image_url, '[^/]*$')"
_REAL = "lower(device_id) NOT LIKE '%test%'"


@query("j1_raw_with_detections", f"""
WITH {_JOINED} SELECT device_id, shot_id, image_url, timestamp, detection_count, detections FROM j""", _BOTH)
def _(t):
    return gallery.with_detections(t.events_raw, t.events_enriched).select(
        "device_id", "shot_id", "image_url", "timestamp", "detection_count", "detections"
    )


def _page_sql(where: str, order: str, offset: int = 0, size: int = 12) -> str:
    return f"""WITH {_JOINED} SELECT {_ID} AS id, device_id, {_FILE} AS filename, image_size AS size, timestamp,
  detection_count > 0 AS has_detections, detection_count,
  CASE WHEN detection_count > 0 THEN replace(annotated_image_url, 'minio:9000', 'localhost:1442') END AS annotated_url,
  replace(image_url, 'minio:9000', 'localhost:1442') AS url
FROM j WHERE {where} ORDER BY {order}, {_ORDER} LIMIT {size} OFFSET {offset}"""


def _page(t, **options):
    return gallery.page(t.events_raw, t.events_enriched, **options).select(
        "id", "device_id", "filename", "size", "timestamp", "has_detections", "detection_count", "annotated_url", "url"
    )


@query("t2_gallery_page", _page_sql(_REAL, "timestamp DESC"), _BOTH)
def _(t):
    return _page(t)


@query("t2_gallery_page_3_by_size", _page_sql(_REAL, "image_size ASC", 40, 20), _BOTH)
def _(t):
    return _page(t, number=3, size=20, sort_by="size", descending=False)


@query("t2_gallery_deep_page", _page_sql(_REAL, "timestamp DESC", 360, 12), _BOTH)
def _(t):
    return _page(t, number=31, deep=100)


@query("t2_gallery_by_detections", _page_sql(_REAL, "detection_count DESC", 12, 12), _BOTH)
def _(t):
    return _page(t, number=2, sort_by="detections")


@query("t2_gallery_totals", f"""
SELECT count(*) AS total, CAST(ceil(count(*) / 12.0) AS BIGINT) AS total_pages FROM events_raw WHERE {_REAL}""", _BOTH)
def _(t):
    return gallery.totals(t.events_raw, t.events_enriched)


@query("p9_gallery_filters", _page_sql(
    f"{_REAL} AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20 23:59:59.999' AND detection_count = 0",
    "timestamp DESC", 0, 50), _BOTH)
def _(t):
    return _page(t, size=50, start_date="2024-01-05", end_date="2024-01-20", has_detections=False)


@query("p9_gallery_totals_with_detections", f"""
WITH {_JOINED} SELECT count(*) AS total, CAST(ceil(count(*) / 12.0) AS BIGINT) AS total_pages FROM j WHERE {_REAL} AND detection_count > 0""", _BOTH)
def _(t):
    return gallery.totals(t.events_raw, t.events_enriched, has_detections=True)


@query("p10_array_predicates", f"""
WITH {_JOINED} SELECT {_ID} AS id, device_id, image_url, timestamp, detection_count FROM j
WHERE {_REAL} AND shot_id <> '' AND shot_id IN (SELECT shot_id FROM objects WHERE confidence >= 0.8)
  AND shot_id IN (SELECT shot_id FROM objects WHERE lower(species) IN ('bee', 'moth')) AND lower({_FILE}) LIKE '%7%'""", _BOTH)
def _(t):
    rows = gallery.matching(
        t.events_raw, t.events_enriched, min_confidence=0.8, species="BEE, moth", search="7"
    )
    return gallery.shaped(rows).select(
        "id", "device_id", F.col("url").alias("image_url"), "timestamp", "detection_count"
    ).withColumn("image_url", F.replace("image_url", F.lit("localhost:1442"), F.lit("minio:9000")))


@query("p13_gallery_rows", f"""
WITH {_JOINED} SELECT {_ID} AS id, {_FILE} AS filename, timestamp, detection_count > 0 AS has_detections,
  CASE WHEN detection_count > 0 THEN detection_count ELSE 0 END AS objects FROM j""", _BOTH)
def _(t):
    rows = gallery.shaped(gallery.with_detections(t.events_raw, t.events_enriched))
    return rows.select("id", "filename", "timestamp", "has_detections", F.size("detections").alias("objects"))


_SHOT = "shot-430"


@query("t9_image_by_shot", f"""
WITH {_JOINED} SELECT shot_id AS id, device_id, timestamp, firmware_version, ip_address, detection_count
FROM j WHERE shot_id = '{_SHOT}' ORDER BY timestamp DESC LIMIT 1""", _BOTH)
def _(t):
    return gallery.image(t.events_raw, t.events_enriched, _SHOT).select(
        "id", "device_id", "timestamp", "firmware_version", "ip_address", "detection_count"
    )


@query("p19_image_detections", f"""
SELECT shot_id AS id, pos, species, confidence, 'yolov8n' AS inference_model FROM objects WHERE shot_id = '{_SHOT}'""", _BOTH)
def _(t):
    found = gallery.image_detections(t.events_raw, t.events_enriched, _SHOT)
    return found.select("id", "inference_model", F.posexplode("detections").alias("pos", "d")).select(
        "id", "pos", F.col("d.class").alias("species"), F.col("d.confidence").alias("confidence"), "inference_model"
    )


# ---- columns ------------------------------------------------------------

@query("f1_device_timestamp", """
SELECT seq, copy, CASE WHEN seq % 3 = 0 THEN CAST(date_trunc('second', arrived_at) AS TIMESTAMP)
  ELSE TIMESTAMP '2024-01-01' + to_seconds(CAST(seq * 60 AS DOUBLE)) END AS ts FROM uploads""", "uploads")
def _(t):
    return t.uploads.select("seq", "copy", times.device_timestamp(F.col("ts_raw"), AS_OF).alias("ts"))


@query("f2_format_timestamp", """
SELECT image_url, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%g') AS text FROM events_raw""", "events_raw")
def _(t):
    return t.events_raw.select("image_url", times.format_timestamp(F.col("timestamp")).alias("text"))


@query("f4_sizes", """
SELECT image_url, timestamp, image_size / 1048576.0::DOUBLE AS mb,
  CASE WHEN image_size < 1024 THEN concat(CAST(image_size AS VARCHAR), ' Bytes')
    WHEN image_size < 1048576 THEN concat(regexp_replace(CAST(round(image_size / 1024.0::DOUBLE, 2) AS VARCHAR), '\\.?0+$', ''), ' KB')
    ELSE concat(regexp_replace(CAST(round(image_size / 1048576.0::DOUBLE, 2) AS VARCHAR), '\\.?0+$', ''), ' MB') END AS label
FROM (SELECT image_url, timestamp, image_size * 7 AS image_size FROM events_raw)""", "events_raw")
def _(t):
    size = F.col("image_size") * 7
    return t.events_raw.select(
        "image_url", "timestamp", (size / 1048576.0).alias("mb"), text.human_size(size).alias("label")
    )


@query("f5_rounding", """
SELECT shot_id, pos, species, round(confidence * 0.37, 1) AS r1, round(confidence * 0.37, 2) AS r2, round(confidence * 0.37, 3) AS r3
FROM objects""", "objects")
def _(t):
    x = F.col("confidence") * 0.37
    return t.objects.select("shot_id", "pos", "species", *(F.round(x, n).alias(f"r{n}") for n in (1, 2, 3)))


@query("f6_object_key", """
WITH u AS (SELECT row_number() OVER () AS n, image_url, regexp_extract(image_url, 'iot-raw/(.*)$', 1) AS key FROM events_raw)
SELECT image_url AS url, key FROM u UNION ALL SELECT concat('iot-raw/', key), key FROM u UNION ALL SELECT key, key FROM u
UNION ALL SELECT concat('http://pub.example/api/v1/buckets/iot-raw/objects/download?preview=true&prefix=', base64(encode(key)), '&version_id=null'), key FROM u""", "events_raw")
def _(t):
    key = F.regexp_extract("image_url", "iot-raw/(.*)$", 1)
    forms = F.array(F.col("image_url"), F.concat(F.lit("iot-raw/"), key), key, urls.public_url(key, "pub.example"))
    return t.events_raw.select(F.explode(forms).alias("url")).select("url", urls.object_key(F.col("url")).alias("key"))


@query("f6_key_after_bucket", """
SELECT concat(image_url, '?X-Amz-Date=1') AS url, regexp_extract(image_url, 'iot-raw/(.*)$', 1) AS key FROM events_raw""", "events_raw")
def _(t):
    url = F.concat("image_url", F.lit("?X-Amz-Date=1"))
    return t.events_raw.select(url.alias("url"), urls.key_after_bucket(url).alias("key"))


@query("f7_public_url", """
SELECT image_url, timestamp, concat('https://pub.example/api/v1/buckets/iot-raw/objects/download?preview=true&prefix=',
  base64(encode(regexp_extract(image_url, 'iot-raw/(.*)$', 1))), '&version_id=null') AS url,
  replace(image_url, 'http://minio:9000', 'http://localhost:1442') AS fallback FROM events_raw""", "events_raw")
def _(t):
    url = F.col("image_url")
    return t.events_raw.select(
        "image_url", "timestamp", urls.to_public(url, "https://pub.example").alias("url"),
        urls.to_public(F.concat(url, F.lit("?sig=1"))).alias("fallback"),
    )


@query("f8_capture_key", """
SELECT image_url, timestamp, concat('raw/', strftime(timestamp, '%Y/%m/%d'), '/', device_id, '/', CAST(epoch_us(received_at) // 1000 AS VARCHAR), '_',
  CASE WHEN shot_id = '' THEN 'na' ELSE right(shot_id, 6) END, '.jpg') AS key,
  concat(device_id, '/', strftime(timestamp, '%Y-%m-%d_%H-%M-%S'), 'Z_', shot_id, '_annotated.jpg') AS annotated FROM events_raw""", "events_raw")
def _(t):
    at = F.col("timestamp")
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.events_raw.select(
        "image_url", "timestamp",
        urls.capture_key(F.col("device_id"), at, F.col("received_at"), F.col("shot_id")).alias("key"),
        urls.annotated_key(F.col("device_id"), iso, F.col("shot_id")).alias("annotated"),
    )


@query("f9_file_names", """
SELECT name, device_id, taken_at, lower(regexp_extract(name, '\\.[a-zA-Z]+$')) AS extension,
  lower(name) LIKE '%.jpg' OR lower(name) LIKE '%.jpeg' AS image
FROM (SELECT concat(strftime(timestamp, '%Y%m%d_%H%M%S'), '_', device_id,
    CASE image_size % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' ELSE '.txt' END) AS name,
  device_id, CAST(date_trunc('second', timestamp) AS TIMESTAMP) AS taken_at FROM events_raw)""", "events_raw")
def _(t):
    ending = F.element_at(F.array(F.lit("x.JPG"), F.lit("x.jpeg"), F.lit("x.txt")), (F.col("image_size") % 3 + 1).cast("int"))
    name = names.unique_name(ending, F.col("device_id"), F.col("timestamp"))
    rows = t.events_raw.select(name.alias("name"))
    return rows.select(
        "name", names.name_parts(F.col("name")).alias("p"), names.extension(F.col("name")).alias("extension"),
        names.is_image(F.col("name")).alias("image"),
    ).select("name", "p.device_id", "p.taken_at", "extension", "image")


@query("f10_url_repair", """
SELECT replace(image_url, ':9002', ':9000') AS old, image_url AS moved, false AS signed,
  regexp_extract(image_url, 'iot-raw/(.*)$', 1) AS key FROM project_images
UNION ALL SELECT concat(image_url, '?X-Amz-Date=1'), concat(image_url, '?X-Amz-Date=1'), true, NULL FROM project_images""", "project_images")
def _(t):
    old = F.array(F.replace("image_url", F.lit(":9002"), F.lit(":9000")), F.concat("image_url", F.lit("?X-Amz-Date=1")))
    rows = t.project_images.select(F.explode(old).alias("old"))
    url = F.col("old")
    return rows.select(
        "old", urls.move_host(url).alias("moved"), urls.is_signed(url).alias("signed"), urls.signable_key(url).alias("key")
    )


@query("f11_digests", """
SELECT image_url, timestamp, md5(image_url) AS md5, sha256(image_url) AS sha256 FROM events_raw""", "events_raw")
def _(t):
    url = F.encode("image_url", "UTF-8")
    return t.events_raw.select(
        "image_url", "timestamp", text.md5_hex(url).alias("md5"), text.sha256_hex(url).alias("sha256")
    )


@query("f12_tolerant_json", """
SELECT seq, CASE WHEN seq % 3 = 0 THEN json_extract_string(props, '$.k') END AS k,
  CASE WHEN seq % 3 = 1 THEN concat('note ', CAST(seq AS VARCHAR)) END AS raw, CASE WHEN seq % 3 = 2 THEN 0 ELSE 1 END AS entries
FROM (SELECT event_id AS seq, props FROM events)""", "src")
def _(t):
    number = F.col("event_id")
    raw = F.when(number % 3 == 0, F.col("props")).when(
        number % 3 == 1, F.concat(F.lit("note "), number.cast("string"))
    ).otherwise("")
    rows = t.src.filter("copy = 0").select(number.alias("seq"), text.tolerant_json(raw).alias("m"))
    return rows.select("seq", F.col("m")["k"].alias("k"), F.col("m")["raw"].alias("raw"), F.size("m").alias("entries"))


@query("f13_detections_array", """
SELECT o.shot_id, o.device_id, o.timestamp, pos, species AS class, confidence FROM objects o
UNION ALL SELECT shot_id, device_id, timestamp, -1, NULL, NULL FROM events_enriched WHERE detection_count = 0""", _BOTH)
def _(t):
    from shutterlake.functions import detections as D

    # A row whose text is broken counts as one without detections.
    damaged = F.when(F.col("detection_count") == 0, F.lit("[{broken")).otherwise(F.col("detections"))
    rows = t.events_enriched.select(
        "shot_id", "device_id", "timestamp", F.posexplode_outer(D.parse(damaged)).alias("pos", "d")
    )
    return rows.select(
        "shot_id", "device_id", "timestamp", F.coalesce("pos", F.lit(-1)).alias("pos"),
        F.col("d.class").alias("class"), F.col("d.confidence").alias("confidence"),
    )


@query("f14_array_functions", """
SELECT shot_id, device_id, timestamp, max(confidence) AS top, bool_or(lower(species) = 'bee') AS bee,
  string_agg(DISTINCT species, ',' ORDER BY species) AS species, string_agg(species, ', ' ORDER BY pos) AS listed
FROM objects GROUP BY ALL""", "objects")
def _(t):
    from shutterlake.functions import detections as D

    d = D.parse(F.col("detections"))
    return t.events_enriched.filter("detection_count > 0").select(
        "shot_id", "device_id", "timestamp", D.max_confidence(d).alias("top"),
        D.any_species(d, ["Bee"]).alias("bee"), F.array_join(D.distinct_species(d), ",").alias("species"),
        D.class_list(d).alias("listed"),
    )


@query("f16_client_address", """
SELECT image_url, timestamp, CASE WHEN image_size % 2 = 0 THEN concat('10.0.0.', CAST(image_size % 200 AS VARCHAR)) ELSE ip_address END AS ip
FROM events_raw""", "events_raw")
def _(t):
    listed = F.concat(F.lit(" 10.0.0."), (F.col("image_size") % 200).cast("string"), F.lit(" , 1.1.1.1"))
    forwarded = F.when(F.col("image_size") % 2 == 0, listed).otherwise("")
    return t.events_raw.select(
        "image_url", "timestamp", text.client_address(forwarded, F.col("ip_address")).alias("ip")
    )
