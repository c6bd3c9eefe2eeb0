"""Labelling, exports, table upkeep, inventory, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import boxes
from shutterlake.operators import changes, labeling, maintain, rollups, scoring
from shutterlake.plans.fixtures import CLASSES_SQL
from shutterlake.plans.stand_in import stub_detector
from shutterlake.plans.registry import AS_OF, query
from shutterlake.sources import images as image_store
from shutterlake.sources import streams

_USES = "labeling_projects project_images annotations"
_RANK = "row_number() OVER (PARTITION BY project_id ORDER BY md5(image_id), image_id)"
_LIST = f"list_position([{CLASSES_SQL}], class)"


def _projects(t):
    return t.labeling_projects.withColumn("class_names", F.split("class_names", ","))


@query("j4_addable_annotations", """
SELECT DISTINCT r.project_id, r.image_id FROM project_images r
WHERE r.project_id IN ('p0', 'p1') AND NOT EXISTS (SELECT 1 FROM annotations a WHERE a.project_id = r.project_id AND a.image_id = r.image_id AND a.status <> 'draft')""", _USES)
def _(t):
    # Requests for every image, twice, and for images nobody has; p2 is gone.
    wanted = t.project_images.select("project_id", "image_id")
    strays = wanted.withColumn("image_id", F.concat(F.lit("no-"), "image_id"))
    requested = wanted.unionByName(wanted).unionByName(strays)
    projects = t.labeling_projects.filter("project_id <> 'p2'")
    present = t.annotations.filter("status <> 'draft'")
    made = labeling.addable_annotations(requested, projects, t.project_images, present)
    return made.select("project_id", "image_id")


@query("j4_addable_images", """
SELECT project_id, image_id FROM project_images WHERE status <> 'completed'""", _USES)
def _(t):
    present = t.project_images.filter("status = 'completed'")
    rows = t.project_images.select("project_id", "image_id")
    return labeling.addable_images(rows.unionByName(rows), t.labeling_projects, present)


@query("j5_annotated_images", """
SELECT a.project_id, a.image_id, a.class, i.image_url, i.width, i.height FROM annotations a JOIN project_images i USING (project_id, image_id)
WHERE a.status IN ('approved', 'submitted')""", _USES)
def _(t):
    images = t.project_images.select("project_id", "image_id", "image_url", "width", "height")
    return labeling.export_annotations(t.annotations).join(images, labeling.IMAGE_KEY).select(
        "project_id", "image_id", "class", "image_url", "width", "height"
    )


@query("j6_category_ids", f"""
SELECT project_id, image_id, class, {_LIST} AS coco_id, coalesce({_LIST} - 1, 0) AS yolo_id FROM annotations""", _USES)
def _(t):
    dimension = labeling.class_dimension(_projects(t))
    return t.annotations.join(dimension, ["project_id", "class"], "left").select(
        "project_id", "image_id", "class", (F.col("first_pos") + 1).alias("coco_id"),
        F.coalesce("last_pos", F.lit(0)).alias("yolo_id"),
    )


@query("j7_cascade_delete", """
SELECT project_id, image_id FROM annotations a WHERE project_id <> 'p1'
  AND EXISTS (SELECT 1 FROM project_images i WHERE i.project_id = a.project_id AND i.image_id = a.image_id AND i.status <> 'rejected')""", _USES)
def _(t):
    left = labeling.without_projects(t.annotations, t.labeling_projects.filter("project_id = 'p1'"))
    return labeling.without_images(left, t.project_images.filter("status = 'rejected'")).select("project_id", "image_id")


@query("a23_project_progress", """
SELECT i.project_id, count(*) AS total_images, count(*) FILTER (i.status = 'completed') AS annotated_images,
  count(*) FILTER (a.status = 'approved') AS reviewed_images
FROM project_images i LEFT JOIN annotations a USING (project_id, image_id) GROUP BY i.project_id""", _USES)
def _(t):
    return labeling.progress(t.project_images, t.annotations)


@query("t5_project_list", """
SELECT project_id, name, labeling_projects.status, min(created_at) AS created_at, count(*) AS total_images FROM labeling_projects JOIN project_images USING (project_id)
WHERE labeling_projects.status IN ('active', 'draft') GROUP BY ALL ORDER BY created_at DESC, project_id LIMIT 2""",
       _USES)
def _(t):
    # Projects as old as their first image.
    begun = t.project_images.groupBy("project_id").agg(F.min("created_at").alias("created_at"), F.count("*").alias("total_images"))
    known = t.labeling_projects.filter("status <> 'completed'").join(begun, "project_id")
    return labeling.project_list(known, n=2).select("project_id", "name", "status", "created_at", "total_images")


@query("t5_image_page", """
SELECT project_id, image_id, status, created_at FROM project_images WHERE project_id = 'p1' AND status = 'pending'
ORDER BY created_at DESC, image_id LIMIT 50 OFFSET 10""", _USES)
def _(t):
    return labeling.image_page(t.project_images, "p1", "pending", skip=10).select(
        "project_id", "image_id", "status", "created_at"
    )


@query("t5_annotation_list", """
SELECT a.project_id, a.image_id, a.class FROM annotations a JOIN project_images i USING (project_id, image_id)
WHERE a.project_id = 'p0' AND a.status = 'draft' ORDER BY i.created_at DESC, a.image_id LIMIT 1000""", _USES)
def _(t):
    times = t.project_images.select("project_id", "image_id", "created_at")
    rows = t.annotations.join(times, labeling.IMAGE_KEY)
    return labeling.annotation_list(rows, "p0", "draft").select("project_id", "image_id", "class")


@query("d1_export_input", """
SELECT project_id, image_id, class, x1, y1, x2, y2 FROM annotations WHERE status IN ('approved', 'submitted')""", _USES)
def _(t):
    return labeling.export_annotations(t.annotations).drop("status")


@query("d2_coco_images", f"""
SELECT project_id, {_RANK} AS id, width, height, regexp_extract(image_url, '[^/]*$') AS file_name, image_url AS coco_url,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS date_captured FROM project_images""", _USES)
def _(t):
    return labeling.coco_images(t.project_images).drop("image_id", "license", "flickr_url")


@query("d2_coco_annotations", f"""
WITH i AS (SELECT project_id, image_id, {_RANK} AS coco_image FROM project_images)
SELECT a.project_id, i.coco_image AS image_id, {_LIST} AS category_id, concat_ws(',', CAST(x1 AS INT), CAST(y1 AS INT), CAST(x2 - x1 AS INT), CAST(y2 - y1 AS INT)) AS bbox,
  (x2 - x1) * (y2 - y1) AS area, 0 AS iscrowd,
  row_number() OVER (PARTITION BY a.project_id ORDER BY md5(concat_ws('|', a.image_id, x1, y1, x2, y2, class))) AS id
FROM annotations a JOIN i USING (project_id, image_id) WHERE a.status IN ('approved', 'submitted') AND class <> 'unlisted'""", _USES)
def _(t):
    rows = labeling.coco_annotations(t.project_images, t.annotations, _projects(t)).drop("segmentation")
    return rows.withColumn("bbox", F.array_join(F.transform("bbox", lambda x: x.cast("int").cast("string")), ","))


@query("d2_coco_categories", f"""
SELECT project_id, CAST(id AS INT) AS id, [{CLASSES_SQL}][id] AS name, 'none' AS supercategory
FROM labeling_projects, unnest([1, 2, 3, 4, 5]) AS c(id)""", _USES)
def _(t):
    return labeling.categories(_projects(t))


@query("d2_coco_used_categories", f"""
SELECT a.project_id, CAST({_LIST} AS INT) AS id, class AS name, count(*) AS boxes FROM annotations a
WHERE status IN ('approved', 'submitted') AND class <> 'unlisted' GROUP BY ALL""", _USES)
def _(t):
    return labeling.used_categories(t.annotations, _projects(t))


@query("d2_coco_header", """
SELECT project_id, 'info' AS relation, concat('{"description":"', project_id, '","version":"1.0","year":2024,"date_created":"2024-01-30"}') AS line FROM (SELECT DISTINCT project_id FROM project_images)
UNION ALL SELECT project_id, 'licenses', '{"id":1,"name":"Unknown","url":""}' FROM (SELECT DISTINCT project_id FROM project_images)""", _USES)
def _(t):
    used = _projects(t).join(t.project_images, "project_id", "left_semi")
    return labeling.coco_header(used, AS_OF)


@query("d2_coco_lines", f"""
WITH i AS (SELECT *, {_RANK} AS coco_image, regexp_extract(image_url, '[^/]*$') AS file FROM project_images),
a AS (SELECT a.*, i.coco_image, {_LIST} AS cat, row_number() OVER (PARTITION BY a.project_id ORDER BY md5(concat_ws('|', a.image_id, x1, y1, x2, y2, class))) AS id
  FROM annotations a JOIN i USING (project_id, image_id) WHERE a.status IN ('approved', 'submitted') AND class <> 'unlisted')
SELECT project_id, 'info' AS relation, concat('{{"description":"', project_id, '","version":"1.0","year":2024,"date_created":"2024-01-30"}}') AS line FROM labeling_projects
UNION ALL SELECT project_id, 'licenses', '{{"id":1,"name":"Unknown","url":""}}' FROM labeling_projects
UNION ALL SELECT project_id, 'images', concat('{{"id":', coco_image, ',"width":', width, ',"height":', height, ',"file_name":"', file, '","license":1,"flickr_url":"',
  image_url, '","coco_url":"', image_url, '","date_captured":"', strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '"}}') FROM i
UNION ALL SELECT project_id, 'annotations', concat('{{"id":', id, ',"image_id":', coco_image, ',"category_id":', cat, ',"bbox":[', x1, ',', y1, ',', x2 - x1, ',', y2 - y1,
  '],"area":', (x2 - x1) * (y2 - y1), ',"iscrowd":0,"segmentation":[]}}') FROM a
UNION ALL SELECT project_id, 'categories', concat('{{"id":', id, ',"name":"', [{CLASSES_SQL}][id], '","supercategory":"none"}}')
  FROM labeling_projects, unnest([1, 2, 3, 4, 5]) AS c(id)""", _USES)
def _(t):
    return labeling.coco_lines(t.project_images, t.annotations, _projects(t), AS_OF)


@query("d3_yolo_labels", f"""
SELECT i.project_id, i.image_id, coalesce(string_agg(printf('%d %.6f %.6f %.6f %.6f', coalesce({_LIST} - 1, 0), (x1 + x2) / 2.0::DOUBLE / width, (y1 + y2) / 2.0::DOUBLE / height, (x2 - x1) / width, (y2 - y1) / height), chr(10)), '') AS label
FROM project_images i LEFT JOIN annotations a ON a.project_id = i.project_id AND a.image_id = i.image_id AND a.status IN ('approved', 'submitted') GROUP BY ALL""", _USES)
def _(t):
    return labeling.yolo_labels(t.project_images, t.annotations, _projects(t)).drop("image_url")


@query("d4_dataset_split", f"""
WITH r AS (SELECT project_id, image_id, {_RANK} AS rank, count(*) OVER (PARTITION BY project_id) AS n FROM project_images)
SELECT project_id, image_id, CASE WHEN rank <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rank <= floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""", _USES)
def _(t):
    return labeling.split(t.project_images).select("project_id", "image_id", "split")


@query("d4_split_annotations", f"""
WITH r AS (SELECT project_id, image_id, {_RANK} AS rank, count(*) OVER (PARTITION BY project_id) AS n FROM project_images)
SELECT a.project_id, a.image_id, a.class, CASE WHEN rank <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rank <= floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM annotations a JOIN r USING (project_id, image_id)""", _USES)
def _(t):
    parts = labeling.split(t.project_images)
    return labeling.split_annotations(t.annotations, parts).select("project_id", "image_id", "class", "split")


def _exports(t):
    """The annotations as a labelling tool would export them, with two boxes on every third image."""
    box = F.struct(F.struct(
        F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"),
        (F.col("y2") - F.col("y1")).alias("height"),
        F.when(F.col("class") != "unlisted", F.array("class")).otherwise(F.array().cast("array<string>")).alias("rectanglelabels"),
    ).alias("value"))
    twice = F.when(F.col("x1") % 3 == 0, F.array(box, box)).otherwise(F.array(box))
    task = F.struct(F.col("image_id").alias("id"), F.struct(F.lit("u").alias("image")).alias("data"))
    text = F.to_json(F.struct(twice.alias("result"), task.alias("task")))
    rows = t.annotations.select("project_id", F.from_json(text, labeling.LABELSTUDIO_EXPORT).alias("e"))
    return rows.select("project_id", "e.*")


@query("d5_imported_annotations", """
SELECT image_id, pos, x1, y1, x2, y2, CASE WHEN class = 'unlisted' THEN 'object' ELSE class END AS class, 'submitted' AS status, 'labelstudio' AS source
FROM annotations, unnest([0, 1]) AS b(pos) WHERE pos = 0 OR x1 % 3 = 0""", _USES)
def _(t):
    return labeling.imported_annotations(_exports(t)).drop("image_url")


@query("d6_upserted_annotations", """
SELECT project_id, image_id, CASE WHEN project_id = 'p0' AND class = 'unlisted' THEN 'object' ELSE class END AS class,
  CASE WHEN project_id = 'p0' THEN 'submitted' ELSE status END AS status FROM annotations""", _USES)
def _(t):
    merged = labeling.upsert_imported(t.annotations, labeling.imported_annotations(_exports(t).filter("project_id = 'p0'")), "p0")
    return merged.select("project_id", "image_id", "class", "status")


@query("d7_labelling_tasks", """
SELECT project_id, image_id, concat('{"data":{"image":"', image_url, '"}}') AS task FROM project_images""", _USES)
def _(t):
    return labeling.labelling_tasks(t.project_images)


@query("d7_label_config", """
SELECT project_id, concat('<View>', chr(10), '  <Image name="image" value="$image"/>', chr(10), '  <RectangleLabels name="label" toName="image">', chr(10),
  string_agg(concat('    <Label value="', c, '" background="red"/>'), chr(10) ORDER BY pos), chr(10), '  </RectangleLabels>', chr(10), '</View>') AS config
FROM (SELECT project_id, unnest(string_split(class_names, ',')) AS c, unnest([1, 2, 3, 4, 5]) AS pos FROM labeling_projects JOIN (SELECT DISTINCT project_id FROM project_images) USING (project_id)) GROUP BY project_id""", _USES)
def _(t):
    used = _projects(t).join(t.project_images, "project_id", "left_semi")
    return used.select("project_id", labeling.label_config(F.col("class_names")).alias("config"))


@query("d8_image_status", """
SELECT i.project_id, i.image_id, CASE WHEN a.status = 'approved' THEN 'completed' WHEN a.status IS NOT NULL THEN 'annotating' ELSE i.status END AS status
FROM project_images i LEFT JOIN (SELECT * FROM annotations WHERE status <> 'draft') a USING (project_id, image_id)""", _USES)
def _(t):
    return labeling.image_status(t.project_images, t.annotations.filter("status <> 'draft'")).select(
        "project_id", "image_id", "status"
    )


@query("d8_explicit_status", """
SELECT i.project_id, i.image_id, CASE WHEN i.status IN ('reviewing', 'rejected') AND (a.status IS NULL OR x1 % 2 = 0) THEN i.status
  WHEN a.status = 'approved' THEN 'completed' WHEN a.status IS NOT NULL THEN 'annotating' ELSE i.status END AS status
FROM project_images i LEFT JOIN (SELECT * FROM annotations WHERE status <> 'draft') a USING (project_id, image_id)""", _USES)
def _(t):
    # Reviews are set by hand at noon; every other annotation was changed later than that.
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp")
    marks = t.annotations.filter("status <> 'draft'").withColumn(
        "changed_at", F.when(F.col("x1") % 2 == 0, noon - F.expr("INTERVAL 1 HOUR")).otherwise(noon + F.expr("INTERVAL 1 HOUR")))
    by_hand = t.project_images.filter("status in ('reviewing', 'rejected')").select(
        "project_id", "image_id", "status", noon.alias("changed_at"))
    wrong = by_hand.withColumn("status", F.lit("nonsense")).withColumn("changed_at", F.col("changed_at") + F.expr("INTERVAL 1 DAY"))
    found = labeling.image_status_changed(t.project_images, marks, by_hand.unionByName(wrong))
    return found.select("project_id", "image_id", "status")


@query("d8_bad_status", """
SELECT image_id, status FROM project_images WHERE status IN ('annotating', 'reviewing', 'completed', 'pending')""", _USES)
def _(t):
    # Image statuses are checked as if they were annotation statuses.
    return labeling.bad_status(t.project_images, "annotation").select("image_id", "status")


@query("d9_project_changes", """
SELECT 'pr-' || device_id AS project_id, max(status) FILTER (created_at = last) AS status, 'object_detection' AS annotation_type, 'system' AS created_by, first AS created_at, last AS updated_at
FROM (SELECT *, min(created_at) OVER w AS first, max(created_at) OVER w AS last FROM project_images WINDOW w AS (PARTITION BY device_id)) GROUP BY device_id, first, last""", _USES)
def _(t):
    none = F.lit(None)
    rows = t.project_images.select(
        F.concat(F.lit("pr-"), "device_id").alias("project_id"), F.col("created_at").alias("changed_at"),
        F.col("image_id").alias("seq"), "status", F.lit("update").alias("op"),
    )
    first = rows.groupBy("project_id").agg(F.min("changed_at").alias("changed_at")).withColumns({
        "seq": F.lit(""), "status": none.cast("string"), "op": F.lit("create"),
    })
    all_rows = rows.unionByName(first).withColumns({
        "name": F.lit("n"), "description": none.cast("string"), "annotation_type": none.cast("string"),
        "class_names": none.cast("array<string>"), "created_by": none.cast("string"),
    })
    return labeling.current_projects(all_rows).select(
        "project_id", "status", "annotation_type", "created_by", "created_at", "updated_at"
    )


@query("d9_duplicate_names", """
SELECT device_id AS name, count(*) AS projects FROM project_images GROUP BY 1 HAVING count(*) > 1""", _USES)
def _(t):
    return labeling.duplicate_names(t.project_images.withColumnRenamed("device_id", "name"))


@query("f15_boxes", """
SELECT image_id, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area,
  (x1 + x2) / 2.0::DOUBLE / 640 AS xc, (y1 + y2) / 2.0::DOUBLE / 480 AS yc, (x2 - x1) / 640 AS w, (y2 - y1) / 480 AS h,
  x1 + x2 - x1 AS corner_x, y1 + y2 - y1 AS corner_y FROM annotations""", _USES)
def _(t):
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    rows = t.annotations.select(
        "image_id", boxes.corner_to_size(*corners).alias("s"),
        boxes.corner_to_centre(*corners, F.lit(640), F.lit(480)).alias("c"),
    )
    back = boxes.size_to_corner(F.col("s"))
    return rows.select("image_id", "s.*", "c.*", back[2].alias("corner_x"), back[3].alias("corner_y"))


# ---- upkeep -------------------------------------------------------------

@query("r2_latest_per_key", """
SELECT device_id, shot_id, timestamp, image_size FROM events_raw
QUALIFY row_number() OVER (PARTITION BY device_id, shot_id ORDER BY timestamp DESC, image_url DESC) = 1""", "events_raw")
def _(t):
    rows = changes.latest(t.events_raw, ["device_id", "shot_id"], ["timestamp", "image_url"])
    return rows.select("device_id", "shot_id", "timestamp", "image_size")


@query("r3_unexpired", """
SELECT device_id, timestamp, image_url FROM events_raw WHERE CAST(received_at AS DATE) >= DATE '2024-04-15' - 90""", "events_raw")
def _(t):
    rows = t.events_raw.withColumn("processing_date", F.to_date("received_at"))
    return maintain.unexpired(rows, "events_raw", "2024-04-15 10:00:00").select("device_id", "timestamp", "image_url")


@query("w1_latest_daily_row", """
SELECT device_id, CAST(timestamp AS DATE) AS date, count(*) AS total_images FROM events_raw GROUP BY ALL""", "events_raw")
def _(t):
    # A first insert of half the rows, then the whole: the later version stays.
    half = rollups.device_stats_daily(t.events_raw.filter("image_size % 2 = 0")).withColumn("version", F.lit(1))
    whole = rollups.device_stats_daily(t.events_raw).withColumn("version", F.lit(2))
    rows = maintain.latest_per_key(half.unionByName(whole), "device_stats_daily", ["version"])
    return rows.select("device_id", "date", "total_images")


# ---- inventory and scoring ----------------------------------------------

def _files(t):
    """Image files as a listing would show them: device/yyyy/MM/dd/name."""
    at = F.col("timestamp")
    name = F.when(F.col("image_size") % 2 == 0, F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), "device_id", F.lit(".jpg")))
    other = F.concat(F.col("image_size").cast("string"), F.lit(".jpeg"))
    return t.events_raw.select(
        F.concat_ws("/", F.lit("file:/data/uploads"), "device_id", F.date_format(at, "yyyy/MM/dd"), F.coalesce(name, other)).alias("path"),
        F.col("received_at").alias("modificationTime"), F.col("image_size").alias("length"),
    )


_FILE_SQL = """f AS (SELECT device_id, image_size AS size, received_at AS updated_at,
    CASE WHEN image_size % 2 = 0 THEN CAST(date_trunc('second', timestamp) AS TIMESTAMP) ELSE received_at END AS created_at,
    concat('/uploads/', device_id, '/', strftime(timestamp, '%Y/%m/%d'), '/',
      CASE WHEN image_size % 2 = 0 THEN concat(strftime(timestamp, '%Y%m%d_%H%M%S'), '_', device_id, '.jpg') ELSE concat(image_size, '.jpeg') END) AS url
  FROM events_raw WHERE device_id NOT ILIKE '%test%')"""


@query("s9_image_inventory", f"""
WITH {_FILE_SQL} SELECT device_id, size, created_at, updated_at, url FROM f""", "events_raw")
def _(t):
    return image_store.inventory(_files(t)).select("device_id", "size", "created_at", "updated_at", "url")


@query("t10_inventory_page", f"""
WITH {_FILE_SQL} SELECT device_id, size, url FROM f ORDER BY size DESC, url LIMIT 12 OFFSET 12""", "events_raw")
def _(t):
    return image_store.inventory_page(image_store.inventory(_files(t)), 2, sort_by="size").select("device_id", "size", "url")


@query("s10_sidecar_join", """
SELECT DISTINCT device_id, concat('raw/', strftime(timestamp, '%Y/%m/%d'), '/', device_id, '/', CASE WHEN image_size % 2 = 0
  THEN concat(strftime(timestamp, '%Y%m%d_%H%M%S'), '_', device_id, '.jpg') ELSE concat(image_size, '.jpeg') END) AS object_key
FROM events_raw WHERE image_size % 3 = 0""", "events_raw")
def _(t):
    files = _files(t).dropDuplicates(["path"])
    sidecars = files.filter("length % 3 = 0").select(
        F.regexp_replace("path", r"\.[^.]*$", ".json").alias("path"),
        F.regexp_extract("path", "uploads/([^/]*)", 1).alias("deviceId"), F.lit("1").alias("ts"),
        F.lit(None).cast("string").alias("shotId"),
    ).dropDuplicates(["path"])
    return image_store.with_sidecars(files, sidecars).select("device_id", "object_key")


@query("s11_objects_of_day", """
SELECT CAST(image_size AS VARCHAR) AS image_id, concat('http://localhost:9002/iot-raw/', object_key) AS image_url
FROM (SELECT image_size, concat('raw/', strftime(timestamp, '%Y/%m/%d'), '/all/', image_size, '.jpg') AS object_key FROM events_raw)
WHERE object_key LIKE 'raw/2024/01/10/all/%' ORDER BY object_key LIMIT 100""", "events_raw")
def _(t):
    key = F.concat(F.lit("raw/"), F.date_format("timestamp", "yyyy/MM/dd"), F.lit("/all/"), F.col("image_size").cast("string"), F.lit(".jpg"))
    objects = t.events_raw.select(key.alias("object_key"))
    return image_store.objects_of_day(objects, "all", "2024", "01", "10").select("image_id", "image_url")


_BYTE = "CAST(('0x' || substr(md5(image_url), {} * 2 + 1, 2)) AS INT)"
_HIT = " + ".join(
    f"CASE WHEN {_BYTE.format(0)} % 4 > {i} AND {_BYTE.format(4 + i)} >= 64 THEN 1 ELSE 0 END" for i in range(3)
)


@query("v1_scored_images", f"""
SELECT device_id, timestamp, image_url, {_HIT} AS detection_count FROM events_raw""", "events_raw")
def _(t):
    rows = scoring.score(t.events_raw.select("device_id", "timestamp", "image_url"), stub_detector)
    return rows.select("device_id", "timestamp", "image_url", F.size("detections").alias("detection_count"))


@query("x15_enriched_events", f"""
SELECT device_id, timestamp, shot_id, {_HIT} AS detection_count, :as_of AS processed_at, 'yolov8n' AS inference_model,
  concat('http://minio:9000/iot-annotated/', device_id, '/', strftime(timestamp, '%Y-%m-%d_%H-%M-%S'), 'Z_',
    CASE WHEN shot_id = '' THEN 'unknown' ELSE shot_id END, '_annotated.jpg') AS annotated_image_url FROM events_raw""", "events_raw")
def _(t):
    rows = scoring.scored(scoring.enrich(t.events_raw, AS_OF, stub_detector))
    return rows.select(
        "device_id", "timestamp", "shot_id", "detection_count", "processed_at", "inference_model", "annotated_image_url"
    )


@query("s3_topic_rows", """
SELECT device_id AS key, shot_id, image_size, 'iot-backend' AS source FROM events_raw""", "events_raw")
def _(t):
    rows = streams.topic_rows(t.events_raw, key="device_id", now=AS_OF)
    return rows.select(
        "key", F.get_json_object("value", "$.shot_id").alias("shot_id"),
        F.get_json_object("value", "$.image_size").cast("bigint").alias("image_size"),
        F.element_at("headers", 1)["value"].cast("string").alias("source"),
    )
