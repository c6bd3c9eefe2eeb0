"""Labelling projects: life cycle, exports, splits, annotation import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake import schemas
from shutterlake.functions import boxes
from shutterlake.functions.names import base_name
from shutterlake.functions.text import given
from shutterlake.functions.times import as_column
from shutterlake.operators import changes
from shutterlake.operators.ranking import numbered

IMAGE_KEY = ["project_id", "image_id"]
DEFAULT_CLASSES = ["object"]
EXPORTED = ["approved", "submitted"]
# Size assumed for an image that states none.
DEFAULT_WIDTH, DEFAULT_HEIGHT = 640, 480


# ---- projects -----------------------------------------------------------

def current_projects(project_changes: DataFrame) -> DataFrame:
    """Projects after create/update/delete rows, defaults filled in."""
    fields = ["name", "description", "status", "annotation_type", "class_names", "created_by"]
    rows = changes.patched(project_changes, "project_id", ["changed_at", "seq"], fields)
    return rows.withColumns({
        "status": F.coalesce("status", F.lit("draft")),
        "annotation_type": F.coalesce("annotation_type", F.lit("object_detection")),
        "created_by": F.coalesce("created_by", F.lit("system")),
    })


def duplicate_names(projects: DataFrame) -> DataFrame:
    """Names used by more than one project."""
    counted = projects.groupBy("name").agg(F.count("*").alias("projects"))
    return counted.filter(F.col("projects") > 1)


def project_list(projects: DataFrame, status: str | None = None, n: int = 100) -> DataFrame:
    return changes.where_eq(projects, status=status).orderBy(F.desc("created_at"), "project_id").limit(n)


def progress(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per project: images, annotated (image completed) and reviewed (annotation approved).

    Both sides are counted on their own and then meet as one row per project.
    """
    done = images.groupBy("project_id").agg(
        F.count("*").alias("total_images"), F.count_if(F.col("status") == "completed").alias("annotated_images")
    )
    reviewed = annotations.groupBy("project_id").agg(
        F.count_if(F.col("status") == "approved").alias("reviewed_images")
    )
    return done.join(reviewed, "project_id", "left").fillna(0, ["reviewed_images"])


def image_page(images: DataFrame, project_id: str, status: str | None = None, limit: int = 50, skip: int = 0) -> DataFrame:
    kept = changes.where_eq(images, project_id=project_id, status=status)
    return kept.orderBy(F.desc("created_at"), "image_id").offset(skip).limit(limit)


def annotation_list(annotations: DataFrame, project_id: str, status: str | None = None, n: int = 1000) -> DataFrame:
    kept = changes.where_eq(annotations, project_id=project_id, status=status)
    return kept.orderBy(F.desc("created_at"), "image_id").limit(n)


def without_projects(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Images or annotations that remain after their projects are deleted."""
    return rows.join(deleted.select("project_id"), "project_id", "left_anti")


def without_images(annotations: DataFrame, deleted: DataFrame) -> DataFrame:
    """Annotations that remain after their images are removed."""
    return annotations.join(deleted.select(*IMAGE_KEY), IMAGE_KEY, "left_anti")


# ---- guards and status --------------------------------------------------

def addable_images(requested: DataFrame, projects: DataFrame, images: DataFrame) -> DataFrame:
    """Requested images of existing projects that are not in them yet, one per key."""
    known = requested.join(projects.select("project_id"), "project_id", "left_semi")
    return changes.insert_absent(known, images, IMAGE_KEY)


def addable_annotations(
    requested: DataFrame, projects: DataFrame, images: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Requested annotations of existing images that have none yet, as drafts."""
    known = requested.join(projects.select("project_id"), "project_id", "left_semi").join(
        images.select(*IMAGE_KEY), IMAGE_KEY, "left_semi"
    )
    return changes.insert_absent(known, annotations, IMAGE_KEY).withColumn("status", F.lit("draft"))


def image_status(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Image status as its annotation leaves it: completed once approved, else annotating."""
    latest = annotations.select(*IMAGE_KEY, F.col("status").alias("_annotation"))
    moved = F.when(F.col("_annotation") == "approved", "completed").when(
        F.col("_annotation").isNotNull(), "annotating"
    )
    return images.join(latest, IMAGE_KEY, "left").withColumn(
        "status", F.coalesce(moved, F.col("status"))
    ).drop("_annotation")


def image_status_changed(images: DataFrame, annotations: DataFrame, updates: DataFrame) -> DataFrame:
    """Image status after annotations and explicit changes, whichever came last.

    `annotations` has changed_at, `updates` project_id, image_id, status and
    changed_at; values outside the allowed ones change nothing. At the same
    instant the explicit change wins.
    """
    explicit = updates.filter(F.col("status").isin(schemas.IMAGE_STATUSES)).groupBy(*IMAGE_KEY).agg(
        F.max(F.struct("changed_at", "status")).alias("_explicit")
    )
    last = annotations.groupBy(*IMAGE_KEY).agg(F.max("changed_at").alias("_annotated"))
    derived = image_status(images, annotations)
    joined = derived.join(explicit, IMAGE_KEY, "left").join(last, IMAGE_KEY, "left")
    later = F.col("_explicit").isNotNull() & F.coalesce(F.col("_explicit.changed_at") >= F.col("_annotated"), F.lit(True))
    return joined.withColumn("status", F.when(later, F.col("_explicit.status")).otherwise(F.col("status"))).drop("_explicit", "_annotated")


def bad_status(rows: DataFrame, kind: str) -> DataFrame:
    """Rows whose status is not allowed for an image, annotation or project."""
    allowed = {
        "image": schemas.IMAGE_STATUSES, "annotation": schemas.ANNOTATION_STATUSES, "project": schemas.PROJECT_STATUSES,
    }[kind]
    return rows.filter(~F.coalesce(F.col("status").isin(allowed), F.lit(False)))


# ---- export -------------------------------------------------------------

def class_dimension(projects: DataFrame) -> DataFrame:
    """project_id, class, first and last position (from 0) in the project's class list."""
    names = F.when(F.size("class_names") > 0, F.col("class_names")).otherwise(
        F.array(*[F.lit(c) for c in DEFAULT_CLASSES])
    )
    return (
        projects.select("project_id", F.posexplode(names).alias("pos", "class"))
        .groupBy("project_id", "class").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    )


def categories(projects: DataFrame) -> DataFrame:
    """COCO categories: ids from 1 in list order."""
    return class_dimension(projects).select(
        "project_id", (F.col("first_pos") + 1).alias("id"), F.col("class").alias("name"),
        F.lit("none").alias("supercategory"),
    )


def used_categories(annotations: DataFrame, projects: DataFrame) -> DataFrame:
    """The categories that exported annotations use, with their number of boxes."""
    boxes_of = export_annotations(annotations).groupBy("project_id", F.col("class").alias("name")).agg(F.count("*").alias("boxes"))
    return categories(projects).drop("supercategory").join(boxes_of, ["project_id", "name"])


def export_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations fit for export: approved or submitted, with their class name."""
    columns = annotations.columns
    category = given(F.col("category")) if "category" in columns else F.lit(None).cast("string")
    return annotations.filter(F.col("status").isin(EXPORTED)).withColumn(
        "class", F.coalesce(given(F.col("class")), category)
    )


def _boxed(annotations: DataFrame) -> DataFrame:
    """Exported annotations that state all four corners."""
    corners = [F.col(c).isNotNull() for c in ("x1", "y1", "x2", "y2")]
    return export_annotations(annotations).filter(corners[0] & corners[1] & corners[2] & corners[3])


def coco_images(images: DataFrame) -> DataFrame:
    """COCO images with ids from 1 per project; the order is that of md5(image_id)."""
    ranked = numbered(images, ["project_id"], F.col("image_id"), ["image_id"])
    name = F.coalesce(given(base_name(F.col("image_url"))), F.concat(F.lit("image_"), (F.col("rank") - 1).cast("string"), F.lit(".jpg")))
    return ranked.select(
        "project_id", "image_id", F.col("rank").alias("id"),
        F.coalesce("width", F.lit(DEFAULT_WIDTH)).alias("width"),
        F.coalesce("height", F.lit(DEFAULT_HEIGHT)).alias("height"),
        name.alias("file_name"), F.lit(1).alias("license"), F.col("image_url").alias("flickr_url"),
        F.col("image_url").alias("coco_url"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date_captured"),
    )


def coco_annotations(images: DataFrame, annotations: DataFrame, projects: DataFrame) -> DataFrame:
    """COCO annotations: boxes of known classes on images of the project."""
    dimension = class_dimension(projects).select("project_id", "class", (F.col("first_pos") + 1).alias("category_id"))
    matched = (
        _boxed(annotations)
        .join(coco_images(images).select("project_id", "image_id", F.col("id").alias("coco_image")), IMAGE_KEY)
        .join(dimension, ["project_id", "class"])
    )
    ties = ["image_id", "x1", "y1", "x2", "y2", "class"]
    key = F.concat_ws("|", *ties)
    box = boxes.corner_to_size(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    ranked = numbered(matched, ["project_id"], key, ties).withColumn("box", box)
    return ranked.select(
        "project_id", F.col("rank").alias("id"), F.col("coco_image").alias("image_id"), "category_id",
        F.array("box.x", "box.y", "box.width", "box.height").alias("bbox"), F.col("box.area").alias("area"),
        F.lit(0).alias("iscrowd"), F.array().cast("array<double>").alias("segmentation"),
    )


def coco_header(projects: DataFrame, now) -> DataFrame:
    """The info and license lines of each project; images refer to license 1."""
    day = F.to_date(as_column(now))
    info = F.to_json(F.struct(
        F.col("project_id").alias("description"), F.lit("1.0").alias("version"), F.year(day).alias("year"),
        F.date_format(day, "yyyy-MM-dd").alias("date_created"),
    ))
    license_ = F.to_json(F.struct(F.lit(1).alias("id"), F.lit("Unknown").alias("name"), F.lit("").alias("url")))
    lines = F.array(
        F.struct(F.lit("info").alias("relation"), info.alias("line")),
        F.struct(F.lit("licenses").alias("relation"), license_.alias("line")),
    )
    return projects.select("project_id", F.inline(lines))


def coco_lines(images: DataFrame, annotations: DataFrame, projects: DataFrame, now) -> DataFrame:
    """The relations info, licenses, images, annotations and categories as JSON lines (project_id, relation, line).

    Written with `partitionBy("project_id", "relation")` each relation becomes
    many files, so no project passes through one task.
    """
    def lines(df: DataFrame, relation: str) -> DataFrame:
        body = F.to_json(F.struct(*[c for c in df.columns if c != "project_id"]))
        return df.select("project_id", F.lit(relation).alias("relation"), body.alias("line"))

    return (
        coco_header(projects, now)
        .unionByName(lines(coco_images(images).drop("image_id"), "images"))
        .unionByName(lines(coco_annotations(images, annotations, projects), "annotations"))
        .unionByName(lines(categories(projects), "categories"))
    )


def yolo_lines(images: DataFrame, annotations: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per box: project_id, image_id, line. Unknown classes count as class 0."""
    sized = images.select(
        *IMAGE_KEY, F.coalesce("width", F.lit(DEFAULT_WIDTH)).alias("width"),
        F.coalesce("height", F.lit(DEFAULT_HEIGHT)).alias("height"),
    )
    dimension = class_dimension(projects).select("project_id", "class", "last_pos")
    centre = boxes.corner_to_centre(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")))
    return (
        _boxed(annotations).join(sized, IMAGE_KEY).join(dimension, ["project_id", "class"], "left")
        .select(*IMAGE_KEY, boxes.yolo_line(F.coalesce("last_pos", F.lit(0)), centre).alias("line"))
    )


def yolo_labels(images: DataFrame, annotations: DataFrame, projects: DataFrame) -> DataFrame:
    """One label text per image, its lines sorted; images without boxes have an empty text."""
    texts = yolo_lines(images, annotations, projects).groupBy(*IMAGE_KEY).agg(
        F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("label")
    )
    return images.select(*IMAGE_KEY, "image_url").join(texts, IMAGE_KEY, "left").fillna("", ["label"])


def split(
    images: DataFrame, train: float = 0.7, val: float = 0.2, test: float = 0.1, seed: str = ""
) -> DataFrame:
    """Add `split` to each image: by rank of md5(seed, image), cut at floor(n × ratio)."""
    if abs(train + val + test - 1.0) > 0.01:
        raise ValueError("ratios must sum to 1")
    ranked = numbered(images, ["project_id"], F.concat(F.lit(seed), "image_id"), ["image_id"])
    first = F.floor(F.col("group_size") * F.lit(float(train)))
    second = first + F.floor(F.col("group_size") * F.lit(float(val)))
    part = F.when(F.col("rank") <= first, "train").when(F.col("rank") <= second, "val").otherwise("test")
    return ranked.withColumn("split", part).drop("rank", "group_size")


def split_annotations(annotations: DataFrame, split_images: DataFrame) -> DataFrame:
    """Annotations with the split of their image."""
    return annotations.join(split_images.select(*IMAGE_KEY, "split"), IMAGE_KEY)


# ---- labelling tool -----------------------------------------------------

LABELSTUDIO_EXPORT = (
    "result array<struct<value: struct<x: double, y: double, width: double, height: double, "
    "rectanglelabels: array<string>>>>, task struct<id: string, data: struct<image: string>>"
)


def imported_annotations(exports: DataFrame) -> DataFrame:
    """Label Studio export rows (`result`, `task`) → one row per box."""
    value = F.col("r.value")
    corners = boxes.size_to_corner(value)
    return exports.select("task", F.posexplode("result").alias("pos", "r")).select(
        F.col("task.id").alias("image_id"), F.coalesce("task.data.image", F.lit("")).alias("image_url"), "pos",
        *(F.element_at(corners, i + 1).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))),
        F.coalesce(F.get(value["rectanglelabels"], F.lit(0)), F.lit("object")).alias("class"),
        F.lit("submitted").alias("status"), F.lit("labelstudio").alias("source"),
    )


def upsert_imported(annotations: DataFrame, imported: DataFrame, project_id: str) -> DataFrame:
    """Imported boxes into a project, keyed by image; the last box of an image wins."""
    rows = imported.withColumn("project_id", F.lit(project_id))
    last = changes.latest(rows, IMAGE_KEY, ["pos"]).drop("pos", "image_url")
    return changes.upsert(annotations, last, IMAGE_KEY)


def labelling_tasks(images: DataFrame) -> DataFrame:
    """One JSON task per image."""
    data = F.struct(F.coalesce("image_url", F.lit("")).alias("image"))
    return images.select(*IMAGE_KEY, F.to_json(F.struct(data.alias("data"))).alias("task"))


def label_config(class_names: Column) -> Column:
    """Labelling interface with one box label per class."""
    labels = F.transform(class_names, lambda c: F.concat(F.lit('    <Label value="'), c, F.lit('" background="red"/>')))
    return F.concat(
        F.lit('<View>\n  <Image name="image" value="$image"/>\n  <RectangleLabels name="label" toName="image">\n'),
        F.array_join(labels, "\n"), F.lit("\n  </RectangleLabels>\n</View>"),
    )
