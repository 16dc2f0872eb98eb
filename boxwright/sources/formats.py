"""LabelMe, YOLO, Pascal VOC and COCO labels to and from canonical tables.

Readers take files (path, value: the whole text) and give annotations: image_id, width, height, ann_idx, label,
shape_type, points (array of [x, y]), score, flags. A file that cannot be parsed gives no annotations. An image without
shapes gives one row with a null ann_idx, so that it is not lost. Everything is Columns; nothing is inferred.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.boxes import Box, box_points, clip_box, pairs_of, polygon_area, polygon_bbox, yolo_denormalize, yolo_normalize
from ..functions.masks import polygons_of_masks
from ..functions.text import date_stamp, stem
from ..operators.dataset import class_histogram
from ..operators.saved import checkpointed
from .images import is_hidden, is_image, list_files, sizes_of, split_key
from .records import RANGE, members, write_joined

ANNOTATION = ("image_id", "width", "height", "ann_idx", "label", "shape_type", "points", "score", "flags")
_LABELME = "imagePath string, imageHeight int, imageWidth int, shapes array<struct<label:string,points:array<array<double>>,shape_type:string,score:double,conf:double,difficult:boolean,flags:map<string,boolean>>>"
_VOC = "filename string, source struct<database:string>, size struct<width:string,height:string,depth:string>, object array<struct<name:string,difficult:string,conf:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>%s>>"
SECTIONS = ("images", "annotations", "categories")
_COCO = "id long, file_name string, height int, width int, image_id long, category_id long, bbox array<double>, segmentation string, name string"


def read_files(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, value) of whole text files."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    return reader.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_names(path: str) -> dict[int, str]:
    """Class names by id: lines of a text file, or ``names`` of a YAML file as a list or a map."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        names = (yaml.safe_load(text) or {}).get("names", {})
        return {int(k): str(v) for k, v in (names.items() if isinstance(names, dict) else enumerate(names))}
    return dict(enumerate(line.strip() for line in text.splitlines() if line.strip()))


def read_coco(spark: SparkSession, pattern: str, recursive: bool = False, size: int = RANGE) -> DataFrame:
    """(path, section, place, value): the images, annotations and categories of COCO documents, cut out by tasks of ``size`` bytes each.

    With ``recursive`` the documents are those of folders named annotations.
    """
    files = list_files(spark, pattern, recursive)
    if recursive:
        files = files.where(F.col("path").rlike(r"/annotations/[^/]*\.json$"))
    return members(spark, files, SECTIONS, size)


def coco_records(files: DataFrame) -> DataFrame:
    """(path, section, place, d): the images, annotations and categories of COCO documents, all as rows of one kind.

    ``files`` has what ``read_coco`` gives, or whole documents (path, value), each in one row, of moderate size.
    """
    if "section" in files.columns:
        return files.select("path", "section", "place", F.from_json("value", _COCO).alias("d"))
    return _coco_documents(files).select("path", F.inline(F.concat(*(_members(F.col(s), F.lit(s)) for s in SECTIONS))))


_RECORD = f"struct<{', '.join(':'.join(part.split()) for part in _COCO.split(', '))}>"


def _coco_documents(files: DataFrame) -> DataFrame:
    """(path, images, annotations, categories) of whole documents, arrays of records."""
    # the generator keeps the parsed arrays as columns, else each use would parse the document anew
    doc = files.select("path", F.inline_outer(F.array(F.from_json("value", ", ".join(f"{s} array<{_RECORD}>" for s in SECTIONS)))))
    return doc.select("path", *(F.coalesce(s, F.array().cast(f"array<{_RECORD}>")).alias(s) for s in SECTIONS))


def _members(listed: Column, section: Column, more: Callable[[Column], dict[str, Column]] = lambda _: {}) -> Column:
    return F.transform(listed, lambda x, i: F.struct(section.alias("section"), i.cast("long").alias("place"), x.alias("d"), *(c.alias(n) for n, c in more(x).items())))


def coco_names(files: DataFrame) -> dict[int, str]:
    """Class names of COCO documents or records from 0 on, in order of their category ids; a row a class reaches the driver."""
    found = coco_records(files).where("section = 'categories'").groupBy("d.name").agg(F.min("d.id").alias("id"))
    return dict(enumerate(r["name"] for r in found.orderBy("id", "name").collect()))


def names_table(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(sorted(names.items()), "cls_id long, label string")


def _whole(text: Column) -> Column:
    """A number's text, cut towards zero."""
    return F.trim(text).try_cast("double").cast("int")


def _parsed(files: DataFrame, doc: Column) -> DataFrame:
    """(path, d): a generator keeps the parsed document as a column, else filters and each use would parse it anew."""
    return files.select("path", F.inline(F.array(F.struct(doc.alias("d")))))


def from_labelme(files: DataFrame, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """The image is named by imagePath, or by ``key`` of the file's own path."""
    doc = _parsed(files, F.from_json("value", _LABELME)).where("d.shapes IS NOT NULL OR d.imagePath IS NOT NULL")
    name = key(F.col("path")) if key else stem(F.coalesce("d.imagePath", "path"))
    rows = doc.select(name.alias("image_id"), F.col("d.imageWidth").alias("width"), F.col("d.imageHeight").alias("height"), F.posexplode_outer("d.shapes").alias("ann_idx", "s"))
    score = F.when(F.col("s").isNotNull(), F.coalesce("s.score", "s.conf", F.lit(1.0)))
    difficult = F.coalesce("s.difficult", F.lit(False)) | F.coalesce(F.try_element_at("s.flags", F.lit("difficult")), F.lit(False))
    flags = F.when(F.col("s").isNotNull(), F.map_concat(F.map_filter(F.coalesce("s.flags", F.create_map().cast("map<string,boolean>")), lambda k, _: k != "difficult"), F.create_map(F.lit("difficult"), difficult)))
    return rows.select("image_id", "width", "height", "ann_idx", F.col("s.label").alias("label"), F.coalesce("s.shape_type", F.when(F.col("s").isNotNull(), "polygon")).alias("shape_type"), F.col("s.points").alias("points"), score.alias("score"), flags.alias("flags"))


def from_yolo(files: DataFrame, names: DataFrame, sizes: DataFrame, key: Callable[[Column], Column] = stem) -> DataFrame:
    """``names`` has cls_id and label; ``sizes`` image_id, width and height, a row an image, with or without a label file.

    An id without a name is its own label.
    """
    texts = sizes.select("image_id", "width", "height").join(files.select(key(F.col("path")).alias("image_id"), "value"), "image_id", "left")  # a row a file
    lines = texts.select("image_id", "width", "height", F.posexplode_outer(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(F.translate(x, "\r\t", "  "))), lambda x: x != "")).alias("ann_idx", "line"))
    # generators keep the parsed numbers as columns, else each later use would split and cast the line anew
    numbers = F.transform(F.split("line", r"\s+"), lambda x: x.cast("double"))
    parts = lines.select("image_id", "width", "height", "ann_idx", F.inline_outer(F.array(F.struct(numbers.alias("v")))))
    odd = F.size("v") % 2 == 0
    kept = F.struct(F.col("v")[0].cast("long").alias("cls_id"), F.slice("v", 2, F.size("v") - F.when(odd, 2).otherwise(1)).alias("n"), F.when(odd, F.element_at("v", -1)).otherwise(1.0).alias("score"))
    rows = parts.select("image_id", "width", "height", "ann_idx", F.inline_outer(F.array(F.when(F.col("v").isNotNull(), kept)))).join(F.broadcast(names), "cls_id", "left")
    n, rectangle = F.col("n"), F.size("n") == 4
    flat = box_points(yolo_denormalize(n[0], n[1], n[2], n[3], F.col("width"), F.col("height")))
    polygon = F.transform(pairs_of(n), lambda p: F.array(p[0] * F.col("width"), p[1] * F.col("height")))
    corners = F.array(flat[0], flat[2])
    return rows.select("image_id", "width", "height", "ann_idx", F.coalesce("label", F.col("cls_id").cast("string")).alias("label"), F.when(F.col("ann_idx").isNotNull(), F.when(rectangle, "rectangle").otherwise("polygon")).alias("shape_type"), F.when(rectangle, corners).otherwise(polygon).alias("points"), "score", F.when(F.col("ann_idx").isNotNull(), F.create_map(F.lit("difficult"), F.lit(False))).alias("flags"))


def from_voc(files: DataFrame, key: Callable[[Column], Column] = stem, extra_keys: tuple[str, ...] | None = None) -> DataFrame:
    """With ``extra_keys`` also database, pose, truncated and those tags of each object, as text."""
    extra = () if extra_keys is None else tuple(dict.fromkeys(("pose", "truncated", *extra_keys)))
    doc = _parsed(files, F.from_xml("value", _VOC % "".join(f",{k}:string" for k in extra if k not in ("name", "difficult", "conf")), {"rowTag": "annotation"})).where("d IS NOT NULL")
    size = doc.select(F.coalesce(key(F.col("path")), stem(F.col("d.filename"))).alias("image_id"), F.coalesce(_whole(F.col("d.size.width")), F.lit(0)).alias("width"), F.coalesce(_whole(F.col("d.size.height")), F.lit(0)).alias("height"), F.coalesce(F.trim("d.source.database"), F.lit("Unknown")).alias("database"), F.posexplode_outer("d.object").alias("ann_idx", "o"))
    raw = Box(*(F.coalesce(_whole(F.col(f"o.bndbox.{c}")), F.lit(0)) for c in ("xmin", "ymin", "xmax", "ymax")))
    b = clip_box(raw, F.when(F.col("width") > 0, F.col("width")).otherwise(1 << 30), F.when(F.col("height") > 0, F.col("height")).otherwise(1 << 30))
    there = F.col("ann_idx").isNotNull()
    corners = F.array(F.array(b.x1.cast("double"), b.y1.cast("double")), F.array(b.x2.cast("double"), b.y2.cast("double")))
    difficult = F.coalesce(F.trim("o.difficult").try_cast("int"), F.lit(0)) != 0
    default = {"pose": "Unspecified", "truncated": "0"}
    more = [] if extra_keys is None else ["database", *(F.when(there, F.coalesce(F.trim(f"o.{k}"), F.lit(default.get(k)))).alias(k) for k in extra)]
    return size.select("image_id", "width", "height", "ann_idx", F.when(there, F.coalesce(F.trim("o.name"), F.lit(""))).alias("label"), F.when(there, "rectangle").alias("shape_type"), F.when(there, corners).alias("points"), F.when(there, F.coalesce(F.trim("o.conf").try_cast("double"), F.lit(1.0))).alias("score"), F.when(there, F.create_map(F.lit("difficult"), difficult)).alias("flags"), *more)


def segmentation_polygons(text: Column, min_area: float = 0.0, masks: bool = True) -> Column:
    """The polygons of a segmentation's JSON, as arrays of [x, y]: of a list of flat polygons those of 3 points and more, or the
    borders of a run-length mask, outer ones before holes; without those under ``min_area``. Null without ``masks`` for a mask."""
    flat = F.from_json(F.when(text.startswith("["), text), "array<array<double>>")
    listed = F.transform(F.filter(flat, lambda p: F.size(p) >= 6), pairs_of)
    if min_area > 0:
        listed = F.filter(listed, lambda p: polygon_area(p) >= min_area)
    return F.coalesce(listed, polygons_of_masks(F.when(text.startswith("{"), text), min_area)) if masks else listed


def _largest(polygons: Column) -> Column:
    ranked = F.array_sort(F.transform(polygons, lambda p: F.struct((-polygon_area(p)).alias("a"), p.alias("points"))))
    return F.get(ranked, F.lit(0))["points"]


def from_coco(files: DataFrame, splits: bool = False, min_area: float = 0.0, masks: bool = True) -> DataFrame:
    """Images with their annotations and categories; the segmentation's largest polygon, else the box.

    ``files`` has whole documents (path, value) or what ``read_coco`` gives. With ``splits`` an image is named <split>/<stem>,
    its split being its document's name without ``instances_``. Annotations of unknown images are left out.
    """
    whole = "section" not in files.columns
    if whole:
        # rows of a document stay in its task, as it is one row before: it is shuffled, and categories are looked up in it
        name = lambda x: F.get(F.filter("categories", lambda c: c["id"] == x["category_id"]), F.lit(0))["name"]
        images, notes = _members(F.col("images"), F.lit("images"), lambda _: {"label": F.lit(None).cast("string")}), _members(F.col("annotations"), F.lit("annotations"), lambda x: {"label": name(x)})
        records = _coco_documents(files.select("path", "value").repartition("path")).select("path", F.inline(F.concat(images, notes)))
    else:
        records = coco_records(files).withColumn("label", F.lit(None).cast("string"))
    rows = records.where("section <> 'categories'").select("path", "section", "place", "label", F.when(F.col("section") == "images", F.col("d.id")).otherwise(F.col("d.image_id")).alias("id"), "d").where("id IS NOT NULL")
    own = Window.partitionBy("path", "id")  # an image and its annotations
    image = F.max(F.when(F.col("section") == "images", F.struct("d.file_name", "d.width", "d.height"))).over(own)
    notes = F.count(F.when(F.col("section") == "annotations", 1)).over(own)
    number = F.row_number().over(own.orderBy("section", "place")) - 1
    rows = rows.select("path", "section", "label", image.alias("image"), notes.alias("notes"), number.alias("number"), F.col("d.category_id").alias("category"), F.col("d.bbox").alias("bbox"), F.col("d.segmentation").alias("segmentation"))
    rows = rows.where("image IS NOT NULL AND (section = 'annotations' OR notes = 0)").withColumn("polygon", _largest(segmentation_polygons(F.col("segmentation"), min_area, masks)))
    if not whole:
        categories = records.where("section = 'categories'").groupBy("path", F.col("d.id").alias("category")).agg(F.first("d.name").alias("label"))
        rows = rows.drop("label").join(categories, ["path", "category"], "left")
    name = stem(F.col("image.file_name"))
    if splits:
        name = F.concat(F.regexp_replace(stem(F.col("path")), "^instances_", ""), F.lit("/"), name)
    b, there = F.col("bbox"), F.col("section") == "annotations"
    corners = F.array(F.array(b[0], b[1]), F.array(b[0] + b[2], b[1] + b[3]))
    return rows.select(name.alias("image_id"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.when(there, F.col("number")).alias("ann_idx"), F.when(there, F.coalesce("label", F.col("category").cast("string"))).alias("label"), F.when(there, F.when(F.col("polygon").isNotNull(), "polygon").otherwise("rectangle")).alias("shape_type"), F.when(there, F.coalesce("polygon", corners)).alias("points"), F.when(there, F.lit(1.0)).alias("score"), F.when(there, F.create_map(F.lit("difficult"), F.lit(False))).alias("flags"))


READERS = {".json": from_labelme, ".xml": from_voc}
#: All readers by format; that of yolo also needs names and sizes.
FORMATS = {"labelme": from_labelme, "voc": from_voc, "yolo": from_yolo, "coco": from_coco}


def read_labels(spark: SparkSession, pattern: str | None, kind: str | None = None, names: dict[int, str] | None = None, sizes: DataFrame | None = None, recursive: bool = False) -> DataFrame:
    """Annotations of label files of a format: labelme, voc, yolo or coco, or what the suffix of ``pattern`` says (.json, .xml, .txt).

    Labels of yolo need ``sizes`` (image_id, width, height). No pattern gives no annotations.
    """
    if pattern is None:
        return from_labelme(spark.createDataFrame([], "path string, value string"))
    kind = kind or {".json": "labelme", ".xml": "voc", ".txt": "yolo"}.get(Path(pattern).suffix)
    if kind not in FORMATS:
        raise ValueError(f"no reader for {pattern}")
    if kind == "yolo" and sizes is None:
        raise ValueError("yolo labels are relative: sizes of the images are needed")
    files = read_coco(spark, pattern, recursive) if kind == "coco" else read_files(spark, pattern, recursive)
    return from_yolo(files, names_table(spark, names or {}), sizes) if kind == "yolo" else FORMATS[kind](files)


def match_records(annotations: DataFrame, clip: bool = False) -> DataFrame:
    """(image_id, idx, label, conf, x1, y1, x2, y2, difficult) of valid enclosing boxes, points cut towards zero; ``clip`` cuts them to the image."""
    rows = annotations.where("ann_idx IS NOT NULL")
    inside = (lambda c, most: F.least(F.greatest(c, F.lit(0)), F.col(most))) if clip else (lambda c, most: c)
    along = lambda i, most: F.transform("points", lambda p: inside(p[i].cast("int"), most))
    edges = F.struct(along(0, "width").alias("xs"), along(1, "height").alias("ys"))
    # a generator keeps the box as columns, else the filter and each use would look at the points anew
    box = F.inline(F.transform(F.array(edges), lambda e: F.struct(F.array_min(e["xs"]).alias("x1"), F.array_min(e["ys"]).alias("y1"), F.array_max(e["xs"]).alias("x2"), F.array_max(e["ys"]).alias("y2"))))
    difficult = F.coalesce(F.try_element_at("flags", F.lit("difficult")), F.lit(False)).alias("difficult")
    rows = rows.select("image_id", F.col("ann_idx").cast("long").alias("idx"), "label", F.least(F.col("score"), F.lit(1.0)).alias("conf"), box, difficult)
    return rows.where("x1 < x2 AND y1 < y2")


def image_sizes(*sources: DataFrame) -> DataFrame:
    """(image_id, width, height): of the first source that knows the image, else 1 by 1."""
    out = None
    for place, df in enumerate(sources):
        part = df.where("width > 0 AND height > 0").select("image_id", F.struct(F.lit(place).alias("place"), "width", "height").alias("s")).unionByName(df.select("image_id", F.struct(F.lit(len(sources)).alias("place"), F.lit(1).alias("width"), F.lit(1).alias("height")).alias("s")))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("image_id").agg(F.min("s").alias("s")).select("image_id", "s.width", "s.height")


Value = Callable[[Callable[[str], Column]], Column]


def by_image(annotations: DataFrame) -> DataFrame:
    """(image_id, width, height, bare, shapes): an image's annotations as an array, in any order; bare if it also has a row without one.

    ``to_labelme``, ``to_yolo`` and ``to_voc`` take these too, so that several targets need the grouping once.
    """
    rest = [c for c in annotations.columns if c not in ("image_id", "width", "height", "image_flags")]
    there = F.col("ann_idx").isNotNull()
    more = [F.first(c).alias(c) for c in ("image_flags",) if c in annotations.columns]
    return annotations.groupBy("image_id", "width", "height").agg(F.max(~there).alias("bare"), F.collect_list(F.when(there, F.struct(*rest))).alias("shapes"), *more)


def annotations_of(images: DataFrame) -> DataFrame:
    """The annotations that ``by_image`` grouped; an image without any has a row with a null ann_idx."""
    return images.select("image_id", "width", "height", *(c for c in ("image_flags",) if c in images.columns), F.inline_outer("shapes"))


def _shapes(annotations: DataFrame, value: Value, name: str) -> DataFrame:
    """(image_id, width, height, <name>): values of an image's annotations in order; ``value`` makes one of a function that gives its columns."""
    own = [c for c in ("image_flags",) if c in annotations.columns]
    if "shapes" in annotations.columns:
        listed = F.array_sort(F.transform("shapes", lambda s: F.struct(s["ann_idx"].alias("ann_idx"), value(lambda c: s[c]).alias("v"))))
        return annotations.select("image_id", "width", "height", F.transform(listed, lambda x: x["v"]).alias(name), *own)
    listed = F.array_sort(F.collect_list(F.when(F.col("ann_idx").isNotNull(), F.struct("ann_idx", value(F.col).alias("v")))))
    return annotations.groupBy("image_id", "width", "height").agg(F.transform(listed, lambda x: x["v"]).alias(name), *(F.first(c).alias(c) for c in own))


def _json_text(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def to_labelme(annotations: DataFrame, suffix: str = ".jpg") -> DataFrame:
    """(image_id, value): a LabelMe document an image; its own flags from image_flags, if the annotations have that map."""
    shape = lambda s: F.to_json(F.struct(s("label").alias("label"), s("points").alias("points"), F.lit(None).cast("string").alias("group_id"), s("shape_type").alias("shape_type"), s("score").alias("score"), s("flags").alias("flags")), {"ignoreNullFields": "false"})
    rows = _shapes(annotations, shape, "shapes")
    own = F.coalesce(F.to_json("image_flags"), F.lit("{}")) if "image_flags" in rows.columns else F.lit("{}")
    head = F.concat(F.lit('{"version":"4.5.6","flags":'), own, F.lit(',"shapes":['), F.array_join("shapes", ","), F.lit('],"imagePath":'), _json_text(F.concat("image_id", F.lit(suffix))))
    return rows.select("image_id", F.concat(head, F.lit(',"imageData":null,"imageHeight":'), F.coalesce(F.col("height").cast("string"), F.lit("null")), F.lit(',"imageWidth":'), F.coalesce(F.col("width").cast("string"), F.lit("null")), F.lit("}")).alias("value"))


def to_yolo(annotations: DataFrame, names: DataFrame) -> DataFrame:
    """(image_id, value): a line a shape; rectangles as class, centre, size and score, polygons as class and all points."""

    def line(s: Callable[[str], Column], cls_id: Column) -> Column:
        corners = F.array(F.struct(*polygon_bbox(s("points")).fields()))  # computed once a shape and not at each use
        box = F.get(F.transform(corners, lambda b: F.array(*yolo_normalize(Box(*(b[n] for n in Box._fields)), F.col("width"), F.col("height")), s("score"))), F.lit(0))
        numbers = F.when(s("shape_type") == "rectangle", box).otherwise(F.flatten(F.transform(s("points"), lambda p: F.array(p[0] / F.col("width"), p[1] / F.col("height")))))
        return F.concat_ws(" ", cls_id.cast("string"), F.array_join(numbers, " "))

    if "shapes" in annotations.columns:
        known = names.where("cls_id IS NOT NULL").agg(F.collect_list(F.struct("label", "cls_id")).alias("known"))  # a row a class
        ids = lambda s: F.transform(F.filter("known", lambda n: n["label"] == s["label"]), lambda n: F.struct(*(s[c].alias(c) for c in ("ann_idx", "points", "shape_type", "score")), n["cls_id"].alias("cls_id")))
        rows = annotations.join(F.broadcast(known)).withColumn("shapes", F.flatten(F.transform("shapes", ids))).where("bare OR size(shapes) > 0")
        return _shapes(rows, lambda s: line(s, s("cls_id")), "lines").select("image_id", F.array_join("lines", "\n").alias("value"))
    rows = annotations.join(F.broadcast(names), "label", "left").where("ann_idx IS NULL OR cls_id IS NOT NULL")
    return _shapes(rows, lambda s: line(s, s("cls_id")), "lines").select("image_id", F.array_join("lines", "\n").alias("value"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def to_voc(annotations: DataFrame, folder: str = "images", suffix: str = ".jpg") -> DataFrame:
    """(image_id, value): a Pascal VOC document an image; polygons by their enclosing box, difficult as it was."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    def item(s: Callable[[str], Column]) -> Column:
        b = polygon_bbox(s("points")).map(lambda c: c.cast("int").cast("string"))
        corners = tag("bndbox", F.concat(*(tag(n, c) for n, c in zip(("xmin", "ymin", "xmax", "ymax"), b, strict=True))))
        difficult = F.coalesce(F.try_element_at(s("flags"), F.lit("difficult")), F.lit(False)).cast("int").cast("string")
        return tag("object", F.concat(tag("name", _escaped(s("label"))), F.lit("<pose>Unspecified</pose><truncated>0</truncated>"), tag("difficult", difficult), corners))

    rows = _shapes(annotations, item, "objects")
    name = _escaped(F.concat("image_id", F.lit(suffix)))
    size = tag("size", F.concat(tag("width", F.col("width").cast("string")), tag("height", F.col("height").cast("string")), F.lit("<depth>3</depth>")))
    head = F.concat(tag("folder", F.lit(folder)), tag("filename", name), tag("path", name), F.lit("<source><database>Unknown</database></source>"), size, F.lit("<segmented>0</segmented>"))
    return rows.select("image_id", tag("annotation", F.concat(head, F.array_join("objects", ""))).alias("value"))


def coco_tables(annotations: DataFrame, names: DataFrame, start: int = 1, suffix: str = ".jpg") -> tuple[DataFrame, DataFrame, DataFrame]:
    """COCO images, annotations and categories. Ids count from ``start`` in order of image_id and shape; boxes are cut to the image.

    Images are put in order once, in sampled ranges that a checkpoint fixes, with the number of their annotations. Sums
    over the ranges, a row each, give every image its id and that of its first annotation; within an image places count.
    """
    named = annotations.join(F.broadcast(names), "label", "left")  # a row a class
    counts = named.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count(F.when(F.col("cls_id").isNotNull(), F.col("ann_idx"))).alias("n"))
    counts = checkpointed(counts.repartitionByRange("image_id").sortWithinPartitions("image_id").select("*", F.monotonically_increasing_id().alias("at")))
    counts = counts.withColumn("run", F.shiftright("at", 33))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = counts.groupBy("run").agg(F.count("*").alias("images"), F.sum("n").alias("notes"))
    sums = sums.select("run", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("images", "notes")))
    inside = Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    images = counts.join(F.broadcast(sums), "run").select("image_id", "width", "height", (F.col("images") + F.col("at") - F.shiftleft("run", 33) + start).alias("id"), (F.col("notes") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + start).alias("first"))
    b = polygon_bbox(F.col("points"))
    rows = named.where("ann_idx IS NOT NULL AND cls_id IS NOT NULL").select("image_id", "ann_idx", "cls_id", *b.fields()).join(images, "image_id")
    cut = clip_box(Box(*(F.col(c) for c in Box._fields)), F.col("width"), F.col("height"))
    own = Window.partitionBy("image_id").orderBy("ann_idx")
    rows = rows.select((F.col("first") + F.row_number().over(own) - 1).alias("note"), F.col("id").alias("coco_image"), (F.col("cls_id") + start).alias("category_id"), *cut.fields())
    notes = rows.select(F.col("note").alias("id"), F.col("coco_image").alias("image_id"), "category_id", F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), F.lit(0).alias("iscrowd"), F.array().cast("array<array<double>>").alias("segmentation"))
    return images.select("id", F.concat("image_id", F.lit(suffix)).alias("file_name"), "height", "width"), notes, names.select((F.col("cls_id") + start).alias("id"), F.col("label").alias("name"), F.lit("").alias("supercategory"))


def write_coco(annotations: DataFrame, names: DataFrame, path: str, start: int = 1) -> None:
    """One COCO document, which the tasks write side by side and which appears once it is whole."""
    spark, tables = annotations.sparkSession, coco_tables(annotations, names, start)
    least = names.agg(F.min("cls_id")).first()[0]
    first = (start, start, start + (least or 0))
    marks = [(k, -(1 << 62), ('{"info": {"date_created": "<today>"}, ' if not k else "], ") + f'"{section}": [') for k, section in enumerate(SECTIONS)] + [(len(SECTIONS), 0, "]}")]
    rows = spark.createDataFrame(marks, "section int, id long, text string").withColumn("text", F.replace("text", F.lit("<today>"), date_stamp()))
    for k, (df, low) in enumerate(zip(tables, first, strict=True)):
        text = F.to_json(F.struct("*"))
        rows = rows.unionByName(df.select(F.lit(k).alias("section"), F.col("id").cast("long").alias("id"), F.when(F.col("id") > low, F.concat(F.lit(", "), text)).otherwise(text).alias("text")))
    write_joined(rows, path, "section", "id")


def write_texts(texts: DataFrame, folder: str, suffix: str) -> int:
    """Write ``value`` of each row to <folder>/<image_id><suffix> from the tasks; returns how many. Split names are folders."""
    from pyarrow import fs

    def write(batches):
        import pyarrow as pa

        files, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for name, value in zip(batch.column("image_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
                parent = f"{root}/{name}".rpartition("/")[0]
                if parent not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                with files.open_output_stream(f"{root}/{name}{suffix}") as out:
                    out.write(value.encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return texts.select("image_id", "value").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_split_coco(annotations: DataFrame, names: DataFrame, folder: str, start: int = 1) -> list[str]:
    """<folder>/instances_<split>.json of each split of ``image_id`` (<split>/<stem>; ``all`` without one)."""
    split, name = F.regexp_extract("image_id", "^(.*)/", 1), F.regexp_extract("image_id", "([^/]*)$", 1)
    rows = annotations.withColumn("split", F.when(split == "", "all").otherwise(F.replace(split, F.lit("/"), F.lit("_"))))
    found = sorted(r.split for r in rows.select("split").distinct().collect())  # a handful
    for one in found:
        write_coco(rows.where(F.col("split") == one).drop("split").withColumn("image_id", name), names, f"{folder}/instances_{one}.json", start)
    return found


def convert(spark: SparkSession, source: str, target: str, pattern: str, out: str, names: dict[int, str] | None = None, sizes: DataFrame | None = None, start: int = 0, images: str | None = None, splits: bool = False) -> None:
    """Convert label files between labelme, yolo, voc and coco as one plan from reader to writer.

    Without ``names`` classes are those of the COCO categories, or else all labels in natural order; labels that given
    names lack raise an error where the target needs ids. Labels of yolo need ``sizes`` or ``images``, a path of image
    files whose headers have them. With ``splits`` images are <split>/<stem> and targets have a folder, or to coco a
    document, for each split.
    """
    files = read_coco(spark, pattern, splits) if source == "coco" else read_files(spark, pattern, splits)
    key = split_key if splits else stem
    if names is None and source == "coco":
        names = coco_names(files)
    table = names_table(spark, names or {})
    if source == "yolo" and sizes is None:
        if images is None:
            raise ValueError("yolo labels are relative: sizes of the images are needed")
        sizes = sizes_of(list_files(spark, images), key)
    notes = {"labelme": lambda: from_labelme(files, key if splits else None), "voc": lambda: from_voc(files, key), "coco": lambda: from_coco(files, splits), "yolo": lambda: from_yolo(files, table, sizes, key)}[source]()
    if names is None and target in ("coco", "yolo"):  # as many rows as there are classes
        table = names_table(spark, dict(enumerate(r.label for r in class_histogram(notes.where("ann_idx IS NOT NULL")).orderBy("natural_rank").collect())))
    if target in ("coco", "yolo") and (unknown := notes.where("label IS NOT NULL").select("label").distinct().join(table, "label", "left_anti").limit(5).collect()):
        raise ValueError(f"labels without a class id: {', '.join(r.label for r in unknown)}")
    if target == "coco":
        (write_split_coco if splits else write_coco)(notes, table, out, start)
    elif target == "labelme":
        write_texts(to_labelme(notes), out, ".json")
    elif target == "voc":
        write_texts(to_voc(notes), out, ".xml")
    elif target == "yolo":
        write_texts(to_yolo(notes, table), out, ".txt")
    else:
        raise ValueError(f"unknown format: {target}")


def to_names(names: dict[int, str], splits: tuple[str, ...] = ("train", "val", "test")) -> tuple[str, str]:
    """A class list, a name a line, and a YAML data set with its split folders and names."""
    import yaml

    ordered = [names[k] for k in sorted(names)]
    body = {split: f"images/{split}" for split in splits} | {"nc": len(ordered), "names": dict(enumerate(ordered))}
    return "\n".join(ordered) + "\n", yaml.safe_dump(body, sort_keys=False, allow_unicode=True)


def gen_names(annotations: DataFrame, out: str | None = None) -> dict[str, int]:
    """How often each label occurs, in natural order; with ``out`` also written there as classes.txt, a name a line, and classes.json."""
    rows = class_histogram(annotations.where("ann_idx IS NOT NULL")).orderBy("natural_rank").collect()  # a row a class
    counts = {r.label: r.n for r in rows}
    if out:
        spark = annotations.sparkSession
        for file, text in (("classes.txt", "".join(f"{name}\n" for name in counts)), ("classes.json", json.dumps(counts, ensure_ascii=False, indent=4))):
            write_texts(spark.createDataFrame([(file, text)], "image_id string, value string"), out, "")
    return counts


def yolo_subset(labels: DataFrame, keep: list[int], images: DataFrame | None = None) -> DataFrame:
    """(path, value): label files with the classes in ``keep`` alone, renumbered by their place in it.

    A file none of whose lines stay becomes empty. Hidden files and class lists go, as do those without an image of the
    same data set (the path up to /labels/ or /images/) and stem where ``images`` (path) is given.
    """
    place = F.create_map(*(x for i, c in enumerate(keep) for x in (F.lit(str(c)), F.lit(str(i)))))
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.transform(lines, lambda x: F.struct(F.get(F.split(x, r"\s+", 2), F.lit(0)).alias("c"), F.get(F.split(x, r"\s+", 2), F.lit(1)).alias("rest")))
    kept = F.filter(cut, lambda x: x["c"].isin(*(str(c) for c in keep)))
    rows = labels.where(~is_hidden(F.col("path")) & (stem(F.col("path")) != "classes"))
    if images is not None:
        same = lambda folder: (F.regexp_replace("path", f"/{folder}/[^/]*$", "").alias("set"), stem(F.col("path")).alias("stem"))
        rows = rows.select("path", "value", *same("labels")).join(images.where(is_image(F.col("path"))).select(*same("images")).distinct(), ["set", "stem"], "left_semi")
    return rows.select("path", F.array_join(F.transform(kept, lambda x: F.concat_ws(" ", F.element_at(place, x["c"]), x["rest"])), "\n").alias("value"))


def exclude_classes(spark: SparkSession, root: str, keep: list[int], names: dict[int, str], title: str = "subset", out: str | None = None) -> int:
    """Reduce <root>/<subset>/labels/*.txt to ``keep``: to labels_<title> beside them, or to the same folders of ``out``.

    Writes classes.txt and data.yaml of the kept names into the target folder; returns how many label files it wrote.
    """
    base = root.rstrip("/")
    pattern = f"{base}/*/labels/*.txt"
    rows = yolo_subset(read_files(spark, pattern), keep, list_files(spark, f"{base}/*/images/*", False))
    relative = F.regexp_extract("path", r"([^/]+/labels/[^/]*)\.txt$", 1)
    target = base if out is None else out.rstrip("/")
    name = relative if out else F.regexp_replace(relative, "/labels/", f"/labels_{title}/")
    n = write_texts(rows.select(name.alias("image_id"), "value"), target, ".txt")
    listed, body = to_names({i: names[c] for i, c in enumerate(keep)})
    for file, text in (("classes.txt", listed), ("data.yaml", body)):
        write_texts(spark.createDataFrame([(file, text)], "image_id string, value string"), target if out else f"{target}/{title}", "")
    return n
