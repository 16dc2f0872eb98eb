"""Images cut around their labels: a plan of crops, labels in the crops' coordinates and, where an image library is there, pixels."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem
from ..operators.merging import crop_labels, crop_plan
from .formats import ANNOTATION, from_voc, from_yolo, match_records, names_table, read_files, to_voc, to_yolo, write_texts
from .images import image_headers, is_image, list_files
from .records import write_joined


def crop_annotations(plan: DataFrame, labels: DataFrame, listed: str = "held") -> DataFrame:
    """The labels of each crop as annotations of an image <image>_cut_<label>; a crop without labels stays as an image."""
    name = lambda image, crop: F.concat(image, F.lit("_cut_"), F.col(crop).cast("string")).alias("image_id")
    rows = crop_labels(plan, labels, listed)
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    known = rows.select(name("image_id", "crop"), F.col("gt_idx").cast("int").alias("ann_idx"), "label", F.lit("rectangle").alias("shape_type"), F.array(corner("x1", "y1"), corner("x2", "y2")).alias("points"), F.lit(1.0).alias("score"), F.create_map(F.lit("difficult"), F.lit(False)).alias("flags"))
    sizes = plan.select(name("image_id", "gt_idx"), (F.col("x2") - F.col("x1")).cast("int").alias("width"), (F.col("y2") - F.col("y1")).cast("int").alias("height"))
    return sizes.join(known, "image_id", "left").select(*ANNOTATION)


def _cutting(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from io import BytesIO

        from PIL import Image
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(out)
        files.create_dir(root, recursive=True)
        for batch in batches:
            done = 0
            for row in batch.to_pylist():
                source, path = fs.FileSystem.from_uri(row["path"])
                with source.open_input_file(path) as file, Image.open(BytesIO(file.read())) as image:
                    for crop in row["crops"]:
                        part = image.convert("RGB").crop((crop["x1"], crop["y1"], crop["x2"], crop["y2"]))
                        for x1, y1, x2, y2 in crop["black"] or ():
                            part.paste((0, 0, 0), (int(x1), int(y1), int(x2), int(y2)))
                        body = BytesIO()
                        part.save(body, "JPEG", quality=100)
                        with files.open_output_stream(f"{root}/{row['image_id']}_cut_{crop['gt_idx']}.jpg") as file_out:
                            file_out.write(body.getvalue())
                        done += 1
            yield pa.record_batch([pa.array([done], pa.int64())], names=["n"])

    return run


def write_crops(plan: DataFrame, blacked: DataFrame, files: DataFrame, out: str) -> int:
    """Cut the images of ``files`` (path) as planned, the parts in ``blacked`` (as crop_labels gives them) black; returns how many crops were written. Needs PIL."""
    black = blacked.groupBy("image_id", F.col("crop").alias("gt_idx")).agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("black"))
    rows = plan.join(black, ["image_id", "gt_idx"], "left").groupBy("image_id").agg(F.collect_list(F.struct("gt_idx", "x1", "y1", "x2", "y2", "black")).alias("crops"))
    first = files.groupBy(stem(F.col("path")).alias("image_id")).agg(F.min("path").alias("path"))
    return rows.join(first, "image_id").select("image_id", "path", "crops").mapInArrow(_cutting(out), "n long").agg(F.sum("n")).first()[0] or 0


def cut_images(spark: SparkSession, root: str, out: str, pattern: str = "voc", target: int = 640, ratio_pct: int = 85, threshold: float = 0.7, mask: bool = False, images: str = "images", labels: str = "labels", names: dict[int, str] | None = None) -> DataFrame:
    """Cut the images in <root>/<images> around their labels in <root>/<labels>, of format voc or yolo.

    Writes to ``out`` the labels of each crop (<labels>/<image>_cut_<i>), name2cut_box.json with the crops of each image
    and, if an image library is installed, <images>/<image>_cut_<i>.jpg. Returns the plan (see ``crop_plan``).
    """
    if pattern not in ("voc", "yolo"):
        raise ValueError(f"unknown format: {pattern}")
    base, target_folder = root.rstrip("/"), out.rstrip("/")
    files = list_files(spark, f"{base}/{images}").where(is_image(F.col("path")))
    sizes = image_headers(files).where("width > 0").groupBy(stem(F.col("path")).alias("image_id")).agg(F.min(F.struct("path", "width", "height")).alias("s")).select("image_id", "s.width", "s.height")
    table = names_table(spark, names or {})
    texts = read_files(spark, f"{base}/{labels}/*{'.xml' if pattern == 'voc' else '.txt'}")
    notes = from_voc(texts) if pattern == "voc" else from_yolo(texts, table, sizes)
    found = match_records(notes).select("image_id", F.col("idx").alias("gt_idx"), "label", "x1", "y1", "x2", "y2")
    plan = crop_plan(found, sizes, target, ratio_pct, threshold, mask)
    made = crop_annotations(plan, found)
    if pattern == "yolo":  # ids without a name are their own names
        ids = table.unionByName(made.where("label RLIKE '^[0-9]+$'").select(F.col("label").cast("long").alias("cls_id"), "label").distinct())
        write_texts(to_yolo(made, ids), f"{target_folder}/{labels}", ".txt")
    else:
        write_texts(to_voc(made, images), f"{target_folder}/{labels}", ".xml")
    each = F.transform(F.array_sort(F.collect_list(F.struct("gt_idx", F.array("x1", "y1", "x2", "y2").alias("bbox")))), lambda c: F.struct(c["bbox"].alias("bbox"), F.concat("image_id", F.lit("_cut_"), c["gt_idx"].cast("string")).alias("name")))
    lines = plan.groupBy("image_id").agg(F.to_json(F.create_map(F.col("image_id"), each)).alias("text")).select("image_id", F.expr("substring(text, 2, length(text) - 2)").alias("text"))
    first = lines.agg(F.min("image_id")).first()[0]
    marks = spark.createDataFrame([(0, "", "{"), (2, "", "}")], "place int, image_id string, text string")
    rows = lines.select(F.lit(1).alias("place"), "image_id", F.when(F.col("image_id") == first, F.col("text")).otherwise(F.concat(F.lit(", "), "text")).alias("text"))
    write_joined(marks.unionByName(rows), f"{target_folder}/name2cut_box.json", "place", "image_id")
    if importlib.util.find_spec("PIL"):
        write_crops(plan, crop_labels(plan, found, "masked"), files, f"{target_folder}/{images}")
    return plan
