"""Data sets as folders: listings, sizes from headers, splits through all conversions, error labels, class subsets."""

import json
from io import BytesIO
from struct import pack

import pytest
from pyspark.sql import functions as F

from boxwright import cli
from boxwright.operators import confusion, dataset, precision
from boxwright.sources import formats, images


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + pack(">I4sIIBBBBB", 13, b"IHDR", w, h, 8, 2, 0, 0, 0)


def tiff(tags, order="<"):
    head = (b"II*\0" if order == "<" else b"MM\0*") + pack(order + "IH", 8, len(tags))
    return head + b"".join(pack(order + "HHI", tag, 3, 1) + pack(order + "HH", value, 0) for tag, value in tags) + b"\0" * 4


def jpeg(w, h, orientation=None):
    exif = b""
    if orientation:
        body = b"Exif\0\0" + tiff([(274, orientation)], ">")
        exif = b"\xff\xe1" + pack(">H", len(body) + 2) + body
    return b"\xff\xd8\xff\xe0" + pack(">H", 16) + b"JFIF" + b"\0" * 10 + exif + b"\xff\xc0" + pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9


def webp(kind, body):
    return b"RIFF\0\0\0\0WEBP" + kind + pack("<I", len(body)) + body + b"\0" * 8


KINDS = [
    (png(31, 17), (31, 17)),
    (b"BM" + b"\0" * 16 + pack("<ii", 40, -30) + b"\0" * 8, (40, 30)),
    (jpeg(50, 20), (50, 20)),
    (jpeg(50, 20, 1), (50, 20)),
    (jpeg(50, 20, 6), (20, 50)),
    (tiff([(256, 9), (257, 8)]), (9, 8)),
    (tiff([(256, 9), (257, 8)], ">"), (9, 8)),
    (webp(b"VP8X", b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")), (100, 50)),
    (webp(b"VP8L", b"\x2f" + ((99) | (49 << 14)).to_bytes(4, "little")), (100, 50)),
    (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + pack("<HH", 100, 50)), (100, 50)),
    (b"text", None),
    (b"", None),
    (b"\xff\xd8\xff", None),
]


@pytest.mark.parametrize("at", range(len(KINDS)))
def test_header_sizes(at):
    assert images.header_size(BytesIO(KINDS[at][0])) == KINDS[at][1]


@pytest.fixture()
def root(tmp_path):
    """Two splits with an image of the same name in each, a hidden file, a class list and a label without image."""
    for split, w in (("train", 100), ("val", 200)):
        for folder in ("images", "labels"):
            (tmp_path / "yolo" / folder / split).mkdir(parents=True)
        (tmp_path / "yolo/images" / split / "1.png").write_bytes(png(w, 50))
        (tmp_path / "yolo/images" / split / ".hidden.png").write_bytes(png(1, 1))
        (tmp_path / "yolo/images" / split / "cut.jpg").write_bytes(b"\xff\xd8\xff\xc0\0\x11")
        (tmp_path / "yolo/labels" / split / "1.txt").write_text("0 0.5 0.5 0.2 0.4\n1 0.25 0.5 0.1 0.2\n")
    (tmp_path / "names.txt").write_text("car\ndog\n")
    return tmp_path


def test_listing_and_headers(spark, root):
    files = images.list_files(spark, f"file://{root}/yolo/images")
    assert "content" not in files.columns
    assert {r.image_id: (r.width, r.height) for r in images.sizes_of(files, images.split_key).collect()} == {"train/1": (100, 50), "val/1": (200, 50)}
    assert {r.split: r.n for r in images.gathered(files.where(~images.is_hidden(F.col("path")))).collect()} == {"train": 2, "val": 2}
    assert spark.createDataFrame([("/a/b/c.png",), ("/x/images/c.png",)], "path string").select(images.split_key(F.col("path"))).collect() == [("c",), ("c",)]


BOXES = {("train/1", "car", 40, 15, 60, 35), ("train/1", "dog", 20, 20, 30, 30), ("val/1", "car", 80, 15, 120, 35), ("val/1", "dog", 40, 20, 60, 30)}


def found(annotations):
    near = annotations.withColumn("points", F.transform("points", lambda p: F.array(F.round(p[0], 6), F.round(p[1], 6))))
    return {(r.image_id, r.label, r.x1, r.y1, r.x2, r.y2) for r in formats.match_records(near).collect()}


@pytest.mark.parametrize("middle", ["labelme", "voc", "coco"])
def test_splits_through_conversions(spark, root, middle):
    """yolo to each format and back keeps splits, sizes and boxes."""
    suffix = {"labelme": "json", "voc": "xml", "coco": "json"}[middle]
    there = f"{root}/{middle}/" + ("annotations" if middle == "coco" else "labels")
    cli.main(["yolo2" + middle, f"file://{root}/yolo/labels", there if middle == "coco" else f"file://{there}", "--names", str(root / "names.txt"), "--images", f"file://{root}/yolo/images", "--splits"])
    if middle == "coco":
        doc = json.loads((root / "coco/annotations/instances_val.json").read_text())
        assert [i["file_name"] for i in doc["images"]] == ["1.jpg"] and doc["images"][0]["width"] == 200
        rows = formats.from_coco(formats.read_files(spark, f"file://{there}", True), True)
    else:
        files = formats.read_files(spark, f"file://{there}", True)
        rows = (formats.from_labelme if middle == "labelme" else formats.from_voc)(files, images.split_key)
        assert (root / middle / "labels/val" / f"1.{suffix}").exists()
    assert found(rows) == BOXES
    formats.convert(spark, middle, "yolo", f"file://{there}", f"file://{root}/back/labels", splits=True)
    names = formats.names_table(spark, {0: "car", 1: "dog"})
    sizes = images.sizes_of(images.list_files(spark, f"file://{root}/yolo/images"), images.split_key)
    assert found(formats.from_yolo(formats.read_files(spark, f"file://{root}/back/labels", True), names, sizes, images.split_key)) == BOXES


def test_class_subset_of_folders(spark, tmp_path):
    for name, text in (("1", "0 .5 .5 .1 .1\n2 .5 .5 .2 .2 .9\n"), ("2", "0 .5 .5 .1 .1\n"), ("3", "2 0 0 1 1\n"), ("classes", "a\nb\nc\n")):
        (tmp_path / "a/labels").mkdir(parents=True, exist_ok=True)
        (tmp_path / "a/labels" / f"{name}.txt").write_text(text)
    (tmp_path / "a/images").mkdir()
    for name in ("1", "2"):
        (tmp_path / "a/images" / f"{name}.png").write_bytes(png(5, 5))
    (tmp_path / "names.yaml").write_text("names: [a, b, c]\n")
    cli.main(["yoloLabelExclude", f"file://{tmp_path}", "2,1", "--names", str(tmp_path / "names.yaml"), "--title", "two"])
    got = {p.name: p.read_text() for p in (tmp_path / "a/labels_two").glob("*.txt")}
    assert got == {"1.txt": "0 .5 .5 .2 .2 .9", "2.txt": ""}
    assert (tmp_path / "two/classes.txt").read_text() == "c\nb\n" and formats.read_names(str(tmp_path / "two/data.yaml")) == {0: "c", 1: "b"}
    both = [spark.createDataFrame([(x,)], "label string") for x in "ca"]
    assert dataset.shared_subsets(both, ["a", "b", "c"]) == ["a", "c"]
    assert dataset.with_background({1: "x", 0: "y"}) == ["y", "x", "background"] == dataset.with_background(["y", "x", "background"])


def test_error_labels(spark):
    gt = spark.createDataFrame([(1, 0, 5, 0, 0, 10, 10, False), (1, 1, 5, 50, 50, 60, 60, False), (1, 2, 6, 80, 80, 90, 90, True), (2, 0, 5, 0, 0, 10, 10, False), (3, 0, 5, 0, 0, 9, 9, True)], "image_id long, gt_idx long, cls long, x1 int, y1 int, x2 int, y2 int, difficult boolean")
    pr = spark.createDataFrame([(1, 0, 5, 0, 0, 10, 10, 0.9), (1, 1, 6, 20, 20, 30, 30, 0.9), (2, 0, 5, 0, 0, 10, 10, 0.9)], "image_id long, pred_idx long, cls long, x1 int, y1 int, x2 int, y2 int, conf double")
    notes = confusion.error_annotations(confusion.error_shapes(gt, pr), spark.createDataFrame([(1, 100, 90)], "image_id long, width int, height int"))
    docs = {r.image_id: json.loads(r.value) for r in formats.to_labelme(notes).collect()}
    assert set(docs) == {1} and docs[1]["flags"] == {"haveTp": True, "haveFp": True, "haveFn": True} and docs[1]["imageWidth"] == 100
    assert {s["label"]: [k for k in ("TPG", "FP", "FN", "difficult") if s["flags"][k]] for s in docs[1]["shapes"]} == {"5": ["TPG"], "6-fp": ["FP"], "5-fn": ["FN"], "6-fn": ["FN", "difficult"]}


def test_detections_and_printing(spark):
    found = spark.createDataFrame([("a", 0, 3, 0.5, 1, 2, 3, 4, [[0.0, 0.0], [5.0, 0.0], [5.0, 5.0]]), ("a", 1, 4, 0.25, 1, 2, 3, 4, None)], "image_id string, pred_idx long, cls long, conf double, x1 int, y1 int, x2 int, y2 int, segment array<array<double>>")
    names = spark.createDataFrame([(3, "bus")], "cls long, label string")
    rows = dataset.detection_annotations(found, names, spark.createDataFrame([("a", 9, 9), ("b", 9, 9)], "image_id string, width int, height int"))
    assert {(r.image_id, r.label, r.shape_type, r.score) for r in rows.collect()} == {("a", "bus", "polygon", 0.5), ("a", "4", "rectangle", 0.25), ("b", None, None, None)}
    empty = spark.createDataFrame([], "cls long, n long, n_images long, p double, r double, ap50 double, ap75 double, map double")
    assert {r.value for r in precision.metric_values(empty).collect()} == {0.0}
    table = precision.results_table(empty, spark.createDataFrame([], "cls long, name string"), found)
    assert [r.line.split() for r in precision.printed(table).collect()][0][:3] == ["all", "1", "0"]
