"""Label files written and read back, odd documents, the streaming counts, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from boxwright import cli
from boxwright.operators.confusion import confusion_counts
from boxwright.sources import formats
from boxwright.sources.derived import boxes
from boxwright.streaming.confusion import PAIRED, confusion_changes, split_sides, totals

NAMES = {0: "car", 1: "person & co"}
SCHEMA = "image_id string, width int, height int, ann_idx int, label string, shape_type string, points array<array<double>>, score double, flags map<string,boolean>"
ROWS = [
    ("a", 200, 100, 0, "car", "rectangle", [[10.0, 20.0], [60.0, 70.0]], 1.0, {"difficult": False}),
    ("a", 200, 100, 1, "person & co", "polygon", [[0.0, 0.0], [40.0, 0.0], [40.0, 50.0], [20.0, 75.0], [0.0, 50.0]], 0.5, {"difficult": True}),
    ("b", 64, 32, None, None, None, None, None, None),
]


@pytest.fixture()
def notes(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def records(df):
    return sorted((r.image_id, r.idx, r.label, r.x1, r.y1, r.x2, r.y2) for r in formats.match_records(df).collect())


EXPECTED = [("a", 0, "car", 10, 20, 60, 70), ("a", 1, "person & co", 0, 0, 40, 75)]


def test_round_trips(spark, notes, tmp_path):
    names = formats.names_table(spark, NAMES)
    for make, suffix, read in (
        (formats.to_labelme, ".json", formats.from_labelme),
        (formats.to_voc, ".xml", formats.from_voc),
        (lambda n: formats.to_yolo(n, names), ".txt", lambda f: formats.from_yolo(f, names, notes.select("image_id", "width", "height").distinct())),
    ):
        folder = tmp_path / suffix[1:]
        assert formats.write_texts(make(notes), f"file://{folder}", suffix) == 2
        back = read(formats.read_files(spark, f"file://{folder}/*{suffix}"))
        rounded = back.withColumn("points", F.transform("points", lambda p: F.array(F.round(p[0], 6), F.round(p[1], 6))))
        assert records(rounded) == EXPECTED
        assert back.where("image_id = 'b'").select("ann_idx").collect() == [(None,)]
    flags = {r.ann_idx: r.flags["difficult"] for r in formats.from_voc(formats.read_files(spark, f"file://{tmp_path}/xml/a.xml")).collect()}
    assert flags == {0: False, 1: True}


def test_coco(spark, notes, tmp_path):
    path = str(tmp_path / "annotations.json")
    formats.write_coco(notes, formats.names_table(spark, NAMES), path, start=1)
    body = json.loads(open(path, encoding="utf-8").read())
    assert [i["id"] for i in body["images"]] == [1, 2] and body["annotations"][0]["bbox"] == [10, 20, 50, 50] and body["annotations"][1]["area"] == 40 * 75
    assert records(formats.from_coco(formats.read_files(spark, f"file://{path}"))) == EXPECTED
    shapes = [[[0, 0, 9, 0, 9, 9, 0, 9], [0, 0, 30, 0, 30, 30]], {"counts": "x", "size": [2, 2]}, []]
    doc = {"images": [{"id": 1, "file_name": "q.jpg", "height": 50, "width": 50}], "annotations": [{"id": k, "image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4], "segmentation": s} for k, s in enumerate(shapes)], "categories": []}
    files = spark.createDataFrame([("/x/q.json", json.dumps(doc)), ("/x/bad.json", "{")], "path string, value string")
    rows = {r.ann_idx: r for r in formats.from_coco(files).collect()}
    assert rows[0].points == [[0, 0], [30, 0], [30, 30]] and [rows[k].shape_type for k in (1, 2)] == ["rectangle"] * 2 and rows[1].label == "7"


def test_odd_documents(spark):
    voc = "<annotation><size><width>100</width><height>50</height></size><object><name>x</name><bndbox><xmin>163.7</xmin><ymin>9</ymin><xmax>10</xmax><ymax>-4</ymax></bndbox></object><object><name>y</name></object></annotation>"
    files = spark.createDataFrame([("/a/k.xml", voc), ("/a/l.xml", "<annotation></annotation>"), ("/a/m.xml", "not xml")], "path string, value string")
    rows = {(r.image_id, r.ann_idx): r for r in formats.from_voc(files).collect()}
    assert rows["k", 0].points == [[10, 0], [100, 9]] and rows["k", 1].points == [[0, 0], [0, 0]]
    assert formats.match_records(formats.from_voc(files)).count() == 1
    labelme = spark.createDataFrame([("/a/k.json", '{"imagePath":"k.png","shapes":[]}'), ("/a/z.json", "oops")], "path string, value string")
    assert [(r.image_id, r.ann_idx) for r in formats.from_labelme(labelme).collect()] == [("k", None)]


def test_names_and_cli(spark, notes, tmp_path):
    (tmp_path / "n.txt").write_text("car\n\nperson & co\n")
    (tmp_path / "n.yaml").write_text("names:\n  0: car\n  1: person & co\n")
    assert formats.read_names(str(tmp_path / "n.txt")) == formats.read_names(str(tmp_path / "n.yaml")) == NAMES
    formats.write_texts(formats.to_labelme(notes), f"file://{tmp_path}/in", ".json")
    cli.main(["labelme2voc", f"file://{tmp_path}/in/*.json", f"file://{tmp_path}/voc"])
    assert records(formats.from_voc(formats.read_files(spark, f"file://{tmp_path}/voc/*.xml"))) == EXPECTED


def test_stream(spark, tmp_path):
    """Files of predictions and truth in any order, some late and some twice, against a batch over the rows."""
    gt, pr = boxes(spark, "/root/testdata/sf0.001")
    common = ["image_id", "cls", "x1", "y1", "x2", "y2"]
    rows = gt.select(*common, F.lit("gt").alias("side"), F.col("gt_idx").alias("idx"), "difficult", F.lit(None).cast("double").alias("conf")).unionByName(pr.select(*common, F.lit("pred").alias("side"), F.col("pred_idx").alias("idx"), F.lit(None).cast("boolean").alias("difficult"), "conf"))
    rows = rows.where("image_id < 60").select(*(part.split()[0] for part in PAIRED.split(", "))).withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("image_id") % 7 * 60)).cache()
    for n, part in enumerate(("side = 'pred' AND image_id % 3 = 0", "side = 'gt' AND idx % 2 = 0", "side = 'pred' AND image_id % 3 > 0", "side = 'gt' AND idx % 2 = 0", "side = 'gt' AND idx % 2 = 1")):
        rows.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        run = confusion_changes(stream, 5, time="at").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        run.awaitTermination(240)
        assert run.exception() is None
        # far later a row of another image lets the watermark pass all others: their state goes, and what was counted stays
        rows.where("image_id = 59").limit(1).withColumns({"image_id": F.lit(1000).cast("long"), "at": F.timestamp_seconds(F.lit(1_700_400_000))}).coalesce(1).write.parquet(f"{tmp_path}/in/5")
        rows.where("image_id = 58").limit(1).withColumns({"image_id": F.lit(1001).cast("long"), "at": F.timestamp_seconds(F.lit(1_700_400_001))}).coalesce(1).write.parquet(f"{tmp_path}/in/6")
        rows.limit(30).coalesce(1).write.parquet(f"{tmp_path}/in/7")  # too late by then
        again = confusion_changes(stream, 5, time="at").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        again.awaitTermination(240)
        assert again.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    expected = sorted(map(tuple, confusion_counts(*split_sides(rows), background=5).collect()))
    assert sorted(map(tuple, totals(spark.read.parquet(str(tmp_path / "out")).where("image_id < 1000")).collect())) == expected


def test_names_that_json_escapes_and_missing_names(spark, tmp_path):
    odd = spark.createDataFrame([('a"b\\c', 10, 10, 0, 'q"r', "rectangle", [[1.0, 1.0], [5.0, 5.0]], 1.0, {"difficult": False})], SCHEMA)
    body = json.loads(formats.to_labelme(odd).first()["value"])
    assert body["imagePath"] == 'a"b\\c.jpg' and body["shapes"][0]["label"] == 'q"r'
    source = spark.createDataFrame(ROWS, SCHEMA)
    formats.write_texts(formats.to_labelme(source), f"file://{tmp_path}/in", ".json")
    formats.convert(spark, "labelme", "yolo", f"file://{tmp_path}/in/*.json", f"file://{tmp_path}/yolo")
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "yolo").glob("*.txt")) == 2
    with pytest.raises(ValueError, match="without a class id"):
        formats.convert(spark, "labelme", "yolo", f"file://{tmp_path}/in/*.json", f"file://{tmp_path}/other", {0: "car"})


def test_readers_by_suffix_or_format(spark, notes, tmp_path):
    names, sizes = formats.names_table(spark, NAMES), notes.select("image_id", "width", "height").distinct()
    for made, suffix in ((formats.to_labelme(notes), ".json"), (formats.to_voc(notes), ".xml"), (formats.to_yolo(notes, names), ".txt")):
        formats.write_texts(made, f"file://{tmp_path}/a{suffix}", suffix)
        back = formats.read_labels(spark, f"file://{tmp_path}/a{suffix}/*{suffix}", names=NAMES, sizes=sizes)
        assert records(back.withColumn("points", F.transform("points", lambda p: F.array(F.round(p[0], 6), F.round(p[1], 6))))) == EXPECTED
    formats.write_coco(notes, names, f"{tmp_path}/c.json")
    assert records(formats.read_labels(spark, f"file://{tmp_path}/c.json", "coco")) == EXPECTED
    assert formats.read_labels(spark, None).count() == 0
    for bad in (("x.txt", None), ("x.bin", None), ("x.json", "other")):
        with pytest.raises(ValueError):
            formats.read_labels(spark, *bad)


def test_targets_of_grouped_annotations(spark):
    """Annotations that are grouped once give the same documents: unknown labels, two sizes, bare rows, polygons and double names too."""
    rows = [("a", 100, 50, 1, "x", "rectangle", [[0.0, 0.0], [10.0, 5.0]], 0.5, {"difficult": True}), ("a", 100, 50, 0, "y", "polygon", [[0.0, 0.0], [10.0, 5.0], [3.0, 9.0]], 1.0, {}), ("a", 90, 50, 0, "x", "rectangle", [[1.0, 1.0], [2.0, 2.0]], 1.0, None), ("b", 10, 10, None, None, None, None, None, None), ("c", 10, 10, 0, "unknown", "rectangle", [[1.0, 1.0], [2.0, 2.0]], 1.0, {}), ("d", 10, 10, 0, "unknown", "rectangle", [[1.0, 1.0], [2.0, 2.0]], 1.0, {}), ("d", 10, 10, None, None, None, None, None, None)]
    notes = spark.createDataFrame(rows, "image_id string, width int, height int, ann_idx int, label string, shape_type string, points array<array<double>>, score double, flags map<string,boolean>")
    names = spark.createDataFrame([(0, "x"), (1, "y"), (2, "y")], "cls_id long, label string")
    grouped = formats.by_image(notes)
    for write in (formats.to_labelme, formats.to_voc, lambda df: formats.to_yolo(df, names)):
        assert sorted(map(tuple, write(grouped).collect())) == sorted(map(tuple, write(notes).collect()))
    back = formats.annotations_of(grouped).where("ann_idx IS NOT NULL").drop("flags")
    assert sorted(map(str, back.collect())) == sorted(map(str, notes.where("ann_idx IS NOT NULL").drop("flags").select(back.columns).collect()))


def test_documents_are_parsed_once(spark):
    """Neither filters nor the columns of labels parse a document again, and conversions read their source once."""
    files = spark.createDataFrame([("/l/a.json", "{}")], "path string, value string")
    for read, parser in ((formats.from_labelme, "from_json"), (formats.from_voc, "from_xml"), (lambda f: formats.from_coco(f, masks=False), "from_json(StructField(images")):
        assert read(files)._jdf.queryExecution().optimizedPlan().toString().count(parser) == 1
