"""COCO documents in ranges and by many writers, run-length masks, crops around labels, extra tags, missing images."""

import json
from struct import pack

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright import cli
from boxwright.functions import masks
from boxwright.operators import dataset
from boxwright.sources import folders, formats, images, records


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + pack(">I4sIIBBBBB", 13, b"IHDR", w, h, 8, 2, 0, 0, 0)


def document(rng, n):
    odd = ['a"b', "c\\", 'd\\"e', "{[", "]}", '"annotations": [', "é漢", "\\\\", "x" * 50, 'end\\\\"']
    pick = lambda: odd[int(rng.integers(len(odd)))]
    return {
        "info": {"images": [{"id": 99}], "note": pick()},
        "licenses": [{"id": 1, "annotations": [{"id": 5}]}],
        "images": [{"id": k, "file_name": f"{k}{pick()}.jpg", "height": 50, "width": 60} for k in range(n)],
        "notes": [[{"id": 1}], "x", {"images": [{"id": 3}]}],
        "annotations": [{"id": k, "image_id": k % n, "category_id": 1 + k % 3, "bbox": [1, 2, 3, 4], "segmentation": [] if k % 2 else {"counts": pick(), "size": [2, 2]}, "extra": [{"t": pick()}, [pick()]]} for k in range(3 * n)],
        "categories": [{"id": k, "name": f"c{k}{pick()}"} for k in (1, 2, 3)],
    }


@pytest.mark.parametrize("size", [1 << 20, 1000, 97])
@pytest.mark.parametrize("indent", [None, 2])
def test_members_of_large_documents(spark, tmp_path, size, indent):
    """Whatever the ranges, the members of the three top-level arrays, and those alone, in order."""
    rng, docs = np.random.default_rng(size), {}
    for k, n in enumerate((7, 1, 0)):
        docs[f"{k}.json"] = document(rng, n) if n else {"images": [], "annotations": []}
        (tmp_path / f"{k}.json").write_text(json.dumps(docs[f"{k}.json"], indent=indent, ensure_ascii=bool(k)), encoding="utf-8")
    (tmp_path / "bad.json").write_text('{"images": [{"id": 1}, {"id": 2')
    files = images.list_files(spark, f"file://{tmp_path}/*.json")
    rows = records.members(spark, files, formats.SECTIONS, size)
    got = {}
    for r in rows.orderBy("path", "place").collect():
        got.setdefault((r.path.rpartition("/")[2], r.section), []).append(json.loads(r.value))
    expected = {(name, s): body[s] for name, body in docs.items() for s in formats.SECTIONS if body.get(s)} | {("bad.json", "images"): [{"id": 1}]}
    assert got == expected
    if size == 1000:
        assert rows.where("path LIKE '%0.json'").select(F.spark_partition_id()).distinct().count() > 1
        whole = formats.from_coco(formats.read_files(spark, f"file://{tmp_path}/?.json"))
        parts = formats.from_coco(formats.read_coco(spark, f"file://{tmp_path}/?.json", size=size))
        key = lambda df: sorted(map(str, df.collect()))
        assert key(whole) == key(parts) and len(key(whole)) == 24
        assert formats.coco_names(formats.read_coco(spark, f"file://{tmp_path}/0.json", size=size)) == {i: c["name"] for i, c in enumerate(docs["0.json"]["categories"])}


def test_document_by_many_writers(spark, tmp_path, monkeypatch):
    """Ids in order, several tasks, nothing through the driver, and no file until it is whole."""
    rows = [(f"i{k % 400:04d}", 100, 80, k // 400, f"é{k % 3}", "rectangle", [[1.0, 2.0], [float(3 + k % 50), 9.0]], 1.0, {"difficult": False}) for k in range(2000)] + [("empty", 5, 6, None, None, None, None, None, None)]
    notes = spark.createDataFrame(rows, "image_id string, width int, height int, ann_idx int, label string, shape_type string, points array<array<double>>, score double, flags map<string,boolean>").repartition(6)
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)
    path = f"{tmp_path}/deep/annotations.json"
    formats.write_coco(notes, formats.names_table(spark, {k: f"é{k}" for k in range(3)}), path)
    body = json.loads(open(path, encoding="utf-8").read())
    assert [i["id"] for i in body["images"]] == list(range(1, 402)) and [i["file_name"] for i in body["images"]] == sorted({f"{r[0]}.jpg" for r in rows})
    assert [a["id"] for a in body["annotations"]] == list(range(1, 2001)) and [c["name"] for c in body["categories"]] == ["é0", "é1", "é2"]
    name = {i["id"]: i["file_name"][:-4] for i in body["images"]}
    listed = [(name[a["image_id"]], a["bbox"][2], a["category_id"]) for a in body["annotations"]]
    assert listed == [(r[0], r[6][1][0] - 1, int(r[4][1]) + 1) for r in sorted(rows, key=lambda r: (r[0], r[3] or 0)) if r[3] is not None]
    back = formats.match_records(formats.from_coco(formats.read_coco(spark, f"file://{path}", size=20_000)))
    assert back.count() == 2000 and not list((tmp_path / "deep").glob("*.part"))
    formats.write_coco(notes.where("false"), formats.names_table(spark, {}), path)
    body = json.loads(open(path).read())
    assert len(body.pop("info")["date_created"].split("/")) == 3 and body == {"images": [], "annotations": [], "categories": []}


def encoded(mask, text):
    flat = mask.T.ravel()
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flat, [1 - flat[-1]]))))
    runs = np.diff(np.concatenate(([0], edges))).tolist()
    runs[-1] = len(flat) - sum(runs[:-1])
    if not text:
        return runs
    out = ""
    for k, run in enumerate(runs):
        value = run - runs[k - 2] if k > 2 else run
        while True:
            bits, value = value & 31, value >> 5
            more = not (value == -1 and bits & 16 or value == 0 and not bits & 16)
            out += chr(48 + (bits | 32 if more else bits))
            if not more:
                break
    return out


def filled(shape, polygons):
    """Pixels on or in the polygons by even and odd crossings; holes' own border pixels stay."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    inside, border = np.zeros(shape, bool), np.zeros(shape, bool)
    for p in polygons:
        for (x1, y1), (x2, y2) in zip(p, [*p[1:], p[0]], strict=True):
            crosses = (y >= min(y1, y2)) & (y < max(y1, y2))
            inside ^= crosses & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1 if y2 != y1 else 1))
            n = int(max(abs(x2 - x1), abs(y2 - y1))) or 1
            border[np.round(y1 + (y2 - y1) * np.arange(n + 1) / n).astype(int), np.round(x1 + (x2 - x1) * np.arange(n + 1) / n).astype(int)] = True
    return inside | border


def test_masks_to_polygons():
    square = np.zeros((12, 15), int)
    square[2:7, 3:9] = 1
    for text in (False, True):
        assert masks.mask_polygons(json.dumps({"size": [12, 15], "counts": encoded(square, text)})) == [[[3, 2], [3, 6], [8, 6], [8, 2]]]
    ring = np.zeros((20, 20), int)
    ring[2:18, 2:18] = 1
    ring[6:14, 6:14] = 0
    ring[9:12, 9:12] = 1
    found = masks.mask_polygons(json.dumps({"size": [20, 20], "counts": encoded(ring, True)}))
    assert len(found) == 3 and {tuple(p) for p in found[0]} == {(2, 2), (2, 17), (17, 17), (17, 2)}  # the outer one, then hole and what is in it
    assert {tuple(p) for p in found[2]} == {(9, 9), (9, 11), (11, 11), (11, 9)}
    assert len(masks.mask_polygons(json.dumps({"size": [20, 20], "counts": encoded(ring, True)}), 20.0)) == 2
    dots = np.zeros((5, 5), int)
    dots[0, 0] = dots[2, 1:4] = dots[4, 4] = 1  # a pixel and a line have no three corners
    assert masks.mask_polygons(json.dumps({"size": [5, 5], "counts": encoded(dots, False)})) == []
    for bad in (None, "", "x", "[]", "{}", '{"size": [2]}'):
        assert masks.mask_polygons(bad) is None
    assert masks.mask_polygons('{"size": [3, 3], "counts": [9]}') == []


def test_contours_of_random_masks_fill_them_again():
    """Outer parts and holes of connected shapes give back the mask."""
    rng = np.random.default_rng(11)
    for _ in range(60):
        mask = np.zeros((24, 30), int)
        for _ in range(int(rng.integers(1, 5))):
            a, b = sorted(rng.integers(0, 24, 2)), sorted(rng.integers(0, 30, 2))
            mask[a[0] : a[1] + 3, b[0] : b[1] + 3] = 1
        for _ in range(int(rng.integers(0, 3))):
            a, b = int(rng.integers(1, 20)), int(rng.integers(1, 26))
            mask[a : a + 2, b : b + 2] = 0
        pixels, first = masks.decoded(encoded(mask, True), 24)
        assert (pixels == mask[:, first : first + pixels.shape[1]]).all()
        outer, inner = masks.contours(mask)
        assert (filled(mask.shape, [p.tolist() for p in outer + inner]) == mask.astype(bool)).all()


def test_coco_segmentations(spark):
    square = np.zeros((50, 60), int)
    square[10:30, 5:25] = 1
    shapes = [{"size": [50, 60], "counts": encoded(square, True)}, {"size": [50, 60], "counts": encoded(square, False)}, [[0, 0, 9, 0, 9, 9, 0, 9], [0, 0, 30, 0, 30, 30]], [[0, 0, 2, 0, 2, 2]], {"size": [50, 60], "counts": [3000]}]
    doc = {"images": [{"id": 1, "file_name": "q.jpg", "height": 50, "width": 60}], "annotations": [{"id": k, "image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4], "segmentation": s} for k, s in enumerate(shapes)], "categories": []}
    files = spark.createDataFrame([("/x/q.json", json.dumps(doc))], "path string, value string")
    rows = {r.ann_idx: r for r in formats.from_coco(files, min_area=5.0).collect()}
    assert rows[0].points == rows[1].points == [[5, 10], [5, 29], [24, 29], [24, 10]] and rows[2].points == [[0, 0], [30, 0], [30, 30]]
    assert [rows[k].shape_type for k in range(5)] == ["polygon", "polygon", "polygon", "rectangle", "rectangle"]
    assert formats.from_coco(files, masks=False).where("shape_type = 'polygon'").count() == 2


def test_tags_clips_and_missing_images(spark, tmp_path):
    voc = "<annotation><source><database>D</database></source><size><width>9</width><height>9</height></size><object><name>x</name><pose>Left</pose><truncated>1</truncated><occluded>yes</occluded><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>5</xmax><ymax>4</ymax></bndbox></object><object><name>y</name></object></annotation>"
    files = spark.createDataFrame([("/a/k.xml", voc)], "path string, value string")
    rows = formats.from_voc(files, extra_keys=("occluded",)).orderBy("ann_idx").collect()
    assert [(r.database, r.pose, r.truncated, r.occluded) for r in rows] == [("D", "Left", "1", "yes"), ("D", "Unspecified", "0", None)]
    lines = spark.createDataFrame([("/a/k.txt", "0 0.9 0.5 0.4 0.5\n1 0.5 0.5 1.5 1.5")], "path string, value string")
    notes = formats.from_yolo(lines, formats.names_table(spark, {}), spark.createDataFrame([("k", 100, 80)], "image_id string, width int, height int"))
    assert sorted((r.x1, r.y1, r.x2, r.y2) for r in formats.match_records(notes, clip=True).collect()) == [(0, 0, 100, 80), (70, 20, 100, 60)]
    assert {(r.file, r.label, r.n) for r in dataset.file_histogram(notes).collect()} == {("k", "0", 1), ("k", "1", 1)}
    (tmp_path / "a.png").write_bytes(png(5, 6))
    listed = spark.createDataFrame([(f"file://{tmp_path}/{n}.png",) for n in ("a", "gone")], "path string")
    assert {(r.path[-5:], r.width) for r in images.image_headers(listed).collect()} == {("a.png", 5), ("e.png", None)}


@pytest.mark.parametrize("pattern", ["voc", "yolo"])
def test_cut_images(spark, tmp_path, pattern):
    """Labels of the crops in their coordinates, and the list of crops."""
    for folder in ("images", "labels"):
        (tmp_path / "in" / folder).mkdir(parents=True)
    (tmp_path / "in/images/p.png").write_bytes(png(1024, 512))
    boxes = [("car", 16, 24, 64, 72), ("dog", 72, 80, 120, 128), ("car", 800, 304, 896, 400)]
    notes = spark.createDataFrame([("p", 1024, 512, k, n, "rectangle", [[float(a), float(b)], [float(c), float(d)]], 1.0, {"difficult": False}) for k, (n, a, b, c, d) in enumerate(boxes)], "image_id string, width int, height int, ann_idx int, label string, shape_type string, points array<array<double>>, score double, flags map<string,boolean>")
    names = {0: "car", 1: "dog"}
    (tmp_path / "n.txt").write_text("car\ndog\n")
    made = formats.to_voc(notes) if pattern == "voc" else formats.to_yolo(notes, formats.names_table(spark, names))
    formats.write_texts(made, f"file://{tmp_path}/in/labels", ".xml" if pattern == "voc" else ".txt")
    cli.main(["cutImg", f"file://{tmp_path}/in", f"file://{tmp_path}/out", "--pattern", pattern, "--size", "200", "--names", str(tmp_path / "n.txt")])
    assert json.loads((tmp_path / "out/name2cut_box.json").read_text()) == {"p": [{"bbox": [0, 0, 200, 200], "name": "p_cut_0"}, {"bbox": [748, 252, 948, 452], "name": "p_cut_2"}]}
    files = formats.read_files(spark, f"file://{tmp_path}/out/labels/*")
    sizes = spark.createDataFrame([("p_cut_0", 200, 200), ("p_cut_2", 200, 200)], "image_id string, width int, height int")
    back = formats.from_voc(files) if pattern == "voc" else formats.from_yolo(files, formats.names_table(spark, names), sizes)
    near = back.withColumn("points", F.transform("points", lambda p: F.array(F.round(p[0], 6), F.round(p[1], 6))))
    assert {(r.image_id, r.label, r.x1, r.y1, r.x2, r.y2) for r in formats.match_records(near).collect()} == {("p_cut_0", "car", 16, 24, 64, 72), ("p_cut_0", "dog", 72, 80, 120, 128), ("p_cut_2", "car", 52, 52, 148, 148)}


def test_names_to_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"imagePath": "a.png", "shapes": [{"label": n, "points": [[0, 0], [1, 1]]} for n in ("b10", "b2", "b2")]}))
    cli.main(["genNames", f"file://{tmp_path}/a.json", ".json", "--out", f"file://{tmp_path}/names"])
    assert (tmp_path / "names/classes.txt").read_text() == "b2\nb10\n" and json.loads((tmp_path / "names/classes.json").read_text()) == {"b2": 2, "b10": 1}


def test_numbered_folders(tmp_path):
    assert folders.as_paths("a") == folders.as_paths(["a"]) == ["a"] and folders.as_paths([tmp_path, "b"]) == [str(tmp_path), "b"]
    parent = str(tmp_path / "x")
    assert folders.free_folder(parent) == folders.free_folder(parent) == f"{parent}/results"
    (tmp_path / "x/results/a").write_text("")
    assert folders.free_folder(parent) == f"{parent}/results1" == folders.free_folder(f"file://{parent}").removeprefix("file://")


def test_masks_of_a_batch_as_each_by_itself(monkeypatch):
    """Borders of many masks are followed at once, in parts of any size, and equal those of each mask alone."""
    rng, texts = np.random.default_rng(5), []
    for k in range(600):
        mask = (rng.random(rng.integers(1, 20, 2)) < rng.random()).astype(int)
        if k % 2:
            mask[:] = 0
            for value in (1, 1, 0, 1):
                a, b = (sorted(rng.integers(0, n + 1, 2)) for n in mask.shape)
                mask[a[0] : a[1], b[0] : b[1]] = value
        texts.append(json.dumps({"size": mask.shape, "counts": encoded(mask, bool(k % 3))}))
    texts += [None, "", "x", "[]", "{}", '{"size": [0, 3], "counts": [1, 2]}', '{"size": [3, 3], "counts": [9]}', '{"size": [3, 3], "counts": []}']
    alone = {least: [masks.mask_polygons(t, least) for t in texts] for least in (0.0, 6.0)}
    monkeypatch.setattr(masks, "contours", None)  # not one mask after the other
    for together in (1 << 21, 700):
        monkeypatch.setattr(masks, "TOGETHER", together)
        for least, expected in alone.items():
            found = masks.batch_polygons(texts, least)
            assert [None if f is None else [p.tolist() for p in np.split(f[1], np.cumsum(f[0])[:-1])] if len(f[0]) else [] for f in found] == expected
