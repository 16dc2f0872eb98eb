"""Hand-computed values of the scalar functions and small kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.functions import boxes as B
from boxwright.functions import text as X
from boxwright.operators import merging, tiling
from boxwright.plans.pipeline import OPERATORS, Pipeline, guarded
from boxwright.plans.registry import PARAMS, Registry


def lit(*values):
    return B.Box(*(F.lit(v) for v in values))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_boxes(spark):
    a, b = lit(0, 0, 10, 10), lit(5, 5, 15, 15)
    assert tuple(one(spark, B.iou(a, b), B.ios(a, b), B.ios(b, a))) == pytest.approx((25 / 175, 0.25, 0.25))
    assert tuple(one(spark, *B.xywh2xyxy(*map(F.lit, (10, 10, 5, 4))))) == (8, 8, 12, 12)
    assert tuple(one(spark, *B.rel_box(lit(10, 10, 50, 50), lit(5, 20, 60, 30)))) == (0, 10, 40, 20)
    assert tuple(one(spark, *B.abs_box(lit(10, 10, 50, 50), lit(0, 10, 40, 20)))) == (10, 20, 50, 30)
    cut, area = B.inter_box(lit(0, 0, 1, 1), lit(1, 0, 2, 1))
    assert tuple(one(spark, area)) == (0,)


def test_direction(spark):
    points = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))))
    for mode in ("semantic_refer", "long_edge_refer", "opencv_refer"):
        assert tuple(one(spark, *B.direction(points, mode))) == pytest.approx((2, 1, 4, 2, 0))
    with pytest.raises(ValueError):
        B.direction(points, "other")


def test_text(spark):
    assert one(spark, X.str2list(F.lit("[1 2 3]"), " "))[0] == [1, 2, 3]
    names = spark.createDataFrame([(n,) for n in ("c10", "c9", "c1b2", "c1b10", "10", "9")], "n string")
    assert [r.n for r in names.orderBy(X.natural_key(F.col("n"))).collect()] == ["9", "10", "c1b2", "c1b10", "c9", "c10"]
    assert one(spark, X.check_version(F.lit("22.04"), ">=22.4,<23"), X.check_version(F.lit("1.2"), "1.10"), X.is_url(F.lit("no url")), X.stem(F.lit("/a/b.c.txt"))) == (True, False, False, "b.c")


def test_tiling(spark):
    images = spark.createDataFrame([(1, 1920, 1080), (2, 8, 8)], "image_id long, width int, height int")
    got = [tuple(r)[1:] for r in tiling.sliding_windows(images, 640, 0.2).where("image_id = 1").collect()]
    xs, ys = ((0, 640), (512, 1152), (1024, 1664), (1280, 1920)), ((0, 640), (440, 1080))
    assert got == [(a, c, b, d) for c, d in ys for a, b in xs]
    assert tiling.sliding_windows(images).where("image_id = 2").count() == 0
    assert tuple(one(spark, tiling.cut_count(F.lit(1280), 640, 0.25), tiling.cut_count(F.lit(720), 640, 0.25))) == (3, 1)
    assert one(spark, tiling.closest_ratio(F.lit(1920), F.lit(1080)))[0] == (2, 1)
    wide = spark.createDataFrame([(1, 1280, 720)], "image_id long, width int, height int")
    assert [tuple(r)[1:] for r in tiling.overlap_split(wide).collect()] == [(0, 0, 512, 720), (384, 0, 896, 720), (768, 0, 1280, 720)]


def test_merging_groups():
    boxes = np.array([[0, 0, 10, 10], [1, 0, 11, 10], [20, 20, 30, 30]], float)
    assert merging.greedy_groups(boxes[:2], np.array([0.9, 0.8]), 0.5) == [[1, 0]]
    assert sorted(map(tuple, merging.greedy_groups(boxes, np.array([0.9, 0.8, 0.7]), 0.5))) == [(0, 1), (2,)]
    assert merging.one_hop_groups(boxes, np.array([0.9, 0.8, 0.7]), 0.5) == [[0, 1], [2]]
    assert merging.fuse_windows([[0, 0, 100, 100], [10, 10, 110, 110], [900, 0, 1000, 100]], 100, 100) == [[0, 0, 110, 110], [900, 0, 1000, 100]]


def test_registry_and_pipeline(spark, tmp_path):
    r = Registry("r")
    r.register("a")(1)
    assert r["a"] == r.a == 1 and "b" not in r and r.get("b") is None
    with pytest.raises(ValueError):
        r.register("a")(2)
    with pytest.raises(KeyError):
        r["b"]
    with pytest.raises(TypeError):
        PARAMS["FloatParam"](1)
    assert PARAMS["IntListParam"]([1, 2]).get() == [1, 2]
    plan = Pipeline({"x": "IosOperator"}, {"x": {"double": True}})
    plan.to_json(str(tmp_path / "p.json"))
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 15, 15)], ", ".join(f"{p}{c} int" for p in ("a_", "b_") for c in ("x1", "y1", "x2", "y2")))
    assert Pipeline.from_json(str(tmp_path / "p.json")).run(df).first()["ios"] == [0.25, 0.25]
    twice = Pipeline({"x": "IosOperator"}).run(df, [lambda d: d.withColumn("y", d.ios * 2), lambda d: d.where("y > 0.4")])
    assert [r.y for r in twice.collect()] == [0.5] and Pipeline({}).run(df, [lambda d: d.limit(0)]).count() == 0
    with pytest.raises(ValueError):
        OPERATORS["IosOperator"]()(df.drop("a_x1"))
    assert guarded(lambda: [][1])()[1] == 15 and not math.isnan(guarded(lambda: 1)()[1])
