"""Dataset operators: histograms, thresholds by class, class subsets, and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key


def class_histogram(annotations: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, natural_rank), ranked in natural order of names."""
    counts = annotations.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("natural_rank", F.row_number().over(Window.orderBy(natural_key(F.col("label")), "label")).cast("long"))


def file_histogram(annotations: DataFrame, label: str = "label", file: str = "image_id") -> DataFrame:
    """(file, label, n) of each label file; one without labels has none."""
    return annotations.where(F.col(label).isNotNull()).groupBy(F.col(file).alias("file"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def equal_bins(values: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): counts in equal-width bins between least and greatest value, the last one closed; empty bins too."""
    ends = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = values.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return values.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").na.fill(0, ["n"])


def thresholds(spark: SparkSession, value: float | int | list[float], classes: list[str]) -> DataFrame:
    """(cls, threshold): one number for all classes, or a list, its last value for the classes beyond it."""
    each = [float(value)] * len(classes) if isinstance(value, (int, float)) else [float(value[min(i, len(value) - 1)]) for i in range(len(classes))]
    return spark.createDataFrame(list(zip(classes, each, strict=True)), f"cls {'long' if classes and isinstance(classes[0], int) else 'string'}, threshold double")


def at_least(rows: DataFrame, limits: DataFrame, value: Column, key: str = "cls") -> DataFrame:
    """Rows whose value reaches their class's threshold; ``limits`` has a row a class and is small."""
    joined = rows.join(F.broadcast(limits.withColumnRenamed("cls", key)), key)
    return joined.where(value >= F.col("threshold")).select(*rows.columns)


def class_subset(annotations: DataFrame, images: DataFrame, keep: list[int], key: str = "cls") -> DataFrame:
    """Annotations of the kept classes, renumbered by place in ``keep``; images without any stay with null annotations."""
    table = annotations.sparkSession.createDataFrame([(c, i) for i, c in enumerate(keep)], f"{key} long, new_cls long")
    kept = annotations.join(F.broadcast(table), key).drop(key).withColumnRenamed("new_cls", key)
    return images.join(kept, "image_id", "left")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def shared_subsets(parts: list[DataFrame], keep: list[str], label: str = "label") -> list[str]:
    """The labels of ``keep``, in its order, that any of the splits holds: the class list of the reduced data set."""
    found = {r[0] for r in union_all([p.select(label) for p in parts]).where(F.col(label).isin(*keep)).distinct().collect()}
    return [name for name in keep if name in found]


def with_background(names: list[str] | dict[int, str]) -> list[str]:
    """Class names in order of their ids, the background last."""
    ordered = [names[k] for k in sorted(names)] if isinstance(names, dict) else list(names)
    return ordered if ordered[-1:] == ["background"] else [*ordered, "background"]


def window_detections(detections: DataFrame, limits: DataFrame) -> DataFrame:
    """Detections that reach their class's threshold, moved from their window (wx, wy) to the image's own coordinates."""
    kept = at_least(detections, limits, F.col("conf"))
    moved = {c: F.col(c) + F.col("wx" if c[0] == "x" else "wy") for c in ("x1", "y1", "x2", "y2")}
    return kept.withColumns(moved).drop("wx", "wy")


def detection_annotations(detections: DataFrame, names: DataFrame, sizes: DataFrame) -> DataFrame:
    """Detections (image_id, pred_idx, cls, conf, corners and perhaps segment, an array of points) as annotations.

    A detection with a segment is a polygon, else a rectangle. ``names`` has cls and label, a row a class. Every image
    of ``sizes`` stays; one without detections has null annotations.
    """
    corners = F.array(F.array(F.col("x1").cast("double"), F.col("y1").cast("double")), F.array(F.col("x2").cast("double"), F.col("y2").cast("double")))
    segment = F.col("segment") if "segment" in detections.columns else F.lit(None).cast("array<array<double>>")
    polygon = F.coalesce(F.size(segment) > 2, F.lit(False))
    rows = detections.join(F.broadcast(names), "cls", "left").select("image_id", F.col("pred_idx").alias("ann_idx"), F.coalesce("label", F.col("cls").cast("string")).alias("label"), F.when(polygon, "polygon").otherwise("rectangle").alias("shape_type"), F.when(polygon, segment).otherwise(corners).alias("points"), F.col("conf").alias("score"), F.create_map(F.lit("difficult"), F.lit(False)).alias("flags"))
    return sizes.select("image_id", "width", "height").join(rows, "image_id", "left")
