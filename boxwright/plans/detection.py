"""Slicing, detection and merging as steps of a pipeline, each chosen by name, so that one JSON plan goes from images to objects.

The steps change what a row is: images become windows, windows detections, and detections merged objects. What detects is
a function over batches of windows, which runs in the tasks; the library has none of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dataset import thresholds, union_all, window_detections
from ..operators.merging import merge_detections
from ..operators.tiling import overlap_split, ratio_split, sliding_windows
from .pipeline import OPERATORS, Operator
from .registry import Param, Registry

SLICERS, MERGERS, DETECTORS = Registry("slicers"), Registry("mergers"), Registry("detectors")
Detector = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_FOUND = "image_id {0}, wx long, wy long, cls long, conf double, x1 double, y1 double, x2 double, y2 double"
CORNERS = ("x1", "y1", "x2", "y2")

SLICERS.register("sliding")(sliding_windows)
SLICERS.register("overlapping")(overlap_split)
SLICERS.register("by_ratio")(ratio_split)


@SLICERS.register()
def halves(images: DataFrame) -> DataFrame:
    """The left and right, or upper and lower, half, whichever side is longer."""
    wide = F.col("width") >= F.col("height")
    middle_x, middle_y = F.when(wide, F.floor(F.col("width") / 2)).otherwise(F.col("width")), F.when(wide, F.col("height")).otherwise(F.floor(F.col("height") / 2))
    first = F.struct(F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("y1"), middle_x.cast("long").alias("x2"), middle_y.cast("long").alias("y2"))
    second = F.struct(F.when(wide, middle_x).otherwise(0).cast("long").alias("x1"), F.when(wide, F.lit(0)).otherwise(middle_y).cast("long").alias("y1"), F.col("width").cast("long").alias("x2"), F.col("height").cast("long").alias("y2"))
    return images.select("image_id", F.inline(F.array(first, second)))


@MERGERS.register()
def greedy(detections: DataFrame, **settings) -> DataFrame:
    return merge_detections(detections, **settings)


@MERGERS.register()
def one_hop(detections: DataFrame, **settings) -> DataFrame:
    return merge_detections(detections, greedy=False, **settings)


@OPERATORS.register()
class SliceOperator(Operator):
    """Images (image_id, width, height) to windows (image_id, x1, y1, x2, y2): those of all slicers and the image itself, each once."""

    used = ("image_id", "width", "height")
    added = ("image_id", *CORNERS)

    def parameters(self) -> dict[str, Param]:
        return {"slicers": Param(str, [], list), "settings": Param(dict, {}, dict), "whole": Param(bool, True)}

    def apply(self, df: DataFrame) -> DataFrame:
        settings = self.params["settings"].get()
        parts = [SLICERS[name](df, **settings.get(name, {})) for name in self.params["slicers"].get()]
        if self.params["whole"].get():
            parts.append(df.select("image_id", F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2")))
        return union_all([p.select("image_id", *(F.col(c).cast("long").alias(c) for c in CORNERS)) for p in parts]).distinct()


@OPERATORS.register()
class DetectOperator(Operator):
    """Windows to detections (image_id, pred_idx, cls, conf, x1, y1, x2, y2) in the image's coordinates.

    ``detector`` names a function over pandas batches of windows that gives image_id, wx, wy (the window's corner), cls,
    conf and corners in the window. Those under their class's threshold go; numbers in an image follow their windows.
    """

    used = ("image_id", *CORNERS)
    added = ("image_id", "pred_idx", "cls", "conf", *CORNERS)

    def parameters(self) -> dict[str, Param]:
        return {"detector": Param(str), "thresholds": Param(float, [0.0], list), "classes": Param(int, [0], list)}

    def apply(self, df: DataFrame) -> DataFrame:
        found = df.mapInPandas(DETECTORS[self.params["detector"].get()], _FOUND.format(dict(df.dtypes)["image_id"]))
        limits = thresholds(df.sparkSession, self.params["thresholds"].get(), self.params["classes"].get())
        order = Window.partitionBy("image_id").orderBy("wy", "wx", "cls", F.desc("conf"), *CORNERS)
        numbered = found.withColumn("pred_idx", (F.row_number().over(order) - 1).cast("long"))
        return window_detections(numbered, limits).select(*self.added)


@OPERATORS.register()
class MergeOperator(Operator):
    """Detections to merged ones by each merger in turn: the columns of detections and n_merged, how many each is made of."""

    used = ("image_id", "pred_idx", "cls", "conf", *CORNERS)
    added = (*used, "n_merged")

    def parameters(self) -> dict[str, Param]:
        return {"mergers": Param(str, ["greedy"], list), "settings": Param(dict, {}, dict)}

    def apply(self, df: DataFrame) -> DataFrame:
        rows = df.select(*self.used, F.lit(1).cast("long").alias("n_merged"))
        for name in self.params["mergers"].get():
            made = MERGERS[name](rows.withColumnRenamed("cls", "code"), **self.params["settings"].get().get(name, {}))
            rows = made.select("image_id", F.col("keep_idx").alias("pred_idx"), F.col("code").alias("cls"), "conf", *CORNERS, "n_merged")
        return rows
