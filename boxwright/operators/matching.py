"""Matching predictions to ground truth: status lists, confusion pairs, and one-to-one assignment by threshold.

Ground truth has image_id, gt_idx, cls, x1, y1, x2, y2, difficult; predictions image_id, pred_idx, cls, x1, y1, x2, y2, conf.
Pairs exist only within an image. Images of up to MANY boxes are joined by image alone, so that all steps keep that one
partitioning and neither boxes nor pairs are shuffled again; larger ones by image and the cells of a grid, which many tasks share.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import Box, box, box_valid, ios, iou

THRESHOLDS = tuple(0.5 + k * 0.05 for k in range(10))
#: Boxes of an image, both sides together, up to which its pairs are those of the whole image.
MANY = 2000
Rows = Callable[[DataFrame, DataFrame], DataFrame]


def by_size(gt: DataFrame, pr: DataFrame, small: Rows, large: Rows) -> DataFrame:
    """``small`` of the images of up to MANY boxes, with ``large`` of the others, if there are any; those are so few that their names are broadcast."""
    counts = gt.select("image_id").unionByName(pr.select("image_id")).groupBy("image_id").agg(F.count("*").alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= MANY:
        return small(gt, pr)
    named = F.broadcast(counts.where(F.col("n") > MANY).select("image_id"))
    part = lambda how: (df.join(named, "image_id", how) for df in (gt, pr))
    return small(*part("left_anti")).unionByName(large(*part("left_semi")))


def _same(a: Column, b: Column) -> Column:
    """Equality that does not make joins go by it: rows stay where their image put them."""
    return (a <= b) & (a >= b)


def _sides(gt: DataFrame, pr: DataFrame) -> tuple[DataFrame, DataFrame, Box, Box]:
    named = lambda df, p, extra: df.select("image_id", *(F.col(c).alias(f"{p}{c}") for c in ("cls", "x1", "y1", "x2", "y2")), *extra)
    return named(gt, "g_", ("gt_idx", "difficult")), named(pr, "p_", ("pred_idx", "conf")), box("g_"), box("p_")


#: Side of the smallest cells in pixels; each further level has cells FACTOR times as wide. A box lies at the first level
#: where it is at most FACTOR cells wide and high, so it covers at most (FACTOR + 1) squared of them.
CELL, FACTOR, DEEPEST = 256.0, 8, 6


def _level(side: Column) -> Column:
    """The level of boxes with this longer side."""
    return F.when(side <= CELL * FACTOR, 0).otherwise(F.least(F.lit(DEEPEST), F.ceil(F.log(side / (CELL * FACTOR)) / math.log(FACTOR)).cast("int")))


def _covered(b: Box, level: Column) -> Column:
    """The cells of a level that a box has a part in."""
    width = F.pow(F.lit(float(FACTOR)), level) * CELL
    along = lambda low, high: F.sequence(F.floor(low / width), F.greatest(F.floor(low / width), F.ceil(high / width) - 1))
    return F.flatten(F.transform(along(b.x1, b.x2), lambda x: F.transform(along(b.y1, b.y2), lambda y: F.struct(level.alias("level"), x.alias("x"), y.alias("y")))))


def _centre(b: Box, level: Column) -> Column:
    """The cell of a level that holds the centre of a box."""
    width = F.pow(F.lit(float(FACTOR)), level) * CELL
    at = lambda low, high: F.floor((low + high) / 2 / width)
    return F.struct(level.alias("level"), at(b.x1, b.x2).alias("x"), at(b.y1, b.y2).alias("y"))


def _levels(low: Column, high: Column) -> Column:
    return F.sequence(low.cast("int"), high.cast("int"))


def near_pairs(left: DataFrame, right: DataFrame, g: Box, p: Box, threshold: float, use_ios: bool, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Pairs of valid boxes that can overlap by more than ``threshold``, each once, by the cells of a grid of levels.

    From a half on, the common part holds the middle of the box that it is measured by: with the smaller box in one cell
    and the other in those that it covers, a pair meets once. Under a half both lie in all cells that they cover, and a
    pair counts where its common part begins. Boxes of very unlike size can't have a high IoU, so few levels are tried.
    An image of many boxes is thus many small joins, and not one.
    """
    side = lambda b: F.greatest(b.x2 - b.x1, b.y2 - b.y1)
    halves = threshold >= 0.5
    least = max(float(threshold), 1e-9)
    if use_ios:  # the ground truth meets predictions of any size
        mine, others = F.lit(0), F.lit(DEEPEST)
        spread = F.explode(F.transform(_levels(mine, others), lambda k: _centre(g, k))) if halves else F.explode(F.flatten(F.transform(_levels(mine, others), lambda k: _covered(g, k))))
        many, one = right.where(box_valid(p)).withColumn("cell", F.explode(_covered(p, _level(side(p))))), left.where(box_valid(g)).withColumn("cell", spread)
        low = p
    else:
        mine, others = _level(side(p) * least), _level(side(p) / least)
        spread = F.explode(F.transform(_levels(mine, others), lambda k: _centre(p, k))) if halves else F.explode(F.flatten(F.transform(_levels(mine, others), lambda k: _covered(p, k))))
        many, one = left.where(box_valid(g)).withColumn("cell", F.explode(_covered(g, _level(side(g))))), right.where(box_valid(p)).withColumn("cell", spread)
        low = g
    met = many.join(one, [*keys, "cell"])
    if halves:
        return met.drop("cell")
    width = F.pow(F.lit(float(FACTOR)), _level(side(low))) * CELL
    first = (F.floor(F.greatest(g.x1, p.x1) / width) == F.col("cell.x")) & (F.floor(F.greatest(g.y1, p.y1) / width) == F.col("cell.y"))
    return met.where(first).drop("cell")


def overlaps(gt: DataFrame, pr: DataFrame, threshold: float = 0.5, use_ios: bool = False) -> DataFrame:
    """All pairs of an image whose IoU (or intersection over ground-truth area) is strictly over the threshold, in single precision.

    Boxes without an area overlap nothing.
    """
    left, right, g, p = _sides(gt, pr)
    score = (ios(g, p) if use_ios else iou(g, p)).cast("float")
    pairs = near_pairs(left, right, g, p, threshold, use_ios).where(score > F.lit(threshold).cast("float"))
    return pairs.select("image_id", "gt_idx", "pred_idx", F.col("g_cls").alias("gcls"), F.col("p_cls").alias("pcls"), "difficult", "conf")


def _status(rows: DataFrame, side: str, hit: Column, kept: tuple[str, ...]) -> DataFrame:
    missed = F.when(F.col("difficult"), "fnDiff").otherwise("fn") if side == "gt" else F.lit("fp")
    return rows.select("image_id", F.lit(side).alias("side"), F.col(f"{side}_idx").alias("idx"), "cls", F.when(hit, "tpg" if side == "gt" else "tpp").otherwise(missed).alias("status"), *kept)


def status_of_small(gt: DataFrame, pr: DataFrame, threshold: float = 0.5, use_ios: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """``match_status`` by pairs of whole images."""
    parts = []
    for own, others, side in ((gt, pr, "gt"), (pr, gt, "pred")):
        mine, theirs = box(), box("o_")
        g, p = (mine, theirs) if side == "gt" else (theirs, mine)
        score = (ios(g, p) if use_ios else iou(g, p)).cast("float")
        named = others.select(*(F.col(c).alias(f"o_{c}") for c in ("image_id", "cls", *Box._fields)))
        near = (F.col("image_id") == F.col("o_image_id")) & _same(F.col("cls"), F.col("o_cls")) & box_valid(g) & box_valid(p) & (score > F.lit(threshold).cast("float"))
        values = [c for c in ("cls", "difficult", *kept) if c in own.columns]
        one = own.join(named, near, "left").groupBy("image_id", f"{side}_idx").agg(*(F.first(c).alias(c) for c in values), (F.count("o_image_id") > 0).alias("hit"))
        parts.append(_status(one, side, F.col("hit"), kept))
    return parts[0].unionByName(parts[1])


def status_of_large(gt: DataFrame, pr: DataFrame, threshold: float = 0.5, use_ios: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """``match_status`` by cells."""
    hits = overlaps(gt, pr, threshold, use_ios).where("gcls = pcls")
    parts = []
    for df, side in ((gt, "gt"), (pr, "pred")):
        own = hits.select("image_id", f"{side}_idx").distinct().withColumn("hit", F.lit(True))
        parts.append(_status(df.join(own, ["image_id", f"{side}_idx"], "left"), side, F.col("hit"), kept))
    return parts[0].unionByName(parts[1])


def match_status(gt: DataFrame, pr: DataFrame, threshold: float = 0.5, use_ios: bool = False) -> DataFrame:
    """(image_id, side, idx, cls, status): tpg, fn, fnDiff for ground truth and tpp, fp for predictions."""
    return by_size(gt, pr, *(partial(f, threshold=threshold, use_ios=use_ios) for f in (status_of_small, status_of_large)))


def true_positives(gt: DataFrame, pr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predictions that overlap ground truth of their class."""
    return pr.join(overlaps(gt, pr, threshold).where("gcls = pcls").select("image_id", "pred_idx"), ["image_id", "pred_idx"], "left_semi")


def false_positives(gt: DataFrame, pr: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pr.join(overlaps(gt, pr, threshold).where("gcls = pcls").select("image_id", "pred_idx"), ["image_id", "pred_idx"], "left_anti")


def confusion_pairs(gt: DataFrame, pr: DataFrame, background: int, threshold: float = 0.5, use_ios: bool = False) -> DataFrame:
    """(kind, pred, gt) of each counted object: R for ground truth in turn, P for predictions.

    A hit goes to the diagonal; another overlap to the class of its lowest-index partner; else the background. Difficult
    ground truth without a hit is left out of both passes.
    """
    hit = F.when(F.col("gcls") == F.col("pcls"), 1).otherwise(0)
    pairs = overlaps(gt, pr, threshold, use_ios).withColumn("hit", hit)
    by_gt = Window.partitionBy("image_id", "gt_idx")
    pairs = pairs.withColumn("retained", (F.max("hit").over(by_gt) == 1) | ~F.col("difficult"))
    g = pairs.groupBy("image_id", "gt_idx").agg(F.max("hit").alias("hit"), F.min(F.struct("pred_idx", "pcls")).alias("first"))
    g = gt.join(g, ["image_id", "gt_idx"], "left").where(F.coalesce("hit", F.lit(0)).eqNullSafe(1) | ~F.col("difficult"))
    recall = g.select(F.lit("R").alias("kind"), F.when(F.col("hit") == 1, F.col("cls")).otherwise(F.coalesce("first.pcls", F.lit(background))).alias("pred"), F.col("cls").alias("gt"))
    p = pairs.groupBy("image_id", "pred_idx").agg(F.max("hit").alias("hit"), F.min(F.when(F.col("retained"), F.struct("gt_idx", "gcls"))).alias("first"))
    p = pr.join(p, ["image_id", "pred_idx"], "left")
    precision = p.select(F.lit("P").alias("kind"), F.col("cls").alias("pred"), F.when(F.col("hit") == 1, F.col("cls")).otherwise(F.coalesce("first.gcls", F.lit(background))).alias("gt"))
    return recall.unionByName(precision)


def _levels_of_best(thresholds: tuple[float, ...]) -> Column:
    """The thresholds, as bits, that a row of (image_id, pred_idx, best) passes and none of its ground truth's predictions before it."""
    passed = sum((F.when(F.col("best.iou") > t, 1).otherwise(0) for t in thresholds), F.lit(0))
    earlier = Window.partitionBy("image_id", "best.gt_idx").orderBy("pred_idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(passed).over(earlier), F.lit(0))
    one = F.lit(1)
    shifted = lambda n: F.call_function("shiftleft", one, n)
    return F.when(F.col("best.iou").isNotNull() & (passed > before), shifted(passed) - shifted(before)).otherwise(0)


def prediction_levels(gt: DataFrame, pr: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(image_id, pred_idx, cls, conf, levels) of each prediction: bit k is set if it is assigned at threshold k.

    Each prediction keeps its best ground truth of its class (the higher index on ties), then each ground truth its
    lowest prediction. So of a ground truth's predictions in order, one has the thresholds that it passes and none before it did.
    """
    best_of = F.max(F.when(F.col("iou") > thresholds[0], F.struct("iou", "gt_idx"))).alias("best")

    def small(gt: DataFrame, pr: DataFrame) -> DataFrame:
        left, right, g, p = _sides(gt, pr)
        left = left.withColumnRenamed("image_id", "g_image_id")
        near = (F.col("image_id") == F.col("g_image_id")) & _same(F.col("g_cls"), F.col("p_cls")) & box_valid(g) & box_valid(p) & (iou(g, p, 1e-7) > thresholds[0])
        best = right.join(left, near, "left").withColumn("iou", iou(g, p, 1e-7)).groupBy("image_id", "pred_idx", F.col("p_cls").alias("cls"), "conf").agg(best_of)
        return best.select("image_id", "pred_idx", "cls", "conf", _levels_of_best(thresholds).alias("levels"))

    def large(gt: DataFrame, pr: DataFrame) -> DataFrame:
        left, right, g, p = _sides(gt, pr)
        keyed = near_pairs(left.withColumnRenamed("g_cls", "cls"), right.withColumnRenamed("p_cls", "cls"), g, p, thresholds[0], False, ("image_id", "cls"))
        pairs = keyed.select("image_id", "gt_idx", "pred_idx", iou(g, p, 1e-7).alias("iou")).where(F.col("iou") > thresholds[0])
        best = pairs.groupBy("image_id", "pred_idx").agg(best_of)
        bits = best.select("image_id", "pred_idx", _levels_of_best(thresholds).alias("levels"))
        return pr.select("image_id", "pred_idx", "cls", "conf").join(bits, ["image_id", "pred_idx"], "left").withColumn("levels", F.coalesce("levels", F.lit(0)))

    return by_size(gt, pr, small, large)


def prediction_hits(levels: DataFrame, n: int = len(THRESHOLDS)) -> DataFrame:
    """(image_id, pred_idx, cls, conf, k, tp) of each prediction and threshold."""
    each = levels.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(n)))))
    return each.select("image_id", "pred_idx", "cls", "conf", "k", F.expr("shiftright(levels, k) & 1").alias("tp"))
