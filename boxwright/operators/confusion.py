"""Confusion counts, their normalisation, and the recall and precision report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matching import by_size, confusion_pairs, match_status, status_of_large, status_of_small


def confusion_counts(gt: DataFrame, pr: DataFrame, background: int, threshold: float = 0.5, use_ios: bool = False) -> DataFrame:
    """(kind, pred, gt, n): cells of the recall (R) and precision (P) matrices that are not empty."""
    return confusion_pairs(gt, pr, background, threshold, use_ios).groupBy("kind", "pred", "gt").agg(F.count("*").alias("n"))


def normalized(counts: DataFrame) -> DataFrame:
    """With share: percent of the column (recall) or row (precision) sum."""
    by_gt, by_pred = Window.partitionBy("kind", "gt"), Window.partitionBy("kind", "pred")
    total = F.when(F.col("kind") == "R", F.sum("n").over(by_gt)).otherwise(F.sum("n").over(by_pred))
    return counts.withColumn("share", 100.0 * F.col("n") / F.greatest(total, F.lit(1)))


def difficult_counts(gt: DataFrame, pr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(cls, fn_diff, tp_diff) of difficult ground truth."""
    hits = match_status(gt, pr, threshold).where("side = 'gt'").select("image_id", F.col("idx").alias("gt_idx"), "status")
    rows = gt.where("difficult").join(hits, ["image_id", "gt_idx"])
    return rows.groupBy("cls").agg(F.count_if(F.col("status") == "fnDiff").alias("fn_diff"), F.count_if(F.col("status") == "tpg").alias("tp_diff"))


def report(counts: DataFrame, classes: DataFrame, background: int, hidden: tuple[int, ...] = ()) -> DataFrame:
    """(name, gt_num, pred_num, recall, precision): a row a class, background, Total and Mean.

    ``classes`` has cls and name. Hidden classes are left out of the rows; their misses still count in the background.
    """
    zero, n = F.lit(0).cast("long"), F.col("n")
    kept = ~F.col("pred").isin(*hidden) if hidden else F.lit(True)
    # each cell counts once for its class, and the background's cells once more for the background; then a row a class
    cells = F.array(F.struct(F.when(F.col("kind") == "R", F.col("gt")).otherwise(F.col("pred")).alias("cls"), F.when(F.col("kind") == "R", n).otherwise(zero).alias("g"), F.when(F.col("kind") == "P", n).otherwise(zero).alias("p")), F.struct(F.lit(background).cast("long").alias("cls"), F.when((F.col("kind") == "R") & (F.col("pred") == background), n).otherwise(zero).alias("g"), F.when((F.col("kind") == "P") & (F.col("gt") == background) & kept, n).otherwise(zero).alias("p")))
    own = counts.select("kind", (F.col("pred") == F.col("gt")).alias("right"), F.posexplode(cells).alias("again", "c")).select("kind", F.col("right") & (F.col("again") == 0), "again", "c.*").toDF("kind", "right", "again", "cls", "g", "p")
    own = own.where((F.col("again") == 1) | (F.col("cls") != background))
    sums = own.groupBy("cls").agg(F.sum("g").alias("gt_num"), F.sum("p").alias("pred_num"), F.sum(F.when(F.col("right"), F.col("g")).otherwise(zero)).alias("r_diag"), F.sum(F.when(F.col("right"), F.col("p")).otherwise(zero)).alias("p_diag"))
    shown = (classes.where(~F.col("cls").isin(*hidden)) if hidden else classes).select("cls", "name")
    every = shown.unionByName(classes.sparkSession.range(1).select(F.lit(background).cast("long").alias("cls"), F.lit("background").alias("name")))
    rows = every.join(sums, "cls", "left").na.fill(0, ["gt_num", "pred_num", "r_diag", "p_diag"])
    back = F.col("cls") == background
    ratio = lambda a, b: F.when(~back, F.bround(F.col(a) / (F.col(b) + 1e-16), 8))
    rows = rows.select("cls", "name", "gt_num", "pred_num", "r_diag", "p_diag", ratio("r_diag", "gt_num").alias("recall"), ratio("p_diag", "pred_num").alias("precision"))
    # a row a class: those rows, all of them under Total, and those that occur under Mean
    places = F.when(back, F.array(F.struct(F.col("name").alias("row")))).otherwise(F.filter(F.array(F.struct(F.col("name").alias("row")), F.struct(F.lit("Total").alias("row")), F.struct(F.when(F.col("gt_num") + F.col("pred_num") > 0, "Mean").alias("row"))), lambda x: x["row"].isNotNull()))
    listed = rows.select("*", F.posexplode(places).alias("place", "at")).withColumn("row", F.col("at.row"))
    whole = lambda a, b: F.bround((F.sum(a) + 1e-16) / (F.sum(b) + 1e-16), 8)
    single = F.max("place") == 0
    each = lambda c, a, b: F.when(single, F.max(c)).when(F.col("row") == "Total", whole(a, b)).otherwise(F.bround(F.avg(c), 8)).alias(c)
    out = listed.groupBy("row", F.when(F.col("place") == 0, F.col("cls")).alias("own")).agg(F.sum("gt_num").alias("gt_num"), F.sum("pred_num").alias("pred_num"), each("recall", "r_diag", "gt_num"), each("precision", "p_diag", "pred_num"))
    return out.select(F.col("row").alias("name"), "gt_num", "pred_num", "recall", "precision")


def error_images(gt: DataFrame, pr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, n_tp, n_fp, n_fn, n_fn_diff) of the images that have a false positive or a missed object."""
    status = match_status(gt, pr, threshold)
    count = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return status.groupBy("image_id").agg(count("tpg", "n_tp"), count("fp", "n_fp"), count("fn", "n_fn"), count("fnDiff", "n_fn_diff")).where("n_fp + n_fn > 0")


def error_shapes(gt: DataFrame, pr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, label, status, x1, y1, x2, y2, have_tp, have_fp, have_fn): the shapes of images with an error.

    Shapes are found ground truth, false positives (label -fp) and missed ground truth (-fn, difficult ones too), by
    class; shape_type and points are carried where both sides have them. The last three columns say what the whole image
    has; difficult misses alone are no error.
    """
    corners = ("x1", "y1", "x2", "y2", *(c for c in ("shape_type", "points") if c in gt.columns and c in pr.columns))
    image = Window.partitionBy("image_id")
    has = lambda *s: F.max(F.col("status").isin(*s)).over(image)
    mark = F.when(F.col("status") == "fp", "-fp").when(F.col("status") == "tpg", "").otherwise("-fn")

    def shapes(status: DataFrame) -> DataFrame:
        rows = status.where("status <> 'tpp'")
        rows = rows.select("image_id", F.concat(F.col("cls").cast("string"), mark).alias("label"), "status", *corners, has("tpg").alias("have_tp"), has("fp").alias("have_fp"), has("fn").alias("have_fn"))
        return rows.where("have_fp OR have_fn")

    return by_size(gt, pr, *(lambda g, p, of=of: shapes(of(g, p, threshold, kept=corners)) for of in (status_of_small, status_of_large)))


def error_annotations(shapes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``error_shapes`` as annotations that ``to_labelme`` writes; a shape's status is a flag of it, have_* are the image's."""
    order = Window.partitionBy("image_id").orderBy("status", "label", "x1", "y1", "x2", "y2")
    points = F.array(F.array(F.col("x1").cast("double"), F.col("y1").cast("double")), F.array(F.col("x2").cast("double"), F.col("y2").cast("double")))
    kind, points = ((F.col("shape_type"), F.col("points")) if "points" in shapes.columns else (F.lit("rectangle"), points))
    image = F.create_map(*(x for name in ("tp", "fp", "fn") for x in (F.lit(f"have{name.title()}"), F.col(f"have_{name}"))))
    kinds = (("TPG", ("tpg",)), ("FP", ("fp",)), ("FN", ("fn", "fnDiff")))
    flags = F.create_map(*(x for name, own in kinds for x in (F.lit(name), F.col("status").isin(*own))), F.lit("difficult"), F.col("status") == "fnDiff")
    rows = shapes.select("image_id", (F.row_number().over(order) - 1).alias("ann_idx"), "label", kind.alias("shape_type"), points.alias("points"), F.lit(1.0).alias("score"), flags.alias("flags"), image.alias("image_flags"))
    return rows.join(sizes.select("image_id", "width", "height"), "image_id", "left")
