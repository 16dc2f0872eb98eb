"""Precision-recall curves, average precision and the operating point, as windows and joins.

Predictions are a row each, with a bit for each threshold. They are put in order once, by class, descending confidence,
image and index, in ranges that Spark samples over that whole key, so neither a frequent class nor a frequent
confidence is one task. Running sums and maxima go within a range and over a row a range. Interpolation reads
only the rows where a curve crosses a grid point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .saved import checkpointed

EPS = 1e-16
LEVELS = 10


def class_counts(gt: DataFrame) -> DataFrame:
    """(cls, n, n_images)."""
    return gt.groupBy("cls").agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("n_images"))


def ranked(levels: DataFrame, gt: DataFrame) -> DataFrame:
    """(run, cls, at, conf, levels, i, t0, t1, ..., n) of each prediction of classes with ground truth.

    ``levels`` as prediction_levels gives them. i is the place in the class, t<k> the hits at threshold k so far, n the
    ground truth. Ranges of the order (run) are fixed by a checkpoint, as two samples of it would differ.
    """
    order = ["cls", F.desc("conf"), "image_id", "pred_idx"]
    rows = levels.select("cls", "conf", "image_id", "pred_idx", "levels").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpointed(rows.select("cls", "conf", "levels", F.monotonically_increasing_id().alias("at"))).withColumn("run", F.shiftright("at", 33))
    names = [f"t{k}" for k in range(LEVELS)]
    hit = [F.shiftright("levels", k).bitwiseAND(1) for k in range(LEVELS)]
    before = Window.partitionBy("cls").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = rows.groupBy("run", "cls").agg(F.count("*").alias("rows"), *(F.sum(h).alias(t) for h, t in zip(hit, names, strict=True)))
    sums = sums.select("run", "cls", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", *names)))
    own = Window.partitionBy("run", "cls").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("run", "cls", "at", "conf", "levels", F.row_number().over(own).cast("long").alias("i"), *(F.sum(h).over(own).alias(t) for h, t in zip(hit, names, strict=True)))
    joined = rows.join(sums, ["run", "cls"]).join(F.broadcast(class_counts(gt).select("cls", "n")), "cls")  # a row a class
    return joined.select("run", "cls", "at", "conf", "levels", (F.col("i") + F.col("rows_before")).alias("i"), *((F.col(t) + F.col(f"{t}_before")).alias(t) for t in names), "n")


def _each_level(rows: DataFrame, values: dict[str, list[Column]], *kept: str) -> DataFrame:
    """A row for each level, with the level's column of each of ``values``."""
    each = F.array(*(F.struct(F.lit(k).alias("k"), *(v[k].alias(name) for name, v in values.items())) for k in range(LEVELS)))
    return rows.select(*kept, F.inline(each))


def pr_points(points: DataFrame) -> DataFrame:
    """(cls, i, conf, k, rec, prec) after each prediction, at each threshold; ``points`` as ranked gives them."""
    t = [F.col(f"t{k}") for k in range(LEVELS)]
    return _each_level(points, {"rec": [x / F.col("n") for x in t], "prec": [x / F.col("i") for x in t]}, "cls", "i", "conf")


def _enveloped(points: DataFrame) -> DataFrame:
    """``points`` with e0, e1, ...: at each threshold the highest precision from here on."""
    names = [f"e{k}" for k in range(LEVELS)]
    precision = [F.col(f"t{k}") / F.col("i") for k in range(LEVELS)]
    back = Window.partitionBy("run", "cls").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("cls").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    most = points.groupBy("run", "cls").agg(*(F.max(p).alias(e) for p, e in zip(precision, names, strict=True)))
    most = most.select("run", "cls", *(F.max(e).over(later).alias(f"{e}_later") for e in names))
    rows = points.withColumns({e: F.max(p).over(back) for p, e in zip(precision, names, strict=True)}).join(most, ["run", "cls"])
    return rows.select(*points.columns, *(F.greatest(e, f"{e}_later").alias(e) for e in names))


def envelope(points: DataFrame) -> DataFrame:
    """(cls, k, i, rec, env) with the sentinels (0, 1) before and (1, 0) after each curve."""
    rows = _enveloped(points)
    each = _each_level(rows, {"rec": [F.col(f"t{k}") / F.col("n") for k in range(LEVELS)], "env": [F.col(f"e{k}") for k in range(LEVELS)]}, "cls", "i")
    ends = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(k).alias("k"), F.lit(rec).alias("rec"), F.lit(env).alias("env")) for k in range(LEVELS) for i, rec, env in ((0, 0.0, 1.0), (1_000_000_000_000, 1.0, 0.0))))
    return each.unionByName(points.select("cls").distinct().select("cls", F.inline(ends))).select("cls", "k", "i", "rec", "env")


def average_precision(points: DataFrame, gt: DataFrame) -> DataFrame:
    """(cls, k, ap) by 101-point interpolation of the envelope; 0 for classes without predictions.

    Recall rises by a step at a hit, so a grid point lies in the step of one hit, whose row has both ends: its own, and
    the row before with one hit less. Beyond the last hit the curve falls to 0 at recall 1.
    """
    n, i, levels = F.col("n"), F.col("i"), range(LEVELS)
    t = [F.col(f"t{k}") for k in levels]
    low, high = [(x - 1) / n for x in t], [x / n for x in t]
    hit = [(F.shiftright("levels", k).bitwiseAND(1) == 1) & (F.floor(high[k] * 100 + 1e-6) >= F.ceil(low[k] * 100 - 1e-6)) for k in levels]
    rows = _enveloped(points)
    any_hit = hit[0]
    for h in hit[1:]:
        any_hit = any_hit | h
    before = [F.when(i == 1, 1.0).otherwise(F.greatest((t[k] - 1) / (i - 1), F.col(f"e{k}"))) for k in levels]
    steps = _each_level(rows.where(any_hit), {"hit": hit, "r0": low, "r1": high, "e0": before, "e1": [F.col(f"e{k}") for k in levels]}, "cls").where("hit").drop("hit")
    last = points.groupBy("cls").agg(F.max("i").alias("i"), F.max("n").alias("n"), *(F.max(f"t{k}").alias(f"t{k}") for k in levels))
    tail = _each_level(last, {"r0": [x / n for x in t], "e0": [x / i for x in t]}, "cls").select("cls", "k", "r0", F.lit(1.0).alias("r1"), "e0", F.lit(0.0).alias("e1"))
    seg = steps.select("cls", "k", "r0", "r1", "e0", "e1").unionByName(tail)
    grid = F.sequence(F.greatest(F.lit(0), F.ceil(F.col("r0") * 100).cast("int") - 1), F.least(F.lit(100), F.ceil(F.col("r1") * 100).cast("int")))
    y = seg.withColumn("g", F.explode(grid)).withColumn("x", F.col("g") / 100.0).where("r0 <= x AND x < r1")
    value = F.col("e0") + (F.col("x") - F.col("r0")) * (F.col("e1") - F.col("e0")) / (F.col("r1") - F.col("r0"))
    found = y.groupBy("cls", "k").agg(((F.sum(value) - 0.5 * F.sum(F.when(F.col("g") == 0, value).otherwise(0.0))) * 0.01).alias("ap"))
    every = gt.select("cls").distinct().withColumn("k", F.explode(F.array(*(F.lit(k) for k in levels))))
    return every.join(found, ["cls", "k"], "left").select("cls", "k", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def curves(points: DataFrame, gt: DataFrame) -> DataFrame:
    """(cls, g, p, r, f1) at the first threshold over confidences g / 999, g from 0 to 999.

    Above the highest confidence recall is 0 and precision 1; below the lowest the last values hold; a class without
    predictions has zeros. Between two rows values change evenly, so of the rows between two grid points the first and last do.
    """
    g = F.floor(F.col("conf") * 999)
    g = F.when(F.col("conf") < g / 999.0, g - 1).when(F.col("conf") >= (g + 1) / 999.0, g + 1).otherwise(g)
    at = F.struct((-F.col("conf")).alias("x"), (F.col("t0") / F.col("n")).alias("r"), (F.col("t0") / F.col("i")).alias("p"))
    ends = points.select("cls", "i", at.alias("at"), F.greatest(F.lit(-1), F.least(F.lit(999), g)).cast("int").alias("g")).groupBy("cls", "g").agg(F.min_by("at", "i").alias("first"), F.max_by("at", "i").alias("last"))
    every = gt.select("cls").distinct().withColumn("g", F.explode(F.sequence(F.lit(-1), F.lit(999)))).join(ends, ["cls", "g"], "left")
    own = Window.partitionBy("cls")  # 1,001 rows a class
    left = F.last("last", True).over(own.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, 0))
    right = F.last("first", True).over(own.orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    full = every.select("cls", "g", left.alias("a"), right.alias("b"), (F.count("last").over(own) > 0).alias("seen"), (-F.col("g") / 999.0).alias("x")).where("g >= 0")
    part = F.when(F.col("b").isNull(), 0.0).otherwise((F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x")))
    value = lambda c: F.when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + part * (F.col(f"b.{c}") - F.col(f"a.{c}")))
    full = full.select("cls", "g", F.coalesce(value("p"), F.when(F.col("seen"), 1.0).otherwise(0.0)).alias("p"), F.coalesce(value("r"), F.lit(0.0)).alias("r"))
    return full.withColumn("f1", 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + EPS))


def smoothed(means: DataFrame, value: str = "f1", points: int = 1000, share: float = 0.1) -> DataFrame:
    """(g, value): box filter over g, with edge values in place of missing neighbours."""
    width = round(points * share * 2) // 2 + 1
    half = width // 2
    frame, whole = Window.orderBy("g").rowsBetween(-half, half), Window.partitionBy(F.lit(0))
    first, last = F.min_by(value, "g").over(whole), F.max_by(value, "g").over(whole)
    before, after = F.greatest(F.lit(0), half - F.col("g")), F.greatest(F.lit(0), F.col("g") + half - (points - 1))
    return means.select("g", ((F.sum(value).over(frame) + before * first + after * last) / width).alias(value))


def operating_point(curve: DataFrame, gt: DataFrame) -> DataFrame:
    """(cls, g, p, r, f1, tp, fp) where the smoothed mean F1 is highest, the lowest such grid point on ties."""
    best = smoothed(curve.groupBy("g").agg(F.avg("f1").alias("f1"))).agg(F.max_by("g", F.struct("f1", -F.col("g"))).alias("g"))
    at = curve.join(F.broadcast(best), "g").join(class_counts(gt), "cls")
    tp = F.rint(F.col("r") * F.col("n"))
    return at.select("cls", "g", "p", "r", "f1", tp.cast("long").alias("tp"), F.rint(tp / (F.col("p") + EPS) - tp).cast("long").alias("fp"))


def best_confidence(curve: DataFrame) -> DataFrame:
    """(cls, conf): the confidence of each class's highest F1."""
    return curve.groupBy("cls").agg((F.max_by("g", F.struct("f1", -F.col("g"))) / 999.0).alias("conf"))


def summary(ap: DataFrame, point: DataFrame) -> DataFrame:
    """One row: mp, mr, map50, map75, map, fitness."""
    maps = ap.agg(F.avg(F.when(F.col("k") == 0, F.col("ap"))).alias("map50"), F.avg(F.when(F.col("k") == 5, F.col("ap"))).alias("map75"), F.avg("ap").alias("map"))
    return point.agg(F.avg("p").alias("mp"), F.avg("r").alias("mr")).join(maps).withColumn("fitness", 0.1 * F.col("map50") + 0.9 * F.col("map"))


def class_results(ap: DataFrame, point: DataFrame, gt: DataFrame) -> DataFrame:
    """(cls, n, n_images, p, r, ap50, ap75, map) a class; classes without predictions have zeros."""
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("ap")))
    each = ap.groupBy("cls").agg(at(0).alias("ap50"), at(5).alias("ap75"), F.avg("ap").alias("map"))
    return class_counts(gt).join(each, "cls", "left").join(point.select("cls", "p", "r"), "cls", "left").na.fill(0.0).select("cls", "n", "n_images", "p", "r", "ap50", "ap75", "map")


def class_maps(results: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, map) of all classes; one without ground truth has the mean of the others."""
    mean = results.agg(F.avg("map").alias("mean"))
    return classes.select("cls").join(results.select("cls", "map"), "cls", "left").join(F.broadcast(mean)).select("cls", F.coalesce("map", "mean").alias("map"))


def metric_values(results: DataFrame) -> DataFrame:
    """(key, value): mean precision, recall, mAP50 and mAP50-95 under their customary keys, and the fitness."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    values = [("metrics/precision(B)", mean("p")), ("metrics/recall(B)", mean("r")), ("metrics/mAP50(B)", mean("ap50")), ("metrics/mAP50-95(B)", mean("map")), ("fitness", 0.1 * mean("ap50") + 0.9 * mean("map"))]
    return results.agg(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values)).alias("m")).select(F.inline("m"))


def results_table(results: DataFrame, names: DataFrame, images: DataFrame, verbose: bool = True) -> DataFrame:
    """(name, n_images, n, p, r, ap50, map): a row of all classes, ``all``, and, if verbose and there are several, one each."""
    values = ("p", "r", "ap50", "map")
    total = results.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in values), F.count("*").alias("classes"))
    whole = total.join(images.agg(F.countDistinct("image_id").alias("n_images")))
    first = whole.select(F.lit("all").alias("name"), "n_images", "n", *values)
    each = results.join(F.broadcast(names), "cls").join(F.broadcast(whole.select("classes")))
    return first.unionByName(each.where(F.col("classes") > 1).select("name", "n_images", "n", *values)) if verbose else first


def printed(table: DataFrame) -> DataFrame:
    """(line) of each row of ``results_table`` in fixed columns."""
    return table.select(F.format_string("%22s%11d%11d%11.4g%11.4g%11.4g%11.4g", "name", "n_images", "n", "p", "r", "ap50", "map").alias("line"))
