"""Registered queries over the given tables, each with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import boxes as B
from .functions import text as X
from .operators import confusion, dataset, matching, merging, precision, tiling
from .operators.saved import stored
from .plans.detection import DETECTORS
from .plans.pipeline import Pipeline
from .sources import formats, images
from .sources.derived import BOXES_SQL, boxes, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
W, H = 1300, 700
_CLASS_NAMES = {0: "car", 1: "person", 2: "bike", 3: "bus", 4: "dog"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c.cast("double"), digits)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pr = boxes(spark, sf_dir)
    g = gt.select("image_id", "gt_idx", *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")), F.col("cls").alias("gcls"))
    p = pr.select("image_id", "pred_idx", *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")), F.col("cls").alias("pcls"))
    return g.join(p, "image_id")



def _by_box(pairs: DataFrame, *values: str) -> DataFrame:
    """How many pairs each ground-truth box has, and the sums of their values."""
    return pairs.groupBy("image_id", "gt_idx").agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values))


def _millionths(c):
    """Whole millionths, which engines agree on where they round ties differently."""
    return F.floor(c * 1_000_000.0)


def _sides() -> tuple[B.Box, B.Box]:
    return B.box("a_"), B.box("b_")


VIEWS = "WITH " + BOXES_SQL
PAIRED = VIEWS + """, j AS (SELECT g.image_id, g.gt_idx, p.pred_idx, g.cls AS gcls, p.cls AS pcls, g.difficult, g.x1 AS ax1, g.y1 AS ay1, g.x2 AS ax2, g.y2 AS ay2, p.x1 AS bx1, p.y1 AS by1, p.x2 AS bx2, p.y2 AS by2,
  greatest(0, least(g.x2,p.x2)-greatest(g.x1,p.x1)) * greatest(0, least(g.y2,p.y2)-greatest(g.y1,p.y1)) AS inter,
  (g.x2-g.x1)*(g.y2-g.y1) AS ga, (p.x2-p.x1)*(p.y2-p.y1) AS pa FROM gt g JOIN pr p ON g.image_id=p.image_id)"""
MATCHED = PAIRED + """, pairs AS (SELECT * FROM j WHERE CAST(CAST(inter AS DOUBLE)/(ga+pa-inter) AS FLOAT) > CAST(0.5 AS FLOAT))"""
STATUS = MATCHED + """, hits AS (SELECT * FROM pairs WHERE gcls = pcls),
 gs AS (SELECT g.image_id, 'gt' AS side, g.gt_idx AS idx, g.cls, CASE WHEN h.gt_idx IS NOT NULL THEN 'tpg' WHEN g.difficult THEN 'fnDiff' ELSE 'fn' END AS status
   FROM gt g LEFT JOIN (SELECT DISTINCT image_id, gt_idx FROM hits) h ON h.image_id=g.image_id AND h.gt_idx=g.gt_idx),
 ps AS (SELECT p.image_id, 'pred' AS side, p.pred_idx AS idx, p.cls, CASE WHEN h.pred_idx IS NOT NULL THEN 'tpp' ELSE 'fp' END AS status
   FROM pr p LEFT JOIN (SELECT DISTINCT image_id, pred_idx FROM hits) h ON h.image_id=p.image_id AND h.pred_idx=p.pred_idx),
 st AS (SELECT * FROM gs UNION ALL SELECT * FROM ps)"""


# --- box functions ---------------------------------------------------------------------------------------------------


@query(VIEWS + " SELECT image_id, gt_idx, (x2-x1)*(y2-y1) AS area, (x1 < x2 AND y1 < y2) AS valid FROM gt")
def box_area_valid(spark, sf_dir):
    b = B.box()
    return boxes(spark, sf_dir)[0].select("image_id", "gt_idx", B.area(b).alias("area"), B.box_valid(b).alias("valid"))


@query(PAIRED + " SELECT image_id, gt_idx, count(*) AS n, CAST(sum(greatest(ax1,bx1)) AS BIGINT) AS x1, CAST(sum(greatest(ay1,by1)) AS BIGINT) AS y1, CAST(sum(least(ax2,bx2)) AS BIGINT) AS x2, CAST(sum(least(ay2,by2)) AS BIGINT) AS y2, CAST(sum(inter) AS BIGINT) AS area FROM j WHERE inter > 0 GROUP BY image_id, gt_idx")
def box_intersection(spark, sf_dir):
    a, p = _sides()
    cut, area = B.inter_box(a, p)
    return _by_box(_joined(spark, sf_dir).select("image_id", "gt_idx", *cut.fields(), area.cast("long").alias("area")).where("area > 0"), "x1", "y1", "x2", "y2", "area")


@query(PAIRED + " SELECT image_id, gt_idx, count(*) AS n, CAST(sum(floor(CAST(inter AS DOUBLE)/(ga+pa-inter)*1000000)) AS BIGINT) AS iou FROM j WHERE inter > 0 GROUP BY image_id, gt_idx")
def box_iou_pairs(spark, sf_dir):
    a, p = _sides()
    return _by_box(_joined(spark, sf_dir).where(B.inter_area(a, p) > 0).select("image_id", "gt_idx", _millionths(B.iou(a, p)).alias("iou")), "iou")


@query(PAIRED + " SELECT image_id, gt_idx, count(*) AS n, CAST(sum(floor(CAST(inter AS DOUBLE)/(CAST(ga+pa-inter AS DOUBLE)+1e-7)*1000000)) AS BIGINT) AS iou FROM j WHERE gcls = pcls GROUP BY image_id, gt_idx")
def box_iou_eps_pairs(spark, sf_dir):
    a, p = _sides()
    return _by_box(_joined(spark, sf_dir).where("gcls = pcls").select("image_id", "gt_idx", _millionths(B.iou(a, p, 1e-7)).alias("iou")), "iou")


@query(PAIRED + " SELECT image_id, gt_idx, count(*) AS n, CAST(sum(floor(CAST(inter AS DOUBLE)/ga*1000000)) AS BIGINT) AS ios_gt, CAST(sum(floor(CAST(inter AS DOUBLE)/pa*1000000)) AS BIGINT) AS ios_pred FROM j WHERE inter > 0 GROUP BY image_id, gt_idx")
def box_ios_double(spark, sf_dir):
    a, p = _sides()
    return _by_box(_joined(spark, sf_dir).where(B.inter_area(a, p) > 0).select("image_id", "gt_idx", _millionths(B.ios(a, p)).alias("ios_gt"), _millionths(B.ios(p, a)).alias("ios_pred")), "ios_gt", "ios_pred")


@query(VIEWS + """, c AS (SELECT image_id, gt_idx, (x1+x2)//2 AS x, (y1+y2)//2 AS y, x2-x1 AS w, y2-y1 AS h FROM gt)
 SELECT image_id, gt_idx, x - w//2 AS x1, y - h//2 AS y1, x + w//2 AS x2, y + h//2 AS y2 FROM c""")
def box_xywh_xyxy(spark, sf_dir):
    half = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    b = B.xywh2xyxy(half("x1", "x2"), half("y1", "y2"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return boxes(spark, sf_dir)[0].select("image_id", "gt_idx", *b.fields())


@query(PAIRED + """, r AS (SELECT *, least(greatest(ax1-bx1,0),bx2-bx1) AS r1, least(greatest(ay1-by1,0),by2-by1) AS r2, least(greatest(ax2-bx1,0),bx2-bx1) AS r3, least(greatest(ay2-by1,0),by2-by1) AS r4 FROM j WHERE inter > 0)
 SELECT image_id, gt_idx, count(*) AS n, CAST(sum(r1) AS BIGINT) AS rel_x1, CAST(sum(r2) AS BIGINT) AS rel_y1, CAST(sum(r3) AS BIGINT) AS rel_x2, CAST(sum(r4) AS BIGINT) AS rel_y2, CAST(sum(bx1+r1) AS BIGINT) AS abs_x1, CAST(sum(by1+r2) AS BIGINT) AS abs_y1, CAST(sum(bx1+r3) AS BIGINT) AS abs_x2, CAST(sum(by1+r4) AS BIGINT) AS abs_y2 FROM r GROUP BY image_id, gt_idx""")
def box_rel_abs(spark, sf_dir):
    a, p = _sides()
    rel = B.rel_box(p, a)
    back = B.abs_box(p, rel)
    named = [c.alias(f"{k}_{n}") for k, b in (("rel", rel), ("abs", back)) for n, c in zip(B.Box._fields, b, strict=True)]
    rows = _joined(spark, sf_dir).where(B.inter_area(a, p) > 0).select("image_id", "gt_idx", *named)
    return _by_box(rows, *rows.columns[2:])


_ROTATED = VIEWS + """, c AS (SELECT image_id, gt_idx, CAST(x1 AS DOUBLE) AS ax, CAST(y1 AS DOUBLE) AS ay, CAST(x2 AS DOUBLE) AS bx, CAST(y1 + gt_idx % 7 AS DOUBLE) AS by_, CAST(x2 - gt_idx % 7 AS DOUBLE) AS cx, CAST(y2 AS DOUBLE) AS cy FROM gt),
 d AS (SELECT image_id, gt_idx, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS w, sqrt((cx-bx)*(cx-bx)+(cy-by_)*(cy-by_)) AS h, atan2(-(by_-ay), bx-ax) AS f, atan2(-(cy-by_), cx-bx) AS s FROM c),
 m AS (SELECT *, 2*pi() AS t, f - 2*pi()*floor(f/(2*pi())) AS sem, CASE WHEN w >= h THEN f ELSE s END AS l, f - pi()*floor(f/pi()) AS fa, s - pi()*floor(s/pi()) AS sa FROM d)
 SELECT image_id, gt_idx, round(sem,6) AS semantic, round(l - pi()*floor(l/pi()),6) AS long_edge, round(CASE WHEN fa <= pi()/2 THEN fa ELSE sa END,6) AS opencv, round(CASE WHEN fa <= pi()/2 THEN w ELSE h END,6) AS opencv_w FROM m"""


@query(_ROTATED)
def rotated_box_angle(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    tilt = F.col("gt_idx") % 7
    points = F.array(F.array(d("x1"), d("y1")), F.array(d("x2"), (F.col("y1") + tilt).cast("double")), F.array((F.col("x2") - tilt).cast("double"), d("y2")), F.array(d("x1"), d("y2")))
    rows = boxes(spark, sf_dir)[0].select("image_id", "gt_idx", points.alias("p"))
    modes = [B.direction(F.col("p"), m) for m in ("semantic_refer", "long_edge_refer", "opencv_refer")]
    return rows.select("image_id", "gt_idx", _r(modes[0].angle).alias("semantic"), _r(modes[1].angle).alias("long_edge"), _r(modes[2].angle).alias("opencv"), _r(modes[2].w).alias("opencv_w"))


@query(VIEWS + f" SELECT image_id, gt_idx, round((x1+x2)/2.0/{W},6) AS xc, round((y1+y2)/2.0/{H},6) AS yc, round(CAST(x2-x1 AS DOUBLE)/{W},6) AS w, round(CAST(y2-y1 AS DOUBLE)/{H},6) AS h FROM gt")
def yolo_normalize(spark, sf_dir):
    parts = B.yolo_normalize(B.box(), W, H)
    return boxes(spark, sf_dir)[0].select("image_id", "gt_idx", *(_r(c).alias(n) for n, c in zip(("xc", "yc", "w", "h"), parts, strict=True)))


@query(VIEWS + " SELECT image_id, gt_idx, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM gt")
def yolo_denormalize(spark, sf_dir):
    back = B.yolo_denormalize(*B.yolo_normalize(B.box(), W, H), W, H)
    return boxes(spark, sf_dir)[0].select("image_id", "gt_idx", *(_r(c, 3).alias(n) for n, c in zip(B.Box._fields, back, strict=True)))


@query(VIEWS + " SELECT image_id, gt_idx, least(x1,500) AS x1, least(y1,300) AS y1, least(x2,500) AS x2, least(y2,300) AS y2 FROM gt")
def coco_bbox_clip(spark, sf_dir):
    cut = B.clip_box(B.box(), 500, 300)
    return boxes(spark, sf_dir)[0].select("image_id", "gt_idx", *(c.cast("long").alias(n) for n, c in zip(B.Box._fields, cut, strict=True)))


@query(VIEWS + " SELECT image_id, gt_idx, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, CAST((x2-x1)*(y2-y1) AS DOUBLE) AS area FROM gt")
def polygon_bbox_area(spark, sf_dir):
    rows = boxes(spark, sf_dir)[0].select("image_id", "gt_idx", B.box_points(B.box()).alias("p"))
    return rows.select("image_id", "gt_idx", *B.polygon_bbox(F.col("p")).fields(), B.polygon_area(F.col("p")).alias("area"))


@query("""SELECT v.vec_id, w.vec_id AS other_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])), 6) AS similarity
 FROM embeddings v JOIN embeddings w ON w.vec_id = v.vec_id + 1""")
def cosine_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    w = v.select(F.col("vec_id").alias("other_id"), F.col("e").alias("o"))
    return v.join(w, F.col("other_id") == F.col("vec_id") + 1).select("vec_id", "other_id", _r(B.cosine_similarity(F.col("e"), F.col("o"))).alias("similarity"))


# --- filters and dataset operators -----------------------------------------------------------------------------------


@query(VIEWS + " SELECT image_id, pred_idx, cls, conf FROM pr WHERE conf >= CASE cls WHEN 0 THEN 0.2 WHEN 1 THEN 0.4 ELSE 0.6 END")
def conf_filter(spark, sf_dir):
    limits = dataset.thresholds(spark, [0.2, 0.4, 0.6], list(range(5)))
    return dataset.at_least(boxes(spark, sf_dir)[1], limits, F.col("conf")).select("image_id", "pred_idx", "cls", "conf")


@query(VIEWS + " SELECT image_id, gt_idx, cls FROM gt WHERE (x2-x1)*(y2-y1) >= CASE WHEN cls < 2 THEN 10000 ELSE 15000 END")
def area_filter(spark, sf_dir):
    limits = dataset.thresholds(spark, [10000.0, 10000.0, 15000.0], list(range(5)))
    return dataset.at_least(boxes(spark, sf_dir)[0], limits, B.area(B.box())).select("image_id", "gt_idx", "cls")


@query(VIEWS + """, kept AS (SELECT image_id, gt_idx, CASE cls WHEN 3 THEN 0 ELSE 1 END AS cls FROM gt WHERE cls IN (3, 1))
 SELECT i.image_id, k.gt_idx, CAST(k.cls AS BIGINT) AS cls FROM (SELECT DISTINCT image_id FROM gt) i LEFT JOIN kept k ON k.image_id = i.image_id""")
def class_subset_remap(spark, sf_dir):
    gt, _ = boxes(spark, sf_dir)
    return dataset.class_subset(gt.select("image_id", "gt_idx", "cls"), gt.select("image_id").distinct(), [3, 1]).select("image_id", "gt_idx", "cls")


@query("SELECT p_brand AS label, count(*) AS n, row_number() OVER (ORDER BY regexp_extract(p_brand,'^[^0-9]*'), CAST(coalesce(nullif(regexp_extract(p_brand,'[0-9]+'),''),'0') AS BIGINT), p_brand) AS natural_rank FROM part GROUP BY p_brand")
def class_histogram(spark, sf_dir):
    return dataset.class_histogram(table(spark, sf_dir, "part"), "p_brand")


@query("""WITH c AS (SELECT DISTINCT p_brand AS name FROM part) SELECT name, row_number() OVER (ORDER BY regexp_extract(name,'^[^0-9]*'), CAST(coalesce(nullif(regexp_extract(name,'[0-9]+'),''),'0') AS BIGINT), name) AS place FROM c""")
def natural_order(spark, sf_dir):
    from pyspark.sql import Window

    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(X.natural_key(F.col("name")), "name")).cast("long").alias("place"))


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
 c AS (SELECT least(CAST(floor((l_extendedprice-lo)/(hi-lo)*20) AS BIGINT), 19) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
 SELECT r.range AS bin, coalesce(c.n, 0) AS n FROM range(20) r LEFT JOIN c ON c.bin = r.range""")
def histogram_bins(spark, sf_dir):
    return dataset.equal_bins(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)


@query(VIEWS + " SELECT cls, count(*) AS n, count(DISTINCT image_id) AS n_images FROM gt GROUP BY cls")
def gt_class_image_counts(spark, sf_dir):
    return precision.class_counts(boxes(spark, sf_dir)[0])


@query(VIEWS + " SELECT image_id, cls, count(*) AS n FROM (SELECT image_id, cls FROM gt UNION ALL SELECT image_id, cls FROM pr) u GROUP BY image_id, cls")
def dataset_union(spark, sf_dir):
    gt, pr = boxes(spark, sf_dir)
    return dataset.union_all([gt.select("image_id", "cls"), pr.select("image_id", "cls")]).groupBy("image_id", "cls").agg(F.count("*").alias("n"))


@query(VIEWS + " SELECT min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, image_id, cls FROM gt GROUP BY image_id, cls")
def class_union_box(spark, sf_dir):
    return boxes(spark, sf_dir)[0].groupBy("image_id", "cls").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


# --- matching and confusion ------------------------------------------------------------------------------------------


@query(STATUS + " SELECT * FROM st")
def match_status_iou(spark, sf_dir):
    return matching.match_status(*boxes(spark, sf_dir))


@query(STATUS.replace("CAST(CAST(inter AS DOUBLE)/(ga+pa-inter) AS FLOAT)", "CAST(CAST(inter AS DOUBLE)/ga AS FLOAT)") + " SELECT * FROM st")
def match_status_ios(spark, sf_dir):
    return matching.match_status(*boxes(spark, sf_dir), use_ios=True)


@query(MATCHED + " SELECT image_id, pred_idx FROM pr EXCEPT SELECT image_id, pred_idx FROM pairs WHERE gcls=pcls")
def fp_antijoin(spark, sf_dir):
    return matching.false_positives(*boxes(spark, sf_dir)).select("image_id", "pred_idx")


@query(MATCHED + " SELECT DISTINCT image_id, pred_idx FROM pairs WHERE gcls=pcls")
def tp_semijoin(spark, sf_dir):
    return matching.true_positives(*boxes(spark, sf_dir)).select("image_id", "pred_idx")


_COUNTS = """, gs AS (SELECT image_id, gt_idx, max(CASE WHEN gcls=pcls THEN 1 ELSE 0 END) AS hit, min(pred_idx) AS first_pred FROM pairs GROUP BY image_id, gt_idx),
g2 AS (SELECT g.*, coalesce(s.hit,0) AS hit, s.first_pred FROM gt g LEFT JOIN gs s ON g.image_id=s.image_id AND g.gt_idx=s.gt_idx),
rec AS (SELECT 'R' AS kind, CASE WHEN g2.hit=1 THEN g2.cls WHEN g2.first_pred IS NOT NULL THEN p.cls ELSE 5 END AS pred, g2.cls AS gt
  FROM g2 LEFT JOIN pr p ON p.image_id=g2.image_id AND p.pred_idx=g2.first_pred WHERE NOT (g2.hit=0 AND g2.difficult)),
ps AS (SELECT x.image_id, x.pred_idx, max(CASE WHEN x.gcls=x.pcls THEN 1 ELSE 0 END) AS hit, min(CASE WHEN NOT (g2.hit=0 AND g2.difficult) THEN x.gt_idx END) AS first_gt
  FROM pairs x JOIN g2 ON x.image_id=g2.image_id AND x.gt_idx=g2.gt_idx GROUP BY x.image_id, x.pred_idx),
prec AS (SELECT 'P' AS kind, p.cls AS pred, CASE WHEN coalesce(ps.hit,0)=1 THEN p.cls WHEN ps.first_gt IS NOT NULL THEN g.cls ELSE 5 END AS gt
  FROM pr p LEFT JOIN ps ON p.image_id=ps.image_id AND p.pred_idx=ps.pred_idx LEFT JOIN gt g ON g.image_id=ps.image_id AND g.gt_idx=ps.first_gt),
cc AS (SELECT kind, pred, gt, count(*) AS n FROM (SELECT * FROM rec UNION ALL SELECT * FROM prec) u GROUP BY kind, pred, gt)"""
COUNTED = MATCHED + _COUNTS


@query(COUNTED + " SELECT * FROM cc")
def confusion_counts(spark, sf_dir):
    return confusion.confusion_counts(*boxes(spark, sf_dir), background=5)


@query((MATCHED + _COUNTS).replace("(dc = 0) AS difficult", "false AS difficult") + " SELECT * FROM cc")
def confusion_legacy(spark, sf_dir):
    gt, pr = boxes(spark, sf_dir)
    return confusion.confusion_counts(gt.withColumn("difficult", F.lit(False)), pr, background=5)


@query(COUNTED + " SELECT *, round(100.0*n/greatest(CASE WHEN kind='R' THEN sum(n) OVER (PARTITION BY kind, gt) ELSE sum(n) OVER (PARTITION BY kind, pred) END, 1), 6) AS share FROM cc")
def confusion_normalized(spark, sf_dir):
    return confusion.normalized(confusion_counts(spark, sf_dir)).withColumn("share", _r(F.col("share")))


@query(COUNTED + """, cl AS (SELECT * FROM (VALUES (0,'car'),(1,'person'),(2,'bike'),(3,'bus'),(4,'dog')) v(cls,name)),
 rr AS (SELECT gt AS cls, sum(n) AS gt_num, sum(CASE WHEN pred=gt THEN n ELSE 0 END) AS rd FROM cc WHERE kind='R' GROUP BY gt),
 pp AS (SELECT pred AS cls, sum(n) AS pred_num, sum(CASE WHEN pred=gt THEN n ELSE 0 END) AS pd FROM cc WHERE kind='P' GROUP BY pred),
 pc AS (SELECT name, coalesce(gt_num,0) AS gt_num, coalesce(pred_num,0) AS pred_num, coalesce(rd,0) AS rd, coalesce(pd,0) AS pd FROM cl LEFT JOIN rr USING (cls) LEFT JOIN pp USING (cls)),
 rows_ AS (SELECT name, gt_num, pred_num, rd/(gt_num+1e-16) AS recall, pd/(pred_num+1e-16) AS precision FROM pc
  UNION ALL SELECT 'background', (SELECT coalesce(sum(n),0) FROM cc WHERE kind='R' AND pred=5), (SELECT coalesce(sum(n),0) FROM cc WHERE kind='P' AND gt=5), NULL, NULL
  UNION ALL SELECT 'Total', sum(gt_num), sum(pred_num), (sum(rd)+1e-16)/(sum(gt_num)+1e-16), (sum(pd)+1e-16)/(sum(pred_num)+1e-16) FROM pc
  UNION ALL SELECT 'Mean', sum(gt_num), sum(pred_num), avg(rd/(gt_num+1e-16)), avg(pd/(pred_num+1e-16)) FROM pc WHERE gt_num+pred_num > 0)
 SELECT name, CAST(gt_num AS BIGINT) AS gt_num, CAST(pred_num AS BIGINT) AS pred_num, round(recall,6) AS recall, round(precision,6) AS precision FROM rows_""")
def recall_precision_report(spark, sf_dir):
    classes = spark.createDataFrame(sorted(_CLASS_NAMES.items()), "cls long, name string")
    rows = confusion.report(confusion_counts(spark, sf_dir), classes, background=5)
    return rows.select("name", "gt_num", "pred_num", _r(F.col("recall")).alias("recall"), _r(F.col("precision")).alias("precision"))


@query(STATUS + " SELECT g.cls, count(*) FILTER (WHERE s.status='fnDiff') AS fn_diff, count(*) FILTER (WHERE s.status='tpg') AS tp_diff FROM gt g JOIN st s ON s.image_id=g.image_id AND s.idx=g.gt_idx AND s.side='gt' WHERE g.difficult GROUP BY g.cls")
def difficult_counts(spark, sf_dir):
    return confusion.difficult_counts(*boxes(spark, sf_dir))


@query(STATUS + """ SELECT image_id, count(*) FILTER (WHERE status='tpg') AS n_tp, count(*) FILTER (WHERE status='fp') AS n_fp, count(*) FILTER (WHERE status='fn') AS n_fn, count(*) FILTER (WHERE status='fnDiff') AS n_fn_diff
 FROM st GROUP BY image_id HAVING count(*) FILTER (WHERE status IN ('fp','fn')) > 0""")
def fpfn_subset(spark, sf_dir):
    return confusion.error_images(*boxes(spark, sf_dir))


@query(STATUS + """, e AS (SELECT st.image_id, cls || CASE status WHEN 'fp' THEN '-fp' WHEN 'tpg' THEN '' ELSE '-fn' END AS label, status, side, idx FROM st WHERE status <> 'tpp'),
 b AS (SELECT image_id, 'gt' AS side, gt_idx AS idx, x1, y1, x2, y2 FROM gt UNION ALL SELECT image_id, 'pred', pred_idx, x1, y1, x2, y2 FROM pr),
 f AS (SELECT image_id, label, status, x1, y1, x2, y2, bool_or(status='tpg') OVER w AS have_tp, bool_or(status='fp') OVER w AS have_fp, bool_or(status='fn') OVER w AS have_fn FROM e JOIN b USING (image_id, side, idx) WINDOW w AS (PARTITION BY image_id))
 SELECT * FROM f WHERE have_fp OR have_fn""")
def error_shapes(spark, sf_dir):
    return confusion.error_shapes(*boxes(spark, sf_dir))


# --- average precision -----------------------------------------------------------------------------------------------

_AP = PAIRED + """, thr AS (SELECT k, 0.5 + k*0.05 AS t FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) v(k)),
c0 AS (SELECT *, CAST(inter AS DOUBLE)/(CAST(ga+pa-inter AS DOUBLE)+1e-7) AS iou FROM j WHERE gcls = pcls),
c1 AS (SELECT k,image_id,gt_idx,pred_idx, row_number() OVER (PARTITION BY k,image_id,pred_idx ORDER BY iou DESC, gt_idx DESC) rn FROM c0, thr WHERE iou > CAST(t AS DOUBLE)),
c2 AS (SELECT k,image_id,pred_idx, row_number() OVER (PARTITION BY k,image_id,gt_idx ORDER BY pred_idx) rn FROM c1 WHERE rn=1),
tp AS (SELECT p.image_id, p.pred_idx, p.cls, p.conf, thr.k, CASE WHEN c.pred_idx IS NULL THEN 0 ELSE 1 END AS tp FROM pr p CROSS JOIN thr LEFT JOIN (SELECT * FROM c2 WHERE rn=1) c ON c.k=thr.k AND c.image_id=p.image_id AND c.pred_idx=p.pred_idx),
nl AS (SELECT cls, count(*) n FROM gt GROUP BY cls),
cum AS (SELECT k,cls,conf, row_number() OVER w AS i, sum(tp) OVER w AS tpc FROM tp WINDOW w AS (PARTITION BY k,cls ORDER BY conf DESC,image_id,pred_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pts AS (SELECT c.k, c.cls, c.i, c.conf, CAST(tpc AS DOUBLE)/n AS rec, CAST(tpc AS DOUBLE)/i AS prec FROM cum c JOIN nl USING (cls))"""
_ENV = _AP + """, pt AS (SELECT k,cls,i,rec,prec FROM pts UNION ALL SELECT DISTINCT k,cls,0,0.0,1.0 FROM pts UNION ALL SELECT DISTINCT k,cls,1000000000000,1.0,0.0 FROM pts),
env AS (SELECT k,cls,i,rec, max(prec) OVER (PARTITION BY k,cls ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM pt)"""
_APS = _ENV + """, seg AS (SELECT k,cls,i,rec r0,e e0, lead(rec) OVER w r1, lead(e) OVER w e1 FROM env WINDOW w AS (PARTITION BY k,cls ORDER BY i)),
y AS (SELECT s.cls, s.k, g.range AS gi, CASE WHEN r1 IS NULL THEN e0 ELSE e0+(g.range/100.0-r0)*(e1-e0)/(r1-r0) END AS y FROM seg s JOIN range(101) g ON s.r0 <= CAST(g.range AS DOUBLE)/100 AND (s.r1 IS NULL OR CAST(g.range AS DOUBLE)/100 < s.r1)),
ap AS (SELECT cls,k, (sum(y) - 0.5*sum(CASE WHEN gi IN (0,100) THEN y ELSE 0 END))*0.01 AS ap FROM y GROUP BY cls,k)"""
_CURVE = _AP + """, s0 AS (SELECT cls, i, -conf AS x0, rec r0, prec p0, lead(-conf) OVER w x1, lead(rec) OVER w r1, lead(prec) OVER w p1 FROM pts WHERE k=0 WINDOW w AS (PARTITION BY cls ORDER BY i)),
cv AS (SELECT c.cls, g.range AS g, coalesce(CASE WHEN x1 IS NULL THEN p0 ELSE p0+(-(g.range/999.0)-x0)/(x1-x0)*(p1-p0) END, 1.0) AS p, coalesce(CASE WHEN x1 IS NULL THEN r0 ELSE r0+(-(g.range/999.0)-x0)/(x1-x0)*(r1-r0) END, 0.0) AS r
 FROM (SELECT DISTINCT cls FROM gt) c CROSS JOIN range(1000) g LEFT JOIN s0 ON s0.cls=c.cls AND s0.x0 <= -(CAST(g.range AS DOUBLE)/999) AND (s0.x1 IS NULL OR -(CAST(g.range AS DOUBLE)/999) < s0.x1)),
cf AS (SELECT *, 2*p*r/(p+r+1e-16) AS f1 FROM cv)"""
_POINT = _CURVE + """, mf AS (SELECT g, avg(f1) AS v FROM cf GROUP BY g),
sm AS (SELECT g, (sum(v) OVER (ORDER BY g ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) + greatest(0,50-g)*(SELECT v FROM mf WHERE g=0) + greatest(0,g+50-999)*(SELECT v FROM mf WHERE g=999))/101 AS v FROM mf),
bp AS (SELECT g FROM sm ORDER BY round(v,9) DESC, g LIMIT 1),
op AS (SELECT c.cls, c.g, p, r, f1, CAST(round_even(r*n,0) AS BIGINT) AS tp, CAST(round_even(round_even(r*n,0)/(p+1e-16)-round_even(r*n,0),0) AS BIGINT) AS fp FROM cf c JOIN bp USING (g) JOIN nl USING (cls))"""


def _ranked(spark, sf_dir):
    gt, pr = boxes(spark, sf_dir)
    return gt, precision.ranked(matching.prediction_levels(gt, pr), gt)


@query(_AP.split("nl AS (")[0].rstrip().rstrip(",") + " SELECT image_id, k, cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tp*pred_idx) AS BIGINT) AS preds FROM tp GROUP BY image_id, k, cls")
def ap_tp_assignment(spark, sf_dir):
    levels, n = matching.prediction_levels(*boxes(spark, sf_dir)), len(matching.THRESHOLDS)
    hits = [F.shiftright("levels", k).bitwiseAND(1).cast("long") for k in range(n)]
    sums = levels.groupBy("image_id", "cls").agg(*(F.sum(h).alias(f"t{k}") for k, h in enumerate(hits)), *(F.sum(h * F.col("pred_idx")).alias(f"p{k}") for k, h in enumerate(hits)))
    return sums.select("image_id", "cls", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("tp"), F.col(f"p{k}").alias("preds")) for k in range(n)))))


@query(_AP + " SELECT cls, k, i, conf, round(rec,6) AS rec, round(prec,6) AS prec FROM pts")
def ap_pr_points(spark, sf_dir):
    _, points = _ranked(spark, sf_dir)
    return precision.pr_points(points).select("cls", "k", "i", "conf", _r(F.col("rec")).alias("rec"), _r(F.col("prec")).alias("prec"))


@query(_ENV + " SELECT cls, k, i, round(rec,6) AS rec, round(e,6) AS env FROM env")
def ap_envelope(spark, sf_dir):
    _, points = _ranked(spark, sf_dir)
    return precision.envelope(points).select("cls", "k", "i", _r(F.col("rec")).alias("rec"), _r(F.col("env")).alias("env"))


@query(_APS + " SELECT cls, k, round(ap,6) AS ap FROM ap")
def ap_per_class_iou(spark, sf_dir):
    gt, points = _ranked(spark, sf_dir)
    return precision.average_precision(points, gt).withColumn("ap", _r(F.col("ap")))


@query(_CURVE + " SELECT cls, g, round(p,6) AS p, round(r,6) AS r, round(f1,6) AS f1 FROM cf")
def pr_curves_grid(spark, sf_dir):
    gt, points = _ranked(spark, sf_dir)
    return precision.curves(points, gt).select("cls", F.col("g").cast("long").alias("g"), *(_r(F.col(c)).alias(c) for c in ("p", "r", "f1")))


@query(_POINT + " SELECT g, round(v,6) AS f1 FROM sm")
def f1_smoothed(spark, sf_dir):
    gt, points = _ranked(spark, sf_dir)
    return precision.smoothed(precision.curves(points, gt).groupBy("g").agg(F.avg("f1").alias("f1"))).select(F.col("g").cast("long").alias("g"), _r(F.col("f1")).alias("f1"))


@query(_POINT + " SELECT cls, g, round(p,6) AS p, round(r,6) AS r, round(f1,6) AS f1, tp, fp FROM op")
def per_class_operating_point(spark, sf_dir):
    gt, points = _ranked(spark, sf_dir)
    point = precision.operating_point(precision.curves(points, gt), gt)
    return point.select("cls", F.col("g").cast("long").alias("g"), *(_r(F.col(c)).alias(c) for c in ("p", "r", "f1")), "tp", "fp")


@query(_CURVE + ", b AS (SELECT cls, g, row_number() OVER (PARTITION BY cls ORDER BY f1 DESC, g) AS rn FROM cf) SELECT cls, round(g/999.0,6) AS conf FROM b WHERE rn=1")
def best_f1_confidence(spark, sf_dir):
    gt, points = _ranked(spark, sf_dir)
    return precision.best_confidence(precision.curves(points, gt)).withColumn("conf", _r(F.col("conf")))


@query(_APS + ", m AS (SELECT avg(ap) FILTER (WHERE k=0) AS map50, avg(ap) FILTER (WHERE k=5) AS map75, avg(ap) AS map FROM ap) SELECT round(map50,6) AS map50, round(map75,6) AS map75, round(map,6) AS map, round(0.1*map50+0.9*map,6) AS fitness FROM m")
def map_summary(spark, sf_dir):
    gt, points = _ranked(spark, sf_dir)
    point = precision.operating_point(precision.curves(points, gt), gt)
    return precision.summary(precision.average_precision(points, gt), point).select(*(_r(F.col(c)).alias(c) for c in ("map50", "map75", "map", "fitness")))


def _class_results(spark, sf_dir):
    gt, points = _ranked(spark, sf_dir)
    point = precision.operating_point(precision.curves(points, gt), gt)
    return precision.class_results(precision.average_precision(points, gt), point, gt), gt


_RESULTS = _APS + _POINT.removeprefix(_AP) + """, res AS (SELECT n.cls, n.n, n.n_images, coalesce(op.p,0) AS p, coalesce(op.r,0) AS r, max(ap) FILTER (WHERE k=0) AS ap50, max(ap) FILTER (WHERE k=5) AS ap75, avg(ap) AS map
 FROM (SELECT cls, count(*) AS n, count(DISTINCT image_id) AS n_images FROM gt GROUP BY cls) n JOIN ap USING (cls) LEFT JOIN op ON op.cls = n.cls GROUP BY ALL)"""


@query(_RESULTS + " SELECT cls, n, n_images, round(p,6) AS p, round(r,6) AS r, round(ap50,6) AS ap50, round(ap75,6) AS ap75, round(map,6) AS map FROM res")
def class_results(spark, sf_dir):
    return _class_results(spark, sf_dir)[0].select("cls", "n", "n_images", *(_r(F.col(c)).alias(c) for c in ("p", "r", "ap50", "ap75", "map")))


@query(_RESULTS + " SELECT c.range AS cls, round(coalesce(map, (SELECT avg(map) FROM res)), 6) AS map FROM range(7) c LEFT JOIN res ON res.cls = c.range")
def class_maps(spark, sf_dir):
    return precision.class_maps(_class_results(spark, sf_dir)[0], spark.range(7).withColumnRenamed("id", "cls")).select("cls", _r(F.col("map")).alias("map"))


@query(_RESULTS + """, m AS (SELECT avg(p) AS p, avg(r) AS r, avg(ap50) AS a, avg(map) AS m FROM res)
 SELECT 'metrics/precision(B)' AS key, round(p,6) AS value FROM m UNION ALL SELECT 'metrics/recall(B)', round(r,6) FROM m UNION ALL SELECT 'metrics/mAP50(B)', round(a,6) FROM m UNION ALL SELECT 'metrics/mAP50-95(B)', round(m,6) FROM m UNION ALL SELECT 'fitness', round(0.1*a+0.9*m,6) FROM m""")
def metric_values(spark, sf_dir):
    return precision.metric_values(_class_results(spark, sf_dir)[0]).select("key", _r(F.col("value")).alias("value"))


@query(_RESULTS + """ SELECT 'all' AS name, (SELECT count(DISTINCT image_id) FROM gt) AS n_images, CAST(sum(n) AS BIGINT) AS n, round(avg(p),6) AS p, round(avg(r),6) AS r, round(avg(ap50),6) AS ap50, round(avg(map),6) AS map FROM res
 UNION ALL SELECT ['car','person','bike','bus','dog'][cls+1], n_images, n, round(p,6), round(r,6), round(ap50,6), round(map,6) FROM res""")
def results_table(spark, sf_dir):
    results, gt = _class_results(spark, sf_dir)
    names = spark.createDataFrame(sorted(_CLASS_NAMES.items()), "cls long, name string")
    return precision.results_table(results, names, gt).select("name", "n_images", "n", *(_r(F.col(c)).alias(c) for c in ("p", "r", "ap50", "map")))


@query(VIEWS + """ SELECT image_id, pred_idx, cls, x1 + 640*(pred_idx%3) AS x1, y1 + 480*(pred_idx%2) AS y1, x2 + 640*(pred_idx%3) AS x2, y2 + 480*(pred_idx%2) AS y2
 FROM pr WHERE conf >= [0.1,0.3,0.5,0.7,0.9][cls+1]""")
def window_detections(spark, sf_dir):
    _, pr = boxes(spark, sf_dir)
    limits = dataset.thresholds(spark, [0.1, 0.3, 0.5, 0.7, 0.9], list(range(5)))
    placed = pr.withColumns({"wx": F.col("pred_idx") % 3 * 640, "wy": F.col("pred_idx") % 2 * 480})
    return dataset.window_detections(placed, limits).select("image_id", "pred_idx", "cls", "x1", "y1", "x2", "y2")


# --- tiling and merging ----------------------------------------------------------------------------------------------


def _images(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("image_id"), (F.col("o_orderkey") * 37 % 2500 + 5).cast("int").alias("width"), (F.col("o_custkey") * 53 % 1500 + 5).cast("int").alias("height"))


_IMAGES = "WITH im AS (SELECT CAST(o_orderkey AS BIGINT) AS image_id, CAST(o_orderkey*37%2500+5 AS BIGINT) AS width, CAST(o_custkey*53%1500+5 AS BIGINT) AS height FROM orders)"
_SLIDES = _IMAGES + """, n AS (SELECT *, CASE WHEN width>=640 THEN (width-640)//512+1 ELSE 0 END AS nx, CASE WHEN height>=640 THEN (height-640)//512+1 ELSE 0 END AS ny FROM im),
 xs AS (SELECT image_id, g.range*512 AS a, g.range*512+640 AS b FROM n JOIN range(10) g ON g.range < nx UNION ALL SELECT image_id, greatest(0,width-640), width FROM n WHERE width - CASE WHEN nx>0 THEN (nx-1)*512+640 ELSE 0 END > 10),
 ys AS (SELECT image_id, g.range*512 AS a, g.range*512+640 AS b FROM n JOIN range(10) g ON g.range < ny UNION ALL SELECT image_id, greatest(0,height-640), height FROM n WHERE height - CASE WHEN ny>0 THEN (ny-1)*512+640 ELSE 0 END > 10)"""


@query(_SLIDES + " SELECT image_id, xs.a AS x1, ys.a AS y1, xs.b AS x2, ys.b AS y2 FROM xs JOIN ys USING (image_id)")
def sliding_windows(spark, sf_dir):
    return _longs(tiling.sliding_windows(_images(spark, sf_dir)))


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) for c in df.columns))


@query(_SLIDES + " SELECT DISTINCT xs.a AS x1, ys.a AS y1, xs.b AS x2, ys.b AS y2 FROM xs JOIN ys USING (image_id)")
def distinct_windows(spark, sf_dir):
    return _longs(tiling.sliding_windows(_images(spark, sf_dir)).select("x1", "y1", "x2", "y2").distinct())


@query(_IMAGES + """, x AS (SELECT image_id, unnest([(0, width//2), (width//2, width)]) AS p FROM im), y AS (SELECT image_id, unnest([(0, height//3), (height//3, height)]) AS p FROM im)
 SELECT x.image_id, x.p[1] AS x1, y.p[1] AS y1, x.p[2] AS x2, y.p[2] AS y2 FROM x JOIN y USING (image_id)""")
def grid_cells(spark, sf_dir):
    cut = lambda c, n: F.array(F.lit(0), F.floor(F.col(c) / n).cast("int"), F.col(c))
    return _longs(tiling.grid_cells(_images(spark, sf_dir), cut("width", 2), cut("height", 3)))


@query(_IMAGES + ", c AS (SELECT image_id, (width-160.0)/480 AS n FROM im) SELECT image_id, CAST(floor(n) + CASE WHEN n-floor(n) > 0 AND n-floor(n) >= 0.25 THEN 1 ELSE 0 END AS BIGINT) AS n FROM c")
def cut_counts(spark, sf_dir):
    return _images(spark, sf_dir).select("image_id", tiling.cut_count(F.col("width"), 640, 0.25).cast("long").alias("n"))


@query(_IMAGES + """, c AS (SELECT *, (width-160.0)/480 AS fx, (height-160.0)/480 AS fy FROM im),
 n AS (SELECT image_id, width, height, greatest(1, CAST(floor(fx)+CASE WHEN fx-floor(fx)>0 AND fx-floor(fx)>=0.25 THEN 1 ELSE 0 END AS BIGINT)) AS nx, greatest(1, CAST(floor(fy)+CASE WHEN fy-floor(fy)>0 AND fy-floor(fy)>=0.25 THEN 1 ELSE 0 END AS BIGINT)) AS ny FROM c),
 s AS (SELECT *, ceil(CAST(width AS DOUBLE)/(nx-(nx-1)*0.25)) AS w, ceil(CAST(height AS DOUBLE)/(ny-(ny-1)*0.25)) AS h FROM n),
 t AS (SELECT *, ceil(w*0.75) AS sw, ceil(h*0.75) AS sh FROM s)
 SELECT image_id, CAST(i.range*sw AS BIGINT) AS x1, CAST(k.range*sh AS BIGINT) AS y1, CAST(least(i.range*sw+w,width) AS BIGINT) AS x2, CAST(least(k.range*sh+h,height) AS BIGINT) AS y2 FROM t JOIN range(20) i ON i.range<nx JOIN range(20) k ON k.range<ny""")
def overlap_split(spark, sf_dir):
    return _longs(tiling.overlap_split(_images(spark, sf_dir)))


_RANKED = ", ".join(f"({n},{i},{j})" for n, (i, j) in enumerate(tiling.ratio_candidates()))


@query(_IMAGES + f""", c(n,i,j) AS (VALUES {_RANKED}), g AS (SELECT image_id, width, height, n, i, j, abs(CAST(width AS DOUBLE)/height - CAST(i AS DOUBLE)/j) AS gap FROM im, c),
 m AS (SELECT image_id, min(gap) AS gap FROM g GROUP BY image_id), t AS (SELECT g.*, row_number() OVER (PARTITION BY g.image_id ORDER BY n) AS rn FROM g JOIN m ON m.image_id=g.image_id AND m.gap=g.gap),
 u AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC) AS pick FROM t WHERE rn=1 OR width*height > 0.5*640*640*i*j),
 r AS (SELECT image_id, i, j FROM u WHERE pick=1)
 SELECT image_id, x.range*640 AS x1, y.range*640 AS y1, x.range*640+640 AS x2, y.range*640+640 AS y2 FROM r JOIN range(6) x ON x.range<i JOIN range(6) y ON y.range<j""")
def aspect_ratio_split(spark, sf_dir):
    return _longs(tiling.ratio_split(_images(spark, sf_dir)))


@query(VIEWS + """, l AS (SELECT *, greatest(0, least(x2,650)-x1)*greatest(0,least(y2,350)-y1) AS held FROM gt)
 SELECT image_id, gt_idx, x1, y1, least(x2,650) AS x2, least(y2,350) AS y2 FROM l WHERE CAST(held AS DOUBLE)/((x2-x1)*(y2-y1)) > 0.7""")
def labels_in_window(spark, sf_dir):
    gt, _ = boxes(spark, sf_dir)
    windows = gt.select("image_id").distinct().select("image_id", F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(650).alias("x2"), F.lit(350).alias("y2"))
    return _longs(tiling.labels_in_windows(windows, gt).select("image_id", "gt_idx", "x1", "y1", "x2", "y2"))


def _detections(spark, sf_dir):
    return boxes(spark, sf_dir)[1].withColumnRenamed("cls", "code")


@query()
def nmm_greedy(spark, sf_dir):
    return merging.merge_detections(_detections(spark, sf_dir))


@query()
def nmm_onehop(spark, sf_dir):
    return merging.merge_detections(_detections(spark, sf_dir), greedy=False)


def _canvas(gt):
    return gt.select("image_id").distinct().select("image_id", F.lit(W).alias("width"), F.lit(H).alias("height"))


@query()
def cluster_windows(spark, sf_dir):
    gt, _ = boxes(spark, sf_dir)
    return merging.cluster_windows(gt, _canvas(gt), padding=0.25)


@query()
def cluster_windows_agglomerative(spark, sf_dir):
    gt, _ = boxes(spark, sf_dir)
    return merging.cluster_windows(gt, _canvas(gt), (320, 320), 5, 0.25, "agglomerative", True)


@query()
def crop_plan(spark, sf_dir):
    gt, _ = boxes(spark, sf_dir)
    return merging.crop_plan(gt, _canvas(gt), 160)


@query()
def crop_plan_masked(spark, sf_dir):
    """Labels of the crops and, as masked, the parts of others that are blacked out in them."""
    gt, _ = boxes(spark, sf_dir)
    plan = merging.crop_plan(gt, _canvas(gt), 160, mask=True)
    rows = gt.select("image_id", "gt_idx", "x1", "y1", "x2", "y2")
    return merging.crop_labels(plan, rows).withColumn("masked", F.lit(False)).unionByName(merging.crop_labels(plan, rows, "masked").withColumn("masked", F.lit(True)))


# --- formats ---------------------------------------------------------------------------------------------------------


def _annotations(spark, sf_dir) -> DataFrame:
    gt, _ = boxes(spark, sf_dir)
    names = F.create_map(*[x for k, v in _CLASS_NAMES.items() for x in (F.lit(k), F.lit(v))])
    corners = F.array(F.array(F.col("x1").cast("double"), F.col("y1").cast("double")), F.array(F.col("x2").cast("double"), F.col("y2").cast("double")))
    return gt.select(F.concat(F.lit("img"), F.lpad(F.col("image_id").cast("string"), 9, "0")).alias("image_id"), F.lit(W).alias("width"), F.lit(H).alias("height"), F.col("gt_idx").cast("int").alias("ann_idx"), names[F.col("cls").cast("int")].alias("label"), F.lit("rectangle").alias("shape_type"), corners.alias("points"), F.lit(1.0).alias("score"), F.create_map(F.lit("difficult"), F.col("difficult")).alias("flags"))


def _names(spark):
    return formats.names_table(spark, _CLASS_NAMES)


_CANON = VIEWS + """, cl AS (SELECT * FROM (VALUES (0,'car'),(1,'person'),(2,'bike'),(3,'bus'),(4,'dog')) v(cls,label)),
 an AS (SELECT 'img' || lpad(CAST(image_id AS VARCHAR),9,'0') AS image_id, gt_idx AS idx, label, gt.cls, x1, y1, least(x2,1300) AS x2, least(y2,700) AS y2, difficult FROM gt JOIN cl ON cl.cls = gt.cls)"""


def _records(annotations: DataFrame) -> DataFrame:
    rows = formats.match_records(annotations)
    return rows.select("image_id", "idx", "label", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")), "difficult")


@query(_CANON + " SELECT image_id, idx, label, x1, y1, x2, y2, difficult FROM an")
def parse_labelme(spark, sf_dir):
    files = formats.to_labelme(_annotations(spark, sf_dir)).select(F.concat(F.lit("/l/"), "image_id", F.lit(".json")).alias("path"), "value")
    return _records(formats.from_labelme(files))


@query(_CANON + " SELECT image_id, idx, label, x1, y1, x2, y2, difficult FROM an")
def parse_voc(spark, sf_dir):
    files = formats.to_voc(_annotations(spark, sf_dir)).select(F.concat(F.lit("/l/"), "image_id", F.lit(".xml")).alias("path"), "value")
    return _records(formats.from_voc(files))


@query(_CANON + " SELECT image_id, idx, label, x1, y1, x2, y2 FROM an")
def parse_yolo(spark, sf_dir):
    notes = _annotations(spark, sf_dir)
    files = formats.to_yolo(notes, _names(spark)).select(F.concat(F.lit("/l/"), "image_id", F.lit(".txt")).alias("path"), "value")
    back = formats.from_yolo(files, _names(spark), notes.select("image_id", "width", "height").distinct())
    rounded = back.withColumn("points", F.transform("points", lambda p: F.array(F.round(p[0], 3), F.round(p[1], 3))))
    return _records(rounded).drop("difficult")


@query(_CANON + " SELECT image_id, idx, label, x1, y1, x2, y2 FROM an")
def parse_coco(spark, sf_dir):
    images, notes, categories = formats.coco_tables(_annotations(spark, sf_dir), _names(spark), 1)
    # one document an image, so that none grows with the table
    notes = notes.withColumn("segmentation", F.lit("[]"))
    by_image = notes.groupBy(F.col("image_id").alias("iid")).agg(F.array_sort(F.collect_list(F.struct("id", "image_id", "category_id", F.col("bbox").cast("array<double>").alias("bbox"), "area", "iscrowd", "segmentation"))).alias("annotations"))
    listed = categories.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("categories"))
    docs = images.join(by_image, images["id"] == F.col("iid")).join(F.broadcast(listed))
    text = F.to_json(F.struct(F.array(F.struct("id", "file_name", "height", "width")).alias("images"), "annotations", "categories"))
    files = docs.select(F.concat(F.lit("/annotations/"), "file_name", F.lit(".json")).alias("path"), text.alias("value"))
    return _records(formats.from_coco(files, masks=False)).drop("difficult")


@query(_CANON + " SELECT CAST(row_number() OVER (ORDER BY image_id) AS BIGINT) AS id, image_id || '.jpg' AS file_name, CAST(700 AS BIGINT) AS height, CAST(1300 AS BIGINT) AS width FROM (SELECT DISTINCT image_id FROM an) d")
def coco_images(spark, sf_dir):
    images = formats.coco_tables(_annotations(spark, sf_dir), _names(spark), 1)[0]
    return images.select("id", "file_name", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"))


@query(_CANON + """, im AS (SELECT image_id, row_number() OVER (ORDER BY image_id) AS iid FROM (SELECT DISTINCT image_id FROM an) d)
 SELECT row_number() OVER (ORDER BY an.image_id, idx) AS id, iid AS image_id, CAST(cls+1 AS BIGINT) AS category_id, x1 AS x, y1 AS y, x2-x1 AS w, y2-y1 AS h, (x2-x1)*(y2-y1) AS area FROM an JOIN im USING (image_id)""")
def coco_annotations(spark, sf_dir):
    notes = formats.coco_tables(_annotations(spark, sf_dir), _names(spark), 1)[1]
    return _longs(notes.select("id", "image_id", "category_id", *(F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")), "area"))


@query("SELECT CAST(cls+1 AS BIGINT) AS id, name, '' AS supercategory FROM (VALUES (0,'car'),(1,'person'),(2,'bike'),(3,'bus'),(4,'dog')) v(cls,name)")
def coco_categories(spark, sf_dir):
    return formats.coco_tables(_annotations(spark, sf_dir), _names(spark), 1)[2]


@query(VIEWS + """, cl AS (SELECT * FROM (VALUES (0,'car'),(1,'person'),(2,'bike'),(3,'bus'),(4,'dog')) v(cls,label))
 SELECT 'p' || image_id AS image_id, label, count(*) AS n, CAST(sum(x1+y1+x2+y2) AS BIGINT) AS edges, round(sum(conf),5) AS conf FROM pr JOIN cl USING (cls) WHERE x2 > x1 AND y2 > y1 GROUP BY ALL""")
def detection_labelme(spark, sf_dir):
    """Detections written as LabelMe documents and read again."""
    _, pr = boxes(spark, sf_dir)
    pr = pr.withColumn("image_id", F.concat(F.lit("p"), "image_id"))
    sizes = pr.select("image_id", F.lit(W).alias("width"), F.lit(H).alias("height")).distinct()
    files = formats.to_labelme(dataset.detection_annotations(pr, _names(spark).withColumnRenamed("cls_id", "cls"), sizes))
    rows = formats.match_records(formats.from_labelme(files.select(F.concat(F.lit("/l/"), "image_id", F.lit(".json")).alias("path"), "value")))
    return rows.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.sum((F.col("x1") + F.col("y1") + F.col("x2") + F.col("y2")).cast("long")).alias("edges"), F.round(F.sum("conf"), 5).alias("conf"))


@query(_CANON + """ SELECT '/d/' || CASE WHEN right(image_id, 1) < '5' THEN 'train' ELSE 'val' END || '/labels/' || image_id || '.txt' AS path, count(*) FILTER (WHERE cls IN (3,1)) AS n, coalesce(CAST(sum(CASE cls WHEN 1 THEN 1 WHEN 3 THEN 0 END) AS BIGINT), 0) AS sum_cls
 FROM an WHERE right(image_id, 1) <> '7' GROUP BY image_id""")
def yolo_subset(spark, sf_dir):
    """Two classes of label files in two subsets; images whose number ends in 7 are missing."""
    labels = formats.to_yolo(_annotations(spark, sf_dir), _names(spark))
    place = lambda folder, end: F.concat(F.lit("/d/"), F.when(F.substr("image_id", F.lit(-1)) < "5", "train").otherwise("val"), F.lit(f"/{folder}/"), "image_id", F.lit(end))
    files = labels.select(place("labels", ".txt").alias("path"), "value")
    pictures = labels.where("image_id NOT LIKE '%7'").select(place("images", ".png").alias("path"))
    rows = formats.yolo_subset(files, [3, 1], pictures)
    lines = F.filter(F.split("value", "\n"), lambda x: x != "")
    return rows.select("path", F.size(lines).cast("long").alias("n"), F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.get(F.split(x, " "), F.lit(0)).cast("long")).alias("sum_cls"))


_FILES = """WITH p AS (SELECT o_orderkey % 4 AS d, 'o' || (o_orderkey % 5000) AS stem, '/p/' || (o_orderkey % 4) || '/' || o_orderpriority || '/o' || (o_orderkey % 5000) || '.json' AS path FROM orders),
 g AS (SELECT c_custkey % 3 AS d, 'o' || c_custkey AS stem, '/g/' || (c_custkey % 3) || '/' || c_mktsegment || '/o' || c_custkey || '.xml' AS path FROM customer)"""


def _files(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.concat(F.lit("/p/"), F.col("o_orderkey") % 4, F.lit("/"), "o_orderpriority", F.lit("/o"), F.col("o_orderkey") % 5000, F.lit(".json")).alias("path"))
    g = table(spark, sf_dir, "customer").select(F.concat(F.lit("/g/"), F.col("c_custkey") % 3, F.lit("/"), "c_mktsegment", F.lit("/o"), "c_custkey", F.lit(".xml")).alias("path"))
    return images.located(p.distinct(), [f"/p/{i}" for i in range(4)]), images.located(g.distinct(), [f"/g/{i}" for i in range(3)])


@query(_FILES + " SELECT CAST(p.d AS BIGINT) AS ds, p.stem, p.path, min(g.path) AS partner FROM (SELECT DISTINCT * FROM p) p LEFT JOIN g ON g.d = p.d AND g.stem = p.stem GROUP BY p.d, p.stem, p.path")
def paired_files(spark, sf_dir):
    return images.paired_files(*_files(spark, sf_dir)).withColumn("ds", F.col("ds").cast("long"))


@query(_FILES + " SELECT CAST(p.d AS BIGINT) AS ds, p.stem, p.path, min(g.path) AS partner FROM (SELECT DISTINCT * FROM p) p LEFT JOIN g ON g.d = p.d AND g.stem = p.stem WHERE p.d < 3 GROUP BY p.d, p.stem, p.path")
def paired_files_of_shared_sets(spark, sf_dir):
    return images.paired_files(*_files(spark, sf_dir), shared_sets=True).withColumn("ds", F.col("ds").cast("long"))


@query("WITH f AS (SELECT '/d/images/' || c_mktsegment || '/' || c_custkey || '.jpg' AS path, c_mktsegment AS split FROM customer) SELECT split, count(*) AS n, min(path) AS first, max(path) AS last FROM f GROUP BY split")
def files_by_split(spark, sf_dir):
    return images.gathered(table(spark, sf_dir, "customer").select(F.concat(F.lit("/d/images/"), "c_mktsegment", F.lit("/"), "c_custkey", F.lit(".jpg")).alias("path")))


# --- text functions and pipelines ------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(event_id % 7 AS DOUBLE) AS first, CAST(user_id AS DOUBLE) AS second, CAST(2 AS BIGINT) AS n FROM events")
def str2list(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x ["), F.col("event_id") % 7, F.lit(" "), "user_id", F.lit("]"))).otherwise(F.concat(F.lit("("), F.col("event_id") % 7, F.lit(" "), "user_id", F.lit(") y")))
    found = e.select("event_id", X.str2list(F.regexp_replace(made, r"^x | y$", ""), " ").alias("v"))
    return found.select("event_id", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"), F.size("v").cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.props_value(F.col("props"), "k", "bigint").alias("k"))


@query("SELECT page_id, url LIKE '%_://_%' AS valid, false AS bare_valid FROM pages")
def url_valid(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.is_url(F.col("url")).alias("valid"), X.is_url(F.regexp_replace("url", "^[a-z]+://", "")).alias("bare_valid"))


@query("SELECT p_partkey, (p_size*10000 + (p_partkey%20)*100 + p_partkey%7) >= 201000 AND (p_size*10000 + (p_partkey%20)*100 + p_partkey%7) < 400000 AS ok FROM part")
def version_check(spark, sf_dir):
    version = F.concat_ws(".", F.col("p_size"), F.col("p_partkey") % 20, F.col("p_partkey") % 7)
    return table(spark, sf_dir, "part").select("p_partkey", X.check_version(version, ">=20.10.0,<40.0.0").alias("ok"))


@query(PAIRED + " SELECT image_id, gt_idx, count(*) AS n, CAST(sum(floor(CAST(inter AS DOUBLE)/ga*1000000)) AS BIGINT) AS ios FROM j WHERE CAST(inter AS DOUBLE)/ga > 0.5 GROUP BY image_id, gt_idx")
def pipeline_ios(spark, sf_dir):
    plan = Pipeline({"overlap": "IosOperator", "near": "FilterOperator"}, {"near": {"column": "ios", "threshold": 0.5}})
    return _by_box(plan.run(_joined(spark, sf_dir)).select("image_id", "gt_idx", _millionths(F.col("ios")).alias("ios")), "ios")


@DETECTORS.register("twice_a_window")
def _twice_a_window(batches):
    """Stands for a model: two equal boxes of unlike confidence in each window, by its place."""
    import pandas as pd

    for b in batches:
        both = []
        for k in (0, 1):
            both.append(pd.DataFrame({"image_id": b.image_id, "wx": b.x1, "wy": b.y1, "cls": (b.x1 + b.y1 + b.image_id) % 3, "conf": ((b.image_id * 7 + b.x1 * 13 + b.y1 * 17 + b.x2 + k * 41) % 1000) / 1000.0, "x1": 5.0, "y1": 3.0, "x2": 5.0 + (b.x2 - b.x1), "y2": 3.0 + (b.y2 - b.y1)}))
        yield pd.concat(both)


_PLAN = {
    "tasks": {"slice": "SliceOperator", "detect": "DetectOperator", "merge": "MergeOperator"},
    "operators": {
        "slice": {"slicers": ["sliding", "halves"], "settings": {"sliding": {"window": 640, "overlap": 0.2}}},
        "detect": {"detector": "twice_a_window", "thresholds": [0.2, 0.1, 0.3], "classes": [0, 1, 2]},
        "merge": {"mergers": ["greedy"], "settings": {"greedy": {"mode": "iou", "threshold": 1.0, "highest_first": True}}},
    },
}


@query(_SLIDES + """, w AS (SELECT image_id, xs.a AS x1, ys.a AS y1, xs.b AS x2, ys.b AS y2 FROM xs JOIN ys USING (image_id)
  UNION SELECT image_id, 0, 0, CASE WHEN width>=height THEN width//2 ELSE width END, CASE WHEN width>=height THEN height ELSE height//2 END FROM im
  UNION SELECT image_id, CASE WHEN width>=height THEN width//2 ELSE 0 END, CASE WHEN width>=height THEN 0 ELSE height//2 END, width, height FROM im
  UNION SELECT image_id, 0, 0, width, height FROM im),
 d AS (SELECT image_id, (x1+y1+image_id)%3 AS cls, ((image_id*7+x1*13+y1*17+x2+k.range*41)%1000)/1000.0 AS conf, x1+5 AS x1, y1+3 AS y1, x2+5 AS x2, y2+3 AS y2 FROM w CROSS JOIN range(2) k),
 f AS (SELECT * FROM d WHERE conf >= [0.2,0.1,0.3][cls+1])
 SELECT image_id, cls, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2, count(*) AS n_merged, CAST(round(max(conf)*1000) AS BIGINT) AS conf FROM f GROUP BY image_id, cls, x1, y1, x2, y2""")
def slice_detect_merge(spark, sf_dir):
    """One plan from images to merged objects."""
    rows = Pipeline(_PLAN["tasks"], _PLAN["operators"]).run(_images(spark, sf_dir).where("width > 0 AND height > 0"))
    return rows.select("image_id", "cls", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")), "n_merged", F.round(F.col("conf") * 1000).cast("long").alias("conf"))


@query(VIEWS + " SELECT image_id, gt_idx, x1//8 AS x1, y1//8 AS y1, x2//8 AS x2, y2//8 AS y2, CAST(4 AS BIGINT) AS corners FROM gt")
def coco_masks(spark, sf_dir):
    """Boxes as run-length masks in images of an eighth, back to polygons: a filled rectangle has its four corner pixels."""
    high = 700 // 8 + 1
    eighth = {c: F.floor(F.col(c) / 8) for c in ("x1", "y1", "x2", "y2")}
    rows = boxes(spark, sf_dir)[0].select("image_id", "gt_idx", *(v.alias(c) for c, v in eighth.items()))
    inside = F.col("y2") - F.col("y1") + 1
    runs = F.concat(F.array(F.col("x1") * high + F.col("y1"), inside), F.flatten(F.transform(F.sequence(F.col("x1") + 1, F.col("x2")), lambda _: F.array(high - inside, inside))))
    text = F.to_json(F.struct(F.array(F.lit(high), F.lit(W)).alias("size"), runs.alias("counts")))
    polygon = F.get(formats.segmentation_polygons(F.col("text")), F.lit(0))
    # generators keep the text and the polygon as columns, else each use would write the text anew
    found = rows.select("image_id", "gt_idx", F.inline(F.array(F.struct(text.alias("text"))))).select("image_id", "gt_idx", F.inline(F.array(F.struct(polygon.alias("p")))))
    return _longs(found.select("image_id", "gt_idx", *B.polygon_bbox(F.col("p")).fields(), F.size("p").alias("corners")))


@query(_CANON + " SELECT image_id AS file, label, count(*) AS n FROM an GROUP BY image_id, label")
def file_histogram(spark, sf_dir):
    return dataset.file_histogram(_annotations(spark, sf_dir))


@query(VIEWS + " SELECT image_id, gt_idx, (x1+x2)/2.0 AS x, (y1+y2)/2.0 AS y FROM gt")
def box_centers(spark, sf_dir):
    x, y = B.centers(B.box())
    return boxes(spark, sf_dir)[0].select("image_id", "gt_idx", x.cast("double").alias("x"), y.cast("double").alias("y"))


@query(ORACLE_SQL["recall_precision_report"].replace("(1,'person'),", "").replace("WHERE kind='P' AND gt=5)", "WHERE kind='P' AND gt=5 AND pred<>1)"))
def report_without_a_class(spark, sf_dir):
    """A hidden class has no row and makes no ghosts; what it misses still counts in the background."""
    classes = spark.createDataFrame(sorted(_CLASS_NAMES.items()), "cls long, name string")
    rows = confusion.report(confusion_counts(spark, sf_dir), classes, background=5, hidden=(1,))
    return rows.select("name", "gt_num", "pred_num", _r(F.col("recall")).alias("recall"), _r(F.col("precision")).alias("precision"))


@query(_IMAGES + " SELECT image_id, CAST(CASE WHEN image_id%3>0 THEN width WHEN image_id%5>0 THEN height ELSE 1 END AS BIGINT) AS width, CAST(CASE WHEN image_id%3>0 THEN height WHEN image_id%5>0 THEN width ELSE 1 END AS BIGINT) AS height FROM im")
def image_shapes(spark, sf_dir):
    """Sizes from a first source that lacks every third image, else from one that has the sides swapped and lacks every fifth, else 1."""
    im = _images(spark, sf_dir)
    known = lambda n, w, h: im.select("image_id", F.when(F.col("image_id") % n > 0, F.col(w)).otherwise(0).alias("width"), F.col(h).alias("height"))
    return _longs(formats.image_sizes(known(3, "width", "height"), known(5, "height", "width")))


def _files_of(kind: str, notes: DataFrame, spark) -> DataFrame:
    """Annotations as label files (path, value) of a format; COCO as one document an image."""
    named = lambda df, end: df.select(F.concat(F.lit("/l/"), "image_id", F.lit(end)).alias("path"), "value")
    if kind == "labelme":
        return named(formats.to_labelme(notes), ".json")
    if kind == "voc":
        return named(formats.to_voc(notes), ".xml")
    if kind == "yolo":
        return named(formats.to_yolo(notes, _names(spark)), ".txt")
    images_, annotations, categories = formats.coco_tables(notes, _names(spark), 1)
    listed = categories.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("categories"))
    own = annotations.select(F.col("image_id").alias("iid"), F.struct("id", "image_id", "category_id", F.col("bbox").cast("array<double>").alias("bbox")).alias("a")).groupBy("iid").agg(F.array_sort(F.collect_list("a")).alias("annotations"))
    docs = images_.join(own, images_["id"] == F.col("iid")).join(F.broadcast(listed))
    return docs.select(F.concat(F.lit("/annotations/"), "file_name", F.lit(".json")).alias("path"), F.to_json(F.struct(F.array(F.struct("id", "file_name", "height", "width")).alias("images"), "annotations", "categories")).alias("value"))


def _read_back(kind: str, files: DataFrame, sizes: DataFrame, spark) -> DataFrame:
    read = {"labelme": formats.from_labelme, "voc": formats.from_voc, "coco": lambda f: formats.from_coco(f, masks=False), "yolo": lambda f: formats.from_yolo(f, _names(spark), sizes)}[kind]
    rows = read(files)
    # only shares of the image are not what was written
    return rows.withColumn("points", F.transform("points", lambda p: F.array(F.round(p[0], 3), F.round(p[1], 3)))) if kind == "yolo" else rows


def _conversions(source: str):
    """The query that turns label files of one format into each other one and reads those again."""
    targets = [k for k in ("coco", "labelme", "voc", "yolo") if k != source]
    sql = f"{_CANON} SELECT target, label, count(*) AS n, CAST(sum(x1+y1+x2+y2) AS BIGINT) AS edges FROM an, (SELECT unnest({targets}) AS target) t GROUP BY target, label"

    def run(spark, sf_dir):
        notes = _annotations(spark, sf_dir)
        sizes = notes.select("image_id", "width", "height").distinct()
        # read once, and grouped once for all targets
        first = stored(formats.by_image(_read_back(source, _files_of(source, notes, spark), sizes, spark)))
        parts = []
        for target in targets:
            given = formats.annotations_of(first) if target == "coco" else first
            rows = formats.match_records(_read_back(target, _files_of(target, given, spark), sizes, spark))
            parts.append(rows.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("x1") + F.col("y1") + F.col("x2") + F.col("y2")).cast("long")).alias("edges")).withColumn("target", F.lit(target)))
        return dataset.union_all(parts)

    run.__name__ = f"convert_{source}"
    return query(sql)(run)


for _source in ("labelme", "voc", "yolo", "coco"):
    _conversions(_source)
