"""Boxes derived from ``lineitem``: ten consecutive orders are an image, a row is an object, some are detected wrongly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _base(lineitem: DataFrame) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    image = F.floor(F.col("l_orderkey") / 10).cast("long")
    rows = lineitem.select(image.alias("image_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"), cents("l_extendedprice").alias("ep"), cents("l_discount").alias("dc"), cents("l_tax").alias("tx"))
    within = Window.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.withColumn("idx", (F.row_number().over(within) - 1).cast("long"))


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ground truth, predictions): image_id, gt_idx or pred_idx, cls, x1, y1, x2, y2, and difficult or conf."""
    base = _base(table(spark, sf_dir, "lineitem"))
    x, y = (F.col("l_partkey") * 37) % 600, (F.col("l_suppkey") * 53) % 400
    right, low = x + 40 + F.col("q") * 3, y + 40 + F.col("q") * 2
    shift = F.when(F.col("tx") == 7, 300).otherwise(F.col("dc"))
    gt = base.select("image_id", F.col("idx").alias("gt_idx"), (F.col("l_partkey") % 5).alias("cls"), x.alias("x1"), y.alias("y1"), right.alias("x2"), low.alias("y2"), (F.col("dc") == 0).alias("difficult"))
    cls = F.when(F.col("tx") == 8, (F.col("l_partkey") + 1) % 5).otherwise(F.col("l_partkey") % 5)
    pr = base.where("tx <> 5").select("image_id", F.col("idx").alias("pred_idx"), cls.alias("cls"), (x + shift).alias("x1"), (y + F.col("tx")).alias("y1"), (right + shift).alias("x2"), (low - F.col("tx")).alias("y2"), ((F.col("ep") % 1000) / 1000.0).alias("conf"))
    return gt, pr


#: The same two views as SQL.
BOXES_SQL = """base AS (
 SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS image_id, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
  CAST(round(l_extendedprice*100) AS BIGINT) AS ep, CAST(round(l_discount*100) AS BIGINT) AS dc, CAST(round(l_tax*100) AS BIGINT) AS tx,
  row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 10) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx
 FROM lineitem),
gt AS (SELECT image_id, idx AS gt_idx, l_partkey % 5 AS cls, (l_partkey*37) % 600 AS x1, (l_suppkey*53) % 400 AS y1,
  (l_partkey*37) % 600 + 40 + q*3 AS x2, (l_suppkey*53) % 400 + 40 + q*2 AS y2, (dc = 0) AS difficult FROM base),
pr AS (SELECT image_id, idx AS pred_idx, CASE WHEN tx = 8 THEN (l_partkey+1) % 5 ELSE l_partkey % 5 END AS cls,
  (l_partkey*37) % 600 + CASE WHEN tx = 7 THEN 300 ELSE dc END AS x1, (l_suppkey*53) % 400 + tx AS y1,
  (l_partkey*37) % 600 + 40 + q*3 + CASE WHEN tx = 7 THEN 300 ELSE dc END AS x2, (l_suppkey*53) % 400 + 40 + q*2 - tx AS y2,
  CAST((ep % 1000) / 1000.0 AS DOUBLE) AS conf FROM base WHERE tx <> 5)"""
