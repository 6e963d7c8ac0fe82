"""The reference's tables as views over the driver's: for each a DataFrame and the SQL that makes the same rows.

tiles: orders with their customers (site = nation, resolution = segment); masks: line items as pixels; boxes: from two
dimensions of the embeddings; patches: embeddings as cells of a grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = (2, 3, 4, 5, 6, 40, 301, 7, 5007, 9003, 0, 15, 255, 303)
TILE_PIXELS = 147456


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TILES = f"""tiles AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS tile_id, CAST(c_nationkey AS VARCHAR) AS site, c_mktsegment AS resolution,
    o_orderstatus AS dataset_version, CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split,
    CAST({TILE_PIXELS} AS BIGINT) AS total_pixels, CAST((o_orderkey * 7919 % 1000) * 147 AS BIGINT) AS pixels_no_data,
    CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000 AS no_data_frac,
    '/' || c_nationkey || '/' || (CASE WHEN o_orderkey % 3 = 0 THEN 'image_' ELSE 'mask_' END) || o_orderkey || '.npz' AS mask_path,
    '/' || c_nationkey || '/image_' || (o_orderkey // 3) || '.npz' AS image_path, o_orderkey % 7 <> 0 AS image_exists,
    CAST(o_orderkey // 3 * 10 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS content,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS original_class_id, o_orderkey, o_orderdate, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    t = o.join(c, o["o_custkey"] == c["c_custkey"])
    k = F.col("o_orderkey")
    nation = F.col("c_nationkey").cast("string")
    return t.select(
        k.cast("string").alias("tile_id"),
        nation.alias("site"),
        F.col("c_mktsegment").alias("resolution"),
        F.col("o_orderstatus").alias("dataset_version"),
        F.when(k % 10 < 8, "train").otherwise("val").alias("split"),
        F.lit(TILE_PIXELS).cast("long").alias("total_pixels"),
        ((k * 7919 % 1000) * 147).alias("pixels_no_data"),
        ((k * 7919 % 1000).cast("double") / 1000).alias("no_data_frac"),
        F.concat(F.lit("/"), nation, F.when(k % 3 == 0, "/image_").otherwise("/mask_"), k.cast("string"), F.lit(".npz")).alias("mask_path"),
        F.concat(F.lit("/"), nation, F.lit("/image_"), F.expr("o_orderkey div 3").cast("string"), F.lit(".npz")).alias("image_path"),
        (k % 7 != 0).alias("image_exists"),
        (F.expr("o_orderkey div 3") * 10 + F.when(k % 5 == 0, 1).otherwise(0)).alias("content"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("original_class_id"),
        "o_orderkey",
        "o_orderdate",
        "o_totalprice",
    )


MASKS = f"""masks AS (
  SELECT CAST(l_suppkey % 40 AS INTEGER) AS tile, CAST(l_partkey % 32 AS INTEGER) AS row, CAST(l_orderkey % 32 AS INTEGER) AS col,
    max(CASE WHEN l_partkey % 997 = 0 AND l_suppkey % 40 < 4 THEN 141 ELSE {list(CODES)}[1 + CAST(l_quantity AS INTEGER) % {len(CODES)}] END) AS class
  FROM lineitem GROUP BY 1, 2, 3)"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), F.col("l_quantity").cast("int") % len(CODES) + 1)
    pixel = F.when((F.col("l_partkey") % 997 == 0) & (F.col("l_suppkey") % 40 < 4), 141).otherwise(code)
    at = [(F.col(c) % m).cast("int").alias(n) for c, m, n in (("l_suppkey", 40, "tile"), ("l_partkey", 32, "row"), ("l_orderkey", 32, "col"))]
    return read(spark, sf_dir, "lineitem").select(*at, pixel.alias("class")).groupBy("tile", "row", "col").agg(F.max("class").alias("class"))


BOXES = """boxes AS (
  SELECT vec_id, label, x - w AS xmin, y - h AS ymin, x + w AS xmax, y + h AS ymax FROM (
    SELECT vec_id, label, CAST(floor(CAST(embedding[1] AS DOUBLE) * 400) AS DOUBLE) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE) * 400) AS DOUBLE) AS y,
      CAST(1 + vec_id % 5 AS DOUBLE) AS w, CAST(1 + vec_id % 7 AS DOUBLE) AS h FROM embeddings))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    place = lambda i: F.floor(F.get("embedding", i).cast("double") * 400).cast("double")
    e = e.select("vec_id", "label", place(0).alias("x"), place(1).alias("y"), (F.col("vec_id") % 5 + 1).cast("double").alias("w"), (F.col("vec_id") % 7 + 1).cast("double").alias("h"))
    return e.select("vec_id", "label", (F.col("x") - F.col("w")).alias("xmin"), (F.col("y") - F.col("h")).alias("ymin"), (F.col("x") + F.col("w")).alias("xmax"), (F.col("y") + F.col("h")).alias("ymax"))


PIXELS = """pixels AS (
  SELECT CAST(l_partkey % 40 AS INTEGER) AS row, CAST(l_suppkey % 40 AS INTEGER) AS col, CAST(l_quantity AS DOUBLE) AS value, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem)"""
#: a total order of line items
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [(F.col(c) % 40).cast("int").alias(n) for c, n in (("l_partkey", "row"), ("l_suppkey", "col"))]
    return read(spark, sf_dir, "lineitem").select(*at, F.col("l_quantity").cast("double").alias("value"), *ORDER)


RGB = """rgb AS (
  SELECT CAST(l_suppkey % 20 AS BIGINT) AS cell_id, CAST(l_partkey % 16 AS INTEGER) AS row, CAST(l_orderkey % 16 AS INTEGER) AS col,
    max(CASE WHEN l_quantity < 25 THEN 0 ELSE CAST(l_quantity AS INTEGER) END) AS r, max(CASE WHEN l_returnflag = 'R' THEN 9 ELSE 0 END) AS g, 0 AS b
  FROM lineitem GROUP BY 1, 2, 3)"""


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 20).alias("cell_id"), (F.col("l_partkey") % 16).cast("int").alias("row"), (F.col("l_orderkey") % 16).cast("int").alias("col")).agg(
        F.max(F.when(F.col("l_quantity") < 25, 0).otherwise(F.col("l_quantity").cast("int"))).alias("r"), F.max(F.when(F.col("l_returnflag") == "R", 9).otherwise(0)).alias("g"), F.lit(0).alias("b")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")
