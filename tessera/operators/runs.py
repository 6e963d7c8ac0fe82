"""Work lists, shards and run records as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_first(df: DataFrame, size: str, key: str, workers: int) -> DataFrame:
    """Adds the worker of each row: largest first, dealt in turn."""
    place = F.row_number().over(Window.orderBy(F.col(size).desc(), F.col(key)))
    return df.withColumn("worker", ((place - 1) % workers).cast("int"))


def sharded(df: DataFrame, order: str, shard: int, shards: int, limit: int | None = None) -> DataFrame:
    """Every ``shards``-th row from ``shard`` on, in order; then the first ``limit`` of these."""
    place = F.row_number().over(Window.orderBy(order)) - 1
    out = df.withColumn("_at", place).where(F.col("_at") % shards == shard)
    if limit:
        out = out.where(F.col("_at") < F.lit(shard + shards * limit))
    return out.drop("_at")


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def pick(df: DataFrame, column: str, part: str, order: str) -> DataFrame:
    """The first row whose text contains ``part`` in any case."""
    return df.where(F.lower(column).contains(part.lower())).orderBy(order).limit(1)


def default_resolution(catalogue: DataFrame) -> DataFrame:
    """site_key and its first resolution, null where there is none."""
    return catalogue.select("site_key", F.get("resolutions", 0).alias("resolution"))


def resolved(wanted: DataFrame, catalogue: DataFrame, rasters: DataFrame) -> DataFrame:
    """raster path and status of every wanted (site_key, resolution or null).

    catalogue: site_key, resolutions; rasters: site_key, resolution, rgb_path. A null resolution takes the site's first
    one in the catalogue, else its smallest by name."""
    first = rasters.groupBy("site_key").agg(F.min("resolution").alias("_any"))
    w = wanted.join(first, "site_key", "left").join(default_resolution(catalogue).withColumnRenamed("resolution", "_first"), "site_key", "left")
    w = w.withColumn("resolution", F.coalesce("resolution", "_first", "_any"))
    out = w.join(rasters.withColumn("_there", F.lit(True)), ["site_key", "resolution"], "left")
    empty = F.coalesce(F.col("rgb_path"), F.lit("")) == ""
    status = F.when(F.col("_any").isNull(), "unknown site").when(F.col("_there").isNull(), "no such resolution").when(empty, "no path").otherwise("ok")
    return out.select("site_key", "resolution", "rgb_path", status.alias("status"))


def run_record(spark, settings: dict, sites: list[str]) -> DataFrame:
    """One row for a run: settings as a map, the sites, and when it began."""
    row = spark.createDataFrame([({str(k): str(v) for k, v in settings.items()}, sites)], "settings map<string,string>, sites array<string>")
    return row.withColumn("n_sites", F.size("sites")).withColumn("started_at", F.current_timestamp())


def outcome(error: Column, exists: Column) -> Column:
    """ok, skipped (already there), skip (nothing to run on) or fail."""
    missing = F.lower(error).rlike("not found|no such|unknown site|no path")
    return F.when(error.isNull() & exists, "skipped").when(error.isNull(), "ok").when(missing, "skip").otherwise("fail")


def grid_or_predicted(blobs: DataFrame, measured: DataFrame, key: str = "uuid") -> DataFrame:
    """Patch grid of each blob: as measured where there is an embedding, else predicted from its size in patches."""
    m = measured.select(key, F.col("grid_h").alias("_h"), F.col("grid_w").alias("_w"))
    ratio = F.col("embed_gsd") / F.col("native_res")
    out = blobs.join(m, key, "left")
    out = out.withColumn("grid_h", F.coalesce("_h", F.bround(F.col("height") / ratio).cast("int"))).withColumn("grid_w", F.coalesce("_w", F.bround(F.col("width") / ratio).cast("int")))
    return out.withColumn("grid_source", F.when(F.col("_h").isNotNull(), "measured").otherwise("predicted")).drop("_h", "_w")
