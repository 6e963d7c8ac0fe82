"""The vector store: patch rows and cell manifests as Parquet, partitioned by site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as fp


def write_manifest(cells: DataFrame, path: str) -> None:
    """Cells by site; only the sites in ``cells`` are replaced."""
    cells.repartition("site_id").sortWithinPartitions("site_id", "cell_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site_id").parquet(path)


def write_sites(rows: DataFrame, path: str) -> None:
    """Any table by site; only the sites in ``rows`` are replaced."""
    rows.repartition("site_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site_id").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_patches(patches: DataFrame, path: str, files_per_site: int = 8) -> None:
    """Patch rows (site_id, cell_id, pr, pc, vec), zstd, sorted by cell so that row groups hold ranges of cells. A site is
    spread over several files by cell, so that a large one is not written by one task."""
    spread = patches.withColumn("_f", F.pmod(F.xxhash64("cell_id"), F.lit(files_per_site)))
    spread.repartition("site_id", "_f").drop("_f").sortWithinPartitions("site_id", "cell_id", "pr", "pc").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("site_id").parquet(path)


def read_cell(spark: SparkSession, path: str, site_id: str, cell_id: int) -> DataFrame:
    """One cell's patches: the site prunes partitions, the cell is pushed to the scan."""
    return spark.read.parquet(path).where((F.col("site_id") == site_id) & (F.col("cell_id") == cell_id))


def grid_shape(patches: DataFrame) -> DataFrame:
    """Rows and columns of every cell's patch grid, and the vector length; no vector is read but its size."""
    return patches.groupBy("site_id", "cell_id").agg((F.max("pr") + 1).alias("gh"), (F.max("pc") + 1).alias("gw"), F.max(F.size("vec")).alias("channels"))


def written_cells(patches: DataFrame) -> DataFrame:
    return patches.select("site_id", "cell_id").distinct()


def with_ref(cells: DataFrame, store: str, target: str = "patch_ref") -> DataFrame:
    """``<store>/<site>#<cell>``, as text for other tools."""
    return cells.withColumn(target, fp.make_ref(F.concat(F.lit(store.rstrip("/") + "/"), F.col("site_id")), F.col("cell_id")))


def joined(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cells with their vectors by key, never by position."""
    return cells.join(vectors, ["site_id", "cell_id"])


def replace_table(df: DataFrame, path: str) -> str:
    """Writes a new version beside the old one and points to it; returns its folder. A table can't be overwritten while
    it is read, and readers of the old version go on."""
    spark = df.sparkSession
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    version = 1 + max([int(v[2:]) for v in versions if v.startswith("v=") and v[2:].isdigit()], default=0)
    to = f"{path}/v={version}"
    df.write.mode("errorifexists").parquet(to)
    return to


def latest_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that was written whole."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/v={max(done)}")


def as_geojson(boxes: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature of every box, as text."""
    ring = F.array(*[F.array(F.col(a), F.col(b)) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return boxes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("feature"))
