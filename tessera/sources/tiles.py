"""Tiles on disk: listings, header reads of .npz archives, pairing of masks and images, catalogues."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as fp


def listing(spark: SparkSession, root: str, pattern: str = "*.npz") -> DataFrame:
    """path, modificationTime and length of the files below a root. Contents are not read: the column is pruned."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "modificationTime", "length")


def images(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff", "npz")) -> DataFrame:
    """Files with any of the extensions, in any case."""
    found = listing(spark, root, "*")
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).orderBy("path")


def member_shape(archive: zipfile.ZipFile, name: str) -> tuple[int, ...]:
    """Shape of an array from its header; the data are not unpacked."""
    with archive.open(f"{name}.npy") as f:
        version = npy.read_magic(f)
        return (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(f)[0]


def member_array(archive: zipfile.ZipFile, name: str) -> np.ndarray:
    with archive.open(f"{name}.npy") as f:
        return npy.read_array(f, allow_pickle=False)


def _boxes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for path, content in pdf[["path", "content"]].itertuples(index=False):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    h, w = member_shape(z, "RED")[:2]
                    gt = member_array(z, "GEO_TRANSFORM").astype(float)
                    srid = int(member_array(z, "SRID").ravel()[0])
                rows.append((path, int(w), int(h), gt[2], gt[5] + h * gt[4], gt[2] + w * gt[0], gt[5], srid, gt.tolist(), None))
            except (zipfile.BadZipFile, KeyError, ValueError, IndexError) as e:
                rows.append((path, *[None] * 8, f"{type(e).__name__}: {e}"))
        out = pd.DataFrame(rows, columns=["path", "w", "h", "xmin", "ymin", "xmax", "ymax", "srid", "affine", "error"])
        yield out.astype({c: "Int32" for c in ("w", "h", "srid")} | {c: "float64" for c in ("xmin", "ymin", "xmax", "ymax")})


def tile_boxes(spark: SparkSession, site_dir: str, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """One row for each tile below ``site_dir/<split>``: tile, split, path, size, world box, srid, affine; of an archive that
    can't be read path and ``error`` only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load([f"{site_dir}/{s}" for s in splits])
    out = files.select("path", "content").mapInPandas(_boxes, "path string, w int, h int, xmin double, ymin double, xmax double, ymax double, srid int, affine array<double>, error string")
    return out.withColumn("tile", F.regexp_extract("path", r"([^/]+)\.npz$", 1)).withColumn("split", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))


def _pixels(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for path, content in pdf[["path", "content"]].itertuples(index=False):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    a = member_array(z, "CLASSIFY") if "CLASSIFY.npy" in z.namelist() else None
            except (zipfile.BadZipFile, ValueError):
                a = None
            if a is None or a.ndim != 2:
                yield pd.DataFrame({"path": [path], "row": [None], "col": [None], "class": [None]}).astype({"row": "Int32", "col": "Int32", "class": "Int32"})
                continue
            r, c = np.indices(a.shape)
            yield pd.DataFrame({"path": path, "row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), "class": a.ravel().astype(np.int32)})


def mask_pixels(spark: SparkSession, root: str) -> DataFrame:
    """(path, row, col, class) of every mask below a root. A file that can't be read gives one row of nulls, so that it is
    recorded and not scanned again."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(root)
    return files.where(F.col("path").rlike("/(train|val)annot/")).select("path", "content").mapInPandas(_pixels, "path string, row int, col int, class int")


def discovered(files: DataFrame, path: str = "path") -> DataFrame:
    """site, resolution, dataset_version, split, name and mask_path of mask files named by path below a root."""
    parts = fp.tile_parts(F.col(path))
    return files.select(*[c.alias(n) for n, c in parts.items()], F.col(path).alias("mask_path")).where("split <> ''")


def paired(masks: DataFrame, found: DataFrame) -> DataFrame:
    """Adds image_path and image_exists: the image of the same name, else the one with ``image_`` for ``mask_``, else the
    name that isn't there.

    masks: image_dir, name; found: image_path of the images there are."""
    same = F.concat_ws("/", "image_dir", "name")
    other = F.when(F.col("name").startswith("mask_"), F.concat(F.col("image_dir"), F.lit("/image_"), F.expr("substring(name, 6)")))
    images = found.select("image_path").distinct()
    out = masks.withColumn("_same", same).withColumn("_other", other)
    out = out.join(images.select(F.col("image_path").alias("_a")), F.col("_same") == F.col("_a"), "left").join(images.select(F.col("image_path").alias("_b")), F.col("_other") == F.col("_b"), "left")
    return out.withColumn("image_exists", F.col("_a").isNotNull() | F.col("_b").isNotNull()).withColumn("image_path", F.coalesce("_a", "_b", "_same")).drop("_same", "_other", "_a", "_b")


def blobs(tiles: DataFrame, name: str = "name", images_only: bool = False) -> DataFrame:
    """Tiles (name, w, h, affine, srid) -> one row for each blob: tiles, width, height, affine and srid of its first.
    ``images_only`` is the older form of names, ``image_<uuid>_<col>_<row>``: others are left out."""
    parts = fp.image_tile(F.col(name)) if images_only else fp.blob_tile(F.col(name))
    t = tiles.withColumns(parts).where(F.col("col").isNotNull())
    return t.groupBy("uuid").agg(F.max(F.col("col") + F.col("w")).alias("width"), F.max(F.col("row") + F.col("h")).alias("height"), F.count("*").alias("n_tiles"), F.min_by("affine", name).alias("affine"), F.min_by("srid", name).alias("srid"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """{site_key: {resolutions: [...]}} as rows site_key, resolutions, ord (place in the file)."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,struct<resolutions:array<string>>>")
    return text.select(F.posexplode(F.map_entries(parsed)).alias("ord", "e")).select(F.col("e.key").alias("site_key"), F.col("e.value.resolutions").alias("resolutions"), "ord")


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


