"""Names and references as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def site_id(path: Column) -> Column:
    """Runs of anything but letters and digits become one underscore; none at the ends."""
    return F.trim(F.regexp_replace(path, "[^0-9A-Za-z]+", "_"), F.lit("_"))


def site_id_from_key(key: Column, resolution: Column, version: Column) -> Column:
    return site_id(F.concat_ws("/", key, resolution, version))


def site_key(relative: Column) -> Column:
    """The path without its last two parts; unchanged if it has fewer than two."""
    parts = F.split(relative, "/")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "/")).otherwise(relative)


def archived_site_id(relative: Column) -> Column:
    return F.replace(relative, F.lit("/"), F.lit("__"))


def clean_key(stem: Column) -> Column:
    """Without a leading ``image_`` and a trailing ``_part``."""
    return F.regexp_replace(F.regexp_replace(stem, "^image_", ""), "_part$", "")


def make_ref(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("#"), index.cast("string"))


def ref_path(ref: Column) -> Column:
    """All before the last ``#``."""
    return F.regexp_extract(ref, "^(.*)#([0-9]+)$", 1)


def ref_index(ref: Column) -> Column:
    return F.regexp_extract(ref, "^(.*)#([0-9]+)$", 2).cast("long")


def cell_key(index: Column) -> Column:
    return F.format_string("cell_%04d", index)


def relative_ref(ref: Column, root: str) -> Column:
    return make_ref(F.regexp_replace(ref_path(ref), "^" + re.escape(root.rstrip("/")) + "/", ""), ref_index(ref))


def absolute_ref(ref: Column, root: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), ref)


def with_dir_id(df: DataFrame, key: str, width: int = 8, target: str = "dir_id") -> DataFrame:
    """A folder name for each row's key: its first characters where no other key shares them, else the whole key,
    both with odd characters replaced. Keys are compared as distinct values."""
    clean = F.regexp_replace(key, "[^A-Za-z0-9._-]", "_")
    short = F.substring(clean, 1, width)
    keys = df.select(key).distinct()
    named = keys.withColumn(target, F.when(F.count("*").over(Window.partitionBy(short)) > 1, clean).otherwise(short))
    return df.join(named, key)


def split_of(path: Column) -> Column:
    """train or val of a path .../<site>/<resolution>/<version>/<split>annot/<name>."""
    return F.regexp_extract(path, "/(train|val)annot/[^/]*$", 1)


def tile_parts(path: Column) -> dict[str, Column]:
    """site, resolution, dataset_version, split and name of a mask path below a root."""
    pattern = "^(.+)/([^/]+)/([^/]+)/(train|val)annot/([^/]+)$"
    return {n: F.regexp_extract(path, pattern, i) for i, n in enumerate(("site", "resolution", "dataset_version", "split", "name"), 1)}


def blob_tile(name: Column) -> dict[str, Column]:
    """key, col and row of a tile name ``<key>_<col>_<row>.npz``."""
    pattern = r"^(.+)_(\d+)_(\d+)\.npz$"
    return {"uuid": clean_key(F.regexp_extract(name, pattern, 1)), "col": F.regexp_extract(name, pattern, 2).try_cast("int"), "row": F.regexp_extract(name, pattern, 3).try_cast("int")}


def image_tile(name: Column) -> dict[str, Column]:
    """The same for the older form ``image_<key>_<col>_<row>``, whatever follows: the shortest key."""
    pattern = r"image_(.+?)_(\d+)_(\d+)"
    return {"uuid": F.regexp_extract(name, pattern, 1), "col": F.regexp_extract(name, pattern, 2).try_cast("int"), "row": F.regexp_extract(name, pattern, 3).try_cast("int")}
