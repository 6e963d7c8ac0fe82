"""Tile statistics and their roll-up, de-duplication and incremental upkeep.

Tables follow three shapes: masks in long form (tile key, row, col, class), tiles (one row a tile) and class rows (tile
key, original class, count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import taxonomy

TILE_KEY = ["tile_id", "site", "resolution", "split"]
GROUP = ["site", "resolution"]


def class_histogram(masks: DataFrame, key: list[str], column: str = "class") -> DataFrame:
    """Pixels of every class in every tile."""
    return masks.groupBy(*key, column).agg(F.count("*").alias("pixel_count"))


def is_no_data(column: str) -> Column:
    return F.col(column).isin(*taxonomy.NO_DATA)


def tile_statistics(masks: DataFrame, key: list[str], column: str = "class", scheme: str = "seven") -> DataFrame:
    """No-data pixels, pixels of the rolled-up classes, unmapped pixels, no_data_frac, distinct original classes, and
    the extent of the annotated pixels (share of the tile's area, density inside). One aggregation, no join but the
    broadcast class table. A tile that holds an unknown class is left out."""
    # one row for each class of a tile, then one for each tile
    span = [f(F.col(c)).alias(f"_{n}_{c}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))]
    each = masks.groupBy(*key, column).agg(F.count("*").alias("_n"), *span)
    coarse = taxonomy.remap(each.withColumn("_known", F.col(column).isin(*[*taxonomy.mapping(scheme), *taxonomy.NO_DATA])), column, scheme, "_coarse")
    none = is_no_data(column)
    there = lambda name: F.when(~none, F.col(name))
    pixels = lambda where: F.coalesce(F.sum(F.when(where, F.col("_n"))), F.lit(0))
    counts = [pixels((F.col("_coarse") == k) & ~none).alias(f"pixels_class_{k}") for k in taxonomy.ROLLED_UP]
    out = coarse.groupBy(*key).agg(
        F.sum("_n").alias("total_pixels"),
        pixels(none).alias("pixels_no_data"),
        *counts,
        F.count(column).cast("short").alias("n_unique_orig_classes"),
        (F.max(there("_max_row")) - F.min(there("_min_row")) + 1).cast("long").alias("_h"),
        (F.max(there("_max_col")) - F.min(there("_min_col")) + 1).cast("long").alias("_w"),
        F.bool_and("_known").alias("_known"),
    )
    annotated = F.col("total_pixels") - F.col("pixels_no_data")
    area = F.coalesce(F.col("_h") * F.col("_w"), F.lit(0))
    out = out.where("_known")
    out = out.withColumn("pixels_unmapped", annotated - sum((F.col(f"pixels_class_{k}") for k in taxonomy.ROLLED_UP[1:]), F.col(f"pixels_class_{taxonomy.ROLLED_UP[0]}")))
    out = out.withColumn("no_data_frac", F.col("pixels_no_data") / F.col("total_pixels"))
    out = out.withColumn("annot_bbox_area_frac", area / F.col("total_pixels"))
    out = out.withColumn("annot_in_bbox_density", F.when(area > 0, annotated / area).otherwise(0.0))
    return out.drop("_h", "_w", "_known")


def split_pivot(tiles: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Tiles in train and val, 0 where there are none."""
    named = tiles.dropna(subset=group).groupBy(*group).pivot("split", ["train", "val"]).agg(F.count("tile_id"))
    return named.na.fill(0, ["train", "val"]).withColumnsRenamed({"train": "n_tiles_train", "val": "n_tiles_val"})


def distinct_classes(classes: DataFrame, group: list[str] = GROUP) -> DataFrame:
    return classes.dropna(subset=group).groupBy(*group).agg(F.count_distinct("original_class_id").alias("n_unique_orig_classes_union"))


def base_rollup(tiles: DataFrame, group: list[str] = GROUP, sums: list[str] = ()) -> DataFrame:
    """Latest version, tiles, pixels, and mean, median, 90th percentile and share above 0.9 of no_data_frac."""
    f = F.col("no_data_frac")
    return tiles.dropna(subset=group).groupBy(*group).agg(
        F.max("dataset_version").alias("dataset_version"),
        F.count("tile_id").alias("n_tiles_total"),
        F.sum("total_pixels").alias("total_pixels"),
        F.sum("pixels_no_data").alias("total_no_data_pixels"),
        F.avg(f.cast("double")).alias("mean_no_data_frac"),
        F.percentile(f.cast("double"), F.lit(0.5)).alias("median_no_data_frac"),
        F.percentile(f.cast("double"), F.lit(0.9)).alias("p90_no_data_frac"),
        F.avg((f > 0.9).cast("double")).alias("frac_tiles_mostly_no_data"),
        *[F.sum(c).alias(c) for c in sums],
    )


def site_rollup(tiles: DataFrame, classes: DataFrame, group: list[str] = GROUP, sums: list[str] = ()) -> DataFrame:
    """The site x resolution table: base figures, tiles by split, distinct original classes (0 where there are none).

    Null group keys are dropped. All three parts are grouped by the same keys, so the joins reuse their partitioning.
    """
    out = base_rollup(tiles, group, sums).join(split_pivot(tiles, group), group, "left").join(distinct_classes(classes, group), group, "left")
    return out.na.fill(0, ["n_tiles_train", "n_tiles_val", "n_unique_orig_classes_union"])


def new_tiles(found: DataFrame, known: DataFrame, key: str = "mask_path") -> DataFrame:
    """What is found but not known yet; a null key is never known."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def pruned(tiles: DataFrame, classes: DataFrame, on_disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose mask is still there. Class rows go by the whole tile key, so that a tile of the same name elsewhere
    keeps its rows."""
    kept = tiles.join(on_disk.select("mask_path").distinct(), "mask_path", "left_semi")
    gone = tiles.join(on_disk.select("mask_path").distinct(), "mask_path", "left_anti")
    return kept, dropped_classes(classes, gone.join(kept.select(*TILE_KEY).distinct(), TILE_KEY, "left_anti"))


def dropped_classes(classes: DataFrame, gone: DataFrame) -> DataFrame:
    return classes.join(gone.select(*TILE_KEY).distinct(), TILE_KEY, "left_anti")


def reconciled(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """Image path and existence as discovered now; a mask not found has no image."""
    now = found.select("mask_path", F.col("image_path").alias("_path"), F.col("image_exists").alias("_exists"))
    out = tiles.drop("image_path", "image_exists").join(now, "mask_path", "left").withColumn("image_exists", F.coalesce("_exists", F.lit(False)))
    return out.withColumn("image_path", F.when(F.col("image_exists"), F.col("_path"))).drop("_path", "_exists")


def shared_images(tiles: DataFrame) -> DataFrame:
    """Rows with an image that other rows have too: row number in its group (a name with ``mask_`` first, then the path)
    and whether all contents of the group agree.

    Expects mask_path, image_path, image_exists and content (a hash). Rows without an image stand alone."""
    with_image = tiles.where("image_exists and image_path is not null")
    agree = with_image.groupBy("image_path").agg(F.count("*").alias("_n"), F.count_distinct("content").alias("_kinds"), F.count("content").alias("_known"))
    several = with_image.join(agree.where("_n > 1"), "image_path")
    name = F.substring_index("mask_path", "/", -1)
    order = Window.partitionBy("image_path").orderBy(F.when(name.startswith("mask_"), 0).otherwise(1), "mask_path")
    return several.withColumn("rank", F.row_number().over(order)).withColumn("agrees", (F.col("_kinds") == 1) & (F.col("_known") == F.col("_n"))).drop("_n", "_kinds", "_known")


def dedup_losers(tiles: DataFrame, verify: bool = True) -> DataFrame:
    """Rows to drop: all but the first of their image. With ``verify`` a group whose contents differ is kept whole."""
    out = shared_images(tiles).where("rank > 1")
    return out.where("agrees") if verify else out


def dedup_conflicts(tiles: DataFrame) -> DataFrame:
    return shared_images(tiles).where("not agrees").groupBy("image_path").agg(F.count("*").alias("n_rows"))


def deduplicated(tiles: DataFrame, classes: DataFrame, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    losers = dedup_losers(tiles, verify)
    return tiles.join(losers.select("mask_path").distinct(), "mask_path", "left_anti"), dropped_classes(classes, losers)


def updated(existing: DataFrame, existing_classes: DataFrame, found: DataFrame, scanned: DataFrame, scanned_classes: DataFrame, prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """The tables after an incremental run: image links reconciled, new tiles appended, vanished ones pruned on demand.

    ``scanned`` holds statistics of at least the new tiles; those of known ones are not taken again."""
    fresh = new_tiles(scanned, existing)
    tiles = reconciled(existing, found).unionByName(fresh, allowMissingColumns=True)
    classes = existing_classes.unionByName(scanned_classes.join(fresh.select(*TILE_KEY).distinct(), TILE_KEY, "left_semi"))
    return pruned(tiles, classes, found) if prune else (tiles, classes)


def parity(stored: DataFrame, recomputed: DataFrame, key: list[str], exact: list[str], close: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Keys whose figures differ: whole numbers at all, others by more than a relative tolerance; or that lack one side."""
    both = stored.select(*key, *[F.col(c).alias(f"a_{c}") for c in exact + close], F.lit(True).alias("_a")).join(recomputed.select(*key, *[F.col(c).alias(f"b_{c}") for c in exact + close], F.lit(True).alias("_b")), key, "full")
    wrong = F.col("_a").isNull() | F.col("_b").isNull()
    for c in exact:
        wrong = wrong | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    for c in close:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        wrong = wrong | F.coalesce(F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)), ~a.eqNullSafe(b))
    return both.where(wrong).drop("_a", "_b")


def common_members(df: DataFrame, member: str, group: str) -> DataFrame:
    """Members that every group has."""
    pairs = df.select(member, group).distinct()
    groups = pairs.agg(F.count_distinct(group).alias("_groups"))
    return pairs.groupBy(member).agg(F.count("*").alias("_n")).join(F.broadcast(groups), F.col("_n") == F.col("_groups")).select(member)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``, failing at run time if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("_n", n).withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit(f"duplicate key {key}"))).where(F.col("_ok").isNull()).drop("_n", "_ok")


def confusion(df: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """precision, recall, f1 and support of every class on either side; 0 where a quotient has no divisor."""
    cells = confusion(df, truth, guess)
    sides = cells.select(F.col(truth).alias("class"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0).alias("hit")).unionAll(cells.select(F.col(guess).alias("class"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("hit")))
    s = sides.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    s = s.withColumn("precision", ratio("hit", "predicted")).withColumn("recall", ratio("hit", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return s.withColumn("f1", f1).drop("hit", "predicted")


def accuracy(df: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def flattened(df: DataFrame, column: str, drop: list[str] = ()) -> DataFrame:
    """Every nested field as a column ``a.b``."""
    def leaves(kind, path):
        for f in kind.fields:
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    found = [p for p in leaves(df.schema[column].dataType, [column]) if ".".join(p[1:]) not in drop]
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*others, *[F.col(".".join(f"`{x}`" for x in p)).alias(".".join(p[1:])) for p in found])


def run_status(expected: DataFrame, done: DataFrame, key: list[str], site: str = "site") -> DataFrame:
    """done and total of every site."""
    marked = expected.join(done.select(*key).distinct().withColumn("_done", F.lit(True)), key, "left")
    return marked.groupBy(site).agg(F.count_if(F.col("_done")).alias("done"), F.count("*").alias("total"))


def status_summary(runs: DataFrame, status: str = "status") -> DataFrame:
    return runs.groupBy(status).agg(F.count("*").alias("n"))


def bounds(boxes: DataFrame, group: list[str] = ()) -> DataFrame:
    return boxes.groupBy(*group).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
