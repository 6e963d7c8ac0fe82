"""Rasters as pixel tables (row, col, value): mosaics, canvases, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed, discard


def canvas(spark, height: int, width: int) -> DataFrame:
    """Every (row, col) of a raster, made in parallel."""
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def mosaic_last(pixels: DataFrame, order: list[str], value: str = "value", at: list[str] = ("row", "col")) -> DataFrame:
    """The value that comes last by ``order``, which must be total."""
    return pixels.groupBy(*at).agg(F.max_by(value, F.struct(*order)).alias(value))


def mosaic_first(pixels: DataFrame, order: list[str], value: str = "value", at: list[str] = ("row", "col")) -> DataFrame:
    return pixels.groupBy(*at).agg(F.min_by(value, F.struct(*order)).alias(value))


def mosaic_mean(pixels: DataFrame, value: str = "value", at: list[str] = ("row", "col")) -> DataFrame:
    return pixels.groupBy(*at).agg(F.avg(F.col(value).cast("double")).alias(value))


def on_canvas(pixels: DataFrame, frame: DataFrame, value: str = "value", hole: float = 0.0) -> DataFrame:
    """Every position of the frame; ``hole`` where nothing was painted."""
    return frame.join(pixels, ["row", "col"], "left").withColumn(value, F.coalesce(value, F.lit(hole)))


def inner_window(pixels: DataFrame, margin: Column, height: Column, width: Column, top: Column, left: Column, bottom: Column, right: Column) -> DataFrame:
    """Pixels (wrow, wcol inside their window) off the seams: ``margin`` is cut at every edge that is not the raster's own
    (the four flags)."""
    keep = (F.col("wrow") >= F.when(top, 0).otherwise(margin)) & (F.col("wrow") < F.when(bottom, height).otherwise(height - margin))
    keep = keep & (F.col("wcol") >= F.when(left, 0).otherwise(margin)) & (F.col("wcol") < F.when(right, width).otherwise(width - margin))
    return pixels.where(keep)


def coverage_heat(windows: DataFrame) -> DataFrame:
    """How many windows (col_px, row_px, w_px, h_px) cover each pixel.

    Equal windows are one with a count. A window adds to its rows where it begins and takes away where it ends, so the
    rows made grow with the heights of the windows that differ and the pixels covered, not with the areas of all."""
    same = windows.where("w_px > 0 and h_px > 0").groupBy("col_px", "row_px", "w_px", "h_px").agg(F.count("*").alias("n"))
    ends = F.array(F.struct(F.col("col_px").alias("col"), F.col("n")), F.struct((F.col("col_px") + F.col("w_px")).alias("col"), (-F.col("n")).alias("n")))
    spots = same.select(F.explode(F.sequence(F.col("row_px"), F.col("row_px") + F.col("h_px") - 1)).alias("row"), ends.alias("e")).select("row", F.explode("e").alias("e"))
    steps = spots.groupBy("row", F.col("e.col").alias("col")).agg(F.sum("e.n").alias("n"))
    along = Window.partitionBy("row").orderBy("col")
    spans = steps.select("row", "col", F.lead("col").over(along).alias("to"), F.sum("n").over(along).alias("n_boxes")).where("n_boxes > 0")
    return spans.select("row", F.explode(F.sequence(F.col("col"), F.col("to") - 1)).alias("col"), "n_boxes")


def offsets(xmin: Column, ymax: Column, site_xmin: Column, site_ymax: Column, gsd: Column) -> tuple[Column, Column]:
    """col and row of a cell on its site's canvas; halves go to the even number."""
    return F.bround((xmin - site_xmin) / gsd).cast("int"), F.bround((site_ymax - ymax) / gsd).cast("int")


def paint(cells: DataFrame, patches: DataFrame, gsd: Column, key: str = "cell_id", site: list[str] = ()) -> DataFrame:
    """Patches (key, pr, pc, value...) at their place on the site's canvas; of overlapping cells the largest key shows."""
    s = list(site)
    corner = cells.groupBy(*s).agg(F.min("xmin").alias("_x"), F.max("ymax").alias("_y"))
    # one row a site
    placed = cells.join(F.broadcast(corner), s) if s else cells.join(F.broadcast(corner))
    col, row = offsets(F.col("xmin"), F.col("ymax"), F.col("_x"), F.col("_y"), gsd)
    placed = placed.select(*s, key, col.alias("_c"), row.alias("_r"))
    values = [c for c in patches.columns if c not in (*s, key, "pr", "pc")]
    spots = patches.join(placed, [*s, key]).withColumn("row", F.col("_r") + F.col("pr")).withColumn("col", F.col("_c") + F.col("pc"))
    return spots.groupBy(*s, "row", "col").agg(*[F.max_by(v, key).alias(v) for v in values])


def keyed(frame: DataFrame, pixels: DataFrame, key: list[str] = ()) -> DataFrame:
    """The frame once for every key that has pixels; the frame itself without a key."""
    k = list(key)
    return frame.crossJoin(pixels.select(*k).distinct()) if k else frame


def data_mask(pixels: DataFrame, frame: DataFrame, key: list[str] = ()) -> DataFrame:
    """Whether any band is not zero; false outside of the pixels there are. With a key, a mask of each."""
    k = list(key)
    lit = (F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0)
    return keyed(frame, pixels, k).join(pixels.select(*k, "row", "col", lit.alias("_lit")), [*k, "row", "col"], "left").select(*k, "row", "col", F.coalesce("_lit", F.lit(False)).alias("has_data"))


def rgba(pixels: DataFrame, mask: DataFrame | None, frame: DataFrame, key: list[str] = ()) -> DataFrame:
    """0..255 colours of values 0..1, and alpha: the data mask, or whether the pixel was painted. With a key, a canvas of
    each."""
    at = [*key, "row", "col"]
    byte = lambda c: F.coalesce(F.floor(F.col(c) * 255).cast("int"), F.lit(0)).alias(c)
    out = keyed(frame, pixels, key).join(pixels.withColumn("_painted", F.lit(True)), at, "left")
    if mask is None:
        return out.select(*at, byte("r"), byte("g"), byte("b"), F.when(F.col("_painted"), 255).otherwise(0).alias("a"))
    return out.join(mask, at, "left").select(*at, byte("r"), byte("g"), byte("b"), F.when(F.col("has_data"), 255).otherwise(0).alias("a"))


def class_codes(painted: DataFrame, classes: list[int], mask: DataFrame, key: list[str] = ()) -> DataFrame:
    """Codes 1..n in the order of ``classes`` where there is data, else 0. The mask has the key's columns too."""
    at = [*key, "row", "col"]
    code = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")).cast("int"), F.lit(0))
    return mask.join(painted, at, "left").select(*at, F.when(F.col("has_data"), F.coalesce(code, F.lit(0))).otherwise(0).alias("code"))


def footprint_or_bounds(pixels: DataFrame, step: int, least: int = 64) -> DataFrame:
    """The footprint, or, where nothing but speckle is there, all coarse cells of the raster's bounds."""
    found = checkpointed(footprint(pixels, step, least))
    if not found.isEmpty():
        return found
    cell = lambda f, n: F.expr(f"{f}({n}) div {step}")
    ends = pixels.agg(*[cell(f, n).alias(f"{f}_{n}") for f in ("min", "max") for n in ("row", "col")]).where("min_row is not null")
    every = lambda n: F.explode(F.sequence(f"min_{n}", f"max_{n}"))
    return ends.withColumn("row", every("row")).withColumn("col", every("col")).select("row", "col")


def footprint(pixels: DataFrame, step: int, least: int = 64) -> DataFrame:
    """Coarse cells of ``step`` pixels that hold data and are no speckle: those in 4-connected components of ``least`` cells
    or more. A mask table instead of a polygon."""
    lit = (F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0)
    cells = pixels.where(lit).select(F.expr(f"row div {step}").alias("row"), F.expr(f"col div {step}").alias("col")).distinct()
    name = lambda r, c: r * F.lit(1 << 31) + c
    nodes = cells.withColumn("node", name(F.col("row"), F.col("col")))
    steps = nodes.select("node", F.explode(F.array(F.struct((F.col("row") + 1).alias("r"), F.col("col").alias("c")), F.struct(F.col("row").alias("r"), (F.col("col") + 1).alias("c")))).alias("p"))
    pairs = steps.select("node", name(F.col("p.r"), F.col("p.c")).alias("other")).join(nodes.select(F.col("node").alias("other")), "other")
    labels = _components(nodes.select("node"), pairs)
    big = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return nodes.join(labels, "node").join(big, "label", "left_semi").select("row", "col")


def _components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, label) by hooking each label to its smallest neighbour and following hooks, until no pair disagrees. Each
    round is checkpointed, and the one before it removed."""
    labels = checkpointed(nodes.withColumn("label", F.col("node")))
    pairs = checkpointed(pairs)
    while True:
        a, b = labels.select("node", F.col("label").alias("la")), labels.select(F.col("node").alias("other"), F.col("label").alias("lb"))
        met = pairs.join(a, "node").join(b, "other").where("la <> lb").select("la", "lb")
        hooks = checkpointed(met.union(met.select("lb", "la")).groupBy("la").agg(F.min("lb").alias("to")).where("to < la"))
        if hooks.isEmpty():
            discard(pairs, hooks)
            return labels
        onward = hooks.select(F.col("la").alias("to"), F.col("to").alias("next"))
        far = hooks.join(onward, "to", "left").select("la", F.coalesce("next", "to").alias("to"))
        before, labels = labels, checkpointed(labels.join(far, labels["label"] == far["la"], "left").select("node", F.coalesce("to", "label").alias("label")))
        discard(before, hooks)


def tile_split(pixels: DataFrame, tile: int) -> DataFrame:
    """tile row and column, and the position inside, row by row."""
    return pixels.select(F.expr(f"row div {tile}").alias("trow"), F.expr(f"col div {tile}").alias("tcol"), F.pmod("row", F.lit(tile)).alias("wrow"), F.pmod("col", F.lit(tile)).alias("wcol"), *[c for c in pixels.columns if c not in ("row", "col")])


def tile_merge(tiles: DataFrame, tile: int) -> DataFrame:
    return tiles.select((F.col("trow") * tile + F.col("wrow")).alias("row"), (F.col("tcol") * tile + F.col("wcol")).alias("col"), *[c for c in tiles.columns if c not in ("trow", "tcol", "wrow", "wcol")])


def super_tiles(rows: Column, cols: Column) -> Column:
    """How many 2 x 2 groups a layout holds; odd rows and columns are left over."""
    return F.floor(rows / 2) * F.floor(cols / 2)


def edge_padded(pixels: DataFrame, height: int, width: int, multiple: int, key: list[str] = ()) -> DataFrame:
    """The raster (with a key, each) grown to whole multiples by repeating its last row and column."""
    k = list(key)
    h, w = height + (-height) % multiple, width + (-width) % multiple
    frame = keyed(canvas(pixels.sparkSession, h, w), pixels, k).withColumn("_r", F.least("row", F.lit(height - 1))).withColumn("_c", F.least("col", F.lit(width - 1)))
    values = [c for c in pixels.columns if c not in (*k, "row", "col")]
    return frame.join(pixels.withColumnsRenamed({"row": "_r", "col": "_c"}), [*k, "_r", "_c"], "left").select(*k, "row", "col", *values)


def black_windows(pixels: DataFrame, key: list[str], most: float = 0.98) -> DataFrame:
    """Windows whose share of all-black pixels reaches ``most``: not worth embedding."""
    black = ((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)).cast("double")
    return pixels.groupBy(*key).agg(F.avg(black).alias("black_frac")).where(F.col("black_frac") >= most)


def window_read(pixels: DataFrame, row: int, col: int, height: int, width: int, values: list[str], key: list[str] = ()) -> DataFrame:
    """A window of a raster (with a key, of each), zero where the raster ends: the range filter reaches the scan."""
    k = list(key)
    part = pixels.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))
    part = part.select(*k, (F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), *values)
    return keyed(canvas(pixels.sparkSession, height, width), pixels, k).join(part, [*k, "row", "col"], "left").na.fill(0, values)


def decimated(pixels: DataFrame, row: int, col: int, height: int, width: int, out_height: int, out_width: int, values: list[str], key: list[str] = ()) -> DataFrame:
    """A window of a raster (with a key, of each) read at ``out_height`` x ``out_width`` positions: each shows the pixel
    under its centre, zero where the raster ends. Other pixels are left out before anything is joined."""
    k = list(key)
    frame = keyed(canvas(pixels.sparkSession, out_height, out_width), pixels, k)
    at = lambda i, n, of, start: F.floor((F.col(i) + 0.5) * of / n).cast("int") + start
    frame = frame.withColumn("_r", at("row", out_height, height, row)).withColumn("_c", at("col", out_width, width, col))
    part = pixels.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))
    part = part.select(*k, F.col("row").alias("_r"), F.col("col").alias("_c"), *values)
    return frame.join(part, [*k, "_r", "_c"], "left").na.fill(0, values).drop("_r", "_c")
