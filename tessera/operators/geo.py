"""Boxes, grids, spatial joins and coverage.

A geometry is a box of four doubles (xmin, ymin, xmax, ymax) in one reference system; joins across systems are refused.
Spatial predicates become equi-joins on bins, so they never plan as nested loops.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import pixel_box_to_world
from tessera.session import checkpointed

BOX = ["xmin", "ymin", "xmax", "ymax"]
#: bins on one axis that a box may meet; larger boxes are joined on larger bins
MOST_BINS = 64


def same_srid(*tables: DataFrame, column: str = "srid") -> None:
    """Fails unless all rows of all tables share one reference system."""
    found = set()
    for t in tables:
        found |= {r[0] for r in t.select(column).distinct().limit(3).collect()}
    if len(found) > 1:
        raise ValueError(f"mixed reference systems: {sorted(map(str, found))}")


def intersects(a: str, b: str) -> Column:
    """Closed: boxes that only touch do intersect."""
    c = F.col
    return (c(f"{a}xmin") <= c(f"{b}xmax")) & (c(f"{b}xmin") <= c(f"{a}xmax")) & (c(f"{a}ymin") <= c(f"{b}ymax")) & (c(f"{b}ymin") <= c(f"{a}ymax"))


def _bins(prefix: str, cell: float) -> tuple[Column, Column, Column, Column]:
    return tuple(F.floor(F.col(f"{prefix}{n}") / cell).cast("long") for n in BOX)


def _binned(boxes: DataFrame, prefix: str, cell: float) -> DataFrame:
    """Every box once for each bin that it meets."""
    x0, y0, x1, y1 = _bins(prefix, cell)
    return boxes.withColumn("_bx", F.explode(F.sequence(x0, x1))).withColumn("_by", F.explode(F.sequence(y0, y1)))


def box_join(left: DataFrame, right: DataFrame, cell: float, left_key: str, right_key: str, by: list[str] = ()) -> DataFrame:
    """(by, left_key, right_key) of all boxes that intersect (and agree in ``by``), each pair once.

    Both sides are spread over square bins of side ``cell`` and joined by bin; a pair is reported by the bin that holds
    the lower left corner of its intersection, so no distinct is needed. Choose the cell near the typical box. A box that
    would meet more than MOST_BINS bins on an axis is joined on bins that are MOST_BINS times as wide, and so on, so it has
    few rows however large it is; the other side has one more set of rows for each size that occurs."""
    by = list(by)
    a = left.select(*by, F.col(left_key).alias("_l"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = right.select(*by, F.col(right_key).alias("_r"), *[F.col(c).alias(f"b_{c}") for c in BOX])

    def level(prefix: str) -> Column:
        """How often the bins must grow MOST_BINS-fold for the box to meet at most as many on an axis."""
        x0, y0, x1, y1 = _bins(prefix, cell)
        return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(x1 - x0, y1 - y0, F.lit(1)) / F.lit(MOST_BINS - 2.0)) / F.log(F.lit(float(MOST_BINS)))).cast("int"))

    a, b = a.withColumn("_level", level("a_")), b.withColumn("_level", level("b_"))
    # a handful of levels, whatever the boxes
    levels = sorted({r[0] for side in (a, b) for r in side.select("_level").distinct().collect() if r[0] is not None})
    out = None
    for n in levels:
        side = cell * MOST_BINS**n
        # pairs whose larger level is n
        x, y = a.where(F.col("_level") <= n).withColumnRenamed("_level", "_la"), b.where(F.col("_level") <= n).withColumnRenamed("_level", "_lb")
        pairs = _binned(x, "a_", side).join(_binned(y, "b_", side), [*by, "_bx", "_by"]).where(intersects("a_", "b_") & (F.greatest("_la", "_lb") == n))
        home = lambda c, side=side: F.floor(F.greatest(F.col(f"a_{c}"), F.col(f"b_{c}")) / side)
        pairs = pairs.where((home("xmin") == F.col("_bx")) & (home("ymin") == F.col("_by"))).select(*by, F.col("_l").alias(left_key), F.col("_r").alias(right_key))
        out = pairs if out is None else out.union(pairs)
    return out if out is not None else a.join(b, by or F.lit(False)).select(*by, F.col("_l").alias(left_key), F.col("_r").alias(right_key)).limit(0)


def box_semi_join(left: DataFrame, right: DataFrame, cell: float, key: str, by: list[str] = ()) -> DataFrame:
    """Rows of ``left`` that intersect any box of ``right`` (of the same ``by``)."""
    tagged = right.withColumn("_rid", F.lit(1))
    hits = box_join(left, tagged, cell, key, "_rid", by).select(*by, key).distinct()
    return left.join(hits, [*by, key], "left_semi")


def clip(boxes: DataFrame, to: DataFrame, cell: float | None = None, by: list[str] = ()) -> DataFrame:
    """Boxes cut to the boxes of ``to`` (of the same ``by``); a box that meets several is there once for each, and those
    without area inside are dropped. With ``cell`` the two sides are joined by bins of that side."""
    by = list(by)
    names = {c: f"_{c}" for c in BOX}
    if cell is None:
        # the reference's one extent, or one for each of ``by``
        t = to.select(*by, *[F.col(c).alias(n) for c, n in names.items()])
        out = boxes.join(F.broadcast(t), by) if by else boxes.join(F.broadcast(t), F.col("xmin") < F.col("_xmax"))
    else:
        rows, areas = (checkpointed(d.withColumn(n, F.monotonically_increasing_id())) for d, n in ((boxes, "_box"), (to.select(*by, *BOX), "_area")))
        pairs = box_join(rows, areas, cell, "_box", "_area", by).select("_box", "_area")
        out = rows.join(pairs, "_box").join(areas.select("_area", *[F.col(c).alias(n) for c, n in names.items()]), "_area").drop("_box", "_area")
    cut = {"xmin": F.greatest("xmin", "_xmin"), "ymin": F.greatest("ymin", "_ymin"), "xmax": F.least("xmax", "_xmax"), "ymax": F.least("ymax", "_ymax")}
    return out.withColumns(cut).drop(*names.values()).where("xmin < xmax and ymin < ymax")


def mask_boxes(cells: DataFrame, affine: Column, step: int, key: list[str] = ()) -> DataFrame:
    """A footprint's coarse cells (row, col of ``step`` pixels) as world boxes, runs along a row joined: what a mask table
    gives to ``clip`` and ``union_area``."""
    k = list(key)
    along = Window.partitionBy(*k, "row").orderBy("col")
    runs = cells.withColumn("_run", F.col("col") - F.row_number().over(along))
    runs = runs.groupBy(*k, "row", "_run").agg(F.min("col").alias("_c0"), (F.max("col") + 1).alias("_c1"))
    box = pixel_box_to_world(affine, F.col("_c0") * step, F.col("row") * step, F.col("_c1") * step, (F.col("row") + 1) * step)
    return runs.select(*k, *[v.alias(n) for n, v in box.items()])


def union_area(boxes: DataFrame, cell: float, group: list[str] = ()) -> DataFrame:
    """Area covered by any box. Boxes are cut at a grid of side ``cell``; inside each grid cell coordinates are compressed,
    so the work in one cell grows with the boxes that meet there only."""
    g = list(group)
    b = _binned(boxes.select(*g, *BOX), "", cell)
    cut = b.withColumns({"xmin": F.greatest("xmin", F.col("_bx") * cell), "xmax": F.least("xmax", (F.col("_bx") + 1) * cell), "ymin": F.greatest("ymin", F.col("_by") * cell), "ymax": F.least("ymax", (F.col("_by") + 1) * cell)}).where("xmin < xmax and ymin < ymax").distinct()
    keys = [*g, "_bx", "_by"]

    def spans(low: str, high: str, name: str) -> DataFrame:
        ends = cut.select(*keys, F.col(low).alias(name)).union(cut.select(*keys, high)).distinct()
        to = F.lead(name).over(Window.partitionBy(*keys).orderBy(name))
        return ends.withColumn(f"{name}2", to).where(F.col(f"{name}2").isNotNull())

    parts = cut.join(spans("xmin", "xmax", "x"), keys).where("x >= xmin and x2 <= xmax").join(spans("ymin", "ymax", "y"), keys).where("y >= ymin and y2 <= ymax")
    return parts.select(*keys, "x", "x2", "y", "y2").distinct().groupBy(*g).agg(F.sum((F.col("x2") - F.col("x")) * (F.col("y2") - F.col("y"))).alias("area"))


def snap_box(affine: Column, box: dict[str, Column], patch: Column | int) -> dict[str, Column]:
    """The box grown to whole patches of pixels, aligned to the raster's grid at its top left (no shear)."""
    px, ox, py, oy = (F.get(affine, i) for i in (0, 2, 4, 5))
    cols = [(box[n] - ox) / px for n in ("xmin", "xmax")]
    rows = [(box[n] - oy) / py for n in ("ymin", "ymax")]
    p = F.lit(patch) if isinstance(patch, int) else patch
    c0, r0 = F.floor(F.least(*cols)), F.floor(F.least(*rows))
    c1 = c0 + F.ceil((F.ceil(F.greatest(*cols)) - c0) / p) * p
    r1 = r0 + F.ceil((F.ceil(F.greatest(*rows)) - r0) / p) * p
    xs, ys = [ox + c * px for c in (c0, c1)], [oy + r * py for r in (r0, r1)]
    return {"xmin": F.least(*xs), "ymin": F.least(*ys), "xmax": F.greatest(*xs), "ymax": F.greatest(*ys)}


def grid(areas: DataFrame, side: Column, carry: list[str] = ()) -> DataFrame:
    """Square cells of ``side`` over every area's box, row by row from the top left: row, col, cell_id and box."""
    n = lambda a, b: F.greatest(F.round((F.col(b) - F.col(a)) / side).cast("int"), F.lit(0))
    out = areas.withColumn("_nx", n("xmin", "xmax")).withColumn("_ny", n("ymin", "ymax")).where("_nx > 0 and _ny > 0")
    out = out.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)))
    out = out.withColumn("cell_id", F.col("row").cast("long") * F.col("_nx") + F.col("col"))
    x0, y1 = F.col("xmin") + F.col("col") * side, F.col("ymax") - F.col("row") * side
    return out.select(*carry, "cell_id", "row", "col", x0.alias("xmin"), (y1 - side).alias("ymin"), (x0 + side).alias("xmax"), y1.alias("ymax"))


def cell_coverage(pixels: DataFrame, key: list[str]) -> DataFrame:
    """Share of a cell's pixels (key, r, g, b) with any band not zero."""
    lit = ((F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0)).cast("double")
    return pixels.groupBy(*key).agg(F.avg(lit).alias("coverage"))


def tile_grid(areas: DataFrame, side: Column, tiles: DataFrame, coverage: DataFrame, cell: float, least: float = 0.02) -> DataFrame:
    """Grid cells that meet a tile and have at least ``least`` data (coverage: cell_id, coverage; missing is 0)."""
    near = box_semi_join(grid(areas, side), tiles, cell, "cell_id")
    return near.join(coverage, "cell_id", "left").na.fill(0.0, ["coverage"]).where(F.col("coverage") >= least)


def window_starts(extent: Column, tile: int, overlap: int, cell: int = 1) -> Column:
    """Starts of overlapping windows, the last one at the far edge, all rounded down to whole cells, without repeats.
    Up to a cell less one may stay uncovered at the edge."""
    stride = tile - overlap
    if stride <= 0:
        raise ValueError(f"overlap {overlap} leaves no stride for windows of {tile}")
    last = F.greatest(F.lit(0), extent - tile)
    every = F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))
    return F.array_sort(F.array_distinct(F.transform(every, lambda v: (F.floor(v / cell) * cell).cast("int"))))


def overlapping_windows(blobs: DataFrame, tile: int, overlap: int, cell: int = 1, carry: list[str] = ("uuid",)) -> DataFrame:
    """Windows over blobs (width, height): col_px, row_px, w_px, h_px and chunk_id."""
    out = blobs.withColumn("row_px", F.explode(window_starts(F.col("height"), tile, overlap, cell))).withColumn("col_px", F.explode(window_starts(F.col("width"), tile, overlap, cell)))
    out = out.withColumn("w_px", F.least(F.lit(tile), F.col("width") - F.col("col_px"))).withColumn("h_px", F.least(F.lit(tile), F.col("height") - F.col("row_px")))
    name = F.concat_ws("_", F.substring("uuid", 1, 8), "col_px", "row_px") if "uuid" in carry else F.concat_ws("_", "col_px", "row_px")
    return out.select(*carry, name.alias("chunk_id"), "col_px", "row_px", "w_px", "h_px")


def chunk_rects(blobs: DataFrame, size: int | str | None, carry: list[str] = ("uuid",), tiles: DataFrame | None = None) -> DataFrame:
    """The whole blob (size None or ``blob``), its tiles (``tile``: rows of ``tiles`` with col, row, w, h), or its parts of
    ``size`` pixels, the last ones cut off."""
    if size == "tile":
        if tiles is None:
            raise ValueError("tiles are needed")
        return tiles.join(blobs.select(*carry), list(carry), "left_semi").select(*carry, F.col("col").alias("col_px"), F.col("row").alias("row_px"), F.col("w").alias("w_px"), F.col("h").alias("h_px"))
    if size is None or size == "blob":
        return blobs.select(*carry, F.lit(0).alias("col_px"), F.lit(0).alias("row_px"), F.col("width").alias("w_px"), F.col("height").alias("h_px"))
    if not isinstance(size, int):
        raise ValueError(f"chunks of {size!r}: blob, tile or a number of pixels")
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - 1), F.lit(size))
    out = blobs.where("width > 0 and height > 0").withColumn("row_px", F.explode(starts("height"))).withColumn("col_px", F.explode(starts("width")))
    return out.select(*carry, "col_px", "row_px", F.least(F.lit(size), F.col("width") - F.col("col_px")).alias("w_px"), F.least(F.lit(size), F.col("height") - F.col("row_px")).alias("h_px"))


def blob_extent(tiles: DataFrame, key: str = "uuid") -> DataFrame:
    """width and height of every blob from its tiles (col, row, w, h), and their number."""
    return tiles.groupBy(key).agg(F.max(F.col("col") + F.col("w")).alias("width"), F.max(F.col("row") + F.col("h")).alias("height"), F.count("*").alias("n_tiles"))


def origin_check(blobs: DataFrame) -> DataFrame:
    """Distinct reference systems and origins: one origin under several blobs is a placeholder."""
    return blobs.agg(F.count_distinct("srid").alias("n_srid"), F.count_distinct(F.round("ox", 3), F.round("oy", 3)).alias("n_origins"), F.count("*").alias("n_blobs"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, anticlockwise, by the monotone chain."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def _hulls(parts: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Corners of the hull of each group in this batch: the rest can't be on the hull of the whole."""
    for pdf in parts:
        rows = []
        for key, part in pdf.groupby(group, sort=False, dropna=False) if group else [((), pdf)]:
            corners = [(x, y) for a, b, c, d in part[BOX].itertuples(index=False) for x, y in ((a, b), (a, d), (c, b), (c, d))]
            rows += [(*(key if isinstance(key, tuple) else (key,)), x, y) for x, y in hull(corners)]
        yield pd.DataFrame(rows, columns=[*group, "x", "y"])


def study_area(boxes: DataFrame, cell: float, group: list[str]) -> DataFrame:
    """area_km2 and perim_km of the convex hull of all boxes of a group, and the share of it that they fill.

    Hull corners are reduced batch by batch before the shuffle; a group gets the corners of partial hulls only.
    """
    kinds = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in group)
    corners = boxes.select(*group, *BOX).mapInPandas(lambda it: _hulls(it, group), f"{kinds}, x double, y double")

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(list(pdf[["x", "y"]].itertuples(index=False, name=None)))
        nxt = h[1:] + h[:1]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, nxt, strict=True))) / 2
        length = sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(h, nxt, strict=True))
        return pd.DataFrame([[*pdf[group].iloc[0], area, length, len(h)]], columns=[*group, "hull_area", "hull_length", "n_corners"])

    hulls = corners.groupBy(*group).applyInPandas(measure, f"{kinds}, hull_area double, hull_length double, n_corners int")
    out = hulls.join(union_area(boxes, cell, group), group)
    return out.select(*group, (F.col("hull_area") / 1e6).alias("area_km2"), (F.col("hull_length") / 1e3).alias("perim_km"), (F.col("area") / F.col("hull_area")).alias("fill_ratio"), "n_corners")
