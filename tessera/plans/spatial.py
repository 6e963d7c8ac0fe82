"""Grids, spatial joins, mosaics and canvases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import geo, raster
from tessera.plans import bindings as b
from tessera.plans.registry import query

CELL = 16.0
_ORDER = ", ".join(b.ORDER)
_TOUCH = "a.xmin <= c.xmax AND c.xmin <= a.xmax AND a.ymin <= c.ymax AND c.ymin <= a.ymax"


#: a square for every supplier
SQUARES = """squares AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 200 - 100 AS DOUBLE) AS xmin, CAST(s_suppkey * 91 % 200 - 100 AS DOUBLE) AS ymin, CAST(s_suppkey * 37 % 200 - 97 AS DOUBLE) AS xmax, CAST(s_suppkey * 91 % 200 - 97 AS DOUBLE) AS ymax FROM supplier)"""


def _squares(spark, sf_dir):
    x, y = (F.col("s_suppkey") * n % 200 - 100 for n in (37, 91))
    return b.read(spark, sf_dir, "supplier").select("s_suppkey", *[v.cast("double").alias(n) for n, v in (("xmin", x), ("ymin", y), ("xmax", x + 3), ("ymax", y + 3))])


@query(f"WITH {b.BOXES} SELECT a.vec_id AS a_id, c.vec_id AS b_id FROM boxes a JOIN boxes c ON a.vec_id < c.vec_id AND {_TOUCH}")
def box_join(spark, sf_dir):
    x = b.boxes(spark, sf_dir)
    return geo.box_join(x.withColumnRenamed("vec_id", "a_id"), x.withColumnRenamed("vec_id", "b_id"), CELL, "a_id", "b_id").where("a_id < b_id")


@query(f"WITH {b.BOXES}, {SQUARES} SELECT vec_id FROM boxes a WHERE EXISTS (SELECT 1 FROM squares c WHERE {_TOUCH})")
def box_semi_join(spark, sf_dir):
    """All boxes against a second table."""
    return geo.box_semi_join(b.boxes(spark, sf_dir), _squares(spark, sf_dir), CELL, "vec_id").select("vec_id")


@query(f"WITH {b.BOXES} SELECT vec_id, greatest(xmin, -40.0::DOUBLE) AS xmin, greatest(ymin, -30.0::DOUBLE) AS ymin, least(xmax, 50.0::DOUBLE) AS xmax, least(ymax, 60.0::DOUBLE) AS ymax FROM boxes WHERE greatest(xmin, -40) < least(xmax, 50) AND greatest(ymin, -30) < least(ymax, 60)")
def box_clip(spark, sf_dir):
    to = spark.createDataFrame([(-40.0, -30.0, 50.0, 60.0)], "xmin double, ymin double, xmax double, ymax double")
    return geo.clip(b.boxes(spark, sf_dir), to).select("vec_id", *geo.BOX)


@query(f"""WITH {b.BOXES}, xs AS (SELECT label, xmin AS x FROM boxes UNION SELECT label, xmax FROM boxes), ys AS (SELECT label, ymin AS y FROM boxes UNION SELECT label, ymax FROM boxes),
  xi AS (SELECT label, x, lead(x) OVER (PARTITION BY label ORDER BY x) AS x2 FROM xs), yi AS (SELECT label, y, lead(y) OVER (PARTITION BY label ORDER BY y) AS y2 FROM ys)
  SELECT xi.label, sum((x2 - x) * (y2 - y)) AS area FROM xi JOIN yi ON xi.label = yi.label WHERE x2 IS NOT NULL AND y2 IS NOT NULL AND EXISTS (SELECT 1 FROM boxes WHERE boxes.label = xi.label AND xmin <= x AND x2 <= xmax AND ymin <= y AND y2 <= ymax) GROUP BY 1""")
def union_area(spark, sf_dir):
    return geo.union_area(b.boxes(spark, sf_dir), CELL, ["label"])


@query(f"""WITH {b.BOXES}, s AS (SELECT vec_id, floor(xmin / 2) AS c0, ceil(xmax / 2) AS c1, floor(-ymax / 2) AS r0, ceil(-ymin / 2) AS r1 FROM boxes),
  t AS (SELECT vec_id, c0, c0 + ceil((c1 - c0) / 8) * 8 AS c1, r0, r0 + ceil((r1 - r0) / 8) * 8 AS r1 FROM s)
  SELECT vec_id, c0 * 2 AS xmin, 0 - r1 * 2 AS ymin, c1 * 2 AS xmax, 0 - r0 * 2 AS ymax FROM t""")
def snap_bbox(spark, sf_dir):
    affine = F.array(*[F.lit(v) for v in (2.0, 0.0, 0.0, 0.0, -2.0, 0.0)])
    x = b.boxes(spark, sf_dir)
    box = geo.snap_box(affine, {n: F.col(n) for n in geo.BOX}, 8)
    return x.select("vec_id", *[v.alias(n) for n, v in box.items()])


@query("""WITH a AS (SELECT s_suppkey, (2 + s_suppkey % 3) AS nx, (1 + s_suppkey % 4) AS ny FROM supplier)
  SELECT s_suppkey, r.range * nx + c.range AS cell_id, CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col, CAST(c.range * 10 AS DOUBLE) AS xmin, CAST((ny - r.range - 1) * 10 AS DOUBLE) AS ymin
  FROM a, range(10) r, range(10) c WHERE r.range < ny AND c.range < nx""")
def grid_gen(spark, sf_dir):
    s = F.col("s_suppkey")
    areas = b.read(spark, sf_dir, "supplier").select(s, F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), ((s % 3 + 2) * 10).cast("double").alias("xmax"), ((s % 4 + 1) * 10).cast("double").alias("ymax"))
    return geo.grid(areas, F.lit(10.0), ["s_suppkey"]).select("s_suppkey", "cell_id", "row", "col", "xmin", "ymin")


@query(f"WITH {b.RGB} SELECT cell_id, round(avg(CASE WHEN r <> 0 OR g <> 0 OR b <> 0 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS coverage FROM rgb GROUP BY 1")
def cell_coverage(spark, sf_dir):
    return geo.cell_coverage(b.rgb(spark, sf_dir), ["cell_id"]).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {b.BOXES}, {b.RGB}, g AS (SELECT r.range * 20 + c.range AS cell_id, -100 + c.range * 10 AS xmin, 100 - (r.range + 1) * 10 AS ymin, -90 + c.range * 10 AS xmax, 100 - r.range * 10 AS ymax FROM range(20) r, range(20) c),
  cov AS (SELECT cell_id, avg(CASE WHEN r <> 0 OR g <> 0 OR b <> 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS coverage FROM rgb GROUP BY 1)
  SELECT a.cell_id FROM g a WHERE EXISTS (SELECT 1 FROM boxes c WHERE {_TOUCH}) AND coalesce((SELECT coverage FROM cov WHERE cov.cell_id = a.cell_id % 20), 0) >= 0.2""")
def tile_grid(spark, sf_dir):
    area = spark.createDataFrame([(-100.0, -100.0, 100.0, 100.0)], "xmin double, ymin double, xmax double, ymax double")
    cover = geo.cell_coverage(b.rgb(spark, sf_dir), ["cell_id"]).withColumn("cell_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.col("cell_id") + 20 * i)))
    return geo.tile_grid(area, F.lit(10.0), b.boxes(spark, sf_dir), cover, CELL, 0.2).select("cell_id")


@query("""WITH e AS (SELECT * FROM (VALUES (300), (512), (1000), (1001), (2055)) t(extent)),
  s AS (SELECT extent, range AS v FROM e, range(0, 3000, 384) WHERE range <= greatest(0, extent - 512) UNION ALL SELECT extent, greatest(0, extent - 512) FROM e)
  SELECT DISTINCT extent, CAST(v // 8 * 8 AS INTEGER) AS start FROM s""")
def overlap_starts(spark, sf_dir):
    e = spark.createDataFrame([(v,) for v in (300, 512, 1000, 1001, 2055)], "extent int")
    return e.select("extent", F.explode(geo.window_starts(F.col("extent"), 512, 128, 8)).alias("start"))


@query("""WITH b AS (SELECT CAST(p_partkey AS VARCHAR) AS uuid, CAST(p_size * 20 AS INTEGER) AS width, CAST(p_size * 13 AS INTEGER) AS height FROM part)
  SELECT uuid, CAST(c.range AS INTEGER) AS col_px, CAST(r.range AS INTEGER) AS row_px, CAST(least(256, width - c.range) AS INTEGER) AS w_px, CAST(least(256, height - r.range) AS INTEGER) AS h_px
  FROM b, range(0, 1024, 256) c, range(0, 1024, 256) r WHERE c.range < width AND r.range < height""")
def chunk_rects(spark, sf_dir):
    return geo.chunk_rects(_blobs(spark, sf_dir), 256)


def _blobs(spark, sf_dir):
    return b.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("uuid"), (F.col("p_size") * 20).alias("width"), (F.col("p_size") * 13).alias("height"))


_WINDOWS = """b AS (SELECT CAST(p_size * 20 AS INTEGER) AS width, CAST(p_size * 13 AS INTEGER) AS height, CAST(p_partkey AS VARCHAR) AS uuid FROM part),
  x AS (SELECT DISTINCT uuid, v // 8 * 8 AS col_px FROM (SELECT uuid, range AS v FROM b, range(0, 1000, 192) WHERE range <= greatest(0, width - 256) UNION ALL SELECT uuid, greatest(0, width - 256) FROM b)),
  y AS (SELECT DISTINCT uuid, v // 8 * 8 AS row_px FROM (SELECT uuid, range AS v FROM b, range(0, 1000, 192) WHERE range <= greatest(0, height - 256) UNION ALL SELECT uuid, greatest(0, height - 256) FROM b)),
  w AS (SELECT uuid, substr(uuid, 1, 8) || '_' || col_px || '_' || row_px AS chunk_id, CAST(col_px AS INTEGER) AS col_px, CAST(row_px AS INTEGER) AS row_px, CAST(least(256, width - col_px) AS INTEGER) AS w_px, CAST(least(256, height - row_px) AS INTEGER) AS h_px FROM b JOIN x USING (uuid) JOIN y USING (uuid))"""


@query(f"WITH {_WINDOWS} SELECT * FROM w")
def overlapping_windows(spark, sf_dir):
    return geo.overlapping_windows(_blobs(spark, sf_dir), 256, 64, 8)


@query(f"""WITH {_WINDOWS}, d AS (SELECT col_px, row_px, w_px, h_px, count(*) AS n FROM w GROUP BY ALL)
  SELECT CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col, CAST(sum(n) AS BIGINT) AS n_boxes FROM d, range(0, 700) r, range(0, 1100) c
  WHERE r.range >= row_px AND r.range < row_px + h_px AND c.range >= col_px AND c.range < col_px + w_px GROUP BY 1, 2""")
def coverage_heat(spark, sf_dir):
    return raster.coverage_heat(geo.overlapping_windows(_blobs(spark, sf_dir), 256, 64, 8))


@query("SELECT count(DISTINCT s_nationkey % 2) AS n_srid, count(DISTINCT (s_nationkey, s_suppkey % 5)) AS n_origins, count(*) AS n_blobs FROM supplier")
def origin_check(spark, sf_dir):
    s = b.read(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 2).alias("srid"), F.col("s_nationkey").cast("double").alias("ox"), (F.col("s_suppkey") % 5 + 0.0001).alias("oy"))
    return geo.origin_check(s)


@query(f"WITH {b.PIXELS} SELECT row, col, arg_max(value, ({_ORDER})) AS value FROM pixels GROUP BY 1, 2")
def mosaic_last(spark, sf_dir):
    return raster.mosaic_last(b.pixels(spark, sf_dir), b.ORDER)


@query(f"WITH {b.PIXELS} SELECT row, col, arg_min(value, ({_ORDER})) AS value FROM pixels GROUP BY 1, 2")
def mosaic_first(spark, sf_dir):
    return raster.mosaic_first(b.pixels(spark, sf_dir), b.ORDER)


@query(f"WITH {b.PIXELS}, f AS (SELECT CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col FROM range(44) r, range(44) c), m AS (SELECT row, col, avg(value) AS v FROM pixels GROUP BY 1, 2) SELECT row, col, round(coalesce(v, 0), 6) AS value FROM f LEFT JOIN m USING (row, col)")
def mosaic_mean(spark, sf_dir):
    out = raster.on_canvas(raster.mosaic_mean(b.pixels(spark, sf_dir)), raster.canvas(spark, 44, 44))
    return out.select("row", "col", F.round("value", 6).alias("value"))


@query(f"""WITH {b.PIXELS}, w AS (SELECT l_partkey % 3 AS wy, l_suppkey % 3 AS wx, CAST(row % 16 AS INTEGER) AS wrow, CAST(col % 16 AS INTEGER) AS wcol, value, {_ORDER} FROM pixels),
  k AS (SELECT wy * 12 + wrow AS row, wx * 12 + wcol AS col, * EXCLUDE (wy, wx) FROM w WHERE wrow >= (CASE WHEN wy = 0 THEN 0 ELSE 2 END) AND wrow < (CASE WHEN wy = 2 THEN 16 ELSE 14 END) AND wcol >= (CASE WHEN wx = 0 THEN 0 ELSE 2 END) AND wcol < (CASE WHEN wx = 2 THEN 16 ELSE 14 END))
  SELECT row, col, arg_min(value, ({_ORDER})) AS value FROM k GROUP BY 1, 2""")
def mosaic_seams(spark, sf_dir):
    wy, wx = F.col("l_partkey") % 3, F.col("l_suppkey") % 3
    p = b.pixels(spark, sf_dir).select(wy.alias("wy"), wx.alias("wx"), (F.col("row") % 16).alias("wrow"), (F.col("col") % 16).alias("wcol"), "value", *b.ORDER)
    n = F.lit(16)
    kept = raster.inner_window(p, F.lit(2), n, n, F.col("wy") == 0, F.col("wx") == 0, F.col("wy") == 2, F.col("wx") == 2)
    placed = kept.withColumn("row", F.col("wy") * 12 + F.col("wrow")).withColumn("col", F.col("wx") * 12 + F.col("wcol"))
    return raster.mosaic_first(placed, b.ORDER)


@query(f"""WITH {b.BOXES}, s AS (SELECT min(xmin) AS x, max(ymax) AS y FROM boxes), p AS (SELECT vec_id, CAST(round_even((xmin - x) / 2.0::DOUBLE, 0) AS INTEGER) AS c, CAST(round_even((y - ymax) / 2.0::DOUBLE, 0) AS INTEGER) AS r FROM boxes, s)
  SELECT r + CAST(i.range AS INTEGER) AS row, c + CAST(j.range AS INTEGER) AS col, max(vec_id) AS value FROM p, range(2) i, range(2) j GROUP BY 1, 2""")
def canvas_paint(spark, sf_dir):
    cells = b.boxes(spark, sf_dir)
    n = F.sequence(F.lit(0), F.lit(1))
    patches = cells.select("vec_id", F.explode(n).alias("pr"), F.col("vec_id").alias("value")).withColumn("pc", F.explode(n))
    return raster.paint(cells, patches, F.lit(2.0), "vec_id")


_KEY = ["cell_id"]


def _frame(height: int, width: int) -> str:
    return f"f AS (SELECT cell_id, CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col FROM (SELECT DISTINCT cell_id FROM rgb), range({height}) r, range({width}) c)"


@query(f"WITH {b.RGB}, {_frame(18, 18)} SELECT cell_id, row, col, coalesce(r <> 0 OR g <> 0 OR b <> 0, false) AS has_data FROM f LEFT JOIN rgb USING (cell_id, row, col)")
def data_mask(spark, sf_dir):
    return raster.data_mask(b.rgb(spark, sf_dir), raster.canvas(spark, 18, 18), _KEY)


@query(f"""WITH {b.RGB}, {_frame(18, 18)}
  SELECT cell_id, row, col, CASE WHEN coalesce(r <> 0 OR g <> 0 OR b <> 0, false) THEN CASE r % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END ELSE 0 END AS code FROM f LEFT JOIN rgb USING (cell_id, row, col)""")
def class_canvas(spark, sf_dir):
    p = b.rgb(spark, sf_dir)
    k = F.col("r") % 4
    painted = p.select(*_KEY, "row", "col", F.when(k == 0, 2).when(k == 1, 5).when(k == 2, 40).otherwise(99).alias("class"))
    return raster.class_codes(painted, [2, 5, 40], raster.data_mask(p, raster.canvas(spark, 18, 18), _KEY), _KEY)


@query(f"""WITH {b.RGB}, o AS (SELECT cell_id, row, col, r / 50.0::DOUBLE AS v FROM rgb), {_frame(18, 18)}
  SELECT cell_id, row, col, coalesce(CAST(floor(v * 255) AS INTEGER), 0) AS r, coalesce(CAST(floor(v * 255) AS INTEGER), 0) AS g, 0 AS b, CASE WHEN v IS NULL THEN 0 ELSE 255 END AS a FROM f LEFT JOIN o USING (cell_id, row, col)""")
def rgba_canvas(spark, sf_dir):
    v = F.col("r") / F.lit(50.0)
    p = b.rgb(spark, sf_dir).select(*_KEY, "row", "col", v.alias("r"), v.alias("g"), F.lit(0.0).alias("b"))
    return raster.rgba(p, None, raster.canvas(spark, 18, 18), _KEY)


@query(f"WITH {b.PIXELS} SELECT row // 8 AS trow, col // 8 AS tcol, count(*) AS n, CAST(sum(row % 8 * 10 + col % 8) AS BIGINT) AS spots FROM pixels GROUP BY 1, 2")
def tile_split(spark, sf_dir):
    t = raster.tile_split(b.pixels(spark, sf_dir), 8)
    back = raster.tile_split(raster.tile_merge(t, 8), 8)
    return back.groupBy(F.col("trow").cast("int").alias("trow"), F.col("tcol").cast("int").alias("tcol")).agg(F.count("*").alias("n"), F.sum(F.col("wrow") * 10 + F.col("wcol")).alias("spots"))


@query("SELECT p_size, CAST((p_size // 2) * ((p_size + 3) // 2) AS BIGINT) AS n FROM (SELECT DISTINCT p_size FROM part)")
def super_tiles(spark, sf_dir):
    return b.read(spark, sf_dir, "part").select("p_size").distinct().select("p_size", raster.super_tiles(F.col("p_size"), F.col("p_size") + 3).cast("long").alias("n"))


@query(f"WITH {b.RGB}, {_frame(21, 21)} SELECT f.cell_id, f.row, f.col, coalesce(rgb.r, -1) AS r FROM f LEFT JOIN rgb ON rgb.cell_id = f.cell_id AND rgb.row = least(f.row, 15) AND rgb.col = least(f.col, 15)")
def edge_pad(spark, sf_dir):
    return raster.edge_padded(b.rgb(spark, sf_dir).select(*_KEY, "row", "col", "r"), 16, 16, 7, _KEY).na.fill(-1, ["r"])


@query(f"WITH {b.RGB} SELECT cell_id, row // 4 AS wy, round(avg(CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS black_frac FROM rgb GROUP BY 1, 2 HAVING avg(CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) >= 0.02")
def black_windows(spark, sf_dir):
    p = b.rgb(spark, sf_dir).withColumn("wy", F.expr("row div 4").cast("int"))
    return raster.black_windows(p, ["cell_id", "wy"], 0.02).withColumn("black_frac", F.round("black_frac", 6))


@query(f"WITH {b.RGB}, {_frame(10, 10)} SELECT f.cell_id, f.row, f.col, coalesce(rgb.r, 0) AS r FROM f LEFT JOIN rgb ON rgb.cell_id = f.cell_id AND rgb.row = f.row + 9 AND rgb.col = f.col + 4")
def window_read(spark, sf_dir):
    return raster.window_read(b.rgb(spark, sf_dir), 9, 4, 10, 10, ["r"], _KEY).select(*_KEY, "row", "col", "r")


@query(f"""WITH {b.BOXES}, p AS (SELECT DISTINCT label, x, y FROM (SELECT label, unnest([xmin, xmin, xmax, xmax]) AS x, unnest([ymin, ymax, ymin, ymax]) AS y FROM boxes)),
  outer_p AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p a JOIN p z ON a.label = z.label WHERE a.label = p.label AND a.x = p.x AND z.x = p.x AND a.y < p.y AND z.y > p.y) ),
  e AS (SELECT a.label, a.x AS x, a.y AS y, z.x AS x2, z.y AS y2 FROM outer_p a JOIN outer_p z ON a.label = z.label AND (a.x <> z.x OR a.y <> z.y)
    WHERE NOT EXISTS (SELECT 1 FROM outer_p c WHERE c.label = a.label AND ((z.x - a.x) * (c.y - a.y) - (z.y - a.y) * (c.x - a.x) < 0
      OR ((z.x - a.x) * (c.y - a.y) - (z.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (z.x - a.x) + (c.y - a.y) * (z.y - a.y) < 0 OR (c.x - z.x) * (a.x - z.x) + (c.y - z.y) * (a.y - z.y) < 0))))),
  h AS (SELECT label, sum(x * y2 - x2 * y) / 2 AS area, sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS length, CAST(count(*) AS INTEGER) AS n_corners FROM e GROUP BY 1),
  xs AS (SELECT label, xmin AS x FROM boxes UNION SELECT label, xmax FROM boxes), ys AS (SELECT label, ymin AS y FROM boxes UNION SELECT label, ymax FROM boxes),
  xi AS (SELECT label, x, lead(x) OVER (PARTITION BY label ORDER BY x) AS x2 FROM xs), yi AS (SELECT label, y, lead(y) OVER (PARTITION BY label ORDER BY y) AS y2 FROM ys),
  u AS (SELECT xi.label, sum((x2 - x) * (y2 - y)) AS filled FROM xi JOIN yi ON xi.label = yi.label WHERE x2 IS NOT NULL AND y2 IS NOT NULL AND EXISTS (SELECT 1 FROM boxes WHERE boxes.label = xi.label AND xmin <= x AND x2 <= xmax AND ymin <= y AND y2 <= ymax) GROUP BY 1)
  SELECT label, round(area / 1e6::DOUBLE, 9) AS area_km2, round(length / 1e3::DOUBLE, 9) AS perim_km, round(filled / area, 9) AS fill_ratio, n_corners FROM h JOIN u USING (label)""")
def study_hull(spark, sf_dir):
    out = geo.study_area(b.boxes(spark, sf_dir), CELL, ["label"])
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("area_km2", "perim_km", "fill_ratio")], "n_corners")


@query(f"""WITH RECURSIVE {b.RGB}, c AS (SELECT DISTINCT (row + cell_id // 5 * 16) // 2 AS row, (col + cell_id % 5 * 16) // 2 AS col FROM rgb WHERE r <> 0 OR g <> 0 OR b <> 0),
  t AS (SELECT row, col, row AS r0, col AS c0 FROM c UNION SELECT c.row, c.col, t.r0, t.c0 FROM t JOIN c ON abs(c.row - t.row) + abs(c.col - t.col) = 1)
  SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM t GROUP BY 1, 2 HAVING count(*) >= 3""")
def footprint(spark, sf_dir):
    return raster.footprint(b.rgb(spark, sf_dir).select((F.col("row") + F.expr("cell_id div 5").cast("int") * 16).alias("row"), (F.col("col") + (F.col("cell_id") % 5).cast("int") * 16).alias("col"), "r", "g", "b"), 2, 3)
