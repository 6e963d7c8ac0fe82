"""Compositions over many sites and blobs, with a stand-in model whose results SQL can state."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import geo, sites
from tessera.plans import bindings as b
from tessera.plans.registry import query
from tessera.session import shared_folder

#: sites are labels of boxes; all but the last have a raster of 64 x 64 pixels of two metres around the origin
AFFINE = [2.0, 0.0, -64.0, 0.0, -2.0, 64.0]
PATCH, STEP, LEAST = 8, 4, 0.02


def block_means():
    """A model whose patch vectors are the means of STEP x STEP pixels."""
    def model(image: np.ndarray):
        n = -(-image.shape[0] // STEP)
        whole = np.zeros((n * STEP, n * STEP, 3), np.float32)
        whole[: image.shape[0], : image.shape[1]] = image
        return whole.reshape(n, STEP, n, STEP, 3).mean((1, 3)), image.mean((0, 1))

    return model


def contextual():
    """A model that looks at the whole window: half its mean is taken from every patch."""
    inner = block_means()

    def model(image: np.ndarray):
        patches, whole = inner(image)
        return patches - whole / 2, whole

    return model


def pixels(spark, sf_dir, sites_: int = 9):
    li = b.read(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("site_"), F.col("l_suppkey") % sites_).alias("site_id"), (F.col("l_partkey") % 64).cast("int").alias("row"), (F.col("l_orderkey") % 64).cast("int").alias("col")).agg(
        F.max(F.when(F.col("l_quantity") < 25, 0).otherwise(F.col("l_quantity").cast("int"))).alias("r"), F.max(F.when(F.col("l_returnflag") == "R", 9).otherwise(0)).alias("g"), F.lit(0).alias("b")
    )


_SITES = f"""{b.BOXES}, tiles AS (SELECT 'site_' || label AS site_id, * FROM boxes),
  pixels AS (SELECT 'site_' || (l_suppkey % 9) AS site_id, CAST(l_partkey % 64 AS INTEGER) AS row, CAST(l_orderkey % 64 AS INTEGER) AS col, max(CASE WHEN l_quantity < 25 THEN 0 ELSE CAST(l_quantity AS INTEGER) END) AS r, max(CASE WHEN l_returnflag = 'R' THEN 9 ELSE 0 END) AS g FROM lineitem GROUP BY 1, 2, 3),
  clipped AS (SELECT * FROM (SELECT site_id, greatest(xmin, -64) AS xmin, greatest(ymin, -64) AS ymin, least(xmax, 64) AS xmax, least(ymax, 64) AS ymax FROM tiles WHERE label < 9) WHERE xmin < xmax AND ymin < ymax),
  area AS (SELECT site_id, floor((min(xmin) + 64) / 2) AS c0, floor((64 - max(ymax)) / 2) AS r0, ceil((max(xmax) + 64) / 2) AS cx, ceil((64 - min(ymin)) / 2) AS rx FROM clipped GROUP BY 1),
  full_grid AS (SELECT site_id, c0 + 8 * j.range AS c, r0 + 8 * i.range AS r FROM area, range(20) i, range(20) j WHERE j.range < ceil((cx - c0) / 8) AND i.range < ceil((rx - r0) / 8)),
  near AS (SELECT * FROM full_grid f WHERE EXISTS (SELECT 1 FROM clipped t WHERE t.site_id = f.site_id AND t.xmin <= (c + 8) * 2 - 64 AND c * 2 - 64 <= t.xmax AND t.ymin <= 64 - r * 2 AND 64 - (r + 8) * 2 <= t.ymax)),
  kept AS (SELECT * FROM near f WHERE (SELECT count(*) FROM pixels p WHERE p.site_id = f.site_id AND (p.r <> 0 OR p.g <> 0) AND p.row >= f.r AND p.row < f.r + 8 AND p.col >= f.c AND p.col < f.c + 8) / 64.0::DOUBLE >= {LEAST})"""


def _run(spark, sf_dir, out_root, labels, loader=block_means):
    tiles = b.boxes(spark, sf_dir).withColumn("site_id", F.concat(F.lit("site_"), "label"))
    rasters = spark.createDataFrame([(f"site_{i}", AFFINE, 64, 64) for i in range(9)], "site_id string, affine array<double>, height int, width int")
    work = spark.createDataFrame([(f"site_{i}", None) for i in labels] + [("site_77", None), ("lost", "unknown site")], "site_id string, message string")
    return sites.run_sites(work, tiles, rasters, pixels(spark, sf_dir), loader, out_root, patch=PATCH, least=LEAST, settings={"model": "block means"})


@query(f"""WITH {_SITES}, n AS (SELECT site_id, (SELECT count(*) FROM full_grid f WHERE f.site_id = a.site_id) AS n_full, (SELECT count(*) FROM near f WHERE f.site_id = a.site_id) AS n_near, (SELECT count(*) FROM kept f WHERE f.site_id = a.site_id) AS n_kept FROM area a),
  w AS (SELECT 'site_' || range AS site_id, range AS i FROM range(10) UNION ALL VALUES ('site_77', 77), ('lost', NULL)),
  s AS (SELECT w.site_id, i, coalesce(n_full, 0) AS n_full, coalesce(n_near, 0) AS n_near, coalesce(n_kept, 0) AS n_kept, (SELECT count(*) FROM tiles t WHERE t.site_id = w.site_id) AS n_tiles,
    i % 2 = 0 AND i < 9 AND coalesce(n_kept, 0) > 0 AS done, CASE WHEN i IS NULL THEN 'unknown site' WHEN i = 77 THEN 'no such tiles' WHEN i = 9 THEN 'no such raster' END AS message FROM w LEFT JOIN n USING (site_id))
  SELECT site_id, CASE WHEN done THEN 'skipped' WHEN message IS NOT NULL THEN 'skip' ELSE 'ok' END AS status, message, n_tiles, CASE WHEN done THEN 0 ELSE n_full END AS n_cells_full, CASE WHEN done THEN 0 ELSE n_near END AS after_tile_filter, CASE WHEN done THEN 0 ELSE n_kept END AS n_cells, CASE WHEN done THEN 0 ELSE n_near - n_kept END AS dropped_void FROM s""")
def run_sites(spark, sf_dir):
    """Every second site, then all of them: the second run takes up where the first stopped."""
    out_root = f"{shared_folder(spark)}/sites-{uuid.uuid4().hex}"
    _run(spark, sf_dir, out_root, range(0, 9, 2))
    return _run(spark, sf_dir, out_root, range(10))


@query(f"""WITH {_SITES}, m AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY r, c) - 1 AS cell_id, r, c FROM kept),
  q AS (SELECT m.site_id, cell_id, CAST(i.range AS INTEGER) AS pr, CAST(j.range AS INTEGER) AS pc, r + 4 * i.range AS r0, c + 4 * j.range AS c0 FROM m, range(2) i, range(2) j)
  SELECT q.site_id, cell_id, pr, pc, round(coalesce(sum(p.r), 0) / 16.0::DOUBLE, 4) AS v0, round(coalesce(sum(p.g), 0) / 16.0::DOUBLE, 4) AS v1 FROM q LEFT JOIN pixels p ON p.site_id = q.site_id AND p.row >= r0 AND p.row < r0 + 4 AND p.col >= c0 AND p.col < c0 + 4 GROUP BY 1, 2, 3, 4""")
def site_patches(spark, sf_dir):
    """The patch vectors that a run of all sites has stored."""
    out_root = f"{shared_folder(spark)}/sites-{uuid.uuid4().hex}"
    _run(spark, sf_dir, out_root, range(9))
    v = lambda i: F.round(F.get("vec", i).cast("double"), 4).alias(f"v{i}")
    return spark.read.parquet(f"{out_root}/patches").select("site_id", "cell_id", "pr", "pc", v(0), v(1))


@query(f"""WITH {b.RGB}, w AS (SELECT cell_id, 4 * i.range AS r0, 4 * j.range AS c0 FROM (SELECT DISTINCT cell_id FROM rgb), range(3) i, range(3) j),
  live AS (SELECT w.* FROM w LEFT JOIN rgb p ON p.cell_id = w.cell_id AND p.row >= r0 AND p.row < r0 + 8 AND p.col >= c0 AND p.col < c0 + 8 GROUP BY 1, 2, 3 HAVING 64 - count(*) FILTER (r <> 0 OR g <> 0 OR b <> 0) < 0.98 * 64),
  spots AS (SELECT DISTINCT cell_id, r0 // 4 + i.range AS row, c0 // 4 + j.range AS col FROM live, range(2) i, range(2) j)
  SELECT CAST(s.cell_id AS VARCHAR) AS uuid, CAST(s.row AS INTEGER) AS row, CAST(s.col AS INTEGER) AS col, round(coalesce(sum(r), 0) / 16.0::DOUBLE, 4) AS v0, round(coalesce(sum(g), 0) / 16.0::DOUBLE, 4) AS v1 FROM spots s LEFT JOIN rgb p ON p.cell_id = s.cell_id AND p.row // 4 = s.row AND p.col // 4 = s.col GROUP BY 1, 2, 3""")
def embed_blobs(spark, sf_dir):
    """Windows that overlap, holes skipped, patches averaged."""
    p = b.rgb(spark, sf_dir).withColumn("uuid", F.col("cell_id").cast("string"))
    blobs = p.select("uuid").distinct().withColumns({"width": F.lit(16), "height": F.lit(16)})
    out = sites.embed_blob(geo.overlapping_windows(blobs, 8, 4, 4), p.select("uuid", "row", "col", "r", "g", "b"), block_means, STEP)
    return out.select("uuid", "row", "col", *[F.round(F.get("vec", i), 4).alias(f"v{i}") for i in range(2)])


@query("""WITH p AS (SELECT CAST(l_partkey % 32 AS INTEGER) AS row, CAST(l_orderkey % 32 AS INTEGER) AS col, max(l_quantity) AS r, min(l_tax) * 100 AS g FROM lineitem GROUP BY 1, 2),
  n AS (SELECT row // 4 AS pr, col // 4 AS pc, sum(r) / 16 AS r, sum(g) / 16 AS g FROM p GROUP BY 1, 2),
  s AS (SELECT * FROM (VALUES (8), (16), (32)) t(size)),
  w AS (SELECT size, row // size AS wr, col // size AS wc, sum(r) / (size * size) AS r, sum(g) / (size * size) AS g FROM p, s GROUP BY 1, 2, 3),
  f AS (SELECT w.size, pr, pc, n.r - w.r / 2 AS r, n.g - w.g / 2 AS g FROM n JOIN w ON n.pr * 4 // size = wr AND n.pc * 4 // size = wc)
  SELECT CAST(a.size AS INTEGER) AS size, round(avg((a.r * z.r + a.g * z.g) / ((sqrt(a.r * a.r + a.g * a.g) + 1e-8) * (sqrt(z.r * z.r + z.g * z.g) + 1e-8))), 5) AS mean_cosine, count(*) AS n FROM f a JOIN f z ON z.size = 32 AND a.pr = z.pr AND a.pc = z.pc GROUP BY 1""")
def tiling_drift(spark, sf_dir):
    """Features of windows of three sizes against those of the largest."""
    li = b.read(spark, sf_dir, "lineitem")
    p = li.groupBy((F.col("l_partkey") % 32).cast("int").alias("row"), (F.col("l_orderkey") % 32).cast("int").alias("col")).agg(F.max("l_quantity").alias("r"), (F.min("l_tax") * 100).alias("g"), F.lit(0.0).alias("b"))
    return sites.tiling_drift(p, [8, 16, 32], 32, contextual, STEP, 32).select("size", F.round("mean_cosine", 5).alias("mean_cosine"), "n")
