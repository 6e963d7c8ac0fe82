"""Statistics, joins, set operations, de-duplication and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import taxonomy
from tessera.operators import runs, stats
from tessera.plans import bindings as b
from tessera.plans.registry import query

_SEVEN = ", ".join(f"({s}, {d})" for s, d in sorted(taxonomy.mapping("seven").items()))
_NONE = ", ".join(map(str, taxonomy.NO_DATA))
_NAMES = ", ".join("({}, {}, '{}')".format(i, f"'{s}'" if s else "NULL", f) for i, s, f in taxonomy.NAMES)
_MAP = f"seven(src, dst) AS (VALUES {_SEVEN})"


@query(f"""WITH {b.TILES} SELECT a.site, a.resolution, a.dataset_version, a.n_tiles_total, a.total_pixels, a.total_no_data_pixels,
  round(a.m, 6) AS mean_no_data_frac, round(a.d, 6) AS median_no_data_frac, round(a.p, 6) AS p90_no_data_frac, round(a.f, 6) AS frac_tiles_mostly_no_data,
  a.n_tiles_train, a.n_tiles_val, a.n_unique_orig_classes_union FROM (
  SELECT site, resolution, max(dataset_version) AS dataset_version, count(*) AS n_tiles_total, CAST(sum(total_pixels) AS BIGINT) AS total_pixels, CAST(sum(pixels_no_data) AS BIGINT) AS total_no_data_pixels,
    avg(no_data_frac) AS m, quantile_cont(no_data_frac, 0.5) AS d, quantile_cont(no_data_frac, 0.9) AS p, avg(CASE WHEN no_data_frac > 0.9 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS f,
    count(*) FILTER (split = 'train') AS n_tiles_train, count(*) FILTER (split = 'val') AS n_tiles_val, count(DISTINCT original_class_id) AS n_unique_orig_classes_union
  FROM tiles GROUP BY 1, 2) a""")
def site_rollup(spark, sf_dir):
    t = b.tiles(spark, sf_dir)
    out = stats.site_rollup(t, t.select("site", "resolution", "original_class_id"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_no_data_frac", "median_no_data_frac", "p90_no_data_frac", "frac_tiles_mostly_no_data")})


@query(f"WITH {b.TILES} SELECT site, resolution, count(*) FILTER (split = 'train') AS n_tiles_train, count(*) FILTER (split = 'val') AS n_tiles_val FROM tiles GROUP BY 1, 2")
def split_pivot(spark, sf_dir):
    return stats.split_pivot(b.tiles(spark, sf_dir))


@query(f"WITH {b.TILES} SELECT site, resolution, count(DISTINCT original_class_id) AS n_unique_orig_classes_union FROM tiles GROUP BY 1, 2")
def distinct_classes(spark, sf_dir):
    return stats.distinct_classes(b.tiles(spark, sf_dir))


@query(f"WITH {b.MASKS} SELECT tile, class, count(*) AS pixel_count FROM masks GROUP BY 1, 2")
def class_histogram(spark, sf_dir):
    return stats.class_histogram(b.masks(spark, sf_dir), ["tile"])


_TILE_SQL = f"""WITH {b.MASKS}, {_MAP},
  m AS (SELECT masks.*, class IN ({_NONE}) AS nd, coalesce(dst, class) AS coarse, (dst IS NOT NULL OR class IN ({_NONE})) AS known FROM masks LEFT JOIN seven ON class = src),
  s AS (SELECT tile, count(*) AS total_pixels, count(*) FILTER (nd) AS pixels_no_data,
    {", ".join(f"count(*) FILTER (coarse = {k} AND NOT nd) AS pixels_class_{k}" for k in taxonomy.ROLLED_UP)},
    CAST(count(DISTINCT class) AS SMALLINT) AS n_unique_orig_classes,
    coalesce((max(row) FILTER (NOT nd) - min(row) FILTER (NOT nd) + 1) * (max(col) FILTER (NOT nd) - min(col) FILTER (NOT nd) + 1), 0) AS area
    FROM m GROUP BY tile HAVING bool_and(known))"""


@query(f"""{_TILE_SQL} SELECT tile, total_pixels, pixels_no_data, {", ".join(f"pixels_class_{k}" for k in taxonomy.ROLLED_UP)}, n_unique_orig_classes,
  CAST(total_pixels - pixels_no_data - ({" + ".join(f"pixels_class_{k}" for k in taxonomy.ROLLED_UP)}) AS BIGINT) AS pixels_unmapped, round(pixels_no_data::DOUBLE / total_pixels, 6) AS no_data_frac FROM s""")
def nodata_stats(spark, sf_dir):
    out = stats.tile_statistics(b.masks(spark, sf_dir), ["tile"]).drop("annot_bbox_area_frac", "annot_in_bbox_density")
    return out.withColumn("no_data_frac", F.round("no_data_frac", 6))


@query(f"""{_TILE_SQL} SELECT tile, round(area::DOUBLE / total_pixels, 6) AS annot_bbox_area_frac, CASE WHEN area > 0 THEN round((total_pixels - pixels_no_data)::DOUBLE / area, 6) ELSE 0.0::DOUBLE END AS annot_in_bbox_density FROM s""")
def annot_bbox(spark, sf_dir):
    out = stats.tile_statistics(b.masks(spark, sf_dir), ["tile"])
    return out.select("tile", F.round("annot_bbox_area_frac", 6).alias("annot_bbox_area_frac"), F.round("annot_in_bbox_density", 6).alias("annot_in_bbox_density"))


@query(f"WITH {b.MASKS}, {_MAP} SELECT tile, coalesce(dst, class) AS class, count(*) AS n FROM masks LEFT JOIN seven ON class = src GROUP BY 1, 2")
def taxonomy_remap(spark, sf_dir):
    return taxonomy.remap(b.masks(spark, sf_dir), "class", "seven").groupBy("tile", "class").agg(F.count("*").alias("n"))


@query(f"""WITH {b.MASKS}, {_MAP}, m AS (SELECT masks.*, CASE WHEN class IN ({_NONE}) THEN 0 ELSE dst END AS mapped FROM masks LEFT JOIN seven ON class = src)
  SELECT tile, mapped, count(*) AS n FROM m WHERE tile NOT IN (SELECT tile FROM m WHERE mapped IS NULL) GROUP BY 1, 2""")
def remap_strict_reject(spark, sf_dir):
    return taxonomy.remap_strict(b.masks(spark, sf_dir), "class", ["tile"]).groupBy("tile", "mapped").agg(F.count("*").alias("n"))


@query(f"WITH {b.MASKS}, {_MAP} SELECT tile, CAST(count(DISTINCT class) AS INTEGER) AS n_unknown, CAST(min(class) AS INTEGER) AS first_unknown FROM masks WHERE class NOT IN (SELECT src FROM seven) AND class NOT IN ({_NONE}) GROUP BY 1")
def class_except(spark, sf_dir):
    return taxonomy.rejected(b.masks(spark, sf_dir), "class", ["tile"]).select("tile", F.size("unknown").alias("n_unknown"), F.get("unknown", 0).alias("first_unknown"))


@query(f"WITH names(id, short, long) AS (VALUES {_NAMES}), c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS INTEGER) ELSE CAST(p_partkey % 10 AS INTEGER) END AS class FROM part) SELECT p_partkey, coalesce(s.short, CAST(class AS VARCHAR)) AS short_name, coalesce(s.long, CAST(class AS VARCHAR)) AS full_name FROM c LEFT JOIN names s ON class = id")
def class_name_fallback(spark, sf_dir):
    k = F.col("p_partkey")
    p = b.read(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, k.cast("int")).otherwise((k % 10).cast("int")).alias("class"))
    out = taxonomy.with_class_name(taxonomy.with_class_name(p, "class", False, "short_name"), "class", True, "full_name")
    return out.select("p_partkey", "short_name", "full_name")


def _coarse_sql(scheme):
    return f"WITH {b.MASKS}, t(src, dst) AS (VALUES {', '.join(f'({s}, {d})' for s, d in sorted(taxonomy.mapping(scheme).items()))}) SELECT coalesce(dst, class) AS class, count(*) AS n FROM masks LEFT JOIN t ON class = src GROUP BY 1"


def _coarse(scheme):
    def run(spark, sf_dir):
        return taxonomy.remap(b.masks(spark, sf_dir), "class", scheme).groupBy("class").agg(F.count("*").alias("n"))

    run.__name__ = f"taxonomy_{scheme}"
    return run


for _scheme in ("six", "three", "two", "erosion", "identity"):
    query(_coarse_sql(_scheme))(_coarse(_scheme))


@query(f"WITH {b.TILES} SELECT mask_path, tile_id FROM tiles t WHERE NOT EXISTS (SELECT 1 FROM tiles k WHERE k.mask_path = t.mask_path AND k.o_orderdate < TIMESTAMP '1997-01-01')")
def incremental_anti(spark, sf_dir):
    t = b.tiles(spark, sf_dir)
    return stats.new_tiles(t, t.where("o_orderdate < timestamp'1997-01-01'")).select("mask_path", "tile_id")


@query(f"WITH {b.TILES} SELECT site, count(*) AS kept FROM tiles WHERE o_orderkey % 4 <> 0 GROUP BY 1")
def prune_semi(spark, sf_dir):
    t = b.tiles(spark, sf_dir)
    return stats.pruned(t, t, t.where("o_orderkey % 4 <> 0"))[0].groupBy("site").agg(F.count("*").alias("kept"))


@query(f"WITH {b.TILES} SELECT site, resolution, split, count(*) AS n FROM tiles WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2, 3")
def prune_classes(spark, sf_dir):
    t = b.tiles(spark, sf_dir)
    return stats.pruned(t, t, t.where("o_orderkey % 4 <> 0"))[1].groupBy("site", "resolution", "split").agg(F.count("*").alias("n"))


_SHARED = f"""WITH {b.TILES}, g AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY image_path ORDER BY CASE WHEN mask_path LIKE '%/mask\\_%' ESCAPE '\\' THEN 0 ELSE 1 END, mask_path) AS rank,
  min(content) OVER w = max(content) OVER w AS agrees FROM tiles WHERE image_exists WINDOW w AS (PARTITION BY image_path))"""


@query(f"{_SHARED} SELECT mask_path, image_path, CAST(rank AS INTEGER) AS rank, agrees FROM g WHERE n > 1")
def dedup_groups(spark, sf_dir):
    return stats.shared_images(b.tiles(spark, sf_dir)).select("mask_path", "image_path", "rank", "agrees")


@query(f"{_SHARED} SELECT mask_path FROM tiles WHERE mask_path NOT IN (SELECT mask_path FROM g WHERE n > 1 AND rank > 1 AND agrees)")
def dedup_keep(spark, sf_dir):
    t = b.tiles(spark, sf_dir)
    return stats.deduplicated(t, t)[0].select("mask_path")


@query(f"{_SHARED} SELECT image_path, count(*) AS n_rows FROM g WHERE n > 1 AND NOT agrees GROUP BY 1")
def dedup_conflicts(spark, sf_dir):
    return stats.dedup_conflicts(b.tiles(spark, sf_dir))


@query(f"{_SHARED} SELECT t.tile_id, t.original_class_id FROM tiles t WHERE NOT EXISTS (SELECT 1 FROM g WHERE n > 1 AND rank > 1 AND agrees AND g.tile_id = t.tile_id AND g.site = t.site AND g.resolution = t.resolution AND g.split = t.split)")
def dedup_cascade(spark, sf_dir):
    t = b.tiles(spark, sf_dir)
    return stats.deduplicated(t, t)[1].select("tile_id", "original_class_id")


@query(f"WITH {b.TILES} SELECT tile_id, CASE WHEN image_exists AND o_orderkey % 2 = 0 THEN image_path END AS image_path, (image_exists AND o_orderkey % 2 = 0) AS image_exists FROM tiles")
def reconcile_linkage(spark, sf_dir):
    t = b.tiles(spark, sf_dir)
    return stats.reconciled(t, t.where("o_orderkey % 2 = 0").select("mask_path", "image_path", "image_exists")).select("tile_id", "image_path", "image_exists")


@query(f"WITH {b.TILES} SELECT site, count(*) AS n, CAST(sum(pixels_no_data) AS BIGINT) AS px FROM tiles GROUP BY 1")
def append_union(spark, sf_dir):
    t = b.tiles(spark, sf_dir)
    old, new = t.where("o_orderkey % 2 = 0"), t.where("o_orderkey % 2 = 1")
    tiles, _ = stats.updated(old, old.select(*stats.TILE_KEY), t, new, new.select(*stats.TILE_KEY))
    return tiles.groupBy("site").agg(F.count("*").alias("n"), F.sum("pixels_no_data").alias("px"))


@query("SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def common_cells(spark, sf_dir):
    return stats.common_members(b.read(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_key_guard(spark, sf_dir):
    return stats.duplicate_keys(b.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k, count(*) AS n FROM events GROUP BY 1")
def json_flatten(spark, sf_dir):
    e = b.read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("props"))
    return stats.flattened(e, "props").groupBy("event_type").agg(F.sum("k").alias("total_k"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT CAST(label AS BIGINT) AS label, CAST((label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 11 AS BIGINT) AS pred FROM embeddings) SELECT label, pred, count(*) AS n FROM p GROUP BY 1, 2""")
def confusion(spark, sf_dir):
    return stats.confusion(_guesses(spark, sf_dir))


def _guesses(spark, sf_dir):
    e = b.read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("label"), ((F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)) % 11).cast("long").alias("pred"))


@query("""WITH p AS (SELECT CAST(label AS BIGINT) AS label, CAST((label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 11 AS BIGINT) AS pred FROM embeddings),
  c AS (SELECT label AS class FROM p UNION SELECT pred FROM p),
  s AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS support, (SELECT count(*) FROM p WHERE pred = class) AS predicted, (SELECT count(*) FROM p WHERE label = class AND pred = class) AS hit FROM c),
  r AS (SELECT class, CAST(support AS BIGINT) AS support, CASE WHEN predicted > 0 THEN hit::DOUBLE / predicted ELSE 0.0::DOUBLE END AS p, CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0.0::DOUBLE END AS r FROM s)
  SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0.0::DOUBLE END AS f1 FROM r""")
def class_report(spark, sf_dir):
    return stats.class_report(_guesses(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("SELECT round(avg(CASE WHEN label = (label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 11 THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS accuracy, count(*) AS n FROM embeddings")
def accuracy(spark, sf_dir):
    return stats.accuracy(_guesses(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT c_nationkey AS site, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS done, count(*) AS total FROM customer GROUP BY 1")
def run_status(spark, sf_dir):
    done = b.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return stats.run_status(b.read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "site"), done, ["c_custkey"])


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'skip' WHEN o_orderkey % 13 = 0 THEN 'fail' WHEN o_orderstatus = 'F' THEN 'skipped' ELSE 'ok' END AS status FROM orders) GROUP BY 1""")
def run_summary(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders")
    error = F.when(F.col("o_orderkey") % 11 == 0, "no path").when(F.col("o_orderkey") % 13 == 0, "out of memory")
    return stats.status_summary(o.select(runs.outcome(error, F.col("o_orderstatus") == "F").alias("status")))


@query(f"WITH {b.BOXES} SELECT label, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM boxes GROUP BY 1")
def bounds(spark, sf_dir):
    return stats.bounds(b.boxes(spark, sf_dir), ["label"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3 OR (c_custkey % 10 = 4 AND c_acctbal <> 0) OR c_custkey % 10 = 5")
def parity_check(spark, sf_dir):
    c = b.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("whole"), F.col("c_acctbal").alias("close"))
    k = F.col("c_custkey") % 10
    again = c.where(k != 5).select("c_custkey", F.when(k == 3, F.col("whole") + 1).otherwise(F.col("whole")).alias("whole"), F.when(k == 4, F.col("close") * 1.001).otherwise(F.col("close") * (1 + 1e-9)).alias("close"))
    return stats.parity(c, again, ["c_custkey"], ["whole"], ["close"]).select("c_custkey")
