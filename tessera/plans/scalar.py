"""Names, references, resolution policy, affine arithmetic, ordering and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric as fn
from tessera.functions import paths as fp
from tessera.operators import runs
from tessera.plans import bindings as b
from tessera.plans.registry import query
from tessera.sources import tiles as src


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.07::DOUBLE WHEN 1 THEN 0.15::DOUBLE ELSE p_size::DOUBLE / 250 END AS res, p_partkey % 2 = 0 AS high FROM part)
  SELECT p_partkey, CASE WHEN res < 0.07::DOUBLE THEN 1024 WHEN res < 0.15::DOUBLE THEN 512 ELSE 256 END AS patch_size,
    (CASE WHEN res < 0.07::DOUBLE THEN 1 WHEN res < 0.15::DOUBLE THEN 2 ELSE 4 END) * (CASE WHEN high THEN 2 ELSE 1 END) AS upsample,
    round(res * 16 / ((CASE WHEN res < 0.07::DOUBLE THEN 1 WHEN res < 0.15::DOUBLE THEN 2 ELSE 4 END) * (CASE WHEN high THEN 2 ELSE 1 END)), 9) AS embed_gsd FROM r""")
def activity_params(spark, sf_dir):
    k = F.col("p_partkey")
    res = F.when(k % 4 == 0, 0.07).when(k % 4 == 1, 0.15).otherwise(F.col("p_size").cast("double") / 250)
    p = b.read(spark, sf_dir, "part").select("p_partkey", res.alias("res"), (k % 2 == 0).alias("high"))
    out = fn.activity_params(F.col("res"), F.col("high"))
    return p.select("p_partkey", out["patch_size"].alias("patch_size"), out["upsample"].alias("upsample"), F.round(out["embed_gsd"], 9).alias("embed_gsd"))


@query("SELECT p_partkey, trim(regexp_replace('##' || p_name || '/' || p_brand || '/ ' || p_type || '--', '[^0-9A-Za-z]+', '_', 'g'), '_') AS site_id FROM part")
def site_id_slug(spark, sf_dir):
    p = b.read(spark, sf_dir, "part")
    return p.select("p_partkey", fp.site_id(F.concat(F.lit("##"), "p_name", F.lit("/"), "p_brand", F.lit("/ "), "p_type", F.lit("--"))).alias("site_id"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' ELSE p_brand || '/' || p_name END AS site_key, replace(CASE p_partkey % 3 WHEN 0 THEN p_brand || '/10cm/v2' WHEN 1 THEN p_brand || '/v2' ELSE p_brand || '/' || p_name || '/10cm/v2' END, '/', '__') AS archived,
  CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'x_' || p_name END AS cleaned FROM part""")
def site_keys(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat("p_brand", F.lit("/10cm/v2"))).when(k % 3 == 1, F.concat("p_brand", F.lit("/v2"))).otherwise(F.concat("p_brand", F.lit("/"), "p_name", F.lit("/10cm/v2")))
    stem = F.when(k % 2 == 0, F.concat(F.lit("image_"), "p_name", F.lit("_part"))).otherwise(F.concat(F.lit("x_"), "p_name"))
    return b.read(spark, sf_dir, "part").select("p_partkey", fp.site_key(path).alias("site_key"), fp.archived_site_id(path).alias("archived"), fp.clean_key(stem).alias("cleaned"))


@query("SELECT c_custkey, '/store/' || c_mktsegment || '#' || c_custkey AS ref, '/store/' || c_mktsegment AS path, c_custkey AS idx, 'cell_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS cell, c_mktsegment || '#' || c_custkey AS relative FROM customer")
def ref_codec(spark, sf_dir):
    c = b.read(spark, sf_dir, "customer").select("c_custkey", fp.make_ref(F.concat(F.lit("/store/"), "c_mktsegment"), F.col("c_custkey")).alias("ref"))
    relative = fp.relative_ref(F.col("ref"), "/store")
    return c.select("c_custkey", fp.absolute_ref(relative, "/store").alias("ref"), fp.ref_path(F.col("ref")).alias("path"), fp.ref_index(F.col("ref")).alias("idx"), fp.cell_key(fp.ref_index(F.col("ref"))).alias("cell"), relative.alias("relative"))


@query("""WITH k AS (SELECT DISTINCT p_brand || ' ' || p_type AS key FROM part), s AS (SELECT key, regexp_replace(key, '[^A-Za-z0-9._-]', '_', 'g') AS clean FROM k)
  SELECT key, CASE WHEN count(*) OVER (PARTITION BY substr(clean, 1, 8)) > 1 THEN clean ELSE substr(clean, 1, 8) END AS dir_id FROM s""")
def dir_ids(spark, sf_dir):
    p = b.read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" "), "p_type").alias("key")).distinct()
    return fp.with_dir_id(p, "key")


@query("""SELECT p_partkey, 'Project ' || p_brand AS site, p_size || 'cm' AS resolution, 'v2' AS dataset_version, CASE WHEN p_partkey % 3 = 0 THEN 'val' ELSE 'train' END AS split, 'mask_' || p_partkey || '.npz' AS name FROM part WHERE p_partkey % 5 <> 0""")
def discover_masks(spark, sf_dir):
    k = F.col("p_partkey")
    folder = F.when(k % 5 == 0, "train").when(k % 3 == 0, "valannot").otherwise("trainannot")
    p = b.read(spark, sf_dir, "part").select(F.concat_ws("/", F.concat(F.lit("Project "), "p_brand"), F.concat(F.col("p_size").cast("string"), F.lit("cm")), F.lit("v2"), folder, F.concat(F.lit("mask_"), k.cast("string"), F.lit(".npz"))).alias("path"))
    found = src.discovered(p)
    return found.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("p_partkey"), "site", "resolution", "dataset_version", "split", "name")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '/i/mask_' || p_partkey WHEN p_partkey % 4 = 1 THEN '/i/image_' || p_partkey ELSE '/i/mask_' || p_partkey END AS image_path, p_partkey % 4 < 2 AS image_exists FROM part""")
def pair_images(spark, sf_dir):
    k = F.col("p_partkey")
    p = b.read(spark, sf_dir, "part")
    masks = p.select("p_partkey", F.lit("/i").alias("image_dir"), F.concat(F.lit("mask_"), k.cast("string")).alias("name"))
    there = p.where(k % 4 < 2).select(F.concat(F.when(k % 4 == 0, "/i/mask_").otherwise("/i/image_"), k.cast("string")).alias("image_path"))
    return src.paired(masks, there).select("p_partkey", "image_path", "image_exists")


@query("""WITH t AS (SELECT 'site' || (p_partkey % 9) AS uuid, CAST(p_partkey % 7 * 100 AS INTEGER) AS col, CAST(p_partkey % 5 * 100 AS INTEGER) AS row, CAST(60 + p_size AS INTEGER) AS w, CAST(50 + p_size AS INTEGER) AS h FROM part)
  SELECT uuid, max(col + w) AS width, max(row + h) AS height, count(*) AS n_tiles FROM t GROUP BY 1""")
def blob_discovery(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("image_site"), (k % 9).cast("string"), F.lit("_part_"), (k % 7 * 100).cast("string"), F.lit("_"), (k % 5 * 100).cast("string"), F.lit(".npz"))
    t = b.read(spark, sf_dir, "part").select(name.alias("name"), (F.col("p_size") + 60).alias("w"), (F.col("p_size") + 50).alias("h"), F.array(F.lit(0.1)).alias("affine"), F.lit(1).alias("srid"))
    return src.blobs(t).select("uuid", "width", "height", "n_tiles")


_AFFINE = "0.5::DOUBLE AS px, 0.0::DOUBLE AS sx, (s_suppkey * 10)::DOUBLE AS ox, 0.0::DOUBLE AS sy, -0.5::DOUBLE AS py, (s_nationkey * 100)::DOUBLE AS oy"


def _affine():
    return F.array(F.lit(0.5), F.lit(0.0), (F.col("s_suppkey") * 10).cast("double"), F.lit(0.0), F.lit(-0.5), (F.col("s_nationkey") * 100).cast("double"))


@query(f"WITH a AS (SELECT s_suppkey, {_AFFINE} FROM supplier) SELECT s_suppkey, ox + 4 * px AS xmin, oy + 20 * py AS ymin, ox + 16 * px AS xmax, oy + 8 * py AS ymax, (ox + 3 - ox) / px AS col, (oy - 4 - oy) / py AS row, 0.5::DOUBLE AS res FROM a")
def affine_boxes(spark, sf_dir):
    s = b.read(spark, sf_dir, "supplier").withColumn("a", _affine())
    box = fn.pixel_box_to_world(F.col("a"), F.lit(4), F.lit(8), F.lit(16), F.lit(20))
    col, row = fn.world_to_pixel(F.col("a"), F.get("a", 2) + 3, F.get("a", 5) - 4)
    return s.select("s_suppkey", *[v.alias(n) for n, v in box.items()], col.alias("col"), row.alias("row"), fn.native_res(F.col("a")).alias("res"))


@query(f"WITH a AS (SELECT s_suppkey, {_AFFINE} FROM supplier) SELECT s_suppkey, ox + 4.5::DOUBLE * px AS xmin, oy + 19.5::DOUBLE * py AS ymin, ox + 15.5::DOUBLE * px AS xmax, oy + 8.5::DOUBLE * py AS ymax FROM a")
def inset_boxes(spark, sf_dir):
    s = b.read(spark, sf_dir, "supplier").withColumn("a", _affine())
    return s.select("s_suppkey", *[v.alias(n) for n, v in fn.inset_box(F.col("a"), F.lit(4), F.lit(8), F.lit(12), F.lit(12)).items()])


@query(f"WITH a AS (SELECT s_suppkey, {_AFFINE} FROM supplier) SELECT s_suppkey, ox AS xmin, oy + 384 * py AS ymin, ox + 200 * px AS xmax, oy AS ymax FROM a")
def tile_bboxes(spark, sf_dir):
    s = b.read(spark, sf_dir, "supplier").withColumn("a", _affine())
    return s.select("s_suppkey", *[v.alias(n) for n, v in fn.tile_box(F.col("a"), F.lit(200), F.lit(384)).items()])


@query(f"""WITH {b.BOXES}, g AS (SELECT range AS i FROM range(4)) SELECT vec_id, CAST(g.i AS INTEGER) AS pr, CAST(h.i AS INTEGER) AS pc, round(xmin + (h.i + 0.5::DOUBLE) / 4 * (xmax - xmin), 6) AS x, round(ymax - (g.i + 0.5::DOUBLE) / 4 * (ymax - ymin), 6) AS y FROM boxes, g, g h""")
def patch_centres(spark, sf_dir):
    n = F.sequence(F.lit(0), F.lit(3))
    out = b.boxes(spark, sf_dir).withColumn("pr", F.explode(n)).withColumn("pc", F.explode(n))
    return out.select("vec_id", "pr", "pc", F.round(fn.patch_centre(F.col("xmin"), F.col("xmax"), F.col("pc"), 4), 6).alias("x"), F.round(fn.patch_centre_from_top(F.col("ymin"), F.col("ymax"), F.col("pr"), 4), 6).alias("y"))


@query("SELECT p_partkey, CAST((16 - p_size % 16) % 16 AS INTEGER) AS pad, CAST(ceil(greatest(p_size * 30, p_partkey % 1500)::DOUBLE / 512) * 512 AS INTEGER) AS target FROM part")
def pad_target(spark, sf_dir):
    return b.read(spark, sf_dir, "part").select("p_partkey", fn.padding(F.col("p_size"), 16).cast("int").alias("pad"), fn.window_target(F.col("p_size") * 30, F.col("p_partkey") % 1500, F.lit(512)).alias("target"))


@query("SELECT p_partkey, round((p_size * 5 / 255.0::DOUBLE - 0.43::DOUBLE) / 0.213::DOUBLE, 6) AS r, round((p_size * 5 / 255.0::DOUBLE - 0.296::DOUBLE) / 0.143::DOUBLE, 6) AS b FROM part")
def rgb_standardise(spark, sf_dir):
    v = F.col("p_size") * 5
    return b.read(spark, sf_dir, "part").select("p_partkey", F.round(fn.standardise(v, 0), 6).alias("r"), F.round(fn.standardise(v, 2), 6).alias("b"))


@query("""WITH n AS (SELECT c_custkey, pow(2::DOUBLE, c_custkey % 40) AS n FROM customer) SELECT c_custkey, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size FROM n""")
def human_bytes(spark, sf_dir):
    return b.read(spark, sf_dir, "customer").select("c_custkey", fn.human_bytes(F.pow(F.lit(2.0), F.col("c_custkey") % 40)).alias("size"))


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'vit7b16' ELSE 'vitl16' END AS model FROM part")
def model_choice(spark, sf_dir):
    gb = F.when(F.col("p_size") > 3, F.col("p_size").cast("double"))
    return b.read(spark, sf_dir, "part").select("p_partkey", fn.model_for(gb).alias("model"))


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) % 4 AS INTEGER) AS worker FROM customer")
def largest_first(spark, sf_dir):
    return runs.largest_first(b.read(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", 4).select("c_custkey", "worker")


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_name) - 1 AS i FROM customer) WHERE i % 5 = 2 AND i < 2 + 5 * 20")
def shard_assign(spark, sf_dir):
    return runs.sharded(b.read(spark, sf_dir, "customer"), "c_name", 2, 5, 20).select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def last_n(spark, sf_dir):
    return runs.last_n(b.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 25)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def first_n(spark, sf_dir):
    return runs.first_n(b.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 25)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey LIMIT 1")
def pick_first(spark, sf_dir):
    return runs.pick(b.read(spark, sf_dir, "part"), "p_name", "RING", "p_partkey").select("p_partkey", "p_name")


@query("""WITH r AS (SELECT DISTINCT 'b' || p_size AS site_key, p_type AS resolution, CASE WHEN p_size % 7 = 0 THEN '' ELSE '/r/' || p_size || p_type END AS rgb_path FROM part WHERE p_type < 'P'),
  c AS (SELECT 'b' || p_size AS site_key, min(p_type) AS first FROM part WHERE p_size % 2 = 0 GROUP BY 1),
  a AS (SELECT site_key, min(resolution) AS some FROM r GROUP BY 1),
  w AS (SELECT 'b' || s_suppkey AS site_key, CASE WHEN s_suppkey % 3 = 0 THEN 'ZZZ' END AS resolution FROM supplier),
  v AS (SELECT w.site_key, coalesce(w.resolution, c.first, a.some) AS resolution, a.some AS some_res FROM w LEFT JOIN c USING (site_key) LEFT JOIN a USING (site_key))
  SELECT v.site_key, v.resolution, rgb_path, CASE WHEN some_res IS NULL THEN 'unknown site' WHEN r.site_key IS NULL THEN 'no such resolution' WHEN coalesce(rgb_path, '') = '' THEN 'no path' ELSE 'ok' END AS status
  FROM v LEFT JOIN r ON r.site_key = v.site_key AND r.resolution = v.resolution""")
def resolve_rasters(spark, sf_dir):
    p = b.read(spark, sf_dir, "part")
    key = F.concat(F.lit("b"), F.col("p_size").cast("string"))
    path = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("/r/"), F.col("p_size").cast("string"), "p_type"))
    rasters = p.where("p_type < 'P'").select(key.alias("site_key"), F.col("p_type").alias("resolution"), path.alias("rgb_path")).distinct()
    catalogue = p.where("p_size % 2 = 0").groupBy(key.alias("site_key")).agg(F.array(F.min("p_type")).alias("resolutions"))
    s = F.col("s_suppkey")
    wanted = b.read(spark, sf_dir, "supplier").select(F.concat(F.lit("b"), s.cast("string")).alias("site_key"), F.when(s % 3 == 0, "ZZZ").alias("resolution"))
    return runs.resolved(wanted, catalogue, rasters)


@query("SELECT max_by(p_name, (p_size, p_name)) AS path FROM part")
def newest(spark, sf_dir):
    return src.newest(b.read(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_size").alias("modificationTime")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 77 ELSE CAST(round_even(p_size * 10 / 4.0::DOUBLE, 0) AS INTEGER) END AS grid_h, CASE WHEN p_partkey % 2 = 0 THEN 88 ELSE CAST(round_even(p_size * 14 / 4.0::DOUBLE, 0) AS INTEGER) END AS grid_w, CASE WHEN p_partkey % 2 = 0 THEN 'measured' ELSE 'predicted' END AS grid_source FROM part""")
def grid_or_predicted(spark, sf_dir):
    p = b.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("uuid"), (F.col("p_size") * 10).alias("height"), (F.col("p_size") * 14).alias("width"), F.lit(0.4).alias("embed_gsd"), F.lit(0.1).alias("native_res"))
    measured = p.where("uuid % 2 = 0").select("uuid", F.lit(77).alias("grid_h"), F.lit(88).alias("grid_w"))
    return runs.grid_or_predicted(p, measured).select(F.col("uuid").alias("p_partkey"), "grid_h", "grid_w", "grid_source")
