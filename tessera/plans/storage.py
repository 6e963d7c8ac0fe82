"""The vector store, incremental ingestion, upkeep of the statistics tables and small filters, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import geo, raster, runs, stats
from tessera.operators import vectors as vec
from tessera.plans import bindings as b
from tessera.plans.registry import query
from tessera.session import shared_folder
from tessera.sources import store
from tessera.streaming import ingest

_PATCHES = "p AS (SELECT 's' || label AS site_id, vec_id // 4 AS cell_id, CAST(vec_id % 4 // 2 AS INTEGER) AS pr, CAST(vec_id % 2 AS INTEGER) AS pc, embedding AS vec FROM embeddings)"


def _patches(spark, sf_dir):
    e = b.read(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    return e.select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("site_id"), F.expr("vec_id div 4").alias("cell_id"), F.expr("vec_id % 4 div 2").cast("int").alias("pr"), (i % 2).cast("int").alias("pc"), F.col("embedding").alias("vec"))


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_PATCHES} SELECT site_id, cell_id, max(pr) + 1 AS gh, max(pc) + 1 AS gw, CAST(max(len(vec)) AS INTEGER) AS channels FROM p GROUP BY 1, 2")
def store_shapes(spark, sf_dir):
    """Patches written to the store and their grids read back."""
    path = _folder(spark, "patches")
    store.write_patches(_patches(spark, sf_dir), path)
    return store.grid_shape(spark.read.parquet(path))


@query(f"WITH {_PATCHES} SELECT cell_id, pr, pc, round(CAST(vec[1] AS DOUBLE), 6) AS v0 FROM p WHERE site_id = 's3' AND cell_id = (SELECT min(cell_id) FROM p WHERE site_id = 's3')")
def store_cell(spark, sf_dir):
    """One cell by site and number: the site prunes partitions, the number reaches the scan."""
    path = _folder(spark, "patches")
    store.write_patches(_patches(spark, sf_dir), path)
    first = spark.read.parquet(path).where("site_id = 's3'").agg(F.min("cell_id")).first()[0]
    return store.read_cell(spark, path, "s3", first).select("cell_id", "pr", "pc", F.round(F.get("vec", 0).cast("double"), 6).alias("v0"))


@query(f"WITH {_PATCHES} SELECT DISTINCT site_id, cell_id, '/store/' || site_id || '#' || cell_id AS patch_ref FROM p WHERE site_id <> 's1' OR cell_id % 2 = 0")
def manifest_rewrite(spark, sf_dir):
    """A manifest of which one site is written again: the other sites' partitions stay."""
    path = _folder(spark, "manifest")
    cells = store.written_cells(_patches(spark, sf_dir))
    store.write_manifest(cells, path)
    store.write_manifest(cells.where("site_id = 's1' and cell_id % 2 = 0"), path)
    return store.with_ref(store.read_manifest(spark, path), "/store").select("site_id", "cell_id", "patch_ref")


@query("SELECT event_type, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def ingest_events(spark, sf_dir):
    """Events taken in by a file stream in two runs; the second finds only what is new."""
    source, sink, mark = (_folder(spark, n) for n in ("feed", "taken", "mark"))
    events = b.read(spark, sf_dir, "events")
    events.where("event_id % 2 = 0").write.parquet(source)
    ingest.ingest_available(spark, source, events.schema, mark, lambda d: d.select("event_type", "user_id"), sink)
    events.where("event_id % 2 = 1").write.mode("append").parquet(source)
    ingest.ingest_available(spark, source, events.schema, mark, lambda d: d.select("event_type", "user_id"), sink)
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {b.TILES}, t AS (SELECT * FROM tiles WHERE o_orderkey % 5 <> 0) SELECT site, resolution, count(*) AS n, CAST(sum(CASE WHEN image_exists THEN 1 ELSE 0 END) AS BIGINT) AS linked FROM t GROUP BY 1, 2""")
def update_with_prune(spark, sf_dir):
    """Old tiles, of which some vanished, and new ones: reconciled, appended and pruned in one update."""
    t = b.tiles(spark, sf_dir).drop("original_class_id")
    old, found = t.where("o_orderkey % 2 = 0"), t.where("o_orderkey % 5 <> 0")
    tiles, _ = stats.updated(old, old.select(*stats.TILE_KEY), found, found, found.select(*stats.TILE_KEY), prune=True)
    return tiles.groupBy("site", "resolution").agg(F.count("*").alias("n"), F.sum(F.col("image_exists").cast("long")).alias("linked"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def label_filter(spark, sf_dir):
    return b.read(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(f"WITH {b.RGB} SELECT cell_id FROM rgb GROUP BY 1 HAVING avg(CASE WHEN r <> 0 OR g <> 0 OR b <> 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) >= 0.25")
def coverage_filter(spark, sf_dir):
    return geo.cell_coverage(b.rgb(spark, sf_dir), ["cell_id"]).where("coverage >= 0.25").select("cell_id")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def drop_duplicates(spark, sf_dir):
    return b.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").dropDuplicates()


@query("SELECT c_mktsegment, 'mask' AS kind, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def key_join(spark, sf_dir):
    """Rows matched by key, never by position."""
    c, n = b.read(spark, sf_dir, "customer"), b.read(spark, sf_dir, "nation")
    cells = c.select(F.col("c_nationkey").cast("string").alias("site_id"), F.lit(0).alias("cell_id"), "c_mktsegment")
    return store.joined(cells, n.select(F.col("n_nationkey").cast("string").alias("site_id"), F.lit(0).alias("cell_id"), F.lit("mask").alias("kind"))).groupBy("c_mktsegment", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {b.BOXES} SELECT vec_id, '{{"type":"Feature","properties":{{"vec_id":' || vec_id || '}},"geometry":{{"type":"Polygon","coordinates":[[[' || xmin || ',' || ymin || '],[' || xmax || ',' || ymin || '],[' || xmax || ',' || ymax || '],[' || xmin || ',' || ymax || '],[' || xmin || ',' || ymin || ']]]}}}}' AS feature FROM boxes""")
def geojson(spark, sf_dir):
    boxes = b.boxes(spark, sf_dir)
    out = store.as_geojson(boxes, ["vec_id"])
    return out.select(F.get_json_object("feature", "$.properties.vec_id").cast("long").alias("vec_id"), "feature")


@query("SELECT CAST(count(*) AS INTEGER) AS n_sites, 'seven' AS scheme FROM nation")
def run_record(spark, sf_dir):
    sites = [r.n_name for r in b.read(spark, sf_dir, "nation").select("n_name").orderBy("n_name").collect()]
    return runs.run_record(spark, {"scheme": "seven"}, sites).select("n_sites", F.col("settings")["scheme"].alias("scheme"))


@query(f"WITH {b.BOXES} SELECT vec_id FROM boxes WHERE label < 5 AND xmax - xmin > 4")
def same_system(spark, sf_dir):
    """Boxes of one reference system; others are refused."""
    boxes = b.boxes(spark, sf_dir).withColumn("srid", F.lit(28350))
    geo.same_srid(boxes)
    return boxes.where("label < 5 and xmax - xmin > 4").select("vec_id")


@query()
def site_map(spark, sf_dir):
    """Patches projected on three components, stretched, and painted on their site's canvas."""
    e = b.vectors(spark, sf_dir)
    rgb = vec.pca_rgb(e).select(F.col("vec_id").alias("cell_id"), F.lit(0).alias("pr"), F.lit(0).alias("pc"), "r", "g", "b")
    cells = b.boxes(spark, sf_dir).withColumnRenamed("vec_id", "cell_id")
    return raster.paint(cells, rgb, F.lit(4.0))
