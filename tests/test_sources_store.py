from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.sources import store
from tessera.sources import tiles as src
from tessera.streaming import ingest


@pytest.fixture(scope="module")
def site(tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    for split, names in (("train", ["image_1", "image_2"]), ("val", ["image_3"])):
        for i, n in enumerate(names):
            folder = root / "P" / "S" / "10cm" / "v2" / split
            folder.mkdir(parents=True, exist_ok=True)
            band = np.zeros((4, 6 - i), np.float32)
            np.savez(folder / f"{n}.npz", RED=band, GREEN=band, BLUE=band, GEO_TRANSFORM=np.array([0.5, 0, 100, 0, -0.5, 200, 0, 0, 1.0]), SRID=np.array([7]))
            annot = folder.parent / f"{split}annot"
            annot.mkdir(exist_ok=True)
            np.savez(annot / f"{n.replace('image', 'mask')}.npz", CLASSIFY=np.full((4, 6), 5 + i, np.int16))
    np.savez(root / "P" / "S" / "10cm" / "v2" / "trainannot" / "broken.npz", OTHER=np.zeros(3))
    return root


def test_tile_boxes(spark, site):
    got = {r.tile: r for r in src.tile_boxes(spark, str(site / "P" / "S" / "10cm" / "v2")).collect()}
    assert (got["image_1"].w, got["image_1"].h, got["image_1"].xmin, got["image_1"].ymin, got["image_1"].xmax, got["image_1"].ymax) == (6, 4, 100.0, 198.0, 103.0, 200.0)
    assert got["image_2"].xmax == 102.5 and got["image_3"].split == "val" and got["image_1"].srid == 7


def test_broken_archives_are_recorded(spark, site, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "val").mkdir()
    (tmp_path / "train" / "bad.npz").write_bytes(b"no archive")
    np.savez(tmp_path / "train" / "other.npz", RED=np.zeros((2, 2)))
    good = site / "P" / "S" / "10cm" / "v2" / "train" / "image_1.npz"
    (tmp_path / "val" / "good.npz").write_bytes(good.read_bytes())
    got = {r.tile: r for r in src.tile_boxes(spark, str(tmp_path)).collect()}
    assert got["good"].error is None and got["good"].w == 6 and got["bad"].w is None and "BadZipFile" in got["bad"].error and got["other"].error


def test_older_names_of_tiles(spark):
    names = ["image_ab_c_10_20.npz", "image_ab_c_30_20_part.npz", "mask_ab_c_0_0.npz", "image_x.npz"]
    t = spark.createDataFrame([(n, 4, 5, [1.0] * 6, 7) for n in names], "name string, w int, h int, affine array<double>, srid int")
    assert [(r.uuid, r.width, r.height, r.n_tiles) for r in src.blobs(t, images_only=True).collect()] == [("ab_c", 34, 25, 2)]


def test_masks_and_broken_files(spark, site):
    px = src.mask_pixels(spark, str(site))
    assert px.where("class is null").select("path").distinct().count() == 1
    tiles = stats.tile_statistics(px.where("class is not null"), ["path"])
    assert {(r.total_pixels, r.pixels_class_5, r.pixels_class_6) for r in tiles.collect()} == {(24, 24, 0), (24, 0, 24)}


def test_discovery_and_pairing(spark, site):
    files = src.listing(spark, str(site)).select(F.regexp_replace("path", f"^.*{site.name}/", "").alias("path"))
    found = src.discovered(files)
    assert {(r.site, r.resolution, r.dataset_version) for r in found.collect()} == {("P/S", "10cm", "v2")}
    masks = found.withColumn("image_dir", F.concat_ws("/", "site", "resolution", "dataset_version", "split"))
    images = files.where("path not like '%annot%'").withColumnRenamed("path", "image_path")
    pairs = {r.name: (r.image_exists, r.image_path) for r in src.paired(masks, images).collect()}
    assert pairs["mask_1.npz"] == (True, "P/S/10cm/v2/train/image_1.npz") and pairs["broken.npz"] == (False, "P/S/10cm/v2/train/broken.npz")
    assert src.images(spark, str(site), ("npz",)).count() == 7


def test_catalogue_keeps_file_order(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"b/x": {"resolutions": ["10cm", "3cm"]}, "a": {"resolutions": []}}))
    rows = src.catalogue(spark, str(tmp_path / "c.json")).orderBy("ord").collect()
    assert [(r.site_key, list(r.resolutions)) for r in rows] == [("b/x", ["10cm", "3cm"]), ("a", [])]


def test_store_replaces_only_its_sites(spark, tmp_path):
    make = lambda site, n, v: spark.range(n).select(F.lit(site).alias("site_id"), F.col("id").alias("cell_id"), F.lit(0).alias("pr"), F.lit(0).alias("pc"), F.array(F.lit(float(v))).alias("vec"))
    path = str(tmp_path / "patches")
    store.write_patches(make("a", 3, 1).union(make("b", 2, 1)), path)
    store.write_patches(make("a", 1, 2), path)
    df = spark.read.parquet(path)
    assert {(r.site_id, r["count"]) for r in df.groupBy("site_id").count().collect()} == {("a", 1), ("b", 2)}
    cell = store.read_cell(spark, path, "b", 1)
    plan = cell._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_id" in plan and "EqualTo(cell_id,1)" in plan
    assert cell.count() == 1 and store.grid_shape(df).where("channels = 1").count() == 3
    store.write_manifest(df.select("site_id", "cell_id"), str(tmp_path / "m"))
    assert store.read_manifest(spark, str(tmp_path / "m")).count() == store.written_cells(df).count() == 3
    assert store.with_ref(df, "/r").orderBy("site_id", "cell_id").first().patch_ref == "/r/a#0"


def test_versions(spark, tmp_path):
    store.replace_table(spark.range(3), str(tmp_path / "t"))
    now = store.latest_table(spark, str(tmp_path / "t"))
    store.replace_table(now.where("id > 0"), str(tmp_path / "t"))
    assert store.latest_table(spark, str(tmp_path / "t")).count() == 2


def test_geojson(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    f = json.loads(store.as_geojson(df, ["id"]).first().feature)
    assert f["properties"] == {"id": 1} and f["geometry"]["coordinates"][0][2] == [1.0, 2.0]


def test_ingestion_takes_what_is_new(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    run = lambda: ingest.ingest_available(spark, source, df.schema, mark, lambda d: d.withColumn("x", F.col("id") * 2), sink)
    df = spark.range(10)
    df.write.parquet(source)
    run()
    run()
    assert spark.read.parquet(sink).count() == 10
    spark.range(5).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(sink).count() == 15
    seen = []
    ingest.ingest_batches(spark, source, df.schema, str(tmp_path / "mark2"), lambda d, i: seen.append(d.count()))
    assert sum(seen) == 15
