from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tessera.operators import geo, raster, sites
from tessera.operators import vectors as vec
from tessera.plans import sites as plan
from tessera.session import shared_folder
from tessera.sources import store

AFFINE = [1.0, 0.0, 100.0, 0.0, -1.0, 200.0]


def out_root(spark):
    return f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def world(spark):
    """Three sites of 16 x 16 pixels of a metre: all lit but for a black quarter; tiles in the left half and at the edge."""
    tiles = [(s, "a", 100.0, 184.0, 107.9, 200.0) for s in ("one", "two", "three")] + [("one", "b", 112.5, 150.0, 130.0, 187.0), ("one", "far", 500.0, 500.0, 510.0, 510.0)]
    tiles = spark.createDataFrame(tiles, "site_id string, tile string, xmin double, ymin double, xmax double, ymax double")
    rasters = spark.createDataFrame([(s, AFFINE, 16, 16) for s in ("one", "two", "three")], "site_id string, affine array<double>, height int, width int")
    rows = [(s, r, c, r + 1, c + 1, k) for k, s in enumerate(("one", "two", "three")) for r in range(16) for c in range(16) if not (r < 4 and c < 4)]
    return tiles, rasters, spark.createDataFrame(rows, "site_id string, row int, col int, r int, g int, b int")


def work(spark, *names):
    return spark.createDataFrame([(n, None) for n in names], "site_id string, message string")


def test_grid_of_a_site(spark, world):
    tiles, rasters, pixels = world
    cells, info = sites.grid_cells(tiles.where("site_id = 'one'"), rasters, pixels, patch=4, least=0.02)
    # tiles cut to the raster span all of it; cells 4 x 4; two columns on the left, one at the right edge of the last rows
    got = {(r.row, r.col): r for r in cells.collect()}
    assert set(got) == {(r, c) for r in range(4) for c in (0, 1)} - {(0, 0)} | {(3, 3)}
    assert sorted(r.cell_id for r in got.values()) == list(range(8)) and got[0, 1].cell_id == 0
    assert (got[3, 3].xmin, got[3, 3].ymin, got[3, 3].r0, got[3, 3].c0) == (112.0, 184.0, 12, 12)
    i = info.first()
    assert (i.n_cells_full, i.after_tile_filter, i.n_cells, i.dropped_void, i.patch_px, i.cell_ground_m) == (16, 9, 8, 1, 4, 4.0)


def test_embedding_reads_the_cells_pixels(spark, world):
    _, _, pixels = world
    cells = spark.createDataFrame([("one", 0, 0, 0, 4), ("one", 1, 2, 3, 4), ("two", 0, 14, 14, 4)], "site_id string, cell_id long, r0 int, c0 int, patch_px int")
    whole = np.zeros((24, 24, 3))
    for r in pixels.where("site_id = 'one'").collect():
        whole[r.row, r.col] = r.r, r.g, r.b
    got = {(r.site_id, r.cell_id): r.vec for r in sites.embed_cells(cells, pixels, plan.block_means).where("pr is null").collect()}
    for cell, (r0, c0) in ((0, (0, 0)), (1, (2, 3))):
        assert got["one", cell] == pytest.approx(whole[r0 : r0 + 4, c0 : c0 + 4].mean((0, 1)))
    assert got["two", 0] == pytest.approx([(15 + 16) * 2 / 16, (15 + 16) * 2 / 16, 4 / 16]), "zero beyond the raster"
    assert {r.cell_id for r in sites.embed_cells(cells, pixels, plan.block_means, black=1.0).where("site_id = 'one'").collect()} == {1}, "a hole is skipped"


def test_a_run_continues_past_failures_and_resumes(spark, world):
    tiles, rasters, pixels = world
    at = out_root(spark)

    def loader():
        inner = plan.block_means()

        def model(image):
            if image[..., 2].max() == 1:
                raise ValueError("no colour")
            return inner(image)

        return model

    run = lambda *names, loader=loader, **kw: {r.site_id: r for r in sites.run_sites(work(spark, *names), tiles, rasters, pixels, loader, at, patch=4, settings={"model": "m"}, **kw).collect()}
    first = run("one", "two", "nowhere")
    assert {n: r.status for n, r in first.items()} == {"one": "ok", "two": "fail", "nowhere": "skip"}
    assert first["two"].message == "ValueError: no colour" and first["one"].n_tiles == 3 and first["one"].n_cells == 8
    second = run("one", "two", "three", loader=plan.block_means)
    assert {n: r.status for n, r in second.items()} == {"one": "skipped", "two": "ok", "three": "ok"}
    assert run("one", resume=False)["one"].status == "ok"
    manifest = store.read_manifest(spark, f"{at}/cells")
    assert {(r.site_id, r.n) for r in manifest.groupBy("site_id").agg(F.count("*").alias("n")).collect()} == {("one", 8), ("two", 7), ("three", 7)}
    patches = spark.read.parquet(f"{at}/patches")
    assert patches.count() == 22 and store.read_cell(spark, f"{at}/patches", "one", 3).count() == 1
    assert manifest.where("site_id = 'two' and cell_id = 2").first().patch_ref == f"{at}/patches/two#2"
    meta = spark.read.parquet(f"{at}/meta").where("site_id = 'two'").first()
    assert len(meta) == 15 and (meta.embed_dim, meta.patch_grid, meta.patch_px, meta.patch_ground_m, meta.model, meta.ginfo.n_cells) == (3, [1, 1], 4, 4.0, "m", 7)
    assert spark.read.parquet(f"{at}/runs").count() == 3
    drawn = spark.read.parquet(f"{at}/map")
    assert drawn.where("site_id = 'one'").count() == 8 and drawn.agg(F.min("r"), F.max("r")).first() == (0, 255)


def test_no_site_to_run(spark, world):
    tiles, rasters, pixels = world
    got = sites.run_sites(work(spark, "nowhere"), tiles, rasters, pixels, plan.block_means, out_root(spark), patch=4).collect()
    assert [(r.status, r.message) for r in got] == [("skip", "no such tiles")]


def test_work_list(spark):
    keys = spark.createDataFrame([(f"P/{i}", None, i) for i in range(7)], "site_key string, resolution string, ord int")
    catalogue = spark.createDataFrame([(f"P/{i}", ["10cm"]) for i in range(7)], "site_key string, resolutions array<string>")
    rasters = spark.createDataFrame([(f"P/{i}", "10cm", None if i == 3 else f"/r/{i}") for i in range(5)], "site_key string, resolution string, rgb_path string")
    got = {r.site_key: (r.site_id, r.message) for r in sites.work_list(keys, catalogue, rasters, "v2", (1, 2)).collect()}
    assert got == {"P/1": ("P_1_10cm_v2", None), "P/3": ("P_3_10cm_v2", "no path"), "P/5": ("P_5_10cm_v2", "unknown site")}
    assert {r.site_key for r in sites.work_list(keys, catalogue, rasters, "v2", (0, 2), 2).collect()} == {"P/0", "P/2"}


def test_clusters_of_window_sizes(spark):
    rows = [(r, c, (r // 8 + c // 8) % 2 * 40 + r % 3, c % 5, 7) for r in range(16) for c in range(16)]
    p = spark.createDataFrame(rows, "row int, col int, r int, g int, b int")
    got = {r["size"]: r for r in sites.tiling_drift(p, [8, 16], 16, plan.contextual, 4, 16, clusters=2).collect()}
    assert got[16].mean_cosine == pytest.approx(1) and got[16].disagreement == 0 and got[8].mean_cosine < 1 and 0 <= got[8].disagreement <= 1


def test_blobs_of_holes_have_no_rows(spark):
    windows = spark.createDataFrame([("a", "a_0_0", 0, 0, 4, 4), ("b", "b_0_0", 0, 0, 4, 4)], "uuid string, chunk_id string, col_px int, row_px int, w_px int, h_px int")
    p = spark.createDataFrame([("a", 0, 0, 1, 0, 0), ("b", 9, 9, 1, 0, 0)], "uuid string, row int, col int, r int, g int, b int")
    assert {r.uuid for r in sites.embed_blob(windows, p, plan.block_means, 4).collect()} == {"a"}


def test_patches_beyond_a_cut_window_are_dropped(spark):
    windows = spark.createDataFrame([("a", "a_0_0", 0, 0, 8, 4)], "uuid string, chunk_id string, col_px int, row_px int, w_px int, h_px int")
    p = spark.createDataFrame([("a", r, c, 1, 1, 1) for r in range(4) for c in range(8)], "uuid string, row int, col int, r int, g int, b int")
    assert {(r.row, r.col) for r in sites.embed_blob(windows, p, plan.block_means, 4).collect()} == {(0, 0), (0, 1)}


# Operators that the compositions rest on ------------------------------------------------------------------------------


def test_order_statistics_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(vec, "FEW", 16)
    monkeypatch.setattr(vec, "PARTS", 8)
    rng = np.random.default_rng(2)
    for values in (rng.standard_normal(400), np.r_[rng.standard_normal(200), np.full(150, 3.0), 1e12, -1e12], np.full(60, 2.5), np.r_[np.zeros(90), 1e-300, 1e300], np.arange(100) * 1.0):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        ordered = np.sort(values)
        for rank in (0, 1, len(values) // 2, len(values) - 1):
            assert vec.order_statistic(df, "v", rank) == ordered[rank]
        lo, hi = vec.percentile_bounds(df.union(spark.createDataFrame([(None,)], "v double")), ["v"]).first()
        assert (lo, hi) == pytest.approx(tuple(np.percentile(values, [2, 98])))


def test_stretch_is_the_same_by_either_way(spark, monkeypatch):
    e = spark.read.parquet(f"{SF_DIR}/events.parquet").select("event_id", "value")
    few = sorted(vec.stretched(e, ["value"]).collect())
    monkeypatch.setattr(vec, "FEW", 50)
    many = sorted(vec.stretched(e, ["value"]).collect())
    assert np.allclose([r.value for r in few], [r.value for r in many], atol=1e-12)


SCHEMA = "id long, xmin double, ymin double, xmax double, ymax double"


def test_large_boxes_have_few_rows(spark):
    """Boxes from a bin to a continent, each pair once, against brute force."""
    rng = np.random.default_rng(3)
    def draw(n):
        size = 10.0 ** rng.uniform(-1, 6, (n, 2))
        corner = rng.uniform(-1000, 1000, (n, 2))
        return [(i, *map(float, corner[i]), *map(float, corner[i] + size[i])) for i in range(n)]

    a, b = draw(70), draw(70)
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA).withColumnRenamed("id", "other")
    got = [(r.id, r.other) for r in geo.box_join(left, right, 1.0, "id", "other").collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_boxes_of_other_groups_do_not_meet(spark):
    rows = [(i, 0.0, 0.0, 1.0, 1.0, f"g{i % 2}") for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA + ", site string")
    got = {(r.site, r.id, r.other) for r in geo.box_join(df, df.withColumnRenamed("id", "other"), 5.0, "id", "other", ["site"]).collect()}
    assert got == {(f"g{i % 2}", i, j) for i in range(4) for j in range(4) if i % 2 == j % 2}


def test_clip_to_a_mask(spark):
    """Boxes cut to a footprint keep the area of the footprint inside of them."""
    lit = [(r, c, 9, 0, 0) for r in range(8) for c in range(8) if not (r >= 4 and c >= 4)]
    p = spark.createDataFrame(lit, "row int, col int, r int, g int, b int")
    area = geo.mask_boxes(raster.footprint(p, 2, 2), F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -1.0, 8.0)]), 2)
    assert area.count() == 4 and geo.union_area(area, 3.0).first().area == 48
    boxes = spark.createDataFrame([(0, 1.0, 1.0, 7.0, 7.0), (1, 5.0, 1.0, 7.0, 3.0)], SCHEMA)
    parts = geo.clip(boxes, area, 3.0)
    assert {r.id: r.area for r in geo.union_area(parts, 3.0, ["id"]).collect()} == {0: 27.0}


def test_footprint_falls_back_to_the_bounds(spark):
    p = spark.createDataFrame([(2, 3, 9, 0, 0), (7, 9, 9, 0, 0), (0, 0, 0, 0, 0)], "row int, col int, r int, g int, b int")
    assert raster.footprint_or_bounds(p, 2, 2).count() == 4 * 5 and raster.footprint_or_bounds(p, 2, 1).count() == 2
    assert raster.footprint_or_bounds(p.limit(0), 2).count() == 0


def test_decimated_read(spark):
    p = spark.createDataFrame([(r, c, 10 * r + c) for r in range(8) for c in range(8)], "row int, col int, v int")
    got = {(r.row, r.col): r.v for r in raster.decimated(p, 0, 0, 8, 8, 4, 2, ["v"]).collect()}
    assert got == {(i, j): 10 * (2 * i + 1) + 4 * j + 2 for i in range(4) for j in range(2)}
    assert {r.v for r in raster.decimated(p, 100, 0, 4, 4, 2, 2, ["v"]).collect()} == {0}


def test_chunks_of_three_kinds(spark):
    blobs = spark.createDataFrame([("a", 5, 3)], "uuid string, width int, height int")
    tiles = spark.createDataFrame([("a", 0, 0, 3, 3), ("a", 3, 0, 2, 3), ("b", 0, 0, 1, 1)], "uuid string, col int, row int, w int, h int")
    get = lambda *a, **k: {(r.col_px, r.row_px, r.w_px, r.h_px) for r in geo.chunk_rects(blobs, *a, **k).collect()}
    assert get("blob") == get(None) == {(0, 0, 5, 3)} and get("tile", tiles=tiles) == {(0, 0, 3, 3), (3, 0, 2, 3)} and get(4) == {(0, 0, 4, 3), (4, 0, 1, 3)}
    for bad in ({"size": "tile"}, {"size": "row"}):
        with pytest.raises(ValueError):
            geo.chunk_rects(blobs, **bad)


def test_command_line(spark, capsys):
    from tessera import __main__ as cli

    cli._list(None)
    assert "run_sites" in capsys.readouterr().out
    a = cli.parser().parse_args("sites --all-sites --catalogue c --raster-paths p --tiles t --rasters r --pixels x --model tessera.plans.sites:block_means --out-root o --shard 1/2 --limit 3 --no-resume".split())
    assert (a.shard, a.limit, a.no_resume, a.no_webmap) == ("1/2", 3, True, False) and cli._loader(a.model) is plan.block_means
