"""Queries over whole tables read all rows of them."""

from __future__ import annotations

from collections import Counter

from tests.conftest import SF_DIR
from tessera.operators import raster
from tessera.plans import registry


def rows(spark, table):
    return spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_no_part_or_supplier_is_left_out(spark):
    for name, key, table in (("chunk_rects", "uuid", "part"), ("overlapping_windows", "uuid", "part"), ("grid_gen", "s_suppkey", "supplier")):
        assert registry.QUERIES[name](spark, SF_DIR).select(key).distinct().count() == rows(spark, table)


def test_heat_of_all_parts_against_brute_force(spark):
    windows = registry.QUERIES["overlapping_windows"](spark, SF_DIR)
    want = sum(r.w_px * r.h_px for r in windows.collect())
    heat = registry.QUERIES["coverage_heat"](spark, SF_DIR)
    assert heat.agg({"n_boxes": "sum"}).first()[0] == want and heat.count() == heat.select("row", "col").distinct().count()


def test_heat_against_brute_force(spark):
    made = [(0, 0, 4, 3), (0, 0, 4, 3), (2, 1, 4, 4), (4, 0, 2, 2), (9, 9, 0, 3), (9, 9, 3, 0), (7, 1, 1, 1)]
    want = Counter((r, c) for x, y, w, h in made for r in range(y, y + h) for c in range(x, x + w))
    got = raster.coverage_heat(spark.createDataFrame(made, "col_px int, row_px int, w_px int, h_px int")).collect()
    assert len(got) == len(want) and {(r.row, r.col): r.n_boxes for r in got} == want


def test_pixels_of_all_line_items(spark):
    from tessera.plans import bindings as b

    li = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").collect()
    spots = {(r.l_suppkey % 20, r.l_partkey % 16, r.l_orderkey % 16) for r in li}
    assert b.rgb(spark, SF_DIR).count() == len(spots)
    assert registry.QUERIES["geo_labels"](spark, SF_DIR).agg({"n": "sum"}).first()[0] == len(li)
    for name in ("data_mask", "class_canvas", "rgba_canvas", "edge_pad", "window_read"):
        assert registry.QUERIES[name](spark, SF_DIR).select("cell_id").distinct().count() == len({s[0] for s in spots})


def test_footprint_takes_all_pixels(spark, monkeypatch):
    from tessera.plans import bindings as b

    monkeypatch.setattr(raster, "footprint", lambda pixels, *_: pixels)
    assert registry.QUERIES["footprint"](spark, SF_DIR).count() == b.rgb(spark, SF_DIR).count()


def test_pairs_of_even_and_of_odd_boxes(spark):
    pairs = registry.QUERIES["box_join"](spark, SF_DIR)
    assert {(r.a, r.b) for r in pairs.selectExpr("a_id % 2 AS a", "b_id % 2 AS b").distinct().collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert {r.v for r in registry.QUERIES["box_semi_join"](spark, SF_DIR).selectExpr("vec_id % 2 AS v").distinct().collect()} == {0, 1}


def test_boosted_probe_judges_all_labels(spark, monkeypatch):
    from tessera.operators import learn, stats

    seen = []
    monkeypatch.setattr(learn, "boosted_probe", lambda train, **_: seen.append(train))
    monkeypatch.setattr(learn, "predict", lambda test, _: test)
    monkeypatch.setattr(stats, "accuracy", lambda test: test)
    seen.append(registry.QUERIES["boosted_probe"](spark, SF_DIR))
    assert [df.select("label").distinct().count() for df in seen] == [10, 10]
