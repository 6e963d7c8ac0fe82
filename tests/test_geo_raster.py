from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import geo, raster

SCHEMA = "id long, xmin double, ymin double, xmax double, ymax double"


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], SCHEMA)


def test_touching_boxes_meet_and_zero_areas_too(spark):
    left = boxes(spark, [(0, 0, 2, 2), (5, 5, 5, 5), (20, 20, 21, 21)])
    right = boxes(spark, [(2, 2, 4, 4), (5, 5, 9, 9)]).withColumnRenamed("id", "other")
    got = {(r.id, r.other) for r in geo.box_join(left, right, 1.5, "id", "other").collect()}
    assert got == {(0, 0), (1, 1)}
    assert {r.id for r in geo.box_semi_join(left, right, 1.5, "id").collect()} == {0, 1}


@pytest.mark.parametrize("cell", [0.7, 3.0, 100.0])
def test_box_join_against_brute_force(spark, cell):
    rng = random.Random(1)
    draw = lambda: (x := rng.uniform(-20, 20), y := rng.uniform(-20, 20), x + rng.uniform(0, 6), y + rng.uniform(0, 6))
    a, b = [draw() for _ in range(60)], [draw() for _ in range(60)]
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]}
    got = [(r.id, r.other) for r in geo.box_join(boxes(spark, a), boxes(spark, b).withColumnRenamed("id", "other"), cell, "id", "other").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_union_area(spark):
    b = boxes(spark, [(0, 0, 2, 2), (1, 1, 3, 3), (1, 1, 2, 2), (10, 0, 11, 1), (10, 0, 11, 1)])
    assert geo.union_area(b, 1.7).first().area == pytest.approx(8.0)


def test_clip_drops_what_only_touches(spark):
    out = geo.clip(boxes(spark, [(0, 0, 2, 2), (3, 0, 4, 1), (2, 0, 3, 1)]), boxes(spark, [(1, 1, 3, 3)])).collect()
    assert [(r.id, r.xmin, r.ymax) for r in out] == [(0, 1.0, 2.0)]


def python_starts(extent, tile, overlap, cell):
    stride = tile - overlap
    s = [v for v in range(0, max(0, extent - tile) + 1, stride)] + [max(0, extent - tile)]
    return sorted({v // cell * cell for v in s})


def test_window_starts(spark):
    df = spark.createDataFrame([(v,) for v in (1, 300, 512, 513, 1000, 1001, 2055)], "e int").select("e", geo.window_starts(F.col("e"), 512, 128, 8).alias("s"))
    assert {r.e: list(r.s) for r in df.collect()} == {v: python_starts(v, 512, 128, 8) for v in (1, 300, 512, 513, 1000, 1001, 2055)}
    assert python_starts(1001, 512, 128, 8)[-1] + 512 == 1000, "a strip of less than a cell stays uncovered"
    with pytest.raises(ValueError, match="stride"):
        geo.window_starts(F.col("e"), 128, 128)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=30))
def test_hull_contains_all_points(points):
    h = geo.hull(points)
    for p in points:
        assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for a, b in zip(h, h[1:] + h[:1], strict=True)) or len(h) < 3


def test_study_area_of_a_square(spark):
    b = boxes(spark, [(0, 0, 1000, 1000), (0, 0, 500, 500)]).withColumn("site", F.lit("s"))
    r = geo.study_area(b, 300.0, ["site"]).first()
    assert (r.area_km2, r.perim_km, r.fill_ratio, r.n_corners) == (pytest.approx(1.0), pytest.approx(4.0), pytest.approx(1.0), 4)


def test_mixed_reference_systems_are_refused(spark):
    a, b = spark.createDataFrame([(1,)], "srid int"), spark.createDataFrame([(2,)], "srid int")
    geo.same_srid(a, a)
    with pytest.raises(ValueError, match="mixed"):
        geo.same_srid(a, b)


def test_halves_round_to_even(spark):
    at = lambda x: spark.range(1).select(*[c.alias(n) for n, c in zip("cr", raster.offsets(F.lit(x), F.lit(0.0), F.lit(0.0), F.lit(x), F.lit(1.0)), strict=True)]).first()
    assert [tuple(at(v)) for v in (0.5, 1.5, 2.5)] == [(0, 0), (2, 2), (2, 2)]


def test_mosaics_do_not_depend_on_row_order(spark):
    rows = [(0, 0, float(v), v) for v in (3, 1, 2)] + [(0, 1, 5.0, 9)]
    for order in (rows, rows[::-1]):
        p = spark.createDataFrame(order, "row int, col int, value double, seq int")
        get = lambda df: {(r.row, r.col): r.value for r in df.collect()}
        assert get(raster.mosaic_mean(p)) == {(0, 0): 2.0, (0, 1): 5.0}
        assert get(raster.mosaic_first(p, ["seq"]))[0, 0] == 1.0 and get(raster.mosaic_last(p, ["seq"]))[0, 0] == 3.0


def test_footprint_drops_speckle(spark):
    lit = [(r, c, 9, 0, 0) for r in range(4) for c in range(4)] + [(10, 10, 9, 0, 0), (12, 12, 0, 0, 0)]
    got = raster.footprint(spark.createDataFrame(lit, "row int, col int, r int, g int, b int"), 1, 4)
    assert got.count() == 16 and got.agg(F.max("row")).first()[0] == 3


def test_alpha_is_presence_not_colour(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0)], "row int, col int, r double, g double, b double")
    assert sorted(r.a for r in raster.rgba(p, None, raster.canvas(spark, 1, 2)).collect()) == [0, 255]
