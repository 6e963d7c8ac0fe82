from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import taxonomy
from tessera.operators import stats

TILE = "mask_path string, image_path string, image_exists boolean, content int, tile_id string, site string, resolution string, split string"


def masks(spark, tiles):
    rows = [(name, r, c, v) for name, grid in tiles.items() for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "tile string, row int, col int, class int")


def test_tile_statistics(spark):
    empty, one = [[0] * 4] * 4, [[5] * 4] * 4
    edge = [[0, 0, 2, 301]] + [[0, 0, 0, 255]] * 3
    fine = [[5007, 9003, 303, 7]] + [[15, 127, -128, 65535]] * 3
    got = {r.tile: r for r in stats.tile_statistics(masks(spark, {"empty": empty, "one": one, "edge": edge, "fine": fine, "unknown": [[141, 2], [2, 2]]}), ["tile"]).collect()}
    assert set(got) == {"empty", "one", "edge", "fine"}, "an unknown class rejects its tile"
    assert (got["empty"].no_data_frac, got["empty"].annot_bbox_area_frac, got["empty"].annot_in_bbox_density) == (1.0, 0.0, 0.0)
    assert (got["one"].pixels_class_5, got["one"].annot_in_bbox_density) == (16, 1.0)
    assert (got["edge"].pixels_class_2, got["edge"].pixels_class_301, got["edge"].annot_bbox_area_frac) == (1, 1, 2 / 16)
    assert (got["fine"].pixels_class_4, got["fine"].pixels_class_3, got["fine"].pixels_class_301) == (1, 1, 2)
    assert all(r.pixels_unmapped == 0 for r in got.values())


def test_schemes_are_functions_of_the_seven():
    assert taxonomy.mapping("six")[9003] == 7 and taxonomy.mapping("three")[601] == 4 and taxonomy.mapping("two")[4] == 3
    assert len(taxonomy.mapping("seven")) == 47 == len(taxonomy.mapping("two"))
    assert len(taxonomy.mapping("identity")) == 53


def test_null_group_keys_are_dropped(spark):
    t = spark.createDataFrame([("a", None, "r", "v1", "train", 10, 1, 0.1, 1), ("b", "s", "r", "v1", "val", 10, 1, 0.95, 2)], "tile_id string, site string, resolution string, dataset_version string, split string, total_pixels long, pixels_no_data long, no_data_frac double, original_class_id int")
    [row] = stats.site_rollup(t, t).collect()
    assert (row.site, row.n_tiles_train, row.n_tiles_val, row.frac_tiles_mostly_no_data) == ("s", 0, 1, 1.0)


def dedup_input(spark):
    rows = [("/a/image_1", "/i/1", True, 7, "image_1"), ("/a/mask_1", "/i/1", True, 7, "mask_1"), ("/a/mask_2", "/i/2", True, 1, "mask_2"), ("/a/image_2", "/i/2", True, 2, "image_2"), ("/a/mask_3", None, False, 1, "mask_3"), ("/a/mask_4", "/i/3", False, 1, "mask_4"), ("/b/mask_4", "/i/3", False, 1, "mask_4")]
    return spark.createDataFrame([(*r, "s", "10", "train") for r in rows], TILE)


def test_dedup_keeps_the_mask_and_conflicts(spark):
    t = dedup_input(spark)
    kept, classes = stats.deduplicated(t, t.select(*stats.TILE_KEY))
    assert {r.mask_path for r in kept.collect()} == {"/a/mask_1", "/a/mask_2", "/a/image_2", "/a/mask_3", "/a/mask_4", "/b/mask_4"}
    assert "image_1" not in {r.tile_id for r in classes.collect()}
    assert [r.image_path for r in stats.dedup_conflicts(t).collect()] == ["/i/2"]
    again, _ = stats.deduplicated(kept, classes)
    assert again.count() == kept.count(), "idempotent"
    assert stats.deduplicated(t, t.select(*stats.TILE_KEY), verify=False)[0].count() == 5


def test_prune_spares_a_tile_of_the_same_name(spark):
    t = spark.createDataFrame([("/a/1", "1", "s1"), ("/b/1", "1", "s2")], "mask_path string, tile_id string, site string").withColumns({"resolution": F.lit("r"), "split": F.lit("train")})
    kept, classes = stats.pruned(t, t, t.where("site = 's2'"))
    assert [r.site for r in kept.collect()] == ["s2"] and [r.site for r in classes.collect()] == ["s2"]


def test_update_in_parts_equals_update_at_once(spark):
    t = dedup_input(spark)
    key = t.select(*stats.TILE_KEY)
    none = t.limit(0)
    whole, _ = stats.updated(none, key.limit(0), t, t, key)
    first = t.where("mask_path < '/a/mask_2'")
    one, c1 = stats.updated(none, key.limit(0), first, first, first.select(*stats.TILE_KEY))
    two, _ = stats.updated(one, c1, t, t, key)
    order = sorted(whole.columns)
    assert sorted(map(repr, whole.select(order).collect())) == sorted(map(repr, two.select(order).collect()))


def test_assert_unique(spark):
    assert stats.assert_unique(spark.range(5), ["id"]).count() == 5
    with pytest.raises(Exception, match="duplicate key"):
        stats.assert_unique(spark.range(5).union(spark.range(1)), ["id"]).collect()


def test_parity_finds_one_sided_rows(spark):
    a = spark.createDataFrame([(1, 5, 1.0), (2, 5, None), (3, 5, 2.0)], "k int, i int, f double")
    b = spark.createDataFrame([(1, 5, 1.0 + 1e-7), (2, 5, None), (4, 5, 2.0)], "k int, i int, f double")
    assert sorted(r.k for r in stats.parity(a, b, ["k"], ["i"], ["f"]).collect()) == [3, 4]
    assert stats.parity(a, a, ["k"], ["i"], ["f"]).isEmpty()


def test_nested_metadata(spark):
    df = spark.sql("select 's' as site, named_struct('patch', named_struct('n', 4L, 'src', 'x'), 'n_box', 2) as meta")
    out = stats.flattened(df, "meta", drop=["patch.src"])
    assert out.columns == ["site", "patch.n", "n_box"]


def test_empty_inputs(spark):
    t = dedup_input(spark).limit(0)
    assert stats.dedup_losers(t).isEmpty() and stats.class_report(spark.createDataFrame([], "label long, pred long")).isEmpty()
