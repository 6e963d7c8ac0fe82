from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tessera.operators import learn
from tessera.operators import vectors as vec


@pytest.fixture(scope="module")
def shifted(spark):
    """The stored vectors, scaled and moved, so that norms and centring matter."""
    e = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    return e.withColumn("vec", F.transform("embedding", lambda x: x.cast("double") * 3 + 5)).drop("embedding").cache()


def matrix(df):
    return np.array([list(r.vec) for r in df.orderBy("vec_id").collect()])


def test_pca_is_exact(shifted):
    x = matrix(shifted)
    model = vec.fit_pca(shifted, None, "vec", normalise=False)
    cov = np.cov(x.T)
    assert np.allclose(model.components @ model.components.T, np.eye(x.shape[1]), atol=1e-9)
    assert model.variance.sum() == pytest.approx(np.trace(cov)) and (np.diff(model.ratio) <= 1e-12).all()
    assert np.allclose(model.components.T @ np.diag(model.variance) @ model.components, cov, atol=1e-8)
    assert np.allclose(model.mean, x.mean(0))


def test_projection_centres(shifted):
    model = vec.fit_pca(shifted, 4, "vec", normalise=False)
    z = np.array([list(r.z) for r in vec.project(shifted, model, "vec", normalise=False).orderBy("vec_id").collect()])
    assert np.allclose(z, (matrix(shifted) - model.mean) @ model.components.T) and np.allclose(z.mean(0), 0, atol=1e-9)


def test_too_many_components_and_no_rows(spark, shifted):
    with pytest.raises(ValueError, match="components"):
        vec.fit_pca(shifted, 65)
    with pytest.raises(ValueError, match="no vectors"):
        vec.fit_pca(shifted.limit(0))


def test_effective_dimensions():
    assert vec.effective_dimensions(np.array([0.5, 0.3, 0.15, 0.05])) == 3
    assert vec.effective_dimensions(np.array([0.3, 0.2])) == 2


def test_spherical_kmeans_improves(shifted):
    e = shifted.withColumn("vec", F.transform("vec", lambda x: x - 5))
    x = matrix(e)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    fits = [(x @ vec.spherical_kmeans(e, 5, iterations=n).T).max(1).mean() for n in (0, 1, 8)]
    assert fits[0] <= fits[1] <= fits[2] + 1e-9


def test_rgb_is_stretched(shifted):
    r = vec.pca_rgb(shifted).agg(F.min("r").alias("a"), F.max("r").alias("b")).first()
    assert (r.a, r.b) == (0.0, 1.0)


def test_greedy_pick(spark):
    counts = spark.createDataFrame([("a", 1, 100), ("b", 2, 100), ("c", 1, 60), ("c", 2, 60)], "tile string, class int, n int")
    picked, totals = learn.greedy_pick(counts, 2, 100)
    assert picked == ["c", "a"] and totals == {"1": 160, "2": 60}
    assert learn.greedy_pick(counts, 9, 50)[0] == ["c"]


def test_groups_stay_together(shifted):
    e = learn.grouped_split(shifted.withColumn("g", F.col("vec_id") % 13), "g")
    assert e.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert 0.1 < e.where("split = 'test'").count() / e.count() < 0.6


def test_probe_beats_the_majority(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 3), (np.eye(8)[i % 3] * 2 + rng.standard_normal(8)).tolist()) for i in range(240)]
    e = learn.grouped_split(spark.createDataFrame(rows, "vec_id long, label int, vec array<double>").withColumn("g", F.col("vec_id") % 17), "g")
    model = learn.linear_probe(e.where("split = 'train'"))
    got = learn.predict(e.where("split = 'test'"), model)
    assert got.where("pred = label").count() / got.count() > 0.6


def test_neighbours_match_brute_force(shifted):
    e = shifted
    x = matrix(e)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-8
    got = {r.vec_id: r for r in learn.neighbour_vote(e.where("vec_id < 20"), e, 1, "vec_id").collect()}
    for q in range(20):
        s = np.round(x @ x[q], 9)
        s[q] = -2
        assert got[q].best_similarity == pytest.approx(s.max(), abs=1e-8)


def test_votes_do_not_depend_on_pieces(spark, shifted):
    """More labelled rows than one piece holds; a repeated vector has ties; nothing labelled gives no label."""
    e = shifted.withColumn("vec", F.when(F.col("vec_id") % 9 == 0, F.transform("vec", lambda x: x * 0 + 1)).otherwise(F.col("vec")))
    x = matrix(e)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-8
    labels = np.array([r.label for r in e.orderBy("vec_id").collect()])
    rows = learn.neighbour_vote(e.where("vec_id < 20"), e, 5, "vec_id", block=60, digits=6).collect()
    got = {r.vec_id: r for r in rows}
    assert len(rows) == len(got) == 20
    for q in range(20):
        s = np.round(x @ x[q], 6)
        near = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:5]
        votes = {v: sum(s[i] for i in near if labels[i] == v) for v in labels[near]}
        assert got[q].best_similarity == pytest.approx(s[near[0]]) and votes[got[q].label] == pytest.approx(max(votes.values()), abs=1e-6)
        assert got[q].confidence == pytest.approx(max(votes.values()) / sum(votes.values()), abs=1e-6)
    none = learn.neighbour_vote(e.where("vec_id < 3"), e.limit(0), 5, "vec_id").collect()
    assert len(none) == 3 and all(r.label is None and r.confidence == 0 for r in none)


def test_random_projections_find_close_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 16))
    rows = [(i, (x[i % 100] + (0.05 * rng.standard_normal(16) if i >= 100 else 0)).tolist()) for i in range(200)]
    e = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    found = {(r.a, r.b) for r in learn.approximate_neighbours(e.where("vec_id < 100"), e, 0.4, "vec_id").collect()}
    assert len(found & {(i, i + 100) for i in range(100)}) >= 90


def test_recall_of_the_neighbour_query(spark):
    from tessera.plans import registry

    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a in ids[ids % 100 == 0] for b in ids[np.linalg.norm(x - x[ids == a][0], axis=1) < 1.25] if a != b}
    got = {(r.a, r.b) for r in registry.QUERIES["ann_lsh"](spark, sf_dir).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 0


def test_nearest_centres_against_brute_force(spark, shifted):
    rng = np.random.default_rng(4)
    centres = [(k, rng.standard_normal(64).tolist()) for k in (7, 3, 5)] + [(9, [0.0] * 64)]
    x = matrix(shifted)
    names = [k for k, _ in sorted(centres)]
    c = np.array([v for _, v in sorted(centres)])
    c = c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-8)
    want = [names[i] for i in (x @ c.T / np.linalg.norm(x, axis=1, keepdims=True)).argmax(1)]
    table = spark.createDataFrame([(k, v) for k, v in centres], "k int, centre array<double>")
    for given in (centres, table):
        assert [r.cluster for r in vec.assign(shifted, given).orderBy("vec_id").collect()] == want


def test_components_of_the_fit(spark, shifted):
    from tessera.plans import registry

    e = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in e], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    want = int(np.searchsorted(np.cumsum(values / values.sum()), 0.9) + 1)
    assert registry.QUERIES["eff_dim_fit"](spark, SF_DIR).first().eff_dim == want
    raw, labels = np.array([r.embedding for r in e], float), np.array([r.label for r in e])
    _, axes = np.linalg.eigh(np.cov(raw[labels == 0].T))
    top = axes[:, ::-1].T[:3]
    top = top * np.sign(top[np.arange(3), np.abs(top).argmax(1)])[:, None]
    z = (raw - raw[labels == 0].mean(0)) @ top.T
    for r in registry.QUERIES["pca_reference_basis"](spark, SF_DIR).collect():
        assert (r.pc0, r.pc1, r.pc2) == pytest.approx(tuple(z[labels == r.label].mean(0)), abs=1e-6)


def test_geo_labels_outside_are_zero(spark):
    patches = spark.createDataFrame([("t", 0, 10.4, 19.6), ("t", 1, 9.9, 19.0), ("t", 2, 11.4, 18.1)], "tile string, p int, x double, y double")
    tiles = spark.createDataFrame([("t", 10.0, 20.0, 1.0, -1.0, 2, 2)], "tile string, ox double, oy double, px double, py double, w int, h int")
    pixels = spark.createDataFrame([("t", r, c, 10 * r + c + 1) for r in range(2) for c in range(2)], "tile string, row int, col int, class int")
    assert {r.p: r.label for r in learn.geo_labels(patches, pixels, tiles).collect()} == {0: 1, 1: 0, 2: 12}
