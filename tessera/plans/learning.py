"""Selections, splits, probes and label propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import learn, stats
from tessera.operators import vectors as vec
from tessera.plans import bindings as b
from tessera.plans.registry import query

_COUNTS = "counts AS (SELECT l_suppkey AS tile, CAST(l_partkey % 6 AS INTEGER) AS class, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)"


def _counts(spark, sf_dir):
    li = b.read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("tile"), (F.col("l_partkey") % 6).cast("int").alias("class")).agg(F.sum("l_quantity").cast("long").alias("n"))


@query(f"WITH {_COUNTS} SELECT tile, CAST(sum(n) AS BIGINT) AS n_labelled FROM counts GROUP BY 1 HAVING sum(n) > 15000")
def candidate_tiles(spark, sf_dir):
    return learn.candidates(_counts(spark, sf_dir), "tile", 15000)


@query(f"WITH {_COUNTS} SELECT class, CAST(sum(n) AS BIGINT) AS ceiling FROM counts GROUP BY 1 HAVING sum(n) >= 2000")
def frequent_classes(spark, sf_dir):
    return learn.frequent_classes(_counts(spark, sf_dir), 2000)


@query(f"""WITH RECURSIVE {_COUNTS}, w AS (SELECT t.tile, list(coalesce(n, 0)::DOUBLE ORDER BY k.class) AS n FROM (SELECT DISTINCT tile FROM counts) t CROSS JOIN (SELECT DISTINCT class FROM counts) k LEFT JOIN counts c ON c.tile = t.tile AND c.class = k.class GROUP BY 1),
  p AS (SELECT -1 AS ord, NULL::BIGINT AS tile, list_transform((SELECT any_value(n) FROM w), lambda x: 0.0::DOUBLE) AS total, []::BIGINT[] AS taken
    UNION ALL SELECT ord, tile, total, taken FROM (
      SELECT p.ord + 1 AS ord, w.tile, list_transform(list_zip(p.total, w.n), lambda z: z[1] + z[2]) AS total, list_append(p.taken, w.tile) AS taken,
        row_number() OVER (ORDER BY list_sum(list_transform(list_zip(p.total, w.n), lambda z: least(z[2], greatest(20000 - z[1], 0)) * (20000 / (z[1] + 1)))) DESC, w.tile) AS place
      FROM p, w WHERE p.ord < 11 AND NOT list_contains(p.taken, w.tile) AND list_min(p.total) < 20000) WHERE place = 1)
  SELECT CAST(ord AS INTEGER) AS ord, tile FROM p WHERE ord >= 0""")
def greedy_pick(spark, sf_dir):
    picked, _ = learn.greedy_pick(_counts(spark, sf_dir), 12, 20000)
    return spark.createDataFrame([(i, int(t)) for i, t in enumerate(picked)], "ord int, tile long")


@query("SELECT label, count(*) AS n FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k <= 20 GROUP BY 1")
def class_cap(spark, sf_dir):
    return learn.capped(b.vectors(spark, sf_dir), "label", 20, "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT g, row_number() OVER (ORDER BY g) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT vec_id % 17 AS g FROM embeddings)) SELECT vec_id, CASE WHEN k <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM embeddings JOIN g ON vec_id % 17 = g")
def group_split(spark, sf_dir):
    e = b.vectors(spark, sf_dir).withColumn("g", F.col("vec_id") % 17)
    return learn.grouped_split(e, "g", 0.3, order=F.col("g")).select("vec_id", "split")


@query("SELECT vec_id, round((SELECT count(*) FROM embeddings)::DOUBLE / ((SELECT count(DISTINCT label) FROM embeddings) * (SELECT count(*) FROM embeddings e WHERE e.label = x.label)), 9) AS weight FROM embeddings x")
def class_weights(spark, sf_dir):
    return learn.balanced_weights(b.vectors(spark, sf_dir)).select("vec_id", F.round("weight", 9).alias("weight"))


@query(f"""WITH {b.MASKS}, p AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 40 AS INTEGER) AS tile, CAST(l_partkey % 37 AS DOUBLE) / 2 + 100 AS x, 200 - CAST(l_orderkey % 35 AS DOUBLE) / 2 AS y FROM lineitem),
  q AS (SELECT *, CAST(floor((x - 100) / 0.5::DOUBLE) AS INTEGER) AS col, CAST(floor((y - 200) / -0.5::DOUBLE) AS INTEGER) AS row FROM p)
  SELECT coalesce(CASE WHEN q.col BETWEEN 0 AND 31 AND q.row BETWEEN 0 AND 31 THEN class END, 0) AS label, count(*) AS n FROM q LEFT JOIN masks m ON m.tile = q.tile AND m.row = q.row AND m.col = q.col GROUP BY 1""")
def geo_labels(spark, sf_dir):
    patches = b.read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 40).cast("int").alias("tile"), ((F.col("l_partkey") % 37).cast("double") / 2 + 100).alias("x"), (200 - (F.col("l_orderkey") % 35).cast("double") / 2).alias("y"))
    tiles = spark.range(40).select(F.col("id").cast("int").alias("tile"), F.lit(100.0).alias("ox"), F.lit(200.0).alias("oy"), F.lit(0.5).alias("px"), F.lit(-0.5).alias("py"), F.lit(32).alias("w"), F.lit(32).alias("h"))
    return learn.geo_labels(patches, b.masks(spark, sf_dir), tiles).groupBy("label").agg(F.count("*").alias("n"))


@query()
def linear_probe(spark, sf_dir):
    """Accuracy of the probe on held-out groups."""
    e = learn.grouped_split(b.vectors(spark, sf_dir).withColumn("g", F.col("vec_id") % 17), "g")
    model = learn.linear_probe(e.where("split = 'train'"))
    return stats.accuracy(learn.predict(e.where("split = 'test'"), model))


@query()
def boosted_probe(spark, sf_dir):
    e = learn.grouped_split(b.vectors(spark, sf_dir).withColumn("g", F.col("vec_id") % 17), "g")
    model = learn.boosted_probe(e.where("split = 'train'"), rounds=3, depth=2)
    return stats.accuracy(learn.predict(e.where("split = 'test'"), model))


# Beyond the reference's code ------------------------------------------------------------------------------------------


@query(f"""WITH {b.MASKS}, n AS (SELECT tile, row // 8 AS pr, col // 8 AS pc, class, count(*) AS n FROM masks GROUP BY ALL)
  SELECT tile, CAST(pr AS INTEGER) AS pr, CAST(pc AS INTEGER) AS pc, arg_max(class, (n, -class)) AS label, round(max(n)::DOUBLE / sum(n), 9) AS purity FROM n GROUP BY 1, 2, 3""")
def purity(spark, sf_dir):
    m = b.masks(spark, sf_dir).select("tile", F.expr("row div 8").cast("int").alias("pr"), F.expr("col div 8").cast("int").alias("pc"), "class")
    return learn.purity(m, ["tile", "pr", "pc"]).withColumn("purity", F.round("purity", 9))


_VOTES = """s AS (SELECT q.vec_id AS q, l.vec_id AS l, l.label, round(list_cosine_similarity(q.embedding::DOUBLE[], l.embedding::DOUBLE[]), 6) AS s FROM embeddings q JOIN embeddings l ON l.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
  k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, l) <= 5),
  v AS (SELECT q, label, sum(s) AS w FROM k GROUP BY 1, 2),
  r AS (SELECT q, label, w, row_number() OVER (PARTITION BY q ORDER BY round(w, 9) DESC, label) AS i, sum(w) OVER (PARTITION BY q) AS whole FROM v),
  f AS (SELECT q AS vec_id, max(label) FILTER (i = 1) AS label, max(w / whole) FILTER (i = 1) AS confidence, (max(w) FILTER (i = 1) - coalesce(max(w) FILTER (i = 2), 0)) / max(whole) AS margin FROM r GROUP BY 1),
  m AS (SELECT q AS vec_id, max(s) AS best_similarity FROM k GROUP BY 1)"""


def _votes(spark, sf_dir):
    e = b.vectors(spark, sf_dir)
    # the stated query set: ids divisible by 100, against all other rows
    return learn.neighbour_vote(e.where("vec_id % 100 = 0"), e, 5, "vec_id", digits=6)


@query(f"WITH {_VOTES} SELECT vec_id, label, round(confidence, 5) AS confidence FROM f")
def knn_vote(spark, sf_dir):
    return _votes(spark, sf_dir).select("vec_id", "label", F.round("confidence", 5).alias("confidence"))


@query(f"WITH {_VOTES} SELECT vec_id, NOT (round(margin, 5) >= 0.2::DOUBLE AND best_similarity >= 0.3::DOUBLE) AS abstain FROM f JOIN m USING (vec_id)")
def abstain(spark, sf_dir):
    return learn.abstained(_votes(spark, sf_dir).withColumn("margin", F.round("margin", 5)), 0.2, 0.3).select("vec_id", "abstain")


@query("""WITH m AS (SELECT label AS k, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, generate_series(1, 64) t(i) GROUP BY 1, 2), c AS (SELECT k, list(x ORDER BY i) AS c FROM m GROUP BY 1)
  SELECT vec_id, arg_min(k, (-s, k)) AS cluster FROM (SELECT vec_id, k, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS s FROM embeddings, c) GROUP BY 1""")
def nearest_mean(spark, sf_dir):
    e = b.vectors(spark, sf_dir)
    return vec.assign(e, learn.class_means(e), "vec", digits=6).select("vec_id", "cluster")


@query()
def ann_lsh(spark, sf_dir):
    e = b.vectors(spark, sf_dir)
    # wide buckets: the tests measure the recall
    return learn.approximate_neighbours(e.where("vec_id % 100 = 0"), e, 1.25, "vec_id", bucket=1.2)
