"""Vectors: norms, covariance, projection, stretch, drift, assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import vectors as fv
from tessera.operators import vectors as vec
from tessera.plans import bindings as b
from tessera.plans.registry import query

DIMS = 64
#: fixed centres and axes, so that another engine can use the same
CENTRES = [(k, [float((k * 7 + i * 3) % 5 - 2 + 0.1 * k) for i in range(DIMS)]) for k in range(5)]
AXES = [[float((a * 5 + i * 2) % 7 - 3) for i in range(DIMS)] for a in range(3)]
MEAN = [0.01 * i for i in range(DIMS)]
_SCALED = f"v AS (SELECT vec_id, label, list_transform(embedding[1:{DIMS}], lambda x: CAST(x AS DOUBLE) * 3 + 5) AS v, list_transform(embedding[1:{DIMS}], lambda x: CAST(x AS DOUBLE)) AS u FROM embeddings)"


def _scaled(spark, sf_dir):
    e = b.vectors(spark, sf_dir)
    first = F.slice(fv.doubles(F.col("vec")), 1, DIMS)
    return e.select("vec_id", "label", F.transform(first, lambda x: x * 3 + 5).alias("v"), first.alias("u"))


def _sql(values):
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def _columns(df, column, n=DIMS):
    return df.select("vec_id", *[F.round(F.get(column, i), 9).alias(f"x{i}") for i in range(n)])


@query(f"""WITH {_SCALED}, n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-6 AS n FROM v) SELECT vec_id, {", ".join(f"round(v[{i + 1}] / n, 9) AS x{i}" for i in range(DIMS))} FROM n""")
def l2_norm(spark, sf_dir):
    return _columns(_scaled(spark, sf_dir).withColumn("w", fv.l2_normalise(F.col("v"))), "w")


@query("SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS mean FROM embeddings, generate_series(1, 64) t(i) GROUP BY 1, 2")
def vec_mean(spark, sf_dir):
    return vec.mean_vector(b.vectors(spark, sf_dir), "vec", ["label"]).withColumn("mean", F.round("mean", 9))


@query(f"""WITH {_SCALED}, x AS (SELECT i, j, v[i + 1] AS a, v[j + 1] AS b FROM v, range({DIMS}) r(i), range({DIMS}) s(j) WHERE i <= j) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(covar_samp(a, b), 9) AS cov FROM x GROUP BY 1, 2""")
def gram_cov(spark, sf_dir):
    """The covariance that the exact PCA is fitted to, from merged partials."""
    _, cov = vec.covariance_from_gram(*vec.gram(_scaled(spark, sf_dir), "v", normalise=False))
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(DIMS) for j in range(i, DIMS)], "i int, j int, cov double").withColumn("cov", F.round("cov", 9))


@query(f"""WITH {_SCALED}, x AS (SELECT i, j, v[i + 1] AS a, v[j + 1] AS b FROM v, range(8) r(i), range(8) s(j) WHERE i <= j) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(covar_samp(a, b), 9) AS cov FROM x GROUP BY 1, 2""")
def covariance_sql(spark, sf_dir):
    """The same from sums of products inside the JVM, of the eight leading components: for few of them."""
    return vec.covariance(_scaled(spark, sf_dir), "v", 8, "vec_id").withColumn("cov", F.round("cov", 9))


@query(f"""WITH {_SCALED} SELECT vec_id, {", ".join(f"round(list_dot_product(list_transform(list_zip(u, {_sql(MEAN)}), lambda p: p[1] - p[2]), {_sql(a)}), 9) AS pc{i}" for i, a in enumerate(AXES))} FROM v""")
def project_fixed(spark, sf_dir):
    model = vec.PCA(np.array(MEAN), np.array(AXES), np.ones(len(AXES)), np.ones(len(AXES)), 1)
    out = vec.project(_scaled(spark, sf_dir), model, "u", normalise=False)
    return out.select("vec_id", *[F.round(F.get("z", i), 9).alias(f"pc{i}") for i in range(3)])


@query(f"""WITH {_SCALED} SELECT vec_id, {", ".join(f"round(list_dot_product(list_transform(list_zip(u, {_sql(MEAN)}), lambda p: p[1] - p[2]), {_sql(a)}), 9) AS pc{i}" for i, a in enumerate(AXES))} FROM v""")
def project_literal(spark, sf_dir):
    """The same without Python."""
    lit = lambda v: F.array(*[F.lit(x) for x in v])
    out = vec.project_sql(_scaled(spark, sf_dir), lit(MEAN), [lit(a) for a in AXES], "u")
    return out.select("vec_id", *[F.round(f"pc{i}", 9).alias(f"pc{i}") for i in range(3)])


@query("SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - lo) / (hi - lo + 1e-6::DOUBLE))), 6) AS value FROM events, (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events)")
def stretch(spark, sf_dir):
    out = vec.stretched(b.read(spark, sf_dir, "events").select("event_id", "value"), ["value"])
    return out.select("event_id", F.round("value", 6).alias("value"))


@query(f"""WITH {_SCALED}, c AS (SELECT list_dot_product(v, u) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(u, u)) + 1e-8)) AS c FROM v) SELECT round(avg(c), 9) AS mean_cosine, count(*) AS n FROM c""")
def cosine_ref(spark, sf_dir):
    x = _scaled(spark, sf_dir)
    out = vec.drift(x.select("vec_id", F.col("v").alias("vec")), x.select("vec_id", F.col("u").alias("vec")), ["vec_id"])
    return out.withColumn("mean_cosine", F.round("mean_cosine", 9))


def _assign_sql(column, name, digits=9):
    unit = [(k, (np.asarray(c) / (np.linalg.norm(c) + 1e-8)).tolist()) for k, c in CENTRES]
    rows = ", ".join(f"({k}, {_sql(c)})" for k, c in unit)
    return f"""{name} AS (SELECT vec_id, arg_min(k, (-s, k)) AS cluster FROM (SELECT vec_id, k, round(list_dot_product({column}, c) / (sqrt(list_dot_product({column}, {column})) + 1e-8), {digits}) AS s FROM v, (VALUES {rows}) t(k, c)) GROUP BY 1)"""


@query(f"WITH {_SCALED}, {_assign_sql('u', 'a')} SELECT vec_id, cluster FROM a")
def assign_centres(spark, sf_dir):
    return vec.assign(_scaled(spark, sf_dir), CENTRES, "u", digits=9).select("vec_id", "cluster")


@query(f"WITH {_SCALED}, {_assign_sql('u', 'a')}, {_assign_sql('v', 'd')} SELECT round(avg(CASE WHEN a.cluster <> d.cluster THEN 1::DOUBLE ELSE 0::DOUBLE END), 9) AS disagreement, count(*) AS n FROM a JOIN d USING (vec_id)")
def label_disagree(spark, sf_dir):
    x = _scaled(spark, sf_dir)
    out = vec.disagreement(vec.assign(x, CENTRES, "u", digits=9), vec.assign(x, CENTRES, "v", digits=9), ["vec_id"])
    return out.withColumn("disagreement", F.round("disagreement", 9))


@query(f"WITH {_SCALED}, {_assign_sql('u', 'a')}, c AS (SELECT CAST(range AS INTEGER) AS cluster FROM range(7)) SELECT c.cluster, count(a.vec_id) AS n, round(count(a.vec_id)::DOUBLE / (SELECT count(*) FROM a), 9) AS fraction FROM c LEFT JOIN a ON a.cluster = c.cluster GROUP BY 1")
def cluster_fraction(spark, sf_dir):
    out = vec.cluster_fractions(vec.assign(_scaled(spark, sf_dir), CENTRES, "u", digits=9), 7)
    return out.withColumn("fraction", F.round("fraction", 9))


@query("WITH r AS (SELECT n_nationkey + 1 AS k, (26 - n_nationkey - 1)::DOUBLE / 325 AS ratio FROM nation), c AS (SELECT k, sum(ratio) OVER (ORDER BY k) AS cum FROM r) SELECT CAST(coalesce(min(k) FILTER (cum >= 0.9), max(k)) AS INTEGER) AS eff_dim FROM c")
def eff_dim(spark, sf_dir):
    r = b.read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("k"), ((25 - F.col("n_nationkey")).cast("double") / 325).alias("ratio"))
    return vec.effective_dimensions_table(r)


@query()
def pca_components(spark, sf_dir):
    """Shares of variance, cumulative, of the exact PCA."""
    model = vec.fit_pca(b.vectors(spark, sf_dir), None, "vec")
    rows = [(i + 1, float(v), float(r), float(c)) for i, (v, r, c) in enumerate(zip(model.variance, model.ratio, np.cumsum(model.ratio), strict=True))]
    return spark.createDataFrame(rows, "k int, variance double, ratio double, cum double")


@query()
def eff_dim_fit(spark, sf_dir):
    """Components of the exact PCA that hold nine tenths of the variance."""
    model = vec.fit_pca(b.vectors(spark, sf_dir), None, "vec")
    return spark.createDataFrame([(vec.effective_dimensions(model.ratio),)], "eff_dim int")


@query()
def pca_reference_basis(spark, sf_dir):
    """A basis fitted on the vectors of label 0 as they are and applied to all of them: drift of label means along it."""
    e = b.vectors(spark, sf_dir)
    model = vec.fit_pca(e.where("label = 0"), 3, "vec", normalise=False)
    z = vec.project(e, model, "vec", normalise=False)
    return z.groupBy("label").agg(*[F.round(F.avg(F.get("z", i)), 9).alias(f"pc{i}") for i in range(3)])


@query()
def pca_sampled(spark, sf_dir):
    """PCA of a hash sample in every class, projected on everything."""
    e = b.vectors(spark, sf_dir)
    model = vec.fit_pca_sampled(e, 200, 10, "vec_id", "label", 3)
    return vec.project(e, model).select("vec_id", *[F.get("z", i).alias(f"pc{i}") for i in range(3)])


@query()
def pca_rgb(spark, sf_dir):
    return vec.pca_rgb(b.vectors(spark, sf_dir)).select("vec_id", "r", "g", "b")


@query()
def kmeans_cos(spark, sf_dir):
    e = b.vectors(spark, sf_dir)
    centres = vec.spherical_kmeans(e, 6)
    return vec.assign(e, list(enumerate(centres.tolist()))).select("vec_id", "cluster")


@query()
def kmeans_best(spark, sf_dir):
    return vec.kmeans(b.vectors(spark, sf_dir), 6, seeds=3).select("vec_id", "cluster")


@query()
def embed_stub(spark, sf_dir):
    """Inference with a stand-in model: a fixed projection of the stored vectors."""
    def loader():
        w = np.random.default_rng(0).standard_normal((64, 8))
        return lambda x: x @ w

    return vec.embed(b.vectors(spark, sf_dir).withColumn("x", F.col("vec").cast("array<float>")), loader, "x", [64], 8, target="out").select("vec_id", *[F.get("out", i).alias(f"y{i}") for i in range(8)])
