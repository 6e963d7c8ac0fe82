"""Vector analytics: exact PCA through mergeable Gram matrices, projection, k-means, drift, similarity search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as fv


@dataclass
class PCA:
    """Mean, components (rows, by falling variance), variances and their shares."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray
    n: int

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.mean.tolist(), self.components.tolist(), self.variance.tolist(), self.ratio.tolist())], "mean array<double>, components array<array<double>>, variance array<double>, ratio array<double>")


def gram(df: DataFrame, column: str = "vec", normalise: bool = True, eps: float = 1e-6) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum of x, sum of x x'), in double. Every batch sends one partial; partials are added in a tree of tasks, so the
    driver gets a bounded number of C x C matrices."""
    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, product = 0, None, None
        for pdf in parts:
            if not len(pdf):
                continue
            x = np.stack(pdf[column].to_numpy()).astype(np.float64)
            if normalise:
                x = x / (np.linalg.norm(x, axis=1, keepdims=True) + eps)
            total = x.sum(0) if total is None else total + x.sum(0)
            product = x.T @ x if product is None else product + x.T @ x
            n += len(x)
        if n:
            yield pd.DataFrame({"n": [n], "s": [total.tobytes()], "g": [product.tobytes()]})

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, product = 0, None, None
        for pdf in parts:
            for k, s, g in pdf.itertuples(index=False):
                n += k
                s, g = np.frombuffer(s), np.frombuffer(g)
                total, product = (s.copy(), g.copy()) if total is None else (total + s, product + g)
        if n:
            yield pd.DataFrame({"n": [n], "s": [total.tobytes()], "g": [product.tobytes()]})

    schema = "n long, s binary, g binary"
    parts = df.select(column).where(F.col(column).isNotNull()).mapInPandas(partial, schema)
    found = parts.repartition(8).mapInPandas(merged, schema).collect()
    if not found:
        raise ValueError("no vectors to fit")
    total = sum(np.frombuffer(r.s) for r in found)
    c = len(total)
    return sum(r.n for r in found), total, sum(np.frombuffer(r.g) for r in found).reshape(c, c)


def covariance_from_gram(n: int, total: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divided by n - 1)."""
    mean = total / max(n, 1)
    return mean, (product - n * np.outer(mean, mean)) / max(n - 1, 1)


def pca_from_gram(n: int, total: np.ndarray, product: np.ndarray, k: int | None = None) -> PCA:
    """The sign of a component is fixed: its largest entry is positive."""
    mean, cov = covariance_from_gram(n, total, product)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1].T
    if k is not None and k > len(values):
        raise ValueError(f"{k} components asked of {len(values)} dimensions")
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    share = values / max(np.clip(values, 0, None).sum(), 1e-12)
    return PCA(mean, vectors[:k], values[:k], share[:k], n)


def fit_pca(df: DataFrame, k: int | None = None, column: str = "vec", normalise: bool = True, eps: float = 1e-6) -> PCA:
    return pca_from_gram(*gram(df, column, normalise, eps), k)


def sampled(df: DataFrame, n: int, key: str, seed: int = 0, within: list[str] = ()) -> DataFrame:
    """n rows (of every group of ``within``) by the order of a hash of their key: the same rows in every run."""
    order = [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]
    if not within:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def fit_pca_sampled(df: DataFrame, most: int, n_cells: int, key: str, cell: str, k: int | None = None, column: str = "vec") -> PCA:
    """PCA of at most most / n_cells rows a cell."""
    return fit_pca(sampled(df, max(1, most // n_cells), key, within=[cell]), k, column)


def project(df: DataFrame, model: PCA, column: str = "vec", normalise: bool = True, target: str = "z", eps: float = 1e-6) -> DataFrame:
    """Adds (x - mean) W' as an array; the model travels with the task."""
    mean, w = model.mean, model.components.T

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            if not len(s):
                yield s
                continue
            x = np.stack(s.to_numpy()).astype(np.float64)
            if normalise:
                x = x / (np.linalg.norm(x, axis=1, keepdims=True) + eps)
            yield pd.Series(list((x - mean) @ w))

    return df.withColumn(target, run(column))


def project_sql(df: DataFrame, mean: Column, axes: list[Column], column: str = "vec", names: list[str] | None = None) -> DataFrame:
    """The same with literal axes and no Python: for few components."""
    return df.withColumns({(names or [f"pc{i}" for i in range(len(axes))])[i]: fv.project(F.col(column), mean, a) for i, a in enumerate(axes)})


#: rows of which one task finds percentiles; more are narrowed down to so many first
FEW = 1 << 20
#: parts of a range of values
PARTS = 1 << 14


def order_statistic(df: DataFrame, column: str, rank: int) -> float:
    """The value of that rank (from 0) in an order of a column without nulls, for any number of rows.

    The range of values is cut into PARTS; the part that holds the rank follows from the parts' counts, and is cut again
    until it holds few rows or one value. PARTS counts a turn come to the driver, and no task gets more than FEW values."""
    x = F.col(column).cast("double")
    low, high, n = df.agg(F.min(x), F.max(x), F.count("*")).first()
    rows = df.select(x.alias("x"))
    while n > FEW and low < high:
        # halves first, so that no difference overflows; the parts are in the order of the values
        part = F.least(F.floor((F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * PARTS), F.lit(PARTS - 1))
        parts = sorted(rows.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect())
        for p in parts:
            if rank < p.n:
                break
            rank -= p.n
        if (p.low, p.high) == (low, high) and p.n == n:
            break
        low, high, n = p.low, p.high, p.n
        rows = rows.where(F.col("x").between(low, high))
    if low == high:
        return low
    return rows.where(F.col("x").between(low, high)).orderBy("x").limit(rank + 1).agg(F.max("x")).first()[0]


def percentile_bounds(df: DataFrame, columns: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row: ``<column>_lo`` and ``<column>_hi``, percentiles with interpolation between neighbours; nulls don't count."""
    ends = (("lo", low), ("hi", high))
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    if all(counts[c] <= FEW for c in columns):
        return df.agg(*[F.percentile(F.col(c).cast("double"), F.lit(p)).alias(f"{c}_{n}") for c in columns for n, p in ends])
    found = {}
    for c in columns:
        some = df.select(c).where(F.col(c).isNotNull())
        for n, p in ends:
            place = p * (counts[c] - 1)
            below = int(place)
            v = order_statistic(some, c, below) if counts[c] else None
            w = order_statistic(some, c, below + 1) if counts[c] and place > below else v
            found[f"{c}_{n}"] = None if v is None else v + (w - v) * (place - below)
    return df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))


def stretched(df: DataFrame, columns: list[str], low: float = 0.02, high: float = 0.98, eps: float = 1e-6) -> DataFrame:
    """Columns clipped to 0..1 between two percentiles over all rows."""
    from tessera.functions.numeric import stretch

    b = F.broadcast(percentile_bounds(df, columns, low, high))  # one row
    return df.join(b).withColumns({c: stretch(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), eps) for c in columns}).drop(*[f"{c}_{n}" for c in columns for n in ("lo", "hi")])


def pca_rgb(df: DataFrame, column: str = "vec", normalise: bool = False) -> DataFrame:
    """r, g, b of 0..1: the three leading components, stretched."""
    model = fit_pca(df, 3, column, normalise)
    z = project(df, model, column, normalise, "_z").withColumns({c: F.get("_z", i) for i, c in enumerate("rgb")}).drop("_z")
    return stretched(z, list("rgb"))


def effective_dimensions(ratio: np.ndarray, share: float = 0.9) -> int:
    """Components until the cumulative share is reached; all of them if it never is."""
    total = np.cumsum(ratio)
    return int(np.searchsorted(total, share) + 1) if len(total) and total[-1] >= share else len(total)


def effective_dimensions_table(ratios: DataFrame, share: float = 0.9) -> DataFrame:
    """As above from rows (k from 1, ratio)."""
    run = ratios.withColumn("cum", F.sum("ratio").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return run.agg(F.coalesce(F.min(F.when(F.col("cum") >= share, F.col("k"))), F.max("k")).alias("eff_dim"))


def mean_vector(df: DataFrame, column: str = "vec", group: list[str] = ()) -> DataFrame:
    """(group, dim, mean) rows: the components' means."""
    return df.select(*group, F.posexplode(column).alias("dim", "x")).groupBy(*group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def covariance(df: DataFrame, column: str, dims: int, key: str) -> DataFrame:
    """(i, j, cov) for the first ``dims`` components, i <= j, from sums of products."""
    x = fv.doubles(F.col(column))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get(x, i).alias("a"), F.get(x, j).alias("b")) for i in range(dims) for j in range(i, dims)])
    rows = df.select(F.inline(pairs))
    n = F.count("*")
    return rows.groupBy("i", "j").agg(((F.sum(F.col("a") * F.col("b")) - F.sum("a") * F.sum("b") / n) / (n - 1)).alias("cov"))


def drift(a: DataFrame, b: DataFrame, key: list[str], column: str = "vec") -> DataFrame:
    """Mean cosine of the vectors at equal places."""
    both = a.select(*key, F.col(column).alias("_a")).join(b.select(*key, F.col(column).alias("_b")), key)
    return both.agg(F.avg(fv.cosine(F.col("_a"), F.col("_b"))).alias("mean_cosine"), F.count("*").alias("n"))


#: numbers of the centres that a task holds
MOST_NUMBERS = 1 << 25


def assign(df: DataFrame, centres: list[tuple[int, list[float]]] | DataFrame, column: str = "vec", target: str = "cluster", eps: float = 1e-8, digits: int | None = None) -> DataFrame:
    """The centre of largest cosine; ties go to the smallest number. Centres are a list, or a table (k, centre) that is
    collected as far as MOST_NUMBERS allows; they travel with the tasks as one matrix."""
    if isinstance(centres, DataFrame):
        dims = centres.select(F.max(F.size("centre"))).first()[0] or 1
        rows = centres.select("k", "centre").limit(MOST_NUMBERS // dims + 1).collect()
        if len(rows) > MOST_NUMBERS // dims:
            raise ValueError(f"more than {MOST_NUMBERS // dims} centres of {dims} numbers: use learn.neighbour_vote with one neighbour")
        centres = [(r.k, list(r.centre)) for r in rows]
    centres = sorted(centres)
    names = np.array([k for k, _ in centres], np.int64)
    matrix = np.array([np.asarray(c, float) / (np.linalg.norm(c) + eps) for _, c in centres]).T

    @F.pandas_udf("int")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for at in range(0, len(s), 1024):
                x = np.stack(s.iloc[at : at + 1024].to_numpy()).astype(float)
                sims = x / (np.linalg.norm(x, axis=1, keepdims=True) + eps) @ matrix
                out.append(names[(sims if digits is None else np.round(sims, digits)).argmax(1)])
            yield pd.Series(np.concatenate(out) if out else [], dtype="int32")

    return df.withColumn(target, nearest(F.when(F.col(column).isNotNull(), F.col(column).cast("array<double>"))))


def spherical_kmeans(df: DataFrame, k: int, column: str = "vec", key: str = "vec_id", iterations: int = 50, seed: int = 0, eps: float = 1e-8, seeding: int = 4096) -> np.ndarray:
    """Centres of unit length. First centres are drawn one by one with odds 1 - largest cosine, among the first
    ``seeding`` rows by hash; then rows go to their nearest centre and centres to the normed mean of their rows, partial
    sums per batch, until nothing moves. An empty cluster starts anew from a drawn row."""
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + eps)
    rng = np.random.default_rng(seed)
    pool = unit(np.array([r[0] for r in sampled(df, seeding, key, seed).select(column).collect()], float))
    if len(pool) < k:
        raise ValueError(f"{k} clusters of {len(pool)} vectors")
    centres = [pool[rng.integers(len(pool))]]
    while len(centres) < k:
        odds = np.clip(1 - (pool @ np.array(centres).T).max(1), 0, None)
        centres.append(pool[rng.choice(len(pool), p=odds / odds.sum()) if odds.sum() > 0 else rng.integers(len(pool))])
    c = np.array(centres)
    for _ in range(iterations):
        def step(parts: Iterator[pd.DataFrame], c=c) -> Iterator[pd.DataFrame]:
            total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for pdf in parts:
                if len(pdf):
                    x = unit(np.stack(pdf[column].to_numpy()).astype(float))
                    near = (x @ c.T).argmax(1)
                    np.add.at(total, near, x)
                    count += np.bincount(near, minlength=len(c))
            yield pd.DataFrame({"k": range(len(c)), "n": count, "s": [t.tobytes() for t in total]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n": [pdf["n"].sum()], "s": [sum(np.frombuffer(s) for s in pdf["s"]).tobytes()]})

        schema = "k int, n long, s binary"
        rows = df.select(column).mapInPandas(step, schema).groupBy("k").applyInPandas(add, schema).collect()
        new = c.copy()
        for r in rows:
            v = np.frombuffer(r.s) / r.n if r.n else pool[rng.integers(len(pool))]
            new[r.k] = v / (np.linalg.norm(v) + eps)
        if np.allclose(new, c):
            return new
        c = new
    return c


def kmeans(df: DataFrame, k: int, column: str = "vec", seeds: int = 10, iterations: int = 50) -> DataFrame:
    """Clusters of L2-normed vectors: the best of several seeds by cost. Adds ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("features", array_to_vector(fv.l2_normalise(F.col(column), 1e-8)))
    held = data.select("features").cache()
    try:
        best = min((KMeans(k=k, seed=s, maxIter=iterations).fit(held) for s in range(seeds)), key=lambda m: m.summary.trainingCost)
    finally:
        held.unpersist()
    return best.transform(data).withColumnRenamed("prediction", "cluster").drop("features")


def cluster_fractions(df: DataFrame, k: int, column: str = "cluster") -> DataFrame:
    """Share of every cluster 0..k-1, empty ones too."""
    n = df.groupBy(F.col(column).alias("cluster")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    out = every.join(n, "cluster", "left").na.fill(0, ["n"])
    return out.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def disagreement(a: DataFrame, b: DataFrame, key: list[str], column: str = "cluster") -> DataFrame:
    both = a.select(*key, F.col(column).alias("_a")).join(b.select(*key, F.col(column).alias("_b")), key)
    return both.agg(F.avg((F.col("_a") != F.col("_b")).cast("double")).alias("disagreement"), F.count("*").alias("n"))


def embed(df: DataFrame, loader: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str, shape: list[int], dims: int, batch: int = 64, target: str = "vec") -> DataFrame:
    """Inference with a frozen model over arrays of ``shape``: ``loader`` makes the model once a Python worker, and the
    model turns a batch of inputs (n x shape) into vectors (n x dims)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    def make():
        model = loader()

        def run(x: np.ndarray) -> np.ndarray:
            out = np.asarray(model(x), np.float32)
            if out.shape != (len(x), dims):
                raise ValueError(f"the model made {out.shape}, not {(len(x), dims)}")
            return out

        return run

    return df.withColumn(target, predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[shape])(F.col(column)))
