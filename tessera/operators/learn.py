"""Labels: balanced selection, capped and grouped samples, probes, neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as fv

#: queries of one piece, and the least number of pieces, in ``neighbour_vote``
QUERIES, MEETINGS = 2048, 12


def candidates(counts: DataFrame, tile: str, least: int = 500) -> DataFrame:
    """Tiles with more than ``least`` labelled pixels."""
    return counts.groupBy(tile).agg(F.sum("n").alias("n_labelled")).where(F.col("n_labelled") > least)


def frequent_classes(counts: DataFrame, least: int = 2000) -> DataFrame:
    """Classes with at least ``least`` pixels over the whole site."""
    return counts.groupBy("class").agg(F.sum("n").alias("ceiling")).where(F.col("ceiling") >= least)


def greedy_pick(counts: DataFrame, most: int, target: int, tile: str = "tile", limit: int = 100_000) -> tuple[list, dict]:
    """Tiles picked one by one: each time the one whose pixels best fill what classes still lack, poorer classes weighing
    more; the first by name on ties; until every class has ``target`` or ``most`` tiles are taken. Sequential by nature:
    only the tile x class counts (at most ``limit`` tiles) come to the driver. Returns picks and the totals."""
    wide = counts.groupBy(tile).pivot("class").agg(F.sum("n")).na.fill(0).orderBy(tile).limit(limit + 1).toPandas()
    if len(wide) > limit:
        raise ValueError(f"more than {limit} tiles")
    names, n = wide[tile].tolist(), wide.drop(columns=tile).to_numpy(float)
    classes = [c for c in wide.columns if c != tile]
    total, picked, left = np.zeros(len(classes)), [], np.ones(len(names), bool)
    while left.any() and len(picked) < most:
        lack = np.clip(target - total, 0, None)
        if not lack.any():
            break
        score = np.where(left, (np.minimum(n, lack) * (target / (total + 1))).sum(1), -1.0)
        i = int(score.argmax())
        left[i] = False
        picked.append(names[i])
        total += n[i]
    return picked, dict(zip(classes, total.astype(int).tolist(), strict=True))


def capped(df: DataFrame, label: str, most: int, key: str, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each class, by the order of a hash."""
    from tessera.operators.vectors import sampled

    return sampled(df, most, key, seed, [label])


def grouped_split(df: DataFrame, group: str, test: float = 0.3, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Adds ``split``: whole groups go to test until their share is reached, in the order of a hash (or ``order``)."""
    groups = df.select(group).distinct()
    place = F.row_number().over(Window.orderBy(order if order is not None else F.xxhash64(F.col(group), F.lit(seed)), F.col(group)))
    n = F.count("*").over(Window.partitionBy())
    named = groups.select(group, F.when(place <= F.ceil(n * F.lit(test)), "test").otherwise("train").alias("split"))
    return df.join(named, group)


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight``: rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("_c"))
    n = n.withColumn("weight", F.sum("_c").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("_c")))
    return df.join(F.broadcast(n.drop("_c")), label)


def linear_probe(train: DataFrame, column: str = "vec", label: str = "label", c: float = 1.0, iterations: int = 200) -> PipelineModel:
    """L2-normed, standardised vectors and balanced multinomial logistic regression. c is the inverse penalty on the sum of
    the losses, so the mean loss is penalised by 1 / (c * total weight)."""
    data = balanced_weights(train, label).withColumn("_raw", array_to_vector(fv.doubles(F.col(column)))).withColumn("_y", F.col(label).cast("double"))
    n = train.count()
    stages = [Normalizer(inputCol="_raw", outputCol="_unit"), StandardScaler(withMean=True, inputCol="_unit", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", regParam=1 / (c * max(n, 1)), standardization=False, maxIter=iterations, family="multinomial")]
    return Pipeline(stages=stages).fit(data)


def boosted_probe(train: DataFrame, column: str = "vec", label: str = "label", rounds: int = 10, depth: int = 3) -> PipelineModel:
    """One gradient-boosted classifier against the rest for each class."""
    data = balanced_weights(train, label).withColumn("_raw", array_to_vector(fv.doubles(F.col(column)))).withColumn("_y", F.col(label).cast("double"))
    one = GBTClassifier(featuresCol="_unit", labelCol="_y", maxIter=rounds, maxDepth=depth, seed=0, weightCol="weight")
    return Pipeline(stages=[Normalizer(inputCol="_raw", outputCol="_unit"), OneVsRest(classifier=one, featuresCol="_unit", labelCol="_y", weightCol="weight")]).fit(data)


def predict(df: DataFrame, model: PipelineModel, column: str = "vec", target: str = "pred") -> DataFrame:
    out = model.transform(df.withColumn("_raw", array_to_vector(fv.doubles(F.col(column)))))
    return out.withColumn(target, F.col("prediction").cast("int")).drop("_raw", "_unit", "_x", "prediction", "probability", "rawPrediction")


def geo_labels(patches: DataFrame, pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """The class under every patch centre (x, y): pixel floor((x - ox) / px), floor((y - oy) / py) of its tile, 0 outside.

    patches: tile, patch keys, x, y; tiles: tile, ox, oy, px, py, w, h; pixels: tile, row, col, class."""
    at = patches.join(tiles, "tile").withColumn("col", F.floor((F.col("x") - F.col("ox")) / F.col("px")).cast("int")).withColumn("row", F.floor((F.col("y") - F.col("oy")) / F.col("py")).cast("int"))
    inside = (F.col("col") >= 0) & (F.col("col") < F.col("w")) & (F.col("row") >= 0) & (F.col("row") < F.col("h"))
    found = at.withColumn("_in", inside).join(pixels, ["tile", "row", "col"], "left")
    return found.withColumn("label", F.when(F.col("_in"), F.coalesce("class", F.lit(0))).otherwise(0)).drop("_in", "class", "ox", "oy", "px", "py", "w", "h")


# Beyond the reference's code: label propagation ----------------------------------------------------------------------


def purity(pixels: DataFrame, key: list[str], label: str = "class") -> DataFrame:
    """The most frequent class of a patch's pixels (the smallest on ties) and its share."""
    n = pixels.groupBy(*key, label).agg(F.count("*").alias("n"))
    best = F.max_by(F.col(label), F.struct(F.col("n"), (-F.col(label)).alias("o")))
    return n.groupBy(*key).agg(best.alias("label"), (F.max("n") / F.sum("n")).alias("purity"))


def neighbour_vote(queries: DataFrame, labelled: DataFrame, k: int, key: str, label: str = "label", column: str = "vec", block: int = 32_768, digits: int = 9) -> DataFrame:
    """Similarity-weighted vote of the k nearest labelled vectors: label, confidence (its share of the weight), margin and
    best similarity.

    Both sides are cut into pieces (``block`` labelled rows, QUERIES queries) and every piece of one meets every piece of
    the other in a task of its own; the k best of each meeting are merged for every query. So any number of labelled rows
    gives the exact result, at a cost of queries times labelled rows. Similarities are rounded before ranking and ties go
    to the smaller key."""
    n, m = max(1, -(-labelled.count() // block)), max(MEETINGS, -(-queries.count() // QUERIES))
    kind = lambda c, d: d.schema[c].dataType.simpleString()
    piece = lambda count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # numbered before they are repeated: queries of one key stay apart, pieces of one query together
    asked = queries.select(F.monotonically_increasing_id().alias("_id"), F.col(key).alias("_q"), F.col(column).alias("_vec"))
    asked = asked.withColumn("_i", F.pmod("_id", F.lit(m)).cast("int")).withColumn("_j", every(n))
    known = labelled.select(F.col(key).alias("_l"), F.col(label).alias("label"), F.col(column).alias("_vec"), piece(n).alias("_j"), every(m).alias("_i"))

    def matrix(column: pd.Series) -> np.ndarray:
        x = np.stack(column.to_numpy()).astype(float)
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right = right.sort_values("_l").reset_index(drop=True)
        keys, labels = right["_l"].to_numpy(), right["label"].to_numpy()
        others = matrix(right["_vec"]) if len(right) else None
        for at in range(0, len(left), 256):
            part = left.iloc[at : at + 256]
            sims = np.round(matrix(part["_vec"]) @ others.T, digits) if len(right) else np.zeros((len(part), 0))
            for i, q, s in zip(part["_id"], part["_q"], sims, strict=True):
                s = np.where(keys == q, -np.inf, s)
                far = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                near = np.flatnonzero((s >= far) & (s > -np.inf))
                near = near[np.argsort(-s[near], kind="stable")][:k]
                out += [(i, q, s[x], keys[x], labels[x]) for x in near] or [(i, q, None, None, None)]
        return pd.DataFrame(out, columns=["_id", "_q", "_s", "_l", "label"])

    met = asked.groupBy("_i", "_j").cogroup(known.groupBy("_i", "_j")).applyInPandas(meet, f"_id long, _q {kind(key, queries)}, _s double, _l {kind(key, labelled)}, label {kind(label, labelled)}")
    place = F.row_number().over(Window.partitionBy("_id").orderBy(F.col("_s").desc_nulls_last(), "_l"))
    best = met.withColumn("_p", place).where(f"_p <= {k}")
    each = best.groupBy("_id").agg(F.first("_q").alias("_q"), F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("_p", "_s", "label")))).alias("_near"))

    def vote(parts):
        for pdf in parts:
            out = []
            for q, near in zip(pdf["_q"], pdf["_near"], strict=True):
                if not len(near):
                    out.append((q, None, 0.0, 0.0, 0.0))
                    continue
                s = [x["_s"] for x in near]
                votes = pd.Series(s).groupby([x["label"] for x in near]).sum().sort_index().sort_values(ascending=False, kind="stable")
                whole = votes.sum()
                out.append((q, votes.index[0], votes.iloc[0] / whole, (votes.iloc[0] - (votes.iloc[1] if len(votes) > 1 else 0.0)) / whole, s[0]))
            yield pd.DataFrame(out, columns=[key, "label", "confidence", "margin", "best_similarity"])

    return each.select("_q", "_near").mapInPandas(vote, f"{key} {kind(key, queries)}, label {kind(label, labelled)}, confidence double, margin double, best_similarity double")


def abstained(votes: DataFrame, least_margin: float, least_similarity: float) -> DataFrame:
    sure = (F.col("margin") >= least_margin) & (F.col("best_similarity") >= least_similarity)
    return votes.withColumn("abstain", ~sure).withColumn("label", F.when(sure, F.col("label")))


def class_means(labelled: DataFrame, label: str = "label", column: str = "vec") -> DataFrame:
    """(k, centre): the mean vector of every class, in a broadcastable table."""
    each = labelled.select(F.col(label).alias("k"), F.posexplode(column).alias("dim", "x")).groupBy("k", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centre"))


def approximate_neighbours(df: DataFrame, others: DataFrame, radius: float, key: str, column: str = "vec", bucket: float = 0.6, tables: int = 8, seed: int = 0) -> DataFrame:
    """Pairs of L2-normed vectors closer than ``radius``, by random projections; recall grows with ``tables``."""
    ready = lambda d: d.select(key, array_to_vector(fv.l2_normalise(F.col(column), 1e-8)).alias("_x"))
    a, b = ready(df), ready(others)
    model = BucketedRandomProjectionLSH(inputCol="_x", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(a)
    pairs = model.approxSimilarityJoin(a, b, radius, "distance")
    return pairs.select(F.col(f"datasetA.{key}").alias("a"), F.col(f"datasetB.{key}").alias("b"), "distance").where("a <> b")
