"""Quality classifier: a generalised additive model with pairwise interactions.

Each figure of a text has a lookup table over its bins, learned by cyclic boosting: in turn, a shallow tree over one
figure's bins is fitted to the gradient and a small part of it is added to that figure's table. Then pairs of figures
whose joint bins explain most of what is left get tables too, learned the same way. Scoring adds up table entries.

Figures are computed in one pass over whole texts and kept (a few numbers a document). The tables are learned on the
driver from a bounded sample, at most MOST_TRAINED labelled documents in the order of the MD5 of their ids.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc, stored

MOST_TRAINED = 20_000
FIGURES = ("words", "word_length", "symbols", "marks", "capitals", "digits", "stops", "same_lines", "distinct_words", "doubled_words", "line_words", "wide_bytes")
_GROUPS = {"symbols": b"#*$%&|<>@^~=+_{}[]\\/", "marks": b"!?", "digits": b"0123456789", "stops": b".,;:"}
_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)


def figures(text: str | None) -> tuple[float, ...]:
    """What FIGURES names, of the whole text; an empty text has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0.0,) * len(FIGURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, size = len(words), max(1, int(count.sum() - count[[9, 10, 11, 12, 13, 32]].sum()))
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, letters = int(count[_UPPER].sum()), int(count[_UPPER].sum() + count[_LOWER].sum())
    share = {name: int(count[list(chars)].sum()) / size for name, chars in _GROUPS.items()}
    doubled = sum(map(operator.eq, words, itertools.islice(words, 1, None))) / n
    return (np.log1p(n), size / n, share["symbols"], share["marks"], upper / max(1, letters), share["digits"], share["stops"], 1 - len(set(lines)) / len(lines), len(set(words)) / n, doubled, np.log1p(n / len(lines)), int(count[128:].sum()) / size)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([figures(t) for t in batch.column(2).to_pylist()], np.float64).reshape(-1, len(FIGURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(rows[:, i]) for i in range(len(FIGURES))]], names=["k", "held_out", *FIGURES])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    joint: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, i], "right")]
        for (i, j), values in zip(self.pairs, self.joint, strict=True):
            total += values[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds between bins: quantiles of the distinct values' order."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values of a tree over ordered bins: the best split of the best leaf, until there are so many leaves."""
    cuts = [(0, len(g))]
    G, H = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    gain_of = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    while len(cuts) < leaves:
        best = (1e-9, None)
        for a, b in cuts:
            at = np.arange(a + 1, b)
            at = at[(H[at] - H[a] >= least) & (H[b] - H[at] >= least)]
            if len(at):
                gains = (G[at] - G[a]) ** 2 / (H[at] - H[a] + 1.0) + (G[b] - G[at]) ** 2 / (H[b] - H[at] + 1.0) - gain_of(a, b)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (gains[k], (a, int(at[k]), b))
        if best[1] is None:
            break
        a, m, b = best[1]
        cuts = [c for c in cuts if c != (a, b)] + [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in cuts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def _joint_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cross of one cut on each axis: values of its four quarters, and its gain."""
    G, H = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    best, values = 0.0, np.zeros_like(g)
    whole = G[-1, -1] ** 2 / (H[-1, -1] + 1.0)
    for a, b in itertools.product(range(1, g.shape[0]), range(1, g.shape[1])):
        quarters = []
        for rows, cols in itertools.product(((0, a), (a, g.shape[0])), ((0, b), (b, g.shape[1]))):
            part = lambda T: T[rows[1], cols[1]] - T[rows[0], cols[1]] - T[rows[1], cols[0]] + T[rows[0], cols[0]]  # noqa: B023, E731
            quarters.append((rows, cols, part(G), part(H)))
        gain = sum(x**2 / (y + 1.0) for _, _, x, y in quarters) - whole
        if gain > best:
            best, values = gain, np.zeros_like(g)
            for rows, cols, x, y in quarters:
                values[rows[0] : rows[1], cols[0] : cols[1]] = x / (y + 1.0)
    return values, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.1, leaves: int = 3, n_pairs: int = 5, pair_rounds: int = 20, pair_bins: int = 8) -> Model:
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(mean / (1 - mean))), [_edges(x[:, i], bins) for i in range(x.shape[1])], [])
    at = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[i], g, len(table)), np.bincount(at[i], h, len(table)), leaves, 1e-3)
            table += step
            total += step[at[i]]
    model.coarse = [_edges(x[:, i], pair_bins) for i in range(x.shape[1])]
    rough = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.coarse)]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def joint(i, j):
        g, h = slopes()
        cell = rough[i] * shape(i, j)[1] + rough[j]
        size = shape(i, j)[0] * shape(i, j)[1]
        return cell, np.bincount(cell, g, size).reshape(shape(i, j)), np.bincount(cell, h, size).reshape(shape(i, j))

    ranked = sorted(((_joint_tree(*joint(i, j)[1:])[1], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:n_pairs] if gain > 1e-6]
    model.joint = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.joint, strict=True):
            cell, g, h = joint(i, j)
            step = rate * _joint_tree(g, h)[0]
            table += step
            total += step.ravel()[cell]
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], 1) if batch.num_rows else np.zeros((0, len(FIGURES)))
        score = model.score(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["k", "held_out", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, most: int = MOST_TRAINED, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score, predicted of every row.

    ``held_out`` marks rows whose labels are never read (default: CRC-32 of the key as text mod 3 is 1). Null and empty
    texts have zeros for figures and are scored too; null labels are skipped and repeated ones all count; without
    labels every score is 0.5; repeated rows score alike; an empty table gives no rows; other columns are not read.
    """
    held_out = crc(F.col(key)) % 3 == 1 if held_out is None else held_out
    slim = docs.select(F.col(key).alias("k"), held_out.alias("held_out"), F.col(text).alias("text"))
    kind = slim.schema["k"].dataType.simpleString()
    kept = stored(slim.mapInArrow(_figures, f"k {kind}, held_out boolean, " + ", ".join(f"{f} double" for f in FIGURES)), "figures")
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("_y")).where("k is not null and _y is not null")
    order = F.md5(F.col("k").cast("string").cast("binary"))
    sample = known.join(kept.where("not held_out"), "k").orderBy(order, "k", "_y", *FIGURES).limit(most).toArrow()
    if sample.num_rows:
        x = np.stack([sample.column(f).to_numpy() for f in FIGURES], 1)
        model = fit(x, sample.column("_y").to_numpy())
    else:
        model = Model(0.0, [np.empty(0)] * len(FIGURES), [np.zeros(1)] * len(FIGURES))
    out = kept.mapInArrow(lambda it: _score(it, model), f"k {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("k", key)
