"""Language identification with error-correcting output codes.

Every language has a codeword of bits; one linear classifier per bit, on hashed byte n-grams of the lower-cased text,
predicts whether the text's language has the bit set. Decoding is weighted by loss: the language whose codeword costs
the classifiers least, each bit weighted by how well it was learned, is chosen, and a text whose two nearest codewords
cost nearly the same is flagged as ambiguous.

The classifiers are fitted on the driver on a bounded sample: at most MOST_TRAINED documents, equally many of each
language, in the order of a hash of their ids and texts. Scoring is one pass over whole texts; the model is
BINS x bits numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc, release_memory, trimmed, uniform_hash

BINS = 4096
MOST_TRAINED = 1200
MOST_LANGUAGES = 256
SPARE = 3
UNKNOWN = "und"
#: the second-best language must cost this much more for a sure answer
AMBIGUOUS_MARGIN = 0.05
#: letters, and few other characters: numbers such as ½ or Ⅷ, which are looked at one by one
_LETTER = re.compile(r"[^\W\d_]")
#: letters and non-ASCII bytes stay, all else separates
_KEPT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode category L stands in the text (str.isalpha knows just these)."""
    return bool(text) and any(found[0].isalpha() for found in _LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams (2 and 3 bytes) of the whole text."""
    data = np.frombuffer(b" %b " % text.lower().encode("utf-8", "surrogatepass").translate(_KEPT), np.uint8).astype(np.uint32)
    keep = np.r_[True, (data[1:] != 32) | (data[:-1] != 32)]
    data = data[keep]
    two = data[:-1] * np.uint32(2654435761) + data[1:] * np.uint32(2246822519)
    three = two[:-1] + data[2:] * np.uint32(3266489917)
    count = np.zeros(BINS, np.float32)
    for h in (two, three):
        count += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(2891336453) >> np.uint32(20), minlength=BINS)
    return np.sqrt(count / max(count.sum(), 1.0)).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1. Up to 7 languages all distinct ways to part them in two; for more, of many random codes of
    8 + 4 log2(n) bits the one whose closest rows are farthest apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[1 if i == 0 or not (mask >> (i - 1)) & 1 else -1 for i in range(n)] for mask in range(1, 1 << (n - 1))]
        return np.array(columns, float).T
    rng, bits, best = np.random.default_rng(seed), 8 + 4 * int(np.ceil(np.log2(n))), (-1, None)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T)[~np.eye(n, dtype=bool)].min()
        if apart > best[0] and (np.abs(code.sum(0)) < n).all():
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def costs(self, x: np.ndarray) -> np.ndarray:
        """Mean weighted logistic loss of every language's codeword."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (loss * self.trust).sum(2) / self.trust.sum()

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score 0..1 and whether it is ambiguous."""
        cost = self.costs(x)
        p = np.exp(-(cost - cost.min(1, keepdims=True)) * self.code.shape[1])
        p /= p.sum(1, keepdims=True)
        best = cost.argmin(1)
        nearest = np.sort(cost, 1)
        margin = nearest[:, 1] - nearest[:, 0] if cost.shape[1] > 1 else np.full(len(x), np.inf)
        return best, p[np.arange(len(x)), best], margin < AMBIGUOUS_MARGIN


def fit(x: np.ndarray, languages: list[str], order: np.ndarray | None = None, steps: int = 150, rate: float = 0.3, penalty: float = 1e-5) -> Model:
    """Logistic regression for every bit at once, by full gradients with Adam steps; languages weigh equally. Rows are
    summed up in the given order, so that the same rows give the same bits however they came."""
    if order is not None:
        x, languages = x[order], [languages[i] for i in order]
    names = sorted(set(languages))
    code = codewords(len(names))
    which = np.searchsorted(names, languages)
    y = code[which].astype(np.float32)
    share = (1.0 / np.bincount(which))[which].astype(np.float32)[:, None] / len(names)
    w = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        margin = y * (x @ w[:-1] + w[-1])
        g = -y * share / (1 + np.exp(np.clip(margin, -30, 30)))
        gradient = np.vstack([x.T @ g + penalty * w[:-1], g.sum(0)])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    loss = (np.logaddexp(0, -y * (x @ w[:-1] + w[-1])) * share).sum(0)
    return Model(names, code, w[:-1], w[-1], 1 / (0.1 + loss))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, texts = batch.columns
        keep = [(a, features(b).tobytes()) for a, b in zip(lang.to_pylist(), texts.to_pylist(), strict=True) if has_letter(b)]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.string()), pa.array([k[1] for k in keep], pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, held_out: Column, most: int = MOST_TRAINED, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fits on documents that are not held out and have a language and a letter; None if there are none."""
    known = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out.alias("_out")).where("lang is not null and text is not null and not _out")
    counts = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = max(1, most // len(counts))
    known = known.withColumn("_hash", F.xxhash64("text"))
    # of each language about SPARE times as many as are wanted, by a hash, go on to be ordered: few rows however hot it is
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (SPARE * each + 100) / r["count"]))])
    chance = uniform_hash("language", F.col("_key"), F.col("_hash"))
    likely = known.select("_key", "_hash", "lang", chance.alias("_u")).where(F.col("_u") < share[F.col("lang")]).distinct()
    order = Window.partitionBy("lang").orderBy("_u", "_key", "_hash")
    picked = likely.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= each)
    # at most ``most`` rows; rows equal in key, text and language are learned from once
    picked = F.broadcast(picked.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), F.col("lang").alias("_lang")))
    same = (F.col("_hash") == F.col("_h")) & (F.col("lang") == F.col("_lang")) & F.col("_key").eqNullSafe(F.col("_k"))
    sample = known.join(picked, same, "left_semi").groupBy("_key", "_hash", "lang").agg(F.first("text").alias("text")).select("lang", "text")
    got = sample.mapInArrow(lambda it: trimmed(_rows(it)), "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    # one buffer, not copied: the driver holds the sample once
    column = got.column("x").combine_chunks()
    x = np.frombuffer(column.buffers()[2], np.float32)[: len(column) * BINS].reshape(-1, BINS)
    names = got.column("lang").to_pylist()
    order = np.lexsort((x[:, :64].sum(1), names))
    return fit(x, names, order)


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        keys, out, texts = batch.columns
        texts = texts.to_pylist()
        lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
        for at in range(0, len(known), 256):
            some = known[at : at + 256]
            best, p, near = model.predict(np.stack([features(texts[i]) for i in some]))
            score[some], unsure[some] = p, near
            for i, b in zip(some, best, strict=True):
                lang[i] = model.languages[b]
        yield pa.RecordBatch.from_arrays([keys, out, pa.array(lang), pa.array(score), pa.array(unsure)], names=["k", "held_out", "lang_pred", "score", "ambiguous"])


def identify(docs: DataFrame, held_out: Column | None = None, most: int = MOST_TRAINED, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score, ambiguous of every row.

    ``held_out`` marks rows never learned from (default: CRC-32 of the key as text mod 4 is 2). Null texts and texts
    without a letter are ``und`` with score 0, and so is everything if nothing can be learned; repeated rows are judged
    alike, ties go to the first language by code point; an empty table gives no rows; other columns are not read.
    """
    held_out = crc(F.col(key)) % 4 == 2 if held_out is None else held_out
    model = train(docs, held_out, most, key, text, lang)
    release_memory()
    slim = docs.select(F.col(key).alias("k"), held_out.alias("held_out"), F.col(text).alias("text"))
    kind = slim.schema["k"].dataType.simpleString()
    out = slim.mapInArrow(lambda it: trimmed(_predict(it, model)), f"k {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("k", key)


def known(docs: DataFrame, held_out: Column | None = None, most: int = MOST_TRAINED, key: str = "doc_id", text: str = "text", lang: str = "lang", accepted: tuple[str, ...] | None = None, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language the codewords tell: a filter without a shuffle.

    A text goes if its language is ``und``, if it is flagged as ambiguous (the two nearest codewords cost nearly the
    same) or if the language is none of ``accepted`` (by default all learned ones are accepted). Null texts and texts
    without a letter are ``und``; if nothing can be learned, nothing can be told and every row goes. ``model`` takes the
    place of a model trained on ``docs``.
    """
    at = docs.columns.index(text)
    model = model or train(docs, crc(F.col(key)) % 4 == 2 if held_out is None else held_out, most, key, text, lang)
    release_memory()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            none = pa.array([None] * batch.num_rows, pa.bool_())
            judged = next(_predict(iter([pa.RecordBatch.from_arrays([none, none, batch.column(at)], names=["k", "o", "t"])]), model))
            found = zip(judged.column("lang_pred").to_pylist(), judged.column("ambiguous").to_pylist(), strict=True)
            keep = [x != UNKNOWN and not unsure and (accepted is None or x in accepted) for x, unsure in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lambda it: trimmed(run(it)), docs.schema)
