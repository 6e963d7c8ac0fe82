"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all documents counts, on hashed words, in how many documents a word occurs (for IDF) and the
   co-occurrence of words inside passages times a sparse random sign matrix. That is A'A times a test matrix for the
   passages' TF-IDF matrix A (its columns' scale moved to the test matrix), so the leading singular vectors of A follow
   without another pass (randomised SVD in its single-view, Nystroem form).
2. Benchmark items become vectors of their passages in that latent space, scaled so that every direction counts alike.
   In a second pass, overlapping passages of every document are compared with all of them by cosine, in blocks.
   Where the cosine reaches ``cosine``, passage and item must have ``common`` of the IDF of the lighter of the two in
   common; both gates are lower where items have answers.
3. Candidates are checked on words: the longest common subsequence of item and surrounding text must cover
   ``strong`` of the item's words, or ``weak`` if all words of the item's answer stand there too (paraphrases).

The search by cosine is approximate: the tests measure its recall, at these gates, against the longest common subsequence
of every text with every item.

Scale: no document is shuffled. Partial sums (WORDS x SKETCH numbers a task) are added by slices; the model is of the same
size at any input. A benchmark of more than MOST_ITEMS items or MOST_BYTES is searched in parts, one pass over the documents
for each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release_memory, trimmed

WORDS = 8192
SKETCH = 112
DIMENSIONS = 80
PASSAGE = 24
STRIDE = 12
COSINE = 0.36
#: share of the IDF of the lighter side that a passage and an item must have in common to be compared word by word
COMMON = 0.4
#: both gates where items have answers
COSINE_WEAK, COMMON_WEAK = 0.3, 0.25
STRONG, WEAK = 0.65, 0.45
#: what is broadcast of a benchmark at once
MOST_ITEMS, MOST_BYTES = 10_000, 16 << 20
SLICES = 32
#: passages that are multiplied at once
GROUP = 64
#: bytes of words: ASCII letters and digits, and all of other scripts; the rest separates
_LETTER = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_STEP = 0x9E3779B97F4A7C15
_PIECE = 1 << 16
#: bytes of texts whose words are found together, and candidates that are looked at together
_TOGETHER, _CANDIDATES = 1 << 17, 1 << 16


def _powers(base: int, n: int = _PIECE + 1) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


class Words:
    """The words of a text in lower case: their places in its bytes and their hashed features."""

    def __init__(self, text: str | None):
        self._read(text.lower().encode("utf-8", "surrogatepass") if text else b"")

    @classmethod
    def many(cls, texts: list[str | None]) -> Iterator[Words]:
        """The words of each text; those of short texts are found together."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(text.lower().encode("utf-8", "surrogatepass") if text else b"")
            size += len(held[-1])
            if size >= _TOGETHER:
                yield from cls._apart(held)
                held, size = [], 0
        if held:
            yield from cls._apart(held)

    @classmethod
    def _apart(cls, parts: list[bytes]) -> Iterator[Words]:
        whole = cls.__new__(cls)
        whole._read(b"\n".join(parts))
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        at = np.searchsorted(whole.starts, np.r_[0, ends]).tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            one = cls.__new__(cls)
            one.data, one.starts, one.ends, one.ids = whole.data, whole.starts[a:b], whole.ends[a:b], whole.ids[a:b]
            yield one

    def _read(self, encoded: bytes) -> None:
        self.data = encoded
        data = np.frombuffer(encoded, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _LETTER[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.ids = np.concatenate([self._hashed(data, a) for a in range(0, max(1, len(data)), _PIECE)]) if len(data) > _PIECE else self._hashed(data, 0)

    def _hashed(self, data: np.ndarray, at: int) -> np.ndarray:
        """Polynomial hashes of the words that start in a piece, from running sums over their bytes."""
        a, b = np.searchsorted(self.starts, (at, at + _PIECE))
        if a == b:
            return np.empty(0, np.int64)
        s = self.starts[a:b] - at
        piece = data[at : int(self.ends[b - 1])]
        with np.errstate(over="ignore"):
            if len(piece) > _PIECE:
                # the last word crosses the border: on its own, a piece at a time
                last, tail = piece[s[-1] :], np.uint64(0)
                for k in range(0, len(last), _PIECE):
                    part = last[k : k + _PIECE]
                    tail += (part * _UP[: len(part)]).sum(dtype=np.uint64) * np.uint64(pow(_STEP, k, 1 << 64))
                piece, s, e = piece[: s[-1]], s[:-1], self.ends[a : b - 1] - at
            else:
                tail, e = None, self.ends[a:b] - at
            run = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * _UP[: len(piece)], out=run[1:])
            h = (run[e] - run[s]) * _DOWN[s]
            if tail is not None:
                h = np.append(h, tail)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, a: int, b: int) -> list[bytes]:
        return [self.data[x:y] for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def _sketch() -> tuple[np.ndarray, np.ndarray]:
    """The test matrix: one signed entry for each word."""
    rng = np.random.default_rng(11)
    return rng.integers(0, SKETCH, WORDS), rng.choice([-1.0, 1.0], WORDS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    column, sign = _sketch()
    seen = np.zeros(WORDS)
    product = np.zeros((WORDS, SKETCH), np.float32)
    held: list[np.ndarray] = []
    held_words = documents = 0

    def add() -> None:
        """Adds, to the row of every word of a passage, the passage's sketch."""
        words = np.concatenate(held)
        before = np.cumsum([0, *(-(-len(w) // PASSAGE) for w in held)])
        passage = np.concatenate([np.arange(len(w)) // PASSAGE + b for w, b in zip(held, before[:-1], strict=True)])
        n = int(before[-1])
        sketch = np.bincount(passage * SKETCH + column[words], sign[words], n * SKETCH).reshape(n, SKETCH).astype(np.float32)
        order = np.argsort(words.astype(np.uint16), kind="stable")
        ordered = words[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        times = np.bincount((np.cumsum(new) - 1) * n + passage[order], minlength=int(new.sum()) * n).reshape(-1, n)
        product[ordered[new]] += times.astype(np.float32) @ sketch

    for batch in batches:
        for found in Words.many(batch.column(0).to_pylist()):
            words = found.ids
            documents += 1
            if not len(words):
                continue
            seen += np.bincount(words, minlength=WORDS) > 0
            for at in range(0, len(words), PASSAGE * GROUP):
                held.append(words[at : at + PASSAGE * GROUP])
                held_words += len(held[-1])
                if held_words >= PASSAGE * GROUP:
                    add()
                    held, held_words = [], 0
    if held:
        add()
    if documents:
        whole = np.concatenate([seen[:, None], product], 1).astype(np.float32)
        parts = [p.tobytes() for p in np.split(whole, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([documents] * SLICES, pa.int64()), pa.array(parts, pa.binary())], names=["slice", "documents", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    documents: dict[int, int] = {}
    for batch in batches:
        for k, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(sums, np.float32).astype(np.float64)
            total[k] = total[k] + part if k in total else part
            documents[k] = documents.get(k, 0) + n
    if total:
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([documents[k] for k in keys], pa.int64()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["slice", "documents", "sums"])


@dataclass
class Latent:
    """Every word's share in a passage's latent vector: IDF times its row of the scaled singular vectors."""

    vectors: np.ndarray
    values: np.ndarray
    idf: np.ndarray

    def passages(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums over the passages that start ``at`` multiples of STRIDE and, the last, flush with the end."""
        rows = self.vectors[words]
        if len(words) <= PASSAGE:
            return rows.sum(0, keepdims=True)
        whole = len(words) // STRIDE
        blocks = rows[: whole * STRIDE].reshape(whole, STRIDE, -1).sum(1)
        n = PASSAGE // STRIDE
        sums = sum(blocks[i : whole - n + 1 + i] for i in range(n))
        return sums if len(sums) == len(at) else np.concatenate([sums, rows[-PASSAGE:].sum(0, keepdims=True)])

    def embed(self, rows: np.ndarray) -> np.ndarray:
        z = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        return z.astype(np.float32)


def fit(docs: DataFrame, text: str = "text") -> Latent | None:
    """The latent space of all documents; None if there are no words."""
    parts = docs.select(F.col(text).alias("text")).mapInArrow(lambda it: trimmed(_count(it)), "slice int, documents long, sums binary")
    sums = parts.repartition(SLICES, "slice").mapInArrow(_added, "slice int, documents long, sums binary").collect()
    if not sums:
        return None
    # SLICES rows at any input size
    whole = np.concatenate([np.frombuffer(r.sums, np.float64).reshape(-1, SKETCH + 1) for r in sorted(sums, key=lambda r: r["slice"])])
    documents, seen, product = sums[0].documents, whole[:, 0], whole[:, 1:]
    if not seen.any():
        return None
    idf = np.log((1 + documents) / (1 + seen)) + 0.1
    column, sign = _sketch()
    test = np.zeros((WORDS, SKETCH))
    test[np.arange(WORDS), column] = sign
    test /= idf[:, None]
    image = idf[:, None] * product
    core = test.T @ image
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values[-1] * 1e-9
    root = image @ (vectors[:, keep] / np.sqrt(values[keep]))
    left, spread, _ = np.linalg.svd(root, full_matrices=False)
    k = min(DIMENSIONS, int((spread > spread[0] * 1e-6).sum()))
    return Latent((idf[:, None] * left[:, :k] / spread[:k]).astype(np.float32), spread[:k], np.r_[idf, 0.0])


def starts(n: int, width: int = PASSAGE, stride: int = STRIDE) -> np.ndarray:
    """Starts of overlapping passages that cover n words, the last one flush with the end."""
    if n <= width:
        return np.zeros(min(n, 1), np.int64)
    return np.unique(np.r_[np.arange(0, n - width + 1, stride), n - width])


def lcs(item_masks: dict[bytes, int], length: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, bits of a row at a time."""
    full = (1 << length) - 1
    row = full
    for w in words:
        m = item_masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return length - row.bit_count()


@dataclass
class Benchmark:
    ids: list
    words: list[list[bytes]]
    masks: list[dict[bytes, int]]
    answers: list[set[bytes] | None]
    owner: np.ndarray
    vectors: np.ndarray
    #: bits of the words of every item, and the IDF of its lightest passage
    has: np.ndarray
    mass: np.ndarray


def prepare(items: list[tuple], latent: Latent) -> Benchmark:
    """items: (id, text, answer or None); items without words match nothing. Their passages need not overlap, as those of
    documents do."""
    vectors, out, owner, rows, masks, answers = latent.vectors, [], [], [], [], []
    kept, has, mass = [], [], []
    for item, text, answer in items:
        found = Words(text)
        if not len(found):
            continue
        words = found.text(0, len(found))
        mask: dict[bytes, int] = {}
        for i, w in enumerate(words):
            mask[w] = mask.get(w, 0) | 1 << i
        at = starts(len(words), PASSAGE, PASSAGE)
        rows += [vectors[found.ids[a : a + PASSAGE]].sum(0) for a in at]
        owner += [len(kept)] * len(at)
        bits = np.zeros(WORDS + 8, np.uint8)
        bits[found.ids] = 1
        has.append(np.packbits(bits))
        mass.append(min(latent.idf[found.ids[a : a + PASSAGE]].sum() for a in at))
        kept.append(item)
        out.append(words)
        masks.append(mask)
        wanted = Words(answer)
        answers.append(set(wanted.text(0, len(wanted))) or None)
    table = latent.embed(np.array(rows, np.float32).reshape(-1, vectors.shape[1]))
    return Benchmark(kept, out, masks, answers, np.array(owner, np.int64), table, np.array(has), np.array(mass))


def leaks(texts: list[str | None], latent: Latent, bench: Benchmark, cosine: float, common: float, strong: float, weak: float) -> list[list[tuple]]:
    """For every text the items found in it: (item, words of the common subsequence, its share, cosine)."""
    found: list[list[tuple]] = [[] for _ in texts]
    if not len(bench.owner):
        return found
    group: list[tuple] = []
    held = 0

    def search() -> None:
        z = latent.embed(np.concatenate([g[2] for g in group]))
        words = np.concatenate([np.r_[g[4], np.full(PASSAGE, WORDS)][g[3][:, None] + np.arange(PASSAGE)] for g in group])
        weight = latent.idf[words]
        total = weight.sum(1)
        edges = np.cumsum([0] + [len(g[2]) for g in group])
        best: dict[tuple[int, int], list] = {}
        block = max(1, (1 << 22) // len(bench.owner))
        for at in range(0, len(z), block):
            near = z[at : at + block] @ bench.vectors.T
            over = np.flatnonzero(near >= cosine)
            for some in (over[i : i + _CANDIDATES] for i in range(0, len(over), _CANDIDATES)):
                rows, cols = np.divmod(some, near.shape[1])
                value, rows, item = near[rows, cols], rows + at, bench.owner[cols]
                shared = ((bench.has[item[:, None], words[rows] >> 3] >> (7 - (words[rows] & 7))) & 1) * weight[rows]
                fine = np.flatnonzero(shared.sum(1) >= common * np.minimum(total[rows], bench.mass[item]))
                which = np.searchsorted(edges, rows, "right") - 1
                for k in fine.tolist():
                    g = int(which[k])
                    best.setdefault((g, int(item[k])), []).append((int(group[g][3][rows[k] - edges[g]]) + group[g][5], float(value[k])))
        for (g, item), places in best.items():
            i, tokens, *_ = group[g]
            words, n = bench.words[item], len(bench.words[item])
            best_here = (0, 0.0, 0.0)
            done = -1
            for start in sorted({p for p, _ in places}):
                if start <= done:
                    continue
                # neighbours are looked at together
                stop = max(q for q, _ in places if q <= start + n) + PASSAGE
                done = stop - PASSAGE
                around = tokens.text(max(0, start - n), stop + n)
                if lcs(bench.masks[item], n, around) < (strong if bench.answers[item] is None else min(strong, weak)) * n:
                    continue
                for a in range(0, max(1, len(around) - n), max(1, n // 4)):
                    span = around[a : a + n + max(4, n // 2)]
                    length = lcs(bench.masks[item], n, span)
                    enough = length >= strong * n or (bench.answers[item] is not None and length >= weak * n and bench.answers[item] <= set(span))
                    if enough and length > best_here[0]:
                        best_here = (length, length / n, max(v for _, v in places))
            if best_here[0]:
                found[i].append((bench.ids[item], *best_here))

    for i, tokens in enumerate(Words.many(texts)):
        # long texts pass by in pieces that overlap by two passages
        for at in range(0, len(tokens), 1 << 15):
            first = max(0, at - 2 * PASSAGE)
            words = tokens.ids[first : at + (1 << 15)]
            s = starts(len(words))
            group.append((i, tokens, latent.passages(words, s), s, words, first))
            held += len(s)
            if held >= 20_000:
                search()
                group, held = [], 0
    if group:
        search()
    # a piece border may show one item twice
    return [sorted({k: max((x for x in f if x[0] == k), key=lambda x: x[1:]) for k in {x[0] for x in f}}.values()) for f in found]


def _parts(benchmark: DataFrame, item: str, item_text: str, answer: str | None) -> list[DataFrame]:
    """The items (id, text, answer) with id and text, in parts of at most about MOST_ITEMS items and MOST_BYTES."""
    chosen = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")).where("i is not null and t is not null")
    rows, size = chosen.agg(F.count("*"), F.sum(F.octet_length("t") + F.coalesce(F.octet_length("a"), F.lit(0)))).first()
    parts = max(1, -(-rows // MOST_ITEMS), -(-(size or 0) // MOST_BYTES))
    if parts == 1:
        return [chosen]
    # a hash deals evenly but for chance
    parts += parts // 4 + 1
    return [chosen.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p) for p in range(parts)]


def _prepared(part: DataFrame, latent: Latent) -> Benchmark:
    return prepare(sorted(map(tuple, part.collect()), key=str), latent)


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float | None = None, strong: float = STRONG, weak: float = WEAK, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None, common: float | None = None) -> DataFrame:
    """One row (key, item, lcs_words, lcs_share, cosine) for each document and benchmark item found in it.

    ``cosine`` and ``common`` are the gates of the candidate search, by default lower with an ``answer`` column. Null and
    empty texts and items match nothing; repeated rows are reported each; items with equal texts are all reported; an
    empty table on either side gives no rows; other columns are not read.
    """
    cosine, common = _gates(cosine, common, answer)
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    kinds = slim.schema["k"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = pa.int64() if kinds[1] in ("bigint", "int", "smallint") else pa.string()
    schema = f"k {kinds[0]}, item {'long' if item_type == pa.int64() else 'string'}, lcs_words int, lcs_share double, cosine double"
    latent = fit(docs, text)
    release_memory()
    names = {"k": key, "item": item}
    if latent is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnsRenamed(names)

    def over(bench: Benchmark) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
                found = leaks(batch.column(1).to_pylist(), latent, bench, cosine, common, strong, weak)
                rows = [(i, *f) for i, each in enumerate(found) for f in each]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], item_type), *[pa.array([r[j] for r in rows], t) for j, t in ((2, pa.int32()), (3, pa.float64()), (4, pa.float64()))]], names=["k", "item", "lcs_words", "lcs_share", "cosine"])

        return slim.mapInArrow(lambda it: trimmed(run(it)), schema)

    each = [over(_prepared(part, latent)) for part in _parts(benchmark, item, item_text, answer)]
    return functools.reduce(DataFrame.union, each).withColumnsRenamed(names)


def _gates(cosine: float | None, common: float | None, answer: str | None) -> tuple[float, float]:
    usual = (COSINE_WEAK, COMMON_WEAK) if answer else (COSINE, COMMON)
    return usual[0] if cosine is None else cosine, usual[1] if common is None else common


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float | None = None, strong: float = STRONG, weak: float = WEAK, text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None, common: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found: a filter without a shuffle."""
    cosine, common = _gates(cosine, common, answer)
    at = docs.columns.index(text)
    latent = fit(docs, text)
    release_memory()
    if latent is None:
        return docs

    def without(docs: DataFrame, bench: Benchmark) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
                found = leaks(batch.column(at).to_pylist(), latent, bench, cosine, common, strong, weak)
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        return docs.mapInArrow(lambda it: trimmed(run(it)), docs.schema)

    for part in _parts(benchmark, item, item_text, answer):
        docs = without(docs, _prepared(part, latent))
    return docs
