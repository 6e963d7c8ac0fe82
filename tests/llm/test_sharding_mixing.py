from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, sharding
from tests.conftest import SF_DIR
from tests.llm import edge

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_position(number, rows, seed=1):
    a, b = sharding.grid(rows)
    mixed = lambda t, h: int(hashlib.md5(f"{seed}:{t}:{h}".encode()).hexdigest()[:15], 16)
    v = number
    while True:
        left, right = divmod(v, b)
        for t in range(sharding.ROUNDS):
            if t % 2 == 0:
                left = (left + mixed(t, right)) % a
            else:
                right = (right + mixed(t, left)) % b
        v = left * b + right
        if v < rows:
            return v


def test_shards_match_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    order = sorted(rows, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest()[:3], r.doc_id))
    want = {}
    for i, r in enumerate(order):
        v = brute_position(i, len(rows))
        want[r.doc_id] = (len(r.text.encode()) + 8, zlib.crc32(r.text.encode()), "rows", v % 24, v // 24, None)
    got = {r.doc_id: tuple(r)[1:] for r in sharding.shard(spark.createDataFrame(rows)).collect()}
    assert got == want


def test_hot_keys_change_no_number(spark, monkeypatch):
    """A third of the rows without a key, and two hot keys of one bucket: numbers as by one sort."""
    bucket = lambda k: hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:3]
    first = 7
    other = next(i for i in range(8, 100_000) if bucket(i) == bucket(first))
    between = [i for i in range(other + 1, 200_000) if bucket(i) == bucket(first)][:2]
    keys = [None] * 60 + [first] * 30 + [other] * 30 + between + list(range(50))
    rows = [(k, (i * 2654435761) % (1 << 32), i % 5) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "doc_id long, crc long, size int")
    want = [r[1:] for r in sorted((bucket(k), k is None, k or 0, c, s) for k, c, s in rows)]
    get = lambda: [(r.doc_id is None, r.doc_id or 0, r.crc, r["size"]) for r in sorted(sharding.numbered(df, "doc_id", ["crc", "size"]).collect(), key=lambda r: r.row_number)]
    assert get() == want
    monkeypatch.setattr(sharding, "HOT_LEAST", 10)
    monkeypatch.setattr(sharding, "MOST_HOT", 20)
    assert set(sharding.hot_keys(df, "doc_id", len(rows))) == {None, first, other} and get() == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 50, 101])
def test_permutation_is_a_bijection(spark, n):
    df = sharding.permute(spark.range(n), "id", n, seed=9)
    assert sorted(r.position for r in df.collect()) == list(range(n))


def test_shards_of_odd_rows(spark):
    got = sharding.shard(edge.docs(spark), shards=3).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 3, i // 3) for i in range(len(edge.ROWS)))
    none = next(r for r in got if r.doc_id == 2)
    assert (none.size, none.text_crc32, none.grown_shard) == (8, 0, None)
    assert sharding.shard(edge.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(edge.docs(spark), shards=0)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Deals and deals again, source by source in the order of names with None last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    whole, capped = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        rest = whole - sum(capped.values())
        got = {s: rest * w[s] / sum(w[o] for o in open_) for s in open_}
        over = [s for s in open_ if got[s] > cap * sizes[s] + 1e-9]
        if not over:
            return got | capped
        capped |= {s: cap * sizes[s] for s in over}


def check_mix(docs, got):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORDS.findall(r.text or ""))
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    source = {r.doc_id: r.source for r in rows}
    taken: dict = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    return taken, want


def test_mix_meets_its_targets_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).collect()
    taken, want = check_mix(docs, got)
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] for s in want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(got) == sorted(again)
    assert sorted(mixing.mix(docs, seed=2).collect()) != sorted(got)


def brute_copies(sizes, target, cap=2.0):
    """size -> expected copies, by halving: min(cap, level * weight), the weight being the power of two about the root."""
    weight = lambda n: 2 ** ((n.bit_length() - 1) // 2)
    low, high = 0.0, 4.0 * cap
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(n * min(cap, level * weight(n)) for n in sizes) < target else (low, level)
    return {n: min(cap, low * weight(n)) for n in sizes}


def test_mix_inclusion_follows_unequal_probabilities(spark):
    """Over several seeds documents of a size class are taken as often as their own expected copies, which differ within
    a source; whole copies are certain."""
    docs = spark.createDataFrame([(i, "w " * (1, 3, 5, 12, 20, 70)[i % 6], "abc"[i // 1200]) for i in range(3600)], "doc_id long, text string, source string").cache()
    source = {r.doc_id: r.source for r in docs.collect()}
    seeds, total, taken = 4, {}, {}
    for seed in range(seeds):
        got = mixing.mix(docs, seed=seed).collect()
        for r in got:
            total.setdefault((source[r.doc_id], r.size), []).append(r.taken / r.size)
        taken |= {source[r.doc_id]: r for r in got}
    kinds = set()
    for s in "abc":
        want = brute_copies([r.size for r in got if source[r.doc_id] == s], taken[s].target)
        kinds |= {round(c, 3) for c in want.values()}
        for size, c in want.items():
            each = total[s, size]
            assert sum(each) / len(each) == pytest.approx(c, abs=0.07), (s, size)
            assert {int(x) for x in each} <= {int(c + 1e-9), int(c + 1e-9) + 1}
    assert len(kinds) >= 5, "unequal probabilities"


def test_given_weights_decide(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a", (1.0, 4.0, None, -3.0)[i % 4]) for i in range(2000)], "doc_id long, text string, source string, quality double")
    got = mixing.mix(docs, share=0.5, weight="quality").collect()
    mean = [sum(r.taken / r.size for r in got if r.doc_id % 4 == k) / 500 for k in range(4)]
    assert mean[1] == pytest.approx(4 * 2 / 7, abs=0.08) and all(mean[k] == pytest.approx(2 / 7, abs=0.08) for k in (0, 2, 3))


def test_running_sums_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGES", 5)
    rng = random.Random(4)
    rows = [(f"s{i}" if i else None, rng.choice([0, 1, 7, 300])) for i in range(60)]
    df = spark.createDataFrame(rows, "source string, source_size long")
    few, many = (sorted(mixing.source_targets(df, (5, 2, 1), 1.5, 2.0, m).collect(), key=str) for m in (False, True))
    assert few == many
    monkeypatch.setattr(mixing, "SMALL_SOURCES", 2)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    whole = sorted(mixing.mix(docs).collect())
    monkeypatch.undo()
    assert whole == sorted(mixing.mix(docs).collect())


def test_resampled_with_the_operators_own_names(spark):
    docs = edge.docs(spark)
    for name in ("_k", "_s", "_n", "_copies", "_copy", "_row", "_key", "_left", "class", "_in"):
        docs = docs.withColumn(name, F.lit("clash"))
    out = mixing.resampled(docs)
    assert out.columns == docs.columns and out.where("_k = 'clash' and _copies = 'clash'").count() == out.count() > 0


def test_mix_of_odd_rows(spark):
    docs = edge.docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(edge.ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].size == by[2].taken == 0 and by[5].size == 3
    assert mixing.mix(edge.empty(spark)).count() == 0
    out = mixing.resampled(docs)
    assert out.columns == docs.columns and mixing.resampled(edge.empty(spark)).count() == 0
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in edge.ROWS}


def test_targets_against_dealing_again(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 40, 1000]) for i in range(7)} | {None: 9}
        df = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0)
        want = brute_targets(sizes)
        assert {r.source: pytest.approx(r.target) for r in df.collect()} == want
