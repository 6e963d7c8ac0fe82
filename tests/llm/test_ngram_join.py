from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import graph
from tessera.llm import ngram_join as nj
from tests.conftest import SF_DIR
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(sets):
    """sets: key -> set; keys unique."""
    keys, root = sorted(sets), {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def near_copies(rng, n, words, edits, vocabulary=5000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def hard(spark):
    """Groups of copies at and around the limit, passages that many share, short texts, case and spacing variants."""
    rng = random.Random(5)
    texts = [t for words, edits in ((30, 2), (120, 4), (300, 9), (60, 1)) for t in near_copies(rng, 25, words, edits)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 200))) + " " + passage for _ in range(30)]
    texts += [passage, passage.upper(), "  " + passage.replace(" ", "\n"), "one two", "One  Two", "one two three", "", None, " \t"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("block", "together"), [(nj.BLOCK, nj.TOGETHER), (7, nj.TOGETHER), (5, 2)])
def test_matches_brute_force(spark, hard, block, together, monkeypatch):
    """With a small ``block``, blocks are cut into shards; nothing changes."""
    monkeypatch.setattr(nj, "TOGETHER", together)
    sets = {i: brute_set(t) for i, t in hard}
    want = brute_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join(spark.createDataFrame(hard, "doc_id long, text string"), block=block).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_matches_brute_force_on_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: brute_set(r.text) for r in rows}
    want = brute_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join(spark.createDataFrame(rows)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=2, max_size=14))
def test_tree_finds_the_components(sets):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    found = nj.linked(arrays)
    want = brute_components(dict(enumerate(sets)))
    groups = lambda m: {frozenset(i for i in range(len(sets)) if m[i] == k) for k in set(m[i] for i in range(len(sets)))}
    assert groups(found) == groups(want)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.integers(0, 40), st.randoms(use_true_random=False))
def test_prefixes_of_linked_sets_meet(a, edits, rng):
    b = set(a)
    for _ in range(edits):
        b ^= {rng.randrange(500)}
    o = len(a & b)
    if not b or 100 * o < 80 * len(a | b):
        return
    pa, pb = sorted(a)[: nj.reach(len(a))], sorted(b)[: nj.reach(len(b))]
    assert len(set(pa) & set(pb)) >= nj.need(min(len(a), len(b))) >= nj.need(-(-80 * max(len(a), len(b)) // 100))


def test_pruning_visits_few_nodes_of_a_dense_group():
    rng = np.random.default_rng(0)
    tree = nj.PrefixTree(400)
    for _ in range(400):
        keep = np.flatnonzero(rng.random(400) > 0.02)
        tree.add(keep, len(keep))
    assert len({tree.find(i) for i in range(400)}) == 1
    assert tree.visited < 400 * 60


def test_odd_rows(spark):
    rows = sorted(nj.join(edge.docs(spark)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in rows]
    assert got[:2] == [(1, 10, 1), (1, 10, 1)] and (2, 0, 2) in got and (4, 0, 4) in got and (8, 1, 7) in got
    assert got[-1][0] is None and got[-1][1] > 0
    assert nj.join(edge.empty(spark)).count() == 0
    kept = nj.one_of_each(edge.docs(spark))
    assert kept.columns == edge.docs(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_rows_without_a_key_link_as_any(spark):
    """As a near copy, as the bridge between two others, and alone."""
    words = [f"w{i}" for i in range(100)]
    changed = lambda low, high: " ".join(w if not low <= i < high else f"x{i}" for i, w in enumerate(words))
    assert len(brute_set(changed(0, 10)) & brute_set(changed(90, 100))) * 100 < 80 * len(brute_set(changed(0, 10)) | brute_set(changed(90, 100)))
    rows = [(5, changed(0, 10)), (None, changed(0, 0)), (9, changed(90, 100)), (None, "alone in this table with no key at all"), (None, "alone in this table with no key at all"), (None, None), (3, "a b c"), (3, "d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_first": F.lit("clash"), "keeper": F.lit("clash"), "uid": F.lit("clash")})
    got = sorted((r.component_id or -1, r.n_shingles) for r in nj.join(docs).collect())
    assert got == sorted([(5, 96)] * 3 + [(-1, 5)] * 2 + [(-1, 0), (3, 1), (3, 1)])
    kept = nj.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(5, rows[0][1]), (-1, rows[3][1]), (-1, ""), (3, "a b c"), (3, "d e f")])


@pytest.mark.parametrize("sampled", [1, 3])
def test_tokens_that_all_sets_share(spark, hard, sampled, monkeypatch):
    """With nearly every token hot, chained through hubs and counted as frequent, the result is the same."""
    monkeypatch.setattr(nj, "SAMPLED", sampled)
    monkeypatch.setattr(nj, "HOT_LEAST", 2)
    monkeypatch.setattr(nj, "FREQUENT", 8)
    sets = {i: brute_set(t) for i, t in hard}
    want = brute_components(sets)
    got = {r.doc_id: r.component_id for r in nj.join(spark.createDataFrame(hard, "doc_id long, text string"), block=40).collect()}
    assert got == want


def test_hot_tokens_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(nj, "SAMPLED", 1)
    monkeypatch.setattr(nj, "HOT_LEAST", 2)
    monkeypatch.setattr(nj, "MOST_HOT", 10)
    rows = [(b"%d" % n, [t for t in range(100) if n < (1 if t > 40 else 50 - t)]) for n in range(50)]
    hot = nj._hot(spark.createDataFrame(rows * 3, "print binary, tokens array<long>"))
    assert hot is None or hot.count() <= 10


@pytest.mark.parametrize("few", [0, 20, graph.FEW])
def test_components_of_paths_hubs_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3), (301, 300), (300, 301)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 300: 300, 301: 300}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(-30, 30)), min_size=1, max_size=60))
def test_few_edges_are_solved(edges):
    import pyarrow as pa

    parts = [pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges[j : j + 7]]) for i in (0, 1)], names=["a", "b"]) for j in range(0, len(edges), 7)]
    [found] = graph._solved(iter(parts))
    got = dict(zip(found.column("n").to_pylist(), found.column("h").to_pylist(), strict=True))
    near = {n: {n} for e in edges for n in e}
    for _ in near:
        for a, b in edges:
            near[a] = near[b] = near[a] | near[b]
    want = {n: min(m for m in near if near[m] & near[n]) for n in near}
    for _ in near:
        want = {n: want[want[n]] for n in want}
    assert got == want


def test_runs_across_batches():
    import pyarrow as pa

    token = np.repeat([1, 2, 2, 3, 4], [1, 3, 4, 1, 2])
    node = np.arange(len(token))
    rows = [pa.RecordBatch.from_arrays([pa.array(token[i : i + 2]), pa.array(node[i : i + 2])], names=["token", "node"]) for i in range(0, len(token), 2)]
    got = [r for b in nj._shared(iter(rows)) for r in b.to_pylist()]
    assert {(r["node"], r["token"], r["df"]) for r in got} == {(i, 2, 7) for i in range(1, 8)} | {(9, 4, 2), (10, 4, 2)}


@pytest.mark.parametrize("size", [1, 3, 5, 100])
def test_counts_across_cut_runs(size, monkeypatch):
    """Repeated nodes count once, before and after a run is cut; every row of a token has one count."""
    import pyarrow as pa

    monkeypatch.setattr(nj, "FREQUENT", 8)
    rows = [(7, 1)] * 8 + [(7, 2)] + [(8, 0)] + [(8, 1)] * 10 + [(8, 2), (8, 3)] + [(9, i) for i in range(20) for _ in range(3)] + [(10, 1)] * 40 + [(11, i) for i in range(8)]
    parts = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + size]]), pa.array([r[1] for r in rows[i : i + size]])], names=["token", "node"]) for i in range(0, len(rows), size)]
    got = sorted((r["token"], r["node"], r["df"]) for b in nj._shared(iter(parts)) for r in b.to_pylist())
    nodes = {t: sorted({n for u, n in rows if u == t}) for t, _ in rows}
    assert got == [(t, n, min(8, len(nodes[t]))) for t in sorted(nodes) if len(nodes[t]) > 1 for n in nodes[t]]


def test_very_frequent_tokens_have_one_count(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(nj, "FREQUENT", 8)
    token, node = np.repeat([1, 2], [30, 3]), np.arange(33)
    rows = [pa.RecordBatch.from_arrays([pa.array(token[i : i + 3]), pa.array(node[i : i + 3])], names=["token", "node"]) for i in range(0, 33, 3)]
    got = [r for b in nj._shared(iter(rows)) for r in b.to_pylist()]
    assert {r["df"] for r in got if r["token"] == 1} == {8} and sorted(r["node"] for r in got) == list(range(33))


def test_sets_with_a_common_passage_only_are_not_met_pair_by_pair(spark, monkeypatch):
    """One passage chains all texts into one block, which is divided before all would go to every shard; nothing is lost."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(20)) + " " + passage for _ in range(80)]
    texts += [f"{t} end" for t in texts[:10]] + [f"{c} {passage}" for c in near_copies(rng, 12, 60, 2)]
    met, links = [], nj._links
    monkeypatch.setattr(nj, "_links", lambda rows, *rest: met.append(rows.count()) or links(rows, *rest))
    sets = {i: brute_set(t) for i, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in nj.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=8).collect()}
    assert got == brute_components(sets)
    assert sum(met) <= 5 * len(texts)


def test_stored_tables_leave_no_shuffle_files(spark):
    from tessera.session import SHUFFLE_CLEANUP, checkpointed

    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    spark.sparkContext._jvm.System.gc()
    made = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffles(), spark.conf.get(SHUFFLE_CLEANUP, None)
    assert checkpointed(made, "made").count() == 7
    assert shuffles() <= before + 1 and spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_one_of_each_of_texts_with_a_common_passage(spark, monkeypatch):
    """As the pipeline's stage takes them: texts that a passage chains don't all go to every shard, and all stay."""
    rng = random.Random(10)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(20)) + " " + passage for _ in range(80)]
    met, links = [], nj._links
    monkeypatch.setattr(nj, "_links", lambda rows, *rest: met.append(rows.count()) or links(rows, *rest))
    kept = nj.one_of_each(spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string"), block=8)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(80)) and sum(met) <= 5 * len(texts)


@pytest.mark.parametrize(("num", "den"), [(80, 100), (1, 1), (3, 10), (1, 50)])
def test_need_of_the_smallest_partner(spark, num, den):
    """The column form equals the function; needs never fall and ask for no more than any partner shares."""
    sizes = range(1, 1200)
    got = {r.n: r.w for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", nj._fewest("n", num, den).alias("w")).collect()}
    assert got == {n: nj.need(-(-num * n // den), num, den) for n in sizes}
    needs = [nj.need(n, num, den) for n in sizes]
    assert needs == sorted(needs) and all(1 <= w <= -(-num * n // den) for n, w in zip(sizes, needs, strict=True))


def test_a_passage_does_not_chain_short_texts(spark, monkeypatch):
    """Texts that share 30 % with all others meet nobody; near copies among them do."""
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) + " " + passage for _ in range(150)]
    texts += [f"{t} end" for t in texts[:5]]
    met, links = [], nj._links
    monkeypatch.setattr(nj, "_links", lambda rows, *rest: met.append(rows.count()) or links(rows, *rest))
    got = {r.doc_id: r.component_id for r in nj.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i if i < 150 else i - 150 for i in range(155)} and sum(met) <= 15


def test_tokens_are_made_and_marked_once(spark, hard, monkeypatch):
    """Hot tokens are told apart by one join of all tokens, whose rows grow with the tokens; nothing joins them again."""
    monkeypatch.setattr(nj, "SAMPLED", 1)
    monkeypatch.setattr(nj, "HOT_LEAST", 20)
    plans, stored = [], nj.stored
    monkeypatch.setattr(nj, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or stored(df, name))
    sets = {i: brute_set(t) for i, t in hard}
    got = {r.doc_id: r.component_id for r in nj.join(spark.createDataFrame(hard, "doc_id long, text string")).collect()}
    assert got == brute_components(sets) and {"hot", "rare", "hubs"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if re.search("Join LeftSemi", plan)]


@pytest.mark.parametrize("bit_words", [1, 3, 1 << 20])
def test_rows_without_others(spark, monkeypatch, bit_words):
    """However few the words of bits are; with enough of them only what is named is joined."""
    monkeypatch.setattr(nj, "BIT_WORDS", bit_words)
    uids = [p * (1 << 33) + i for p in range(4) for i in range(150)]
    gone = [u for u in uids if u % 7 == 3 or u % (1 << 33) == 63]
    rows = spark.createDataFrame([(u, f"t{u}") for u in uids], "uid long, text string")
    of = spark.createDataFrame([(u,) for u in gone], "uid long")
    assert sorted(r.uid for r in nj._without(rows, of).collect()) == sorted(set(uids) - set(gone))
    assert nj._without(rows, of).columns == rows.columns and nj._without(rows, of.limit(0)).count() == len(uids)
    hits = {r.uid for r in nj._bits(rows, of).where("_hit").collect()}
    assert hits >= set(gone) and (bit_words < 4 or hits == set(gone))


def test_kept_texts_are_not_shuffled(spark):
    """Of the rows of one_of_each only those that go, or may, are joined by row, where sides are too large to be broadcast."""
    sc, threshold = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    rng = random.Random(13)
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(1000)) for _ in range(60)]
    rows = [*enumerate(texts), (60, texts[0]), (61, texts[1] + " end"), (62, ""), (63, None)]
    default = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        kept = nj.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        before = shuffled()
        assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 62, 63]
    finally:
        spark.conf.set(threshold, default)
    assert sum(n for i, n in shuffled().items() if i not in before) < sum(map(len, texts)) / 10


def test_tokens_are_shuffled_in_parts(spark, hard, monkeypatch):
    """Where sets are many no shuffle has all tokens, what is shared is told by part, and the links are the same."""
    monkeypatch.setattr(nj, "SETS_A_PART", 16, raising=False)
    sc, made, stored = spark.sparkContext, [], nj.stored

    def kept(df, name):
        out = stored(df, name)
        if name == "shared":
            made.append({r.token for r in out.select("token").distinct().collect()})
        return out

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    monkeypatch.setattr(nj, "stored", kept)
    sets = {i: brute_set(t) for i, t in hard}
    before = shuffled()
    got = {r.doc_id: r.component_id for r in nj.join(spark.createDataFrame(hard, "doc_id long, text string")).collect()}
    assert got == brute_components(sets)
    tokens = sum(min(len(s), nj.reach(len(s))) for s in {frozenset(s) for s in sets.values()})
    assert max(n for i, n in shuffled().items() if i not in before) < tokens / 2
    assert len(made) == nj.PARTS and all(made) and sum(map(len, made)) == len(set.union(*made))
