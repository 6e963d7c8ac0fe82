"""N-gram Jaccard self-join by prefix trees.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Two sets of Jaccard similarity t or more share all
but a few tokens, so

1. in one global order (of hashes), both hold their first ``need(n)`` common tokens within their first ``reach(n)``
   tokens. Only these are shuffled, once, by token; tokens that one set alone has vanish there. Where sets are many, a
   part of all tokens is shuffled after the other, so that disk has to hold one part's shuffle and what was shared in
   the parts before. Short sets have to meet in more of their tokens, so a passage that many short texts end with does
   not chain them.
2. What a set shares is put in a second global order, rare tokens first. A set that shares fewer tokens than any
   partner needs has none; for the others a shorter prefix of the rare tokens must meet the partner's. Sets that meet
   are chained, and the components of the chains (blocks) can be joined apart from each other.
3. Inside a block, the whole sets are stored in a prefix tree (path-compressed, tokens in order of falling frequency in
   the block). Each set walks the tree: overlaps along a path are counted once for all sets below it, and a subtree is
   left when its sizes, or the overlap so far with the most that can still follow, rule out t, or when all its sets are
   already in the walker's component. Overlaps at the ends are exact.

Equal sets are one node from the start, whatever their number: only one row of each goes on. A token that very many sets
have (found in a sample of the sets, which decides nothing but the way) is dealt by token and set: it counts as frequent
wherever it stands, and its sets are chained through one set for each class of sizes. Blocks that still have more than
``BLOCK`` sets are cut into shards that are joined inside and then with what is outside of the block's largest component,
so no group has to fit into one task and a group of near copies is not met pair by pair. Where more than ``BLOCK`` sets
are outside, as a common passage may chain what is not alike, the block is divided before that in the way of 2, by whole
sets: a set shares t of all its tokens with any partner, so most of those that have but the passage in common go. Links
found make up the components.

Bounds hold for every pair: no partner, candidate or bucket is capped, and no text is cut.

Rows with their texts are stored once and not shuffled where it can be helped: which of them are copies, stand in a block
or go is told by bits that are broadcast, and only rows with their bit set are joined by row.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tessera.llm.common import stored, trimmed
from tessera.llm.graph import connected_components
from tessera.session import discard

SHINGLE = 5
#: similarity as a fraction of whole numbers
T_NUM, T_DEN = 80, 100
#: sets of one tree
BLOCK = 1500
#: common tokens that short sets are asked for
MANY = 24
#: a token's count of sets is known up to here; above, all are equally frequent
FREQUENT = 1 << 20
#: stands for the count of a hot token
HOT = 1 << 40
#: words of 64 bits that are broadcast at most
BIT_WORDS = 1 << 20
#: a token that stands in one of so many sampled sets, and in this share of all sampled rows, is hot: not in one task
SAMPLED, HOT_LEAST, MOST_HOT = 64, 64, 10_000
#: tokens are shuffled in so many parts at most, one after the other, one for each SETS_A_PART sets
PARTS, SETS_A_PART = 3, 1 << 16
#: sets that stand for the largest component of a shard
ENVOYS = 8
#: shards whose envoys meet in one tree
TOGETHER = 128
#: words and rows that a Python worker holds at once
_WORDS_KEPT = 1 << 17
_ROWS = 512


class _WordHashes(dict):
    """word -> 64-bit hash, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, cache: dict, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (as signed 64-bit numbers) of the k-word shingles; fewer words make one shingle."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.int64)
    # bytes.lower() and bytes.split() know A-Z and the six white-space characters only
    h = np.fromiter((cache[w] for w in tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        width = min(k, len(h))
        total = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            total = _mixed(total + h[i : len(h) - width + 1 + i] * np.uint64(2 * i + 0x9E3779B97F4A7C15))
    return np.unique(total.view(np.int64))


def need(n, num: int = T_NUM, den: int = T_DEN):
    """Common tokens to look for: half of a set's tokens up to MANY, of a larger set one in twenty, and one. It never falls
    as n grows and is no more than a set of n has in common with any partner."""
    return min(max(n // 20 + 1, min(-(-n // 2), MANY)), -(-num * n // den))


def _fewest(n: str, num: int, den: int) -> Column:
    """need() of the smallest partner that a set of n may have."""
    m = f"(({n} * {num} + {den} - 1) div {den})"
    return F.expr(f"least(greatest({m} div 20 + 1, least(({m} + 1) div 2, {MANY})), ({m} * {num} + {den} - 1) div {den})")


def reach(n: int, num: int = T_NUM, den: int = T_DEN) -> int:
    """Tokens within which a set of n has its first need(n) common ones with any partner."""
    return min(n, n - -(-num * n // den) + need(n, num, den))


def needed_overlap(n: int, m: int, num: int = T_NUM, den: int = T_DEN) -> int:
    """den * o >= num * (n + m - o)"""
    return -(-num * (n + m) // (num + den))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few at a time: texts become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _sets(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, row) -> (id, print, n, tokens, text, row)."""
    cache = _WordHashes()
    for batch in _small(batches):
        prints, sizes, prefixes = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, cache, k)
            prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sizes.append(len(s))
            prefixes.append(s[: reach(len(s), num, den)])
        ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), tokens, batch.column(1), batch.column(2)], names=["id", "print", "n", "tokens", "text", "row"])


def _whole(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) -> (node, tokens), all tokens of the set."""
    cache = _WordHashes()
    for batch in _small(batches):
        sets = [shingle_set(text, cache, k) for text in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), tokens], names=["node", "tokens"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, node) sorted by both -> (node, token, number of nodes) of tokens that two nodes or more have. Repeated
    rows count once. The rows of a token that FREQUENT nodes have go on as they come and all count FREQUENT. A third column
    is set in the rows of hot tokens, which may stand elsewhere too: they go on and count HOT."""
    last, over = None, None
    token = node = np.empty(0, np.int64)

    def counted(stop: int) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, token[1:stop] != token[: stop - 1]])
        count = np.diff(np.r_[starts, stop])
        each = np.repeat(np.minimum(count, FREQUENT), count)
        found = each >= 2
        return pa.RecordBatch.from_arrays([pa.array(node[:stop][found]), pa.array(token[:stop][found]), pa.array(each[found])], names=["node", "token", "df"])

    for batch in batches:
        t, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
        if batch.num_columns > 2 and batch.column(2).null_count < batch.num_rows:
            hot = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(n[hot]), pa.array(t[hot]), pa.array([HOT] * int(hot.sum()), pa.int64())], names=["node", "token", "df"])
            t, n = t[~hot], n[~hot]
        if not len(t):
            continue
        fresh = np.r_[last != (t[0], n[0]), (t[1:] != t[:-1]) | (n[1:] != n[:-1])]
        last, t, n = (t[-1], n[-1]), t[fresh], n[fresh]
        more = int(np.searchsorted(t, over, "right")) if over is not None else 0
        if more:
            yield pa.RecordBatch.from_arrays([pa.array(n[:more]), pa.array(t[:more]), pa.array([FREQUENT] * more, pa.int64())], names=["node", "token", "df"])
        if more == len(t):
            continue
        token, node = np.concatenate([token, t[more:]]), np.concatenate([node, n[more:]])
        stop = int(np.searchsorted(token, token[-1]))
        if len(token) - stop >= FREQUENT:
            stop, over = len(token), token[-1]
        if stop:
            yield counted(stop)
            token, node = token[stop:], node[stop:]
    if len(token):
        yield counted(len(token))


def _chains(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, n, node) sorted by all -> neighbours of a token whose sizes allow a link. Between sizes that don't,
    no pair across can link either."""
    last: tuple | None = None
    for batch in batches:
        token, n, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(token):
            continue
        if last is not None:
            token, n, node = np.r_[last[0], token], np.r_[last[1], n], np.r_[last[2], node]
        last = token[-1], n[-1], node[-1]
        near = (token[1:] == token[:-1]) & (den * n[:-1] >= num * n[1:]) & (node[1:] != node[:-1])
        if near.any():
            pairs = np.unique(np.sort(np.stack([node[:-1][near], node[1:][near]], 1), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


class PrefixTree:
    """Sets as sorted arrays of ranks, path-compressed. A node is [segment, children, ends, smallest size, largest
    size, most tokens from here down, a member of the component of all sets below or -1]."""

    def __init__(self, universe: int, num: int = T_NUM, den: int = T_DEN):
        self.num, self.den = num, den
        self.root = [np.empty(0, np.int64), {}, [], 1 << 60, 0, 0, None]
        self.parent: list[int] = []
        self.sizes: list[int] = []
        self.member = np.zeros(universe, bool)
        self.visited = 0

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def add(self, ranks: np.ndarray, size: int, fellow: int | None = None, walks: bool = True) -> int:
        """Links the set with all that it is similar to, then stores it. ``fellow``: a set that is known to be in the same
        component."""
        i = len(self.parent)
        self.parent.append(i)
        self.sizes.append(size)
        if fellow is not None:
            self.union(i, fellow)
        if walks:
            self._walk(i, ranks, size)
        self._store(i, ranks, size)
        return i

    def _walk(self, i: int, ranks: np.ndarray, size: int) -> None:
        num, den = self.num, self.den
        least = -(-num * size // den)
        self.member[ranks] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            segment, children, ends, low, high, most, same = node
            if high < least or num * low > den * size or (same not in (None, -1) and self.find(same) == self.find(i)):
                continue
            self.visited += 1
            wanted = needed_overlap(size, max(low, least), num, den)
            if overlap + most < wanted:
                continue
            left = len(ranks)
            if len(segment):
                overlap += int(np.count_nonzero(self.member[segment]))
                left -= int(np.searchsorted(ranks, segment[-1], "right"))
            if overlap + min(left, most - len(segment)) < wanted:
                continue
            for j in ends:
                if overlap >= needed_overlap(size, self.sizes[j], num, den):
                    self.union(i, j)
            stack += [(child, overlap) for child in children.values()]
        self.member[ranks] = False

    def _store(self, i: int, ranks: np.ndarray, size: int) -> None:
        node, at = self.root, 0
        while True:
            node[3], node[4], node[5] = min(node[3], size), max(node[4], size), max(node[5], len(ranks) - at)
            node[6] = i if node[6] is None else node[6] if node[6] != -1 and self.find(node[6]) == self.find(i) else -1
            at += len(node[0])
            if at == len(ranks):
                node[2].append(i)
                return
            child = node[1].get(int(ranks[at]))
            if child is None:
                node[1][int(ranks[at])] = [ranks[at:], {}, [i], size, size, len(ranks) - at, i]
                return
            segment = child[0]
            k = min(len(segment), len(ranks) - at)
            differ = np.flatnonzero(segment[:k] != ranks[at : at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(segment):
                upper = [segment[:k], {int(segment[k]): child}, [], child[3], child[4], child[5], child[6]]
                child[0], child[5] = segment[k:], child[5] - k
                node[1][int(ranks[at])] = child = upper
            node = child


def linked(sets: list[np.ndarray], num: int = T_NUM, den: int = T_DEN, known: list | None = None, walks: list[bool] | None = None) -> list[int]:
    """For each set the first set of its component, by one prefix tree. ``known`` names components that are known; sets
    that don't walk are stored first, and links between two of them are not looked for."""
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    # tokens of one set alone can't overlap: they count in its size only
    keep = counts >= 2
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.arange(len(tokens))
    tree, first = PrefixTree(len(tokens), num, den), {}
    known, walks = known or list(range(len(sets))), walks or [True] * len(sets)
    by_size = sorted(range(len(sets)), key=lambda i: (walks[i], len(sets[i])))
    for i in by_size:
        at = np.searchsorted(tokens, sets[i])
        j = tree.add(np.sort(rank[at[keep[at]]]), len(sets[i]), first.get(known[i]), walks[i])
        first.setdefault(known[i], j)
    found = [0] * len(sets)
    for j, i in enumerate(by_size):
        found[i] = by_size[tree.find(j)]
    return found


def _joined(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, i, j, node, known, walks, text) sorted by the first three -> links (a, b) between nodes."""
    cache, key, nodes, sets, known, walks = _WordHashes(), None, {}, [], [], []

    def flush():
        ids = list(nodes)
        root = linked(sets, num, den, known, walks)
        pairs = [(ids[i], ids[r]) for i, r in enumerate(root) if i != r]
        return pa.RecordBatch.from_arrays([pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1)], names=["a", "b"])

    for batch in _small(batches):
        for *now, node, fellow, walk, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                if len(sets) > 1:
                    yield flush()
                key, nodes, sets, known, walks = now, {}, [], [], []
            if node in nodes:
                continue
            nodes[node] = len(sets)
            sets.append(shingle_set(text, cache, k))
            known.append(node if fellow is None else fellow)
            walks.append(walk)
    if len(sets) > 1:
        yield flush()


def _links(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One tree for each (block, i, j)."""
    keys = ["block", "i", "j"]
    rows = rows.select(*keys, "node", "known", "walks", "text")
    made = rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(lambda it: trimmed(_joined(it, k, num, den)), "a long, b long")
    return stored(made, "links")


def _in_shards(members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    return _links(members.withColumns({"i": F.col("s"), "j": F.lit(0), "known": F.lit(None).cast("long"), "walks": F.lit(True)}), k, num, den)


def _across_shards(members: DataFrame, links: DataFrame, block: int, k: int, num: int, den: int, nodes: DataFrame | None = None) -> DataFrame:
    """All links of blocks that were cut into shards, given those inside of the shards.

    The largest components of a block's shards are linked through a few sets of each. Then only sets outside of the
    block's largest component are still looked at: they go, in parts, to every shard. In a group of near copies these are
    few, so the work grows with the group and not with its square. Where they are more than ``block``, the block is divided
    by its whole sets, given the sizes of ``nodes``; where they are that many in a divided one, all pairs of shards are met."""
    def labelled(links: DataFrame) -> DataFrame:
        found = connected_components(links)
        return members.join(found, "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component")

    def largest(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        n = df.groupBy(*keys, "known").agg(F.count("*").alias("_n"))
        return n.groupBy(*keys).agg(F.max_by("known", F.struct("_n", (-F.col("known")).alias("_o"))).alias(name))

    # inside of a shard a link leads to the first set of its component
    inside = links.select(F.col("a").alias("node"), F.col("b").alias("known"))
    one = members.join(inside, "node", "left").withColumn("known", F.coalesce("known", "node"))
    big = one.join(largest(one, ["block", "s"], "_big"), ["block", "s"]).where(F.col("known") == F.col("_big"))
    # one shard holds about ``block`` sets
    few = F.row_number().over(Window.partitionBy("block", "s").orderBy(F.xxhash64("node"), "node")) <= ENVOYS
    # those of a block's first shard meet the others in bounded groups of shards
    group = F.when(F.col("s") == 0, F.sequence(F.lit(0), F.expr(f"(g - 1) div {TOGETHER}").cast("int"))).otherwise(F.array(F.expr(f"s div {TOGETHER}").cast("int")))
    envoys = big.withColumn("_few", few).where("_few").withColumns({"i": F.explode(group), "j": F.lit(0), "walks": F.lit(True)})
    links = links.union(_links(envoys, k, num, den))
    two = labelled(links)
    # a block's rows are joined by shard, so that no task gets a whole block
    shards = two.select("block", "s").distinct()
    main = largest(two, ["block"], "_main").join(shards, "block")
    marked = two.join(main, ["block", "s"]).withColumn("walks", F.col("known") != F.col("_main"))
    parts = marked.where("walks").groupBy("block").agg(F.ceil(F.count("*") / block).cast("int").alias("_parts")).join(shards, "block")
    made = marked = stored(marked.join(parts, ["block", "s"]), "marked")
    many = marked.where("_parts > 1")
    if nodes is not None and not many.isEmpty():
        finer = stored(_divided(many, nodes, block, k, num, den), "members")
        within, again = _in_shards(finer, k, num, den), finer.where("g > 1")
        links = links.union(within if again.isEmpty() else _across_shards(again, within, block, k, num, den))
        discard(finer)
        marked = marked.where("_parts = 1")
    shard = marked.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("i", F.col("s"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("_parts")).cast("int")
    guests = marked.where("walks").withColumn("j", part).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    # a guest in its own shard is there twice and taken once; the other sets of a shard are only stored
    same = F.col("walks") & (part == F.col("j"))
    rows = shard.withColumn("walks", same).where(~F.col("walks")).select("block", "i", "j", "node", "known", "walks", "text").union(guests.select("block", "i", "j", "node", "known", "walks", "text"))
    links = links.union(_links(rows, k, num, den))
    discard(made)
    return links


def _sampled(name: str) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(5)), F.lit(SAMPLED)) == 0


def _hot(sets: DataFrame) -> DataFrame | None:
    """Tokens that very many sets (print, tokens) have, judged by the sets whose hash is a multiple of SAMPLED: at most
    MOST_HOT, as each takes a MOST_HOT-th of the sampled rows. Whether a token is among them changes the way and not the
    result."""
    some = sets.where(_sampled("print"))
    sample = some.groupBy("print").agg(F.first("tokens").alias("tokens")).select(F.explode("tokens").alias("token"))
    counts = stored(sample.groupBy("token").agg(F.count("*").alias("n")), "sample")
    least = max(HOT_LEAST, -(-(counts.agg(F.sum("n")).first()[0] or 0) // MOST_HOT))
    hot = stored(counts.where(F.col("n") >= least).select("token"), "hot")
    discard(counts)
    return None if hot.isEmpty() else hot


def _through_hubs(rare: DataFrame, num: int, den: int) -> DataFrame:
    """Chains (a, b) of rows (token, n, node) of hot tokens: all nodes of a token whose sizes are in one class are chained
    through one of them, and these with those of the next classes. A class is as wide as sizes may differ."""
    size = F.floor(F.log("n") / F.lit(math.log(den / num))) if num < den else F.col("n")
    rare = rare.withColumn("cls", size.cast("long"))
    # at most MOST_HOT tokens times the classes, about a hundred
    hubs = stored(rare.groupBy("token", "cls").agg(F.min("node").alias("hub")), "hubs")
    inside = rare.join(F.broadcast(hubs), ["token", "cls"]).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # sizes at the very limit may round to the class after the next
    onward = hubs.select("token", F.explode(F.array(F.col("cls") + 1, F.col("cls") + 2)).alias("cls"), F.col("hub").alias("a"))
    return inside.union(onward.join(F.broadcast(hubs), ["token", "cls"]).select("a", F.col("hub").alias("b")))


def _blocks(tokens: list[DataFrame], nodes: DataFrame, hot: DataFrame | None, wanted: Column, block: int, num: int, den: int) -> DataFrame:
    """(node, block, g, s): no link leaves a block, which is to be cut into ``g`` shards, and a node is in that with number s.

    Rows of ``tokens`` (token, node) name some tokens of each set, of which it has ``wanted`` or more, a term of its size n,
    in common with any partner; ``nodes`` has (node, n). Sets that can have no partner are in no block. Parts of
    ``tokens`` are shuffled one after the other; each has all rows of its tokens."""
    dealt = [F.col("token")]
    if hot is not None:
        tokens = [part.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "token", "left").select("token", "node", "hot") for part in tokens]
        dealt.append(F.when(F.col("hot"), F.col("node")))
    made = [part.repartition(*dealt).sortWithinPartitions("token", "node").mapInArrow(lambda it: trimmed(_shared(it)), "node long, token long, df long") for part in tokens]
    if len(made) > 1:
        made = [stored(part, "shared") for part in made]
    shared = functools.reduce(DataFrame.unionAll, made)
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"))
    lists = lists.join(nodes.select("node", "n"), "node").withColumn("_need", wanted.cast("int")).where(F.size("list") >= F.col("_need"))
    prefix = F.slice("list", F.lit(1), F.size("list") - F.col("_need") + 1)
    rare = lists.select(F.explode(prefix).alias("x"), "n", "node").select("x.token", "x.df", "n", "node")
    if hot is not None:
        rare = stored(rare, "rare")
        discard(*made)
    alone = rare.where(F.col("df") != HOT).select("token", "n", "node")
    chains = alone.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(lambda it: trimmed(_chains(it, num, den)), "a long, b long")
    if hot is not None:
        chains = chains.union(_through_hubs(rare.where(F.col("df") == HOT).select("token", "n", "node"), num, den))
    blocks = connected_components(chains).select("node", F.col("component").alias("block"))
    discard(rare, *made)
    sizes = blocks.groupBy("block").agg(F.count("*").alias("m"))
    return blocks.join(sizes, "block").select("node", "block", F.ceil(F.col("m") / block).cast("int").alias("g")).withColumn("s", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))


def _divided(cut: DataFrame, nodes: DataFrame, block: int, k: int, num: int, den: int) -> DataFrame:
    """Rows (block, g, s, node, text) of large blocks, divided by their whole sets into blocks of the same kind. What shares
    too little with all others together to be linked goes."""
    def whole(rows: DataFrame) -> DataFrame:
        return rows.select("node", "text").mapInArrow(lambda it: trimmed(_whole(it, k)), "node long, tokens array<long>")

    hot = _hot(whole(cut.where(_sampled("node"))).withColumnRenamed("node", "print"))
    tokens = whole(cut).select(F.explode("tokens").alias("token"), "node")
    finer = _blocks([tokens], nodes, hot, F.expr(f"(n * {num} + {den} - 1) div {den}"), block, num, den)
    return cut.select("node", "text").join(finer.hint("merge"), "node").select("block", "g", "s", "node", "text")


def _bits(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` (uid, ...) with ``_hit``: false only where the uid is not in ``of`` (uid). Nothing is shuffled but ``of``: at
    most BIT_WORDS words of bits are broadcast. Up to about that many words nearly all other rows have false."""
    word, bit = F.pmod(F.xxhash64(F.shiftright("uid", 6)), F.lit(BIT_WORDS)), F.expr("cast(uid & 63 as int)")
    words = of.select(word.alias("_word"), F.expr("shiftleft(1L, cast(uid & 63 as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    hit = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left").withColumn("_hit", hit).drop("_word", "_bits")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (uid, ...) whose uid is not in ``gone`` (uid): only those that may be are shuffled."""
    marked = _bits(rows, gone)
    return marked.where(~F.col("_hit")).unionAll(marked.where("_hit").join(gone.hint("merge"), "uid", "left_anti").select(*marked.columns)).drop("_hit")


def _grouped(docs: DataFrame, k: int, num: int, den: int, block: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, id, print, n, text, row) of ``docs``, and (print, component_id, keeper) of every distinct set: the
    smallest key of its component and the row that stands for it.

    Rows are named by a number of their own, sets by 128 bits until they are named by one of their rows."""
    rest = [c for c in docs.columns if c != text]
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    schema = StructType([StructField("id", LongType()), StructField("print", BinaryType()), StructField("n", LongType()), StructField("tokens", ArrayType(LongType())), StructField("text", StringType()), StructField("row", slim.schema["row"].dataType)])
    made = stored(slim.mapInArrow(lambda it: trimmed(_sets(it, k, num, den)), schema).withColumn("uid", F.monotonically_increasing_id()), "sets")
    # the row with the smallest key, rows without a key last, stands for a set; copies are combined before they are shuffled
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    sets = made.where("n > 0").groupBy("print")
    nodes = stored(sets.agg(first, F.first("n").alias("n")).select(F.col("first.uid").alias("node"), F.col("first.id").alias("rep"), "print", "n"), "nodes")
    # tokens of copies don't go on
    uids = made.where("n > 0").select("uid")
    copies = stored(uids.join(nodes.select(F.col("node").alias("uid")), "uid", "left_anti"), "copies")
    distinct = _without(made.where("n > 0").select("uid", "tokens"), copies)
    parts = min(PARTS, max(1, -(-nodes.count() // SETS_A_PART)))
    arrays = [F.filter("tokens", lambda t: F.pmod(t, F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [F.col("tokens")]
    tokens = [distinct.select(F.explode(array).alias("token"), F.col("uid").alias("node")) for array in arrays]
    hot = _hot(made.where("n > 0"))
    blocks = stored(_blocks(tokens, nodes, hot, _fewest("n", num, den), block, num, den), "blocks")
    # as it goes where there are many: texts by row, both sides shuffled
    members = _bits(made.select("uid", "text"), blocks.select(F.col("node").alias("uid"))).where("_hit").select(F.col("uid").alias("node"), "text")
    members = stored(members.join(blocks.hint("merge"), "node").select("block", "g", "s", "node", "text"), "members")
    discard(copies, blocks)
    links = _in_shards(members, k, num, den)
    cut = members.where("g > 1")
    if not cut.isEmpty():
        links = _across_shards(cut, links, block, k, num, den, nodes)
    linked = stored(connected_components(links).join(nodes.select("node", "rep"), "node"), "linked")
    discard(members)
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("least")
    named = linked.select("node", "component").join(linked.groupBy("component").agg(least).hint("merge"), "component")
    named = nodes.select("node", "rep", "print").join(named, "node", "left")
    return made, named.select("print", F.coalesce("least.rep", "rep").alias("component_id"), F.coalesce("least.node", "node").alias("keeper"))


def join(docs: DataFrame, k: int = SHINGLE, num: int = T_NUM, den: int = T_DEN, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every row of ``docs``; similarity is num / den or more.

    Null, empty and blank texts have an empty set and are linked with nothing. A null key is no name for a component, but
    its row is linked as any: it gets the smallest key of those it can reach, else null. Rows with one key and several
    texts are compared each for itself; ties can't arise; an empty table gives no rows; other columns are not read.
    """
    made, named = _grouped(docs.select(key, text), k, num, den, block, key, text)
    out = made.select("id", "n", "print").join(named.drop("keeper"), "print", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, num: int = T_NUM, den: int = T_DEN, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, all columns, of each component of ``docs``: the one with the smallest key (a row without a key only where
    none has one; of rows equal in key and text, any one). Texts without words are copies of nothing and all stay."""
    made, named = _grouped(docs, k, num, den, block, key, text)
    gone = stored(made.where("n > 0").select("uid").join(named.select(F.col("keeper").alias("uid")), "uid", "left_anti"), "gone")
    kept = _without(made.select("uid", "text", "row"), gone)
    return kept.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
