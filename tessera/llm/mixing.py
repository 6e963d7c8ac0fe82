"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words. Inside a source a document's expected number of copies is in proportion to its
inclusion weight, by default about the root of its words (a power of two: a short text is taken less often than a long
one), none above ``cap``, such that the expected words add up to the target. Whole copies are certain; the rest p, which
differs from document to document, is an inclusion probability. Documents are ranked by their random odds divided by
their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the head of that order whose words come nearest to what is left
of the target is taken: a fixed-size sample with unequal probabilities, the size being counted in words.

Inclusion weights are powers of two, so a source has few classes of them (at most CLASSES), and what is proportional
follows exactly from the words of each class.

Scale: the order is never sorted in one task. Ranks are cut into fixed buckets of an increasing function of the rank;
words per (source, bucket) are summed map-side, the bucket in which the target falls is found from these sums, and
only its rows are put in order. A bucket at the cut holds at most about 1/BUCKETS of a source, however hot the source
is: there the density of ranks is 4 p (1 - p). Running sums over the sources go range by range where there are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import n_words, stored, uniform_hash

BUCKETS = 4096
#: inclusion weights are 2 ** k for k up to this
CLASSES = 40
#: ranges that many sources are cut into
RANGES = 256
#: More sources than this are joined by shuffling, and summed up range by range.
SMALL_SOURCES = 20_000


def running(df: DataFrame, order: list, sums: dict, many: bool) -> DataFrame:
    """Adds, for every name in ``sums``, the sum over all rows before in the given total order (null for the first row).

    Up to SMALL_SOURCES rows one window does it; ``many`` rows are cut into ranges of the order, summed up inside and
    moved on by the sums of the ranges before, RANGES rows."""
    before = lambda by: by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if not many:
        return df.withColumns({n: F.sum(c).over(before(Window.partitionBy())) for n, c in sums.items()})
    ranged = stored(df.repartitionByRange(RANGES, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"{n}_whole") for n, c in sums.items()])
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("_range", *[F.sum(f"{n}_whole").over(upto).alias(f"{n}_off") for n in sums])
    inside = ranged.withColumns({n: F.sum(c).over(before(Window.partitionBy("_range"))) for n, c in sums.items()}).join(F.broadcast(offsets), "_range")
    added = {n: F.when(F.col(n).isNull() & F.col(f"{n}_off").isNull(), None).otherwise(F.coalesce(n, F.lit(0)) + F.coalesce(f"{n}_off", F.lit(0))) for n in sums}
    return inside.withColumns(added).drop("_range", *[f"{n}_off" for n in sums])


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float, many: bool = False) -> DataFrame:
    """source, source_size -> + target: ``share`` of all sizes dealt by the weights (in turn, by code point, null
    last), none above ``cap`` times its source's size, the excess dealt again until none is above.

    One row per source. Dealing again and again ends where target = min(cap, level * weight) adds up to the whole,
    and sources reach their caps in the order of cap / weight; so the level follows from running sums in that order:
    it is that of the first source which keeps below its cap.
    """
    name = F.col("source").asc_nulls_last()
    turn = F.coalesce("_turn", F.lit(0)) % len(weights)
    s = running(sources, [name], {"_turn": F.lit(1)}, many).withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))).drop("_turn")
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    s = running(s, [F.col("_cap") / F.col("_weight"), name], {"_capped": F.col("_cap"), "_shut": F.col("_weight")}, many)
    total = s.agg(F.sum("source_size").cast("double").alias("size"), F.sum("_weight").alias("weight")).first()
    if total.size is None:
        return s.select("source", "source_size", F.col("_cap").alias("target"))
    level = (F.lit(total.size) * F.lit(float(share)) - F.coalesce("_capped", F.lit(0.0))) / (F.lit(total.weight) - F.coalesce("_shut", F.lit(0.0)))
    # in the order of cap / weight a source that keeps below its cap is followed by such sources alone
    fits = s.withColumn("_level", level).where(F.col("_level") * F.col("_weight") <= F.col("_cap"))
    first = fits.agg(F.min_by("_level", F.struct(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), F.col("source"))).alias("level")).first().level
    target = F.col("_cap") if first is None else F.least(F.col("_cap"), F.lit(first) * F.col("_weight"))
    return s.select("source", "source_size", target.alias("target"))


def inclusion_class(size: Column, weight: Column | None = None) -> Column:
    """k of the inclusion weight 2 ** k: half the bits of the words, or, of a weight given, the power of two at or below
    it (weights from 1 to 2 ** CLASSES; null, below and above count as the nearest of these)."""
    if weight is None:
        return F.floor((F.length(F.bin(F.greatest(size, F.lit(1)))) - 1) / 2).cast("int")
    bounded = F.least(F.greatest(F.coalesce(weight.cast("double"), F.lit(1.0)), F.lit(1.0)), F.lit(float(1 << CLASSES)))
    return (F.length(F.bin(F.floor(bounded).cast("long"))) - 1).cast("int")


def copies(classes: DataFrame, targets: DataFrame, cap: float, small) -> DataFrame:
    """Expected copies of each (source, class): min(cap, level * 2 ** class) with the source's words in all classes adding
    up to its target. Classes reach the cap from the heaviest down; a source has at most CLASSES + 1."""
    rows = classes.join(small(targets.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_w", F.pow(F.lit(2.0), F.col("class")))
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(cap))
    open_ = F.sum(F.col("words") * F.col("_w")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", F.when(open_ > 0, (F.col("target") - full) / open_))
    fits = F.when(F.col("_level") * F.col("_w") <= F.lit(float(cap)), F.col("_level"))
    level = F.first(fits, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("source", "class", "source_size", "target", "words", F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.coalesce(level * F.col("_w"), F.lit(float(cap))))).alias("copies"))


def _head(rows: DataFrame, small, nearest: bool) -> DataFrame:
    """Takes, for each source, the head of the order of what is open until the next document doesn't fit into _left
    (``nearest``: until less than half of it fits). Adds to _in."""
    rows = rows.withColumn("_fits", ~F.col("_in") & F.col("_rank").isNotNull() & (F.col("size") <= F.when(F.lit(nearest), 2 * F.col("_left")).otherwise(F.col("_left"))))
    sums = rows.where("_fits").groupBy("source", "_bucket").agg(F.sum("size").alias("_words"), F.first("_left").alias("_left"))
    sums = sums.withColumn("_before", F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_words"))
    # the first bucket that does not fit as a whole, or one past the last
    whole = F.col("_before") + F.col("_words") <= F.col("_left")
    cut = sums.groupBy("source").agg(F.coalesce(F.min(F.when(~whole, F.col("_bucket"))), F.lit(BUCKETS)).alias("_cut"), F.min(F.when(~whole, F.col("_before"))).alias("_before"))
    rows = rows.join(small(cut.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    at_edge = F.coalesce(F.col("_fits") & (F.col("_bucket") == F.col("_cut")), F.lit(False))
    order = Window.partitionBy("source").orderBy(F.col("_rank"), F.col("_key").asc_nulls_last(), F.col("size"))
    edge = rows.where(at_edge).withColumn("_upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    used = F.col("_upto") - F.col("size") / 2 if nearest else F.col("_upto")
    edge = edge.withColumn("_in", F.col("_before") + used <= F.col("_left")).drop("_upto")
    rest = rows.where(~at_edge).withColumn("_in", F.col("_in") | F.coalesce(F.col("_fits") & (F.col("_bucket") < F.col("_cut")), F.lit(False)))
    return rest.unionByName(edge).drop("_fits", "_cut", "_before")


#: After the head, documents that no longer fit are passed over and the order goes on: so many turns in all.
TURNS = 3

def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 1, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, keep_source: bool = False) -> DataFrame:
    """key, size, source_size, target, taken of every row of ``docs``; taken / size is the number of copies.

    ``weight`` names a column of inclusion weights (by default they follow from the sizes, see above). Null text has size
    0 and is taken 0 times over; null is a source of its own; an empty table gives no rows. Rows equal in key, source,
    size and weight share their random number: rows that tie at the boundary are taken one by one. Other columns are
    not read.
    """
    kind = inclusion_class(n_words(F.col(text)), F.col(weight) if weight else None)
    base = stored(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), kind.alias("class")), "sizes")
    # at most CLASSES + 1 rows a source
    classes = stored(base.groupBy("source", "class").agg(F.sum("size").alias("words")), "classes")
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    many = sources.count() > SMALL_SOURCES
    small = (lambda df: df) if many else F.broadcast  # checked: at most SMALL_SOURCES rows, or CLASSES + 1 times that
    targets = source_targets(sources, weights, share, cap, many)
    each = copies(classes, targets, cap, small).withColumn("_certain", F.floor("copies").cast("long")).withColumn("_p", F.col("copies") - F.col("_certain"))
    each = stored(each, "copies")
    sure = each.groupBy("source").agg(F.first("target").alias("_t"), F.sum(F.col("_certain") * F.col("words")).alias("_sure"))
    left = sure.select(F.col("source").alias("_s"), (F.col("_t") - F.col("_sure")).alias("_open"))
    each = each.drop("words", "copies").join(small(left), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnsRenamed({"source": "_s", "class": "_c"}).withColumn("_left", F.col("_open"))
    u = uniform_hash(str(seed), F.col("_key"), F.col("source"), F.col("size"))
    rows = base.join(small(each), F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))).drop("_s", "_c").withColumn("_u", u)
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    rows = rows.withColumn("_rank", F.when((F.col("_p") > 0) & (F.col("size") > 0), odds))
    # grows with the rank and is spread over 0..1; the cut is near a rank of 1
    rows = rows.withColumn("_bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.lit(BUCKETS) * (F.col("_rank") / (1 + F.col("_rank")))).cast("int")))
    rows = rows.drop("_u", "_p", "class").withColumn("_in", F.lit(False))
    for turn in range(TURNS):
        rows = _head(rows, small, nearest=turn == TURNS - 1)
        if turn < TURNS - 1:
            rows = stored(rows, "mix")
            got = rows.groupBy("source").agg(F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0)).alias("_got")).withColumnRenamed("source", "_s")
            rows = rows.join(small(got), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_left", F.col("_open") - F.col("_got")).drop("_s", "_got")
    taken = F.col("size") * (F.col("_certain") + F.col("_in").cast("long"))
    return rows.select(F.col("_key").alias(key), *["source"] * keep_source, "size", "source_size", "target", taken.cast("long").alias("taken"))


def resampled(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 1, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them. Rows equal in key, source and size are taken
    as often as the one of them taken most. Columns may have any names: rows travel as one struct."""
    read = docs.select(key, text, source, *[weight] * (weight is not None))
    taken = mix(read, weights, share, cap, seed, key, text, source, weight, keep_source=True)
    copies = taken.where("taken > 0").groupBy(F.col(key).alias("_k"), F.col("source").alias("_s"), F.col("size").alias("_n")).agg(F.max(F.expr("taken div size")).cast("int").alias("_copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    body = F.col("_row").getField
    same = body(key).eqNullSafe(F.col("_k")) & body(source).eqNullSafe(F.col("_s")) & (n_words(body(text)) == F.col("_n"))
    out = rows.join(copies, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*[body(c).alias(c) for c in docs.columns])
