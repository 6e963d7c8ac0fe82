"""Quality rules with risk-controlled thresholds.

Every rule rejects a document whose figure is above a cutoff. Cutoffs are set per stratum (language) from the labelled
documents that pass the base rule, in two parts dealt by a hash of the key:

1. One third selects. For each rule the cutoff that best separates bad from good documents there is its aim; a rule that
   separates nothing has none. The aims make a path of STEPS vectors of cutoffs: at each step all rules go on together
   along their lists, from their most lenient cutoff to their aim.
2. Two thirds certify. A step is tested with an exact binomial bound: the documents that any of its cutoffs rejects must
   be so few among the good ones that a false rejection rate over ``alpha`` is refuted at error ``delta`` / strata
   (Bonferroni over the strata). Steps are tested from lenient to strict, each at the full error, and the first that
   fails ends the sequence (fixed-sequence testing needs no further correction).

The last certified step holds; without one the stratum has no rule. So with probability 1 - ``delta`` the rules reject
no more than ``alpha`` of the good documents of any stratum (of those that pass the base rule).

Scale: figures are computed in one pass inside the JVM; nothing but counts per (stratum, rule, cutoff) and per (stratum,
step) is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, uniform_hash, words

SYMBOLS = "#*$%&|<>"
#: figure -> cutoffs, lenient first
RULES = {
    "symbols": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01),
    "marks": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "same_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeats": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
}
STEPS = 16
#: share of the labelled documents that selects cutoffs; the others certify
SELECTING = 1 / 3
#: positions take this many bits of a packed key; longer texts are compared word by word
POSITION_BITS = 22


def repeated_words(tokens: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more in ``tokens``, the first included.

    Windows are sorted by a hash with their position in the low bits; only those whose hash has an equal neighbour are
    compared as words, so a collision of hashes changes nothing. A covered word counts once: with the repeated windows
    in order of position, each adds min(3, distance to the next).
    """
    n = F.size(tokens)
    keep = (1 << 63) - (1 << POSITION_BITS)
    at = lambda array, i: F.get(array, i)
    places = F.when((n >= 4) & (n < (1 << POSITION_BITS)), F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(places, lambda i: F.xxhash64(at(tokens, i), at(tokens, i + 1), at(tokens, i + 2)).bitwiseAND(F.lit(keep)).bitwiseOR(i.cast("long")))
    return _covered(tokens, _suspects(F.sort_array(packed)), n)


def _suspects(ordered: Column) -> Column:
    """Positions whose hash equals that of a neighbour in the sorted packed keys; evaluated over one bound array."""
    hash_of = lambda v: F.shiftright(v, POSITION_BITS)

    def pick(s: Column) -> Column:
        same = F.filter(s, lambda v, i: (hash_of(F.get(s, i - 1)) == hash_of(v)) | (hash_of(F.get(s, i + 1)) == hash_of(v)))
        return F.transform(same, lambda v: v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int"))

    return F.get(F.transform(F.array(ordered), pick), 0)


def _covered(tokens: Column, suspects: Column, n: Column) -> Column:
    everywhere = F.when((n >= (1 << POSITION_BITS)), F.sequence(F.lit(0), n - 3)).otherwise(suspects)
    window = lambda i: F.struct(F.get(tokens, i).alias("a"), F.get(tokens, i + 1).alias("b"), F.get(tokens, i + 2).alias("c"))

    def repeated(s: Column) -> Column:
        same = lambda v, w: (v["w"] == w["w"])
        kept = F.filter(s, lambda v, i: F.coalesce(same(v, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(v, F.get(s, i + 1)), F.lit(False)))
        return F.sort_array(F.transform(kept, lambda v: v["i"]))

    windows = F.sort_array(F.transform(everywhere, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    starts = F.transform(F.array(windows), repeated)
    total = F.transform(starts, lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")), lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(3), x - acc["last"])).alias("sum"), x.alias("last")), lambda acc: acc["sum"]))
    return F.coalesce(F.get(total, 0), F.lit(0)).cast("long")


def figures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_body", body).withColumn("_tokens", words(F.col(text)))
    lines = F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda chars: F.length("_body") - F.length(F.translate("_body", chars, ""))
    out = out.withColumn("_lines", lines).withColumn("_places", F.size("_tokens"))
    return out.select(
        F.col(key),
        F.col("_places").cast("long").alias("n_words"),
        F.aggregate("_tokens", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_tokens")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        count("!?").cast("long").alias("n_marks"),
        F.length(F.regexp_replace("_body", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("_body", r"\P{L}+", "")).cast("long").alias("n_letters"),
    )


def ratios() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbols": share("n_symbols", "word_chars"), "marks": share("n_marks", "word_chars"), "capitals": share("n_capitals", "n_letters"), "same_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}


def most_allowed(good: Column, alpha: float, error: Column) -> Column:
    """The largest k with P(Binomial(good, alpha) <= k) <= error, -1 if none: an exact test by summing the terms of the
    distribution in logarithms, ratio by ratio. k stays below alpha * good, where the tail is near a half."""
    step = math.log(alpha) - math.log1p(-alpha)
    top = F.ceil(good * F.lit(alpha)).cast("int")
    first = good * F.lit(math.log1p(-alpha))
    state = lambda term, tail, k: F.struct(term.alias("term"), tail.alias("tail"), k.alias("k"))
    level = F.log(error)
    start = state(first.cast("double"), first.cast("double"), F.when(first <= level, F.lit(0)).otherwise(F.lit(-1)))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((good - i + 1) / i) + F.lit(step)
        high, low = F.greatest(acc["tail"], term), F.least(acc["tail"], term)
        tail = high + F.log1p(F.exp(low - high))
        return state(term, tail, F.when((tail <= level) & (acc["k"] == i - 1), i).otherwise(acc["k"]))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), start, add, lambda acc: acc["k"])


def aims(selecting: DataFrame, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """stratum, aims (rule -> place in its list of cutoffs): of each rule the cutoff with the largest share of bad
    documents above it less that of good ones, the most lenient of equals; rules without a gain are left out."""
    above = [F.sum(((F.col(name) > c) & (F.col("good") == which)).cast("long")).alias(f"{name}_{i}_{which}") for name, cuts in rules.items() for i, c in enumerate(cuts) for which in (0, 1)]
    counts = selecting.groupBy("stratum").agg(F.sum((F.col("good") == 1).cast("long")).alias("n_good"), F.sum((F.col("good") == 0).cast("long")).alias("n_bad"), *above)
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(i).alias("at"), F.col(f"{name}_{i}_1").alias("lost"), F.col(f"{name}_{i}_0").alias("caught")) for name, cuts in rules.items() for i in range(len(cuts))])
    long = counts.select("stratum", "n_good", "n_bad", F.inline(each))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    long = long.withColumn("gain", share("caught", "n_bad") - share("lost", "n_good"))
    best = long.where("gain > 0").groupBy("stratum", "rule").agg(F.max_by("at", F.struct("gain", -F.col("at"))).alias("at"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "at"))).alias("aims"))


def first_step(rules: dict[str, tuple[float, ...]] = RULES) -> Column:
    """The first step of the path that rejects a document, STEPS + 1 if none: of each rule with an aim the first place at
    which its figure is above the cutoff, and the step at which the path gets there."""
    steps = []
    for name, cuts in rules.items():
        aim = F.col("aims")[name]
        # the first cutoff below the figure; the path is at place floor(aim * step / STEPS)
        place = F.coalesce(*[F.when(F.col(name) > c, F.lit(i)) for i, c in enumerate(cuts)])
        reached = F.when(place == 0, F.lit(1)).otherwise(F.ceil(place * STEPS / F.when(aim > 0, aim)).cast("int"))
        steps.append(F.when(aim.isNotNull() & place.isNotNull() & (place <= aim), reached))
    return F.coalesce(F.least(*steps, F.lit(STEPS + 1)), F.lit(STEPS + 1))


def thresholds(labelled: DataFrame, alpha: float, delta: float, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """stratum, aims, step, n_good, lost, n_bad, caught from ``labelled`` (stratum, good, selecting, one column per rule):
    the strictest certified step of each stratum that has labelled documents to certify with, 0 if none is certified. A
    null stratum is one of its own."""
    aimed = aims(labelled.where("selecting"), rules).withColumnRenamed("stratum", "_s")
    rows = labelled.where("not selecting").join(F.broadcast(aimed), F.col("stratum").eqNullSafe(F.col("_s")), "left").withColumn("_at", first_step(rules))
    rejects = [F.sum(((F.col("_at") <= step) & (F.col("good") == which)).cast("long")).alias(f"_{step}_{which}") for step in range(1, STEPS + 1) for which in (0, 1)]
    # one row per stratum: aims are equal within it
    counts = rows.groupBy("stratum").agg(F.max(F.map_entries("aims")).alias("aims"), F.sum((F.col("good") == 1).cast("long")).alias("n_good"), F.sum((F.col("good") == 0).cast("long")).alias("n_bad"), *rejects)
    counts = stored(counts, "strata")
    counts = counts.withColumn("_allowed", most_allowed(F.col("n_good"), alpha, F.lit(delta / max(1, counts.count()))))
    # the first step that loses too many ends the sequence
    failed = F.coalesce(*[F.when(F.col(f"_{step}_1") > F.col("_allowed"), F.lit(step)) for step in range(1, STEPS + 1)], F.lit(STEPS + 1))
    counts = counts.withColumn("step", F.when(F.col("aims").isNull(), 0).otherwise(failed - 1).cast("int"))
    held = lambda which: F.coalesce(*[F.when(F.col("step") == step, F.col(f"_{step}_{which}")) for step in range(1, STEPS + 1)], F.lit(0))
    return counts.select("stratum", F.map_from_entries("aims").alias("aims"), "step", "n_good", held(1).alias("lost"), "n_bad", held(0).alias("caught"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.1, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Every document with its figures, base_failed and kept.

    ``labels``: key and quality (1 good, 0 bad; null is skipped). Null and empty text have no words and fail the base
    rule; a null stratum is one of its own; repeated rows are judged alike, repeated labels all count; an empty table
    gives no rows; other columns are not read. Without labels nothing is certified and only the base rule rejects.
    """
    base = docs.select(F.struct(F.col(key).alias("_key"), F.col(stratum).alias("_stratum")).alias("_id"), F.col(text).alias("text"))
    made = figures(base, "_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    made = stored(made.select("_id.*", *[c for c in made.columns if c != "_id"]).withColumn("base_failed", failed), "figures")
    shares = [c.alias(n) for n, c in ratios().items()]
    known = labels.select(F.col(key).alias("_key"), F.col("quality").alias("good")).where("good is not null and _key is not null")
    labelled = made.where("not base_failed").join(known, "_key").select(F.col("_stratum").alias("stratum"), "good", (uniform_hash("select", F.col("_key")) < SELECTING).alias("selecting"), *shares)
    # one row per stratum
    held = thresholds(labelled, alpha, delta).select(F.col("stratum").alias("_s"), "aims", "step")
    out = made.select("*", *shares).join(held, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    rejected = F.coalesce(first_step() <= F.col("step"), F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & ~rejected)
    return out.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
