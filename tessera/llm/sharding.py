"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0..N-1 in the order (first hex digits of md5(key), key, tie columns). A Feistel network over
Z_a x Z_b, the smallest near-square grid with a*b >= N, permutes the numbers; values that fall outside 0..N-1 are
walked on until they fall inside. Position v of the shuffle is slot v div S of shard v mod S, so shard and slot of a
row follow from its number alone, and counts of shards differ by one at most (law ``rows``).

Scale: only key, size and checksum are shuffled, once, by 4096 md5 buckets. The rows of a key that has a large share of all
rows (null above all) are cut out of their bucket and numbered in ranges of their first tie column. Offsets are a bounded
number of rows at any input size. No step sees a group of equal texts together: repeated rows are numbered apart by their
keys.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import crc, utf8_bytes

ROUNDS = 6
BUCKET_DIGITS = 3
#: a key is hot with more rows than this, and more than this share of all
HOT_LEAST, MOST_HOT = 1 << 16, 64
#: ranges of a hot key's rows
PARTS = 256


def grid(rows: int) -> tuple[int, int]:
    """The sides (a, b) with a*b >= rows and fewer than a numbers too many."""
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-rows // a))


def _permuted(value: str, a: int, b: int, seed: int) -> str:
    """SQL of one pass of the network: (left, right) = (value div b, value mod b), then rounds that add an MD5 of one
    half to the other. A higher-order function keeps the generated code as small as one round."""
    mixed = "cast(conv(substring(md5(cast(concat('{seed}:', t, ':', acc.{half}) as binary)), 1, 15), 16, 10) as bigint)"
    left = f"(acc.l + {mixed.format(seed=seed, half='r')}) % {a}L"
    right = f"(acc.r + {mixed.format(seed=seed, half='l')}) % {b}L"
    step = f"if(t % 2 = 0, named_struct('l', {left}, 'r', acc.r), named_struct('l', acc.l, 'r', {right}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {value} div {b}L, 'r', {value} % {b}L), (acc, t) -> {step}, acc -> acc.l * {b}L + acc.r)"


def walk_length(spark: SparkSession, rows: int, seed: int) -> int:
    """The exact number of extra passes after which every row is inside. Rows leave through the outside numbers that
    are no image of an outside number; these, fewer than sqrt(rows) + 1, are followed until all are inside again."""
    a, b = grid(rows)
    step = F.expr(_permuted("id", a, b, seed)).alias("id")
    outside, extra = spark.range(rows, a * b, numPartitions=1), 0
    left = outside.join(outside.select(step), "id", "left_anti")
    while not left.isEmpty():
        extra += 1
        left = left.select(step).where(F.col("id") >= rows)
    return extra


def permute(df: DataFrame, number: str, rows: int, seed: int, target: str = "position") -> DataFrame:
    """Adds the shuffled position of every global row number in column ``number``."""
    if rows < 2:
        return df.withColumn(target, F.lit(0).cast("long"))
    a, b = grid(rows)
    walked, extra = _permuted(number, a, b, seed), walk_length(df.sparkSession, rows, seed)
    if extra:
        walked = f"aggregate(sequence(1, {extra}), {walked}, (v, turn) -> if(v < {rows}L, v, {_permuted('v', a, b, seed)}))"
    return df.withColumn(target, F.expr(walked))


def hot_keys(df: DataFrame, key: str, rows: int) -> list:
    """Keys of more than HOT_LEAST rows and a MOST_HOT-th of all rows: fewer than MOST_HOT. Null counts as a key."""
    least = max(HOT_LEAST, -(-rows // MOST_HOT))
    return [r[0] for r in df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(key).collect()]


def numbered(df: DataFrame, key: str, ties: list[str], number: str = "row_number", rows: int | None = None) -> DataFrame:
    """Adds the global row number: the rank by (md5 bucket of the key, key, ties). Rows equal in all of these get
    different numbers in no particular order, as they can't be told apart. The first of ``ties`` is a number from 0 to
    2 ** 32 - 1, by which the rows of a hot key are cut into PARTS ranges; ``rows`` saves a count."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    bucket = lambda c: F.substring(F.md5(text(c).cast("binary")), 1, BUCKET_DIGITS)
    kind = df.schema[key].dataType
    df = df.withColumn("_bucket", bucket(F.col(key)))
    segment = F.lit(0)
    for k in sorted(hot_keys(df, key, df.count() if rows is None else rows), key=lambda k: (k is None, k)):
        # 0 before the first hot key of the bucket, 1 for its rows, 2 between it and the next, and so on
        value = F.lit(k).cast(kind)
        after = F.when(F.col(key).eqNullSafe(value), 1).when(F.col(key).isNull() if k is not None else F.lit(False), 2).when(F.col(key) > value, 2).otherwise(0)
        segment = segment + F.when(F.col("_bucket") == bucket(value), after).otherwise(0)
    df = df.withColumn("_segment", segment)
    df = df.withColumn("_part", F.when(F.col("_segment") % 2 == 1, F.expr(f"cast(`{ties[0]}` div {(1 << 32) // PARTS} as int)")).otherwise(0))
    place = ["_bucket", "_segment", "_part"]
    counts = df.groupBy(*place).agg(F.count("*").alias("_rows"))
    before = counts.select(*place, (F.sum("_rows").over(Window.orderBy(*place)) - F.col("_rows")).alias("_before"))
    order = [F.col(key).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    inside = F.row_number().over(Window.partitionBy(*place).orderBy(*order))
    # at most 16^BUCKET_DIGITS rows, and PARTS + 1 for each hot key
    return df.withColumn("_inside", inside).join(F.broadcast(before), place).withColumn(number, F.col("_before") + F.col("_inside") - 1).drop(*place, "_inside", "_before")


def shard(docs: DataFrame, shards: int = 24, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard of every row.

    Null text counts as empty, null keys sort last; repeated rows keep one slot each; an empty table gives no rows;
    other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = docs.count()
    slim = docs.select(F.col(key), (utf8_bytes(F.col(text)) + 8).alias("size"), crc(F.col(text)).alias("text_crc32"))
    out = permute(numbered(slim, key, ["text_crc32", "size"], "_number", rows), "_number", rows, seed, "_position")
    return out.select(key, "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_position") % shards).cast("int").alias("shard"), F.expr(f"_position div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
