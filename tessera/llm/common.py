"""Words, shared storage and small column helpers used by several operators."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpointed

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc(value: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as no bytes."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def uniform_hash(*parts: Column | str) -> Column:
    """A number in (0, 1) fixed by the parts: 52 bits of an MD5, so that any engine can recompute it."""
    digest = F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    return checkpointed(df, name)


def release_memory() -> None:
    """Gives memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    library = ctypes.util.find_library("c")
    if library and hasattr(libc := ctypes.CDLL(library), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(batches: Iterator) -> Iterator:
    """The batches; at their end, free memory goes back to the system. Spark keeps Python workers for later tasks, and an
    executor may have several that are idle."""
    try:
        yield from batches
    finally:
        release_memory()
