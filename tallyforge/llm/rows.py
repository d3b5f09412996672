"""Which row is which: keys of rows, and dropping rows by their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type of row_key().
ROW = "struct<id:bigint,a:bigint,b:bigint>"
#: Keys up to which rows are dropped or kept by a broadcast (some 30 bytes each); more are joined by shuffling.
BROADCAST_KEYS = 250_000
LAST = (1 << 63) - 1


def row_key(doc_id: Column, text: Column) -> Column:
    """doc_id and two hashes of the text: repeated rows share a key, and other rows aren't expected to at any size."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text, F.isnull(text)).alias("b"))


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that is none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """The rows, broadcast if they are few. ``keys`` should be cheap to count twice."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def by_keys(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs, in all their columns, that have one of ``keys`` (column row; left_semi) or none (left_anti)."""
    name = unused(docs, "_row")
    keyed = docs.withColumn(name, row_key(docs["doc_id"], docs["text"]))
    found = small(keys.select(F.col("row").alias(name)).distinct())
    return keyed.join(found, name, how).select(*[F.col(f"`{c}`") for c in docs.columns])
