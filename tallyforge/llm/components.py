"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.store import cut

#: Parts into which the rows of a key are dealt when they are joined with the key's one row, which is copied to each part.
SALTS = 8


def with_one(many: DataFrame, one: DataFrame, key: str, deal: str) -> DataFrame:
    """many joined with one (a row a key). The rows of a key are dealt by ``deal``, so that a task has a part of a hub's."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(deal), F.lit(SALTS)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least node around it (itself included)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return with_one(both.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours and itself to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = with_one(links, least, "a", "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root being the least node of its component.

    Links of a node to itself and links with a null end are left out. Minima per node are pre-aggregated, and a node's
    links are joined with its minimum in SALTS parts. Each round is written to the shared folder.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links)
    before = None
    while True:
        links = cut(_small_star(_large_star(links)).where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
