"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves of the tree are the distinct values of the level columns (domain, language, source by default). A budget of
tokens flows down: each node's share goes to its children by weight, none above what it can give; what a child can't take
goes to its siblings by their weights, and only what all of them can't take was never given to their parent, so its
siblings have it. Each leaf's share is then taken from seeded epochs: the documents in an order drawn anew for each
epoch, whole epochs first and a prefix of the next one's tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.rows import row_key
from tallyforge.llm.store import cut

LEVELS, EPOCHS, SEED, SHARE = ("domain", "lang", "source"), 2, 5, 0.5
#: Hash ranges into which an epoch of a leaf is cut to find where its prefix ends.
RANGES = 4096
#: Leaves up to which the plan (a short row each) is broadcast; a larger one is joined by shuffling.
BROADCAST_LEAVES = 100_000
NONE = "(none)"


def token_count(text: Column) -> Column:
    """Runs of characters other than blank, tab to carriage return; null has none."""
    gaps = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "a")
    return (F.char_length(gaps) - F.char_length(F.replace(gaps, F.lit("a")))).cast("long")


def level_shares(leaves: DataFrame, levels: tuple[str, ...], budget: float) -> DataFrame:
    """Leaves (level columns, weight of each level as weight_<level>, tokens, capacity) with ``share`` tokens each.

    At each level the amount of a parent is dealt to its children by weight, none above its capacity. Children fill in
    the order of capacity by weight: once one can't take its part, no earlier one could. Siblings meet in one task; a
    tree has few nodes, however many documents there are. Weights of 0 or less get what is left when all others are full.
    """
    tree, parent = leaves.withColumn("amount", F.lit(float(budget))), []
    for level in levels:
        path = [*parent, level]
        nodes = tree.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.max(f"weight_{level}").alias("weight"), F.max("amount").alias("amount"))
        weight = F.greatest(F.col("weight").cast("double"), F.lit(1e-12))
        whole = Window.partitionBy(*(parent or [F.lit(0)]))
        order = whole.orderBy(F.col("capacity") / weight, *path)
        upto = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum(weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("_rate", F.greatest(F.col("amount") - upto, F.lit(0.0)) / left).withColumn("_w", weight)
        # full if the rate at its turn covers it; the first that is not has the largest rate of those, and it holds for them all
        nodes = nodes.withColumn("_open", F.when(F.col("capacity") > F.col("_rate") * F.col("_w"), F.col("_rate")))
        nodes = nodes.withColumn("_rate", F.max("_open").over(whole))
        nodes = nodes.withColumn("amount", F.least(F.col("capacity"), F.coalesce(F.col("_rate") * F.col("_w"), F.col("capacity"))))
        tree = tree.drop("amount").join(nodes.select(*path, "amount"), path)
        parent = path
    return tree.withColumnRenamed("amount", "share")


def planned(docs: DataFrame, weights: dict[str, dict[str, float]], levels=LEVELS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Leaves of docs (level columns, tokens): tokens, capacity (tokens in all epochs), share, epochs taken whole, rest.

    The budget is ``share`` of all tokens. Values that ``weights`` doesn't name weigh 1. Small: a row a leaf.
    """
    leaves = docs.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    for level in levels:
        named = weights.get(level, {})
        weight = F.lit(1.0)
        for value, w in named.items():
            weight = F.when(F.col(level) == value, float(w)).otherwise(weight)
        leaves = leaves.withColumn(f"weight_{level}", weight)
    leaves = cut(leaves.withColumn("capacity", F.col("tokens") * float(epochs)))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    out = level_shares(leaves, levels, total * share).withColumn("share", F.floor("share").cast("long"))
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("share") / F.col("tokens")), F.lit(epochs))).otherwise(0).cast("int")
    return cut(out.withColumn("whole", whole).withColumn("rest", F.col("share") - F.col("whole") * F.col("tokens")).drop(*[f"weight_{x}" for x in levels]))


def mixed(docs: DataFrame, weights: dict[str, dict[str, float]], levels=LEVELS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, light: DataFrame | None = None) -> DataFrame:
    """All rows of docs (row, level columns, tokens, any others) with ``taken``: array of (epoch, tokens) for the mixture.

    Whole epochs give all of a document's tokens. Of the next one, in the order of a hash of seed, epoch and row, documents
    give tokens until the leaf's share is met, the last one perhaps a part. Equal rows come in any order. Weights of 0 or
    less get what is left when all others are full.

    A leaf is cut by hash range. Sums of ranges (RANGES a leaf at most, however many documents it has) tell in which
    range its prefix ends: ranges before it are taken, those after it not, and only the rows of that one range, one in
    RANGES of the leaf, are put in order. ``light``: docs without the other columns, if these are cheaper to read.
    """
    light = docs if light is None else light
    hashed = lambda df: df.withColumn("_h", F.xxhash64(F.lit(seed), "whole", "row")).withColumn("_range", F.shiftrightunsigned("_h", 52).cast("int"))
    plan = planned(light, weights, levels, share, epochs).select(*levels, "whole", "rest")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan
    sums = hashed(light.join(plan, list(levels))).groupBy(*levels, "_range").agg(F.sum("tokens").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*levels).orderBy("_range"))
    sums = sums.withColumn("_before", upto - F.col("_sum")).join(plan, list(levels))
    ends = sums.where("_before < rest AND _before + _sum >= rest").groupBy(*levels).agg(F.min(F.struct("_range", "_before")).alias("_end"))
    plan = cut(plan.join(ends, list(levels), "left"))
    keyed = hashed(docs.join(F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan, list(levels)))
    inside = Window.partitionBy(*levels).orderBy(F.shiftrightunsigned("_h", 1), "_h", "row").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_end._before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    last = keyed.where(F.col("_range") == F.col("_end._range"))
    last = last.withColumn("_part", F.greatest(F.least(F.col("tokens"), F.col("rest") - place), F.lit(0)))
    others = keyed.where(F.col("_end").isNull() | (F.col("_range") != F.col("_end._range")))
    others = others.withColumn("_part", F.when(F.col("_range") < F.col("_end._range"), F.col("tokens")).otherwise(0).cast("long"))
    none = F.array().cast("array<struct<epoch:int,tokens:bigint>>")
    every = F.transform(F.sequence(F.lit(1), F.col("whole")), lambda e: F.struct((e - 1).alias("epoch"), F.col("tokens").alias("tokens")))
    part = F.when(F.col("_part") > 0, F.array(F.struct(F.col("whole").alias("epoch"), F.col("_part").alias("tokens")))).otherwise(none)
    taken = F.concat(F.when(F.col("whole") > 0, every).otherwise(none), part).alias("taken")
    return others.unionByName(last).select(*docs.columns, taken)


def leaf_columns(docs: DataFrame, *more: Column) -> DataFrame:
    """row (row_key), doc_id, domain (by the number at the end of source), lang, source, tokens, and ``more``.

    Null levels are the value (none). The domains are a stand-in for a table of sources: odd numbers are web, even ones
    are books, and sources without a number are other.
    """
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9])$", 1)
    domain = F.when(number == "", "other").when(number.isin("1", "3", "5", "7", "9"), "web").otherwise("books")
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    row = row_key(docs["doc_id"], docs["text"]).alias("row")
    return docs.select(row, F.col("doc_id"), domain.alias("domain"), level("lang"), level("source"), token_count(F.col("text")).alias("tokens"), *more)


#: Weights of the query and the pipeline.
WEIGHTS = {"domain": {"web": 3.0, "books": 2.0, "other": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}


def op8(spark, sf_dir: str) -> DataFrame:
    out = mixed(cut(leaf_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))), WEIGHTS)
    total = F.aggregate("taken", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return out.select("doc_id", "domain", "lang", "source", F.col("tokens").alias("n_tokens"), F.size("taken").cast("long").alias("n_epochs"), total.alias("taken_tokens"))


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token, blanks between tokens as they are."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixture(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, **how) -> DataFrame:
    """The rows of docs that the mixture takes tokens from, in all their columns, once for each epoch that takes any.

    Where an epoch takes only the first tokens of a document, its text ends after these. Columns may have any names.
    """
    light = cut(leaf_columns(docs).select("row", *LEVELS, "tokens"))
    taken = mixed(leaf_columns(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")), weights or WEIGHTS, light=light, **how)
    out = taken.select("doc", "tokens", F.explode("taken").alias("t"))
    text = F.when(F.col("t.tokens") < F.col("tokens"), first_tokens(F.col("doc.text").cast("string"), F.col("t.tokens"))).otherwise(F.col("doc.text").cast("string"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
