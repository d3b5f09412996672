"""Lookups by time, revision and prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.normalise import revision, revision_rank


def superseded(sets: DataFrame, key: str, created: str, *tie: str) -> DataFrame:
    """sets with superseded_at: when the next one of the same key was created; null for the last."""
    return sets.withColumn("superseded_at", F.lead(created).over(Window.partitionBy(key).orderBy(created, *tie)))


def effective(asked: DataFrame, sets: DataFrame, key: str, at: str, created: str, value: str, *tie: str) -> DataFrame:
    """asked with the newest set of the same key created at or before ``at``: ``value`` and ``created``, null if none.

    Both sides are merged per key and the last set is carried forward, so no pairs are made; a set of the same moment
    counts as there.
    """
    columns = [c for c in asked.columns if c != key]
    left = asked.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*columns).alias("_row"), F.lit(None).cast(dict(sets.dtypes)[value]).alias("_value"), *[F.lit(None).cast(dict(sets.dtypes)[t]).alias(f"_{t}") for t in tie])
    right = sets.select(key, F.col(created).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), *[F.col(t).alias(f"_{t}") for t in tie])
    order = Window.partitionBy(key).orderBy("_at", "_side", *[f"_{t}" for t in tie]).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct("_value", "_at")), ignorenulls=True).over(order))
    return both.where("_side = 1").select(key, "_row.*", F.col("_last._value").alias(value), F.col("_last._at").alias(created))


def longest_prefix(asked: DataFrame, column: str, known: DataFrame, prefix: str, breaks: str) -> DataFrame:
    """asked with the longest of the known prefixes that ends at one of ``breaks`` (characters) or at the end; null if none.

    Each text is exploded into its prefixes and joined on equality, never by a nested loop.
    """
    ends = F.filter(F.sequence(F.lit(1), F.char_length(column)), lambda i: (i == F.char_length(column)) | F.contains(F.lit(breaks), F.substr(F.col(column), i + 1, F.lit(1))))
    texts = asked.select(column).where(F.char_length(column) > 0).distinct()
    parts = texts.select(column, F.explode(F.transform(ends, lambda i: F.substr(F.col(column), F.lit(1), i))).alias("_prefix"))
    found = parts.join(known.select(F.col(prefix).alias("_prefix")).distinct(), "_prefix")
    best = found.groupBy(column).agg(F.max_by("_prefix", F.char_length("_prefix")).alias(prefix))
    return asked.join(best, column, "left")


def cited_revision(asked: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """asked (key, cited, set_id) moved to the set of the cited revision where it is loaded; else ``flag`` says what is not.

    sets: key, set_id, revision (tokens separated by commas).
    """
    tokens = sets.select(key, F.col("set_id").alias("_id"), F.explode(F.split("revision", ",")).alias("_token"))
    tokens = tokens.select(key, "_id", revision(F.col("_token")).alias("_token")).where("_token IS NOT NULL")
    tokens = tokens.groupBy(key, "_token").agg(F.min("_id").alias("_cited_id"))
    out = asked.withColumn("_token", revision(F.col("cited"))).join(tokens, [key, "_token"], "left")
    flag = F.when(F.col("_token").isNotNull() & F.col("_cited_id").isNull(), F.concat(F.lit("not loaded: "), F.col("_token")))
    return out.withColumn("flag", flag).withColumn("set_id", F.coalesce("_cited_id", "set_id")).drop("_cited_id", "_token")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def by_prefix(asked: DataFrame, column: str, at: str, sets: DataFrame, number: str, created: str, value: str) -> DataFrame:
    """asked with ``number``, ``value`` and ``tier`` of the set in force at ``at`` for a drawing number, or nulls.

    Tier 1: the set of exactly this number. Tier 2: of the longest known number that this one begins with. Tier 3: of the
    first known number (in the order of numbers) that begins with this one. Within a tier the newest set created at or before
    ``at`` counts (any, where ``at`` is null); a number without one in force is passed over. Beginnings are found by joins on
    equality: of texts exploded into their prefixes.
    """
    pairs = asked.select(F.col(column).alias("_text"), F.col(at).alias("_at")).where(F.col(column) != "").distinct()
    moment = lambda c: F.col(c).cast("timestamp")
    known = sets.select(F.col(number).alias("_number"), moment(created).alias("_created"), F.col(value).alias("_value")).where("_number <> ''")
    rank = F.struct((-F.unix_micros("_created")).alias("_age"), F.col("_value"))
    numbers = known.groupBy("_number").agg(F.min("_created").alias("_first"), F.min(rank).alias("_newest"))
    texts = pairs.select("_text").distinct()
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.substr(c, F.lit(1), i))
    down = texts.select("_text", F.explode(prefixes(F.col("_text"))).alias("_number")).join(numbers.select("_number", "_first").hint("merge"), "_number")
    down = down.withColumn("_tier", F.when(F.col("_number") == F.col("_text"), 1).otherwise(2)).withColumn("_order", -F.char_length("_number"))
    up = numbers.where("length(_number) > 1").withColumn("_text", F.explode(F.slice(prefixes(F.col("_number")), F.lit(1), F.char_length("_number") - 1)))
    up = up.join(texts.hint("merge"), "_text").withColumn("_tier", F.lit(3)).withColumn("_order", F.lit(0))
    links = [x.select("_text", "_tier", "_order", "_number", "_first") for x in (down, up)]
    order = Window.partitionBy("_text").orderBy("_tier", "_order", "_number")
    links = links[0].union(links[1]).withColumn("_before", F.min("_first").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.row_number().over(order))
    # A number is passed over only where it has no set yet, so one counts at some moment only if it has one before all that come first.
    links = links.where("_n = 1 OR _first < _before OR _before IS NULL AND _first IS NOT NULL")
    found = pairs.join(links.hint("merge"), "_text").where(F.col("_at").isNull() | (F.col("_first") <= moment("_at")))
    best = found.groupBy("_text", "_at").agg(F.min(F.struct("_tier", "_order", "_number")).alias("_b")).select("_text", "_at", "_b._tier", "_b._number")
    # The newest set by then: sets and what is asked of a number are merged by time, and the last set is carried forward.
    asks = best.where("_at IS NOT NULL").select("_number", moment("_at").alias("_when"), F.lit(1).alias("_side"), F.lit(None).cast(known.schema["_value"].dataType).alias("_value")).distinct()
    both = asks.union(known.where("_created IS NOT NULL").select("_number", F.col("_created").alias("_when"), F.lit(0).alias("_side"), "_value"))
    by_time = Window.partitionBy("_number").orderBy("_when", "_side", F.desc_nulls_last("_value")).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct("_value")), ignorenulls=True).over(by_time)).where("_side = 1")
    dated = best.where("_at IS NOT NULL").withColumn("_when", moment("_at")).join(carried.select("_number", "_when", "_last").hint("merge"), ["_number", "_when"]).select("_text", "_at", "_number", "_tier", "_last._value")
    undated = best.where("_at IS NULL").join(numbers.select("_number", "_newest").hint("merge"), "_number").select("_text", "_at", "_number", "_tier", "_newest._value")
    best = dated.union(undated).select("_text", "_at", F.col("_number").alias(number), F.col("_value").alias(value), F.col("_tier").alias("tier"))
    return asked.join(best.hint("merge"), F.col("_text").eqNullSafe(F.col(column)) & F.col("_at").eqNullSafe(F.col(at)), "left").drop("_text", "_at")


def grouped_files(files: DataFrame, keys: list[str], revision_column: str, place: str) -> DataFrame:
    """One row for each key: the file of the highest revision rank, of equal ones the first by ``place``, and collisions.

    collisions: an array of (existing_rev, new_rev, chosen_rev), one for each further file in the order in which they came.
    """
    rest = [c for c in files.columns if c not in keys]
    rows = files.withColumn("_rank", revision_rank(F.col(revision_column)))
    every = F.array_sort(F.collect_list(F.struct(F.col(place).alias("_place"), F.col("_rank"), F.col(revision_column).alias("_rev"), F.struct(*rest).alias("_row"))))
    fold = lambda acc, x: F.struct(
        F.when(x["_rank"] > acc["best"]["_rank"], x).otherwise(acc["best"]).alias("best"),
        F.array_append(acc["seen"], F.struct(acc["best"]["_rev"].alias("existing_rev"), x["_rev"].alias("new_rev"), F.when(x["_rank"] > acc["best"]["_rank"], x["_rev"]).otherwise(acc["best"]["_rev"]).alias("chosen_rev"))).alias("seen"),
    )
    rows = rows.groupBy(*keys).agg(every.alias("_every"))
    out = rows.withColumn("_first", F.struct(F.get("_every", F.lit(0)).alias("best"), F.array().cast("array<struct<existing_rev:string,new_rev:string,chosen_rev:string>>").alias("seen")))
    out = out.withColumn("_f", F.aggregate(F.slice("_every", 2, 1_000_000), F.col("_first"), fold))
    return out.select(*keys, "_f.best._row.*", F.col("_f.seen").alias("collisions"))
