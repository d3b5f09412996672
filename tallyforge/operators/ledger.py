"""Ledgers: reconciliation of three sides, upserts, sampling, scoring and usage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.normalise import code_family, code_key, codes_named, line_code, percent_off, table_value, truthy

CONFLICT = "CONFLICT"


def unit_index(claims: DataFrame, keys: list[str], unit: Column, drawn: Column | None = None, total: Column | None = None) -> DataFrame:
    """keys, rows, drawn, total, unit (as text: the one value that isn't zero, CONFLICT if several, null if none).

    Rows with a blank key are left out; grand_total() counts them.
    """
    value = F.when(unit != 0, unit.cast("string"))
    given = [F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) != "" for k in keys]
    some = claims.where(reduce(lambda a, b: a & b, given))
    zero = F.lit(0).cast("decimal(18,2)")
    out = some.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.coalesce(drawn if drawn is not None else zero, zero)).alias("drawn"), F.sum(F.coalesce(total if total is not None else zero, zero)).alias("total"),
                                  F.countDistinct(value).alias("_n"), F.min(value).alias("_one"))
    return out.withColumn("unit", F.when(F.col("_n") > 1, CONFLICT).otherwise(F.col("_one"))).drop("_n", "_one")


def grand_total(claims: DataFrame, total: Column) -> DataFrame:
    """One row: the total over all rows, those without keys included."""
    return claims.agg(F.coalesce(F.sum(total), F.lit(0)).alias("grand_total"))


def piece_overrun(inspected: DataFrame, drawn: DataFrame, keys: list[str], ledger: DataFrame, report: str) -> DataFrame:
    """keys, pieces, drawn where more pieces were inspected than drawn.

    inspected: report, keys, pieces. Only reports that the ledger has count, and keys with a known unit: drawn (keys, drawn,
    unit) with a unit that is neither null nor CONFLICT.
    """
    known = inspected.join(ledger.select(report).distinct(), report, "left_semi")
    sums = known.groupBy(*keys).agg(F.sum("pieces").alias("pieces"))
    units = drawn.where(F.col("unit").isNotNull() & (F.col("unit") != CONFLICT)).select(*keys, "drawn")
    return sums.join(units, keys).where("pieces > drawn")


def coverage(reports: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """One row: reports read, numbers in the ledger, and how many of these were read."""
    both = reports.select(key).distinct().withColumn("_r", F.lit(1)).join(ledger.select(key).distinct().withColumn("_l", F.lit(1)), key, "full")
    return both.agg(F.count("_r").alias("n_reports"), F.count("_l").alias("n_ledger"), F.count(F.when(F.col("_r").isNotNull() & F.col("_l").isNotNull(), 1)).alias("n_both"))


def billed_against_required(billed: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """key, billed, required, over, under (sorted arrays), status, over_rows, over_amount, confirmed, unproven.

    billed: key, method, amount, confirmed (whether the row's overbilling is proven), a row a claim. required: key, methods (null: not read).
    status: OK, over, under, both, or unknown where the requirement isn't there or wasn't read. Each claim meets one requirement.
    """
    rows = billed.join(required.select(key, "methods"), key, "left")
    outside = F.coalesce(~F.array_contains("methods", F.col("method")), F.lit(False))
    zero = F.lit(0).cast("decimal(18,2)")
    amount = lambda test: F.sum(F.when(test, F.col("amount")).otherwise(zero))
    out = rows.groupBy(key).agg(F.array_sort(F.collect_set("method")).alias("billed"), F.first("methods").alias("_m"), F.count(F.when(outside, 1)).alias("over_rows"),
                                amount(outside).alias("over_amount"), amount(outside & F.col("confirmed")).alias("confirmed"), amount(outside & ~F.col("confirmed")).alias("unproven"))
    over, under = F.array_sort(F.array_except("billed", "_m")), F.array_sort(F.array_except("_m", "billed"))
    out = out.withColumn("over", over).withColumn("under", under)
    status = F.when(F.col("_m").isNull(), "unknown").when((F.size("over") > 0) & (F.size("under") > 0), "both").when(F.size("over") > 0, "over").when(F.size("under") > 0, "under").otherwise("OK")
    return out.withColumn("status", status).withColumn("required", F.array_sort("_m")).drop("_m")


def overbill_counters(found: DataFrame) -> DataFrame:
    """One row of counters over billed_against_required(): keys by status, rows, methods missing, and amounts."""
    n = lambda test: F.count(F.when(test, 1))
    by = [n(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("OK", "over", "under", "both", "unknown")]
    return found.agg(F.count("*").alias("n_keys"), *by, F.sum("over_rows").alias("over_rows"), F.sum(F.coalesce(F.size("under"), F.lit(0)).cast("long")).alias("under_pairs"), F.sum("confirmed").alias("confirmed"), F.sum("unproven").alias("unproven"))


def code_gap(cited: DataFrame, known: DataFrame) -> DataFrame:
    """code, family, n_cited, n_drawings, drawings, n_known, outcome: cited codes (code, drawing) against known ones (code).

    Codes are compared by code_key(). outcome: matched, cited_only, ingested_only. ``drawings``: the first five in order.
    """
    one = cited.select(code_key(F.col("code")).alias("code"), code_family(F.col("code")).alias("family"), "drawing")
    one = one.groupBy("code").agg(F.min("family").alias("family"), F.count("*").alias("n_cited"), F.array_sort(F.collect_set("drawing")).alias("_d"))
    one = one.withColumn("n_drawings", F.size("_d")).withColumn("drawings", F.slice("_d", 1, 5)).drop("_d")
    two = known.groupBy(code_key(F.col("code")).alias("code")).agg(F.count("*").alias("n_known"))
    both = one.join(two, "code", "full")
    outcome = F.when(F.col("n_cited").isNull(), "ingested_only").when(F.col("n_known").isNull(), "cited_only").otherwise("matched")
    return both.withColumn("outcome", outcome).na.fill(0, ["n_cited", "n_known", "n_drawings"])


def begun(numbers: DataFrame, column: str, known: DataFrame, number: str) -> DataFrame:
    """numbers with ``indexed``: whether a known number begins with this one. Known numbers are exploded into their beginnings."""
    heads = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length(number)), lambda i: F.substr(F.col(number), F.lit(1), i))).alias(column)).distinct()
    return numbers.join(heads.withColumn("indexed", F.lit(True)), column, "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))


def reconcile(expected: DataFrame, ledger: DataFrame, key: str, limit: float = 1.0) -> DataFrame:
    """expected (key, expected, unknown) against ledger (key, booked, shared): key, expected, booked, outcome.

    incalculable if anything is unknown or the cell is shared; ledger_missing; mismatch over ``limit`` percent; match.
    """
    out = expected.join(ledger, key, "left")
    off = percent_off(F.col("expected"), F.col("booked"))
    outcome = F.when(F.col("booked").isNull(), "ledger_missing").when(F.col("unknown") | F.col("shared"), "incalculable").when(off > limit, "mismatch").otherwise("match")
    return out.select(key, "expected", "booked", outcome.alias("outcome"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put over those of the same keys (null-safe), and new ones added; keys of new are distinct."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_row"))
    return best.select(*keys, "_row.*").select(*old.columns)


def quotas(strata: DataFrame, n: int) -> DataFrame:
    """strata (stratum, size) with quota: 1 and a part of the rest by size, what is left over to the largest first."""
    whole = Window.partitionBy(F.lit(1))
    total, count = F.sum("size").over(whole), F.count("*").over(whole)
    out = strata.withColumn("_total", total).withColumn("_count", count)
    out = out.withColumn("_base", 1 + F.floor((n - F.col("_count")) * F.col("size") / F.col("_total")).cast("long"))
    left = n - F.sum("_base").over(whole)
    out = out.withColumn("_left", left).withColumn("_place", F.row_number().over(whole.orderBy(F.desc("size"), "stratum")))
    return out.select("stratum", "size", F.least("size", F.col("_base") + (F.col("_place") <= F.col("_left")).cast("long")).alias("quota"))


def stratified(rows: DataFrame, stratum: Column, key: str, n: int, seed: int = 7) -> DataFrame:
    """A sample by quota: within each stratum the rows of least hash. The strata are few; their sizes are windowed."""
    rows = rows.withColumn("stratum", stratum)
    plan = quotas(rows.groupBy("stratum").agg(F.count("*").alias("size")), n)
    order = Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed), key), key)
    picked = rows.join(plan, "stratum").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("quota"))
    return picked.drop("_n", "size", "quota")


def upper_median(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, median: the value at floor(n / 2) of the sorted ones, nulls left out. Only the counts of values are ranked."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn("_half", F.floor(F.sum("_n").over(whole) / 2))
    return counts.where("_upto > _half AND _upto - _n <= _half").select(*keys, F.col(value).alias("median"))


def answer_summary(answers: DataFrame, judge: str) -> DataFrame:
    """Per judge: n, parse_ok, truncated, errors, median and largest delay, right ones, accuracy (4 places).

    answers: judge, parsed, truncated, failed, delay, correct.
    """
    n = lambda c: F.count(F.when(F.col(c), 1))
    out = answers.groupBy(judge).agg(F.count("*").alias("n"), n("parsed").alias("parse_ok"), n("truncated").alias("truncated"), n("failed").alias("errors"), F.max("delay").alias("max_delay"), n("correct").alias("right"))
    out = out.join(upper_median(answers, "delay", [judge]), judge, "left")
    return out.withColumn("accuracy", F.round(F.col("right") / F.col("n"), 4))


def agreement_pairs(answers: DataFrame, case: str, judge: str, says: str) -> DataFrame:
    """a, b, n, agreed, share for each pair of judges over the cases that both answered."""
    one, two = answers.select(case, F.col(judge).alias("a"), F.col(says).alias("_x")), answers.select(case, F.col(judge).alias("b"), F.col(says).alias("_y"))
    both = one.join(two, case).where("a < b")
    out = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.count(F.when(F.col("_x").eqNullSafe(F.col("_y")), 1)).alias("agreed"))
    return out.withColumn("share", F.round(F.col("agreed") / F.col("n"), 4))


def weighted_score(shares: DataFrame, judge: str, weights: dict[str, float], veto: str, least: float) -> DataFrame:
    """judge, score, verdict from shares (judge, category, share): the weighted mean; rejected where the veto category is below ``least``."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    w = F.coalesce(F.try_element_at(weight, F.col("category")), F.lit(0.0))
    out = shares.groupBy(judge).agg((F.sum(w * F.col("share")) / F.sum(w)).alias("score"), F.min(F.when(F.col("category") == veto, F.col("share"))).alias("_v"))
    return out.withColumn("verdict", F.when(F.col("_v") < least, "rejected").otherwise("accepted")).drop("_v")


def table_scores(truth: DataFrame, got: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: keys, keys found, rows that match in full, right and wrong cells, accuracy, the three worst columns.

    Keys are compared by line_code(), cells by table_value(), and cells that name codes by the sets of codes: all of the truth's
    must be there. Of rows of equal keys the least counts.
    """
    side = lambda df: df.withColumn("_k", line_code(F.col(key))).groupBy("_k").agg(F.min(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])).alias("r"))
    both = side(truth).withColumnRenamed("r", "t").join(side(got).withColumnRenamed("r", "g"), "_k", "left")

    def right(c: str) -> Column:
        want, have = F.col(f"t.{c}"), F.col(f"g.{c}")
        named = codes_named(want)
        return F.col("g").isNotNull() & F.when(F.size(named) > 0, F.size(F.array_except(named, codes_named(have))) == 0).otherwise(table_value(want) == table_value(have))

    marks = [F.coalesce(right(c), F.lit(False)) for c in columns]
    n = lambda c: F.count(F.when(c, 1))
    out = both.agg(F.count("*").alias("keys"), n(F.col("g").isNotNull()).alias("found"), n(reduce(lambda a, b: a & b, marks)).alias("full_rows"), *[n(m).alias(f"_{i}") for i, m in enumerate(marks)])
    total = sum((F.col(f"_{i}") for i in range(len(columns))), F.lit(0))
    cells = F.col("keys") * len(columns)
    worst = F.array_sort(F.array(*[F.struct(F.col(f"_{i}").alias("n"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(columns)]))
    worst = F.transform(F.slice(F.filter(worst, lambda x: x["n"] < F.col("keys")), 1, 3), lambda x: x["c"])
    return out.select("keys", "found", "full_rows", total.alias("right_cells"), (cells - total).alias("wrong_cells"), F.when(cells > 0, F.round(total / cells, 4)).alias("accuracy"), worst.alias("worst"))


def review_scores(truth: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """One row of counters: agree, disagree, flagged, missed and missing rows, and transitions of verdicts (as text).

    truth: keys, report_no, verdict (null: can't be judged). got: keys, report_no, verdict, needs_review. A row that can't be
    judged should have been flagged.
    """
    right = got.select(*keys, F.col("report_no").alias("_report"), F.col("verdict").alias("_verdict"), truthy(F.col("needs_review")).alias("_flag"), F.lit(True).alias("_there"))
    rows = truth.join(right, keys, "left")
    there, judged_ = F.coalesce("_there", F.lit(False)), F.col("verdict").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    out = rows.agg(n(there & F.col("report_no").eqNullSafe(F.col("_report"))).alias("agree"), n(there & ~F.col("report_no").eqNullSafe(F.col("_report"))).alias("disagree"),
                   n(there & ~judged_ & F.col("_flag")).alias("flagged"), n(there & ~judged_ & ~F.col("_flag")).alias("missed"), n(~there).alias("missing"))
    steps = rows.where(there & judged_).groupBy(F.concat_ws("→", "verdict", F.coalesce("_verdict", F.lit("-"))).alias("t")).agg(F.count("*").alias("n"))
    steps = steps.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "t", "n"))), ", ").alias("transitions"))
    return out.crossJoin(F.broadcast(steps))


def call_stats(calls: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The ``k`` values of a key with the most calls: key, calls, rank; ties by the key."""
    counts = calls.groupBy(key).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), key).limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("calls"), key)))


def usage(events: DataFrame, ts: str, today: str, amount: Column) -> DataFrame:
    """One row: calls and amounts of today, the last seven days (today included), the month and all."""
    at, now = F.to_date(ts), F.to_date(F.lit(today))
    spans = {"today": at == now, "week": (at > F.date_sub(now, 7)) & (at <= now), "month": F.date_format(at, "yyyyMM") == F.date_format(now, "yyyyMM"), "all": F.lit(True)}
    parts = []
    for name, inside in spans.items():
        parts += [F.sum(inside.cast("long")).alias(f"calls_{name}"), F.sum(F.when(inside, amount).otherwise(F.lit(0).cast("decimal(18,2)"))).alias(f"amount_{name}")]
    return events.agg(*parts)


def majority(votes: DataFrame, key: str, value: str, place: str, known: Column) -> DataFrame:
    """key, value: a member of the known set first, then the most frequent, then the first seen."""
    counts = votes.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    order = Window.partitionBy(key).orderBy(F.desc(known), F.desc("_n"), "_first")
    return counts.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(key, value)
