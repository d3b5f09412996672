"""Fuzzy candidates: claims and reports whose fields are alike, each field to its own threshold."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.evidence import token_set, token_set_ratio

#: Least score of each field (fixed values), and candidates of a claim.
THRESHOLDS, MOST = {"joint_no": 85, "ndt_method": 100, "welder_id": 90}, 5
#: Least score from which there are keys: below 200 / 3 two values may differ in as many letters as they have.
KEYED = 67
#: Subsequences of one length up to which they are keys of a value; where there are more, its pieces are.
MOST_KEYS = 500
#: Letters up to which pieces are told apart by the length of the value that was cut.
LONG = 40


def words(value: str | None) -> str:
    """A value as token_set_ratio sees it: its distinct tokens in upper case, sorted."""
    return " ".join(sorted(set((value or "").upper().split())))


def _common(n: int, m: int, least: float) -> int:
    """Least letters that values of n and m letters without a common token have in common, in order, if they score ``least``."""
    return ceil(least * (n + m) / 200 - 1e-9)


@lru_cache(maxsize=None)
def _partners(n: int, least: float) -> tuple[frozenset[int], Sequence[int], int]:
    """How values of n letters meet those without a common token: lengths of the common subsequences that are keys; lengths of
    the values that meet them by pieces; and the width of their own pieces."""
    first, last = ceil(n * least / (200 - least) - 1e-9), floor(n * (200 - least) / least + 1e-9)
    if n > MOST_KEYS:
        return frozenset(), range(first, last + 1), n // (last - n + 1)
    common, others, apart = set(), [], 0
    for m in range(first, last + 1):
        c = _common(n, m, least)
        if c > min(n, m) or c == n == m:  # equal values have common tokens
            continue
        if m <= MOST_KEYS and max(comb(n, c), comb(m, c)) <= MOST_KEYS:
            common.add(c)
        else:
            others.append(m)
            apart = max(apart, n + m - 2 * c)
    return frozenset(common), others, n // (apart + 1)


@lru_cache(maxsize=None)
def _cuts(n: int, least: float) -> set[tuple[int, int]]:
    """Lengths and widths of the pieces that values of n letters are searched for."""
    return {(min(m, LONG), _partners(m, least)[2]) for m in _partners(n, least)[1]}


def near_keys(value: str, least: float, cut: bool) -> list[str]:
    """Keys of which two values, as of words(), share one if their token_set_ratio is ``least`` or more; ``cut`` for one of them.

    The tokens. Of values without a common one, what they must have in common: as a subsequence, where a value has few of that
    length; else as a piece: of d + 1 pieces of the value that is cut, d insertions and deletions leave one whole, which the
    other one holds. Below KEYED any two values share the only key. Only keys of the last two kinds have spaces.
    """
    if least < KEYED:
        return [""]
    if not value:
        return []
    n = len(value)
    common, others, width = _partners(n, least)
    keys = set(value.split(" "))
    for c in common:
        keys.update("~ " + "".join(x) for x in combinations(value, c))
    if cut and others:
        keys.update(f"+{min(n, LONG)} {value[i : i + width]}" for i in range(0, n - width + 1, width))
    for length, width in () if cut else _cuts(n, least):
        keys.update(f"+{length} {value[i : i + width]}" for i in range(n - width + 1))
    return sorted(keys)


def bag(value: str) -> int:
    """Bits of a value's letters, the second A another than the first: bits that another value hasn't are letters that it hasn't."""
    bits, seen = 0, Counter()
    for c in value:
        bits |= 1 << (ord(c) + 37 * seen[c]) % 63
        seen[c] += 1
    return bits


@F.pandas_udf(T.StringType())
def _words(values: pd.Series) -> pd.Series:
    return values.map(words)


@F.pandas_udf(T.LongType())
def _bag(values: pd.Series) -> pd.Series:
    return values.map(bag)


def _keys_of(least: float, cut: bool):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(values: pd.Series) -> pd.Series:
        return values.map(lambda v: near_keys(v, least, cut))

    return keys


def _may_score(least: float) -> Column:
    """False only for values _a and _b that score less, by what the edit distance, the letters or the common tokens allow.

    By a key with a space those meet that have no common token; others have one that is a key.
    """
    n, m, one, two = F.col("_an"), F.col("_bn"), F.split("_a", " "), F.split("_b", " ")
    most = F.floor((100 - least) * (n + m) / 100 + 1e-9).cast("int")
    alike = lambda a, b: F.call_function("levenshtein", a, b, most) >= 0
    lacks = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y)))
    common = F.ceil(least * (n + m) / 200 - 1e-9)
    apart = (lacks("_abag", "_bbag") <= n - common) & (lacks("_bbag", "_abag") <= m - common) & alike("_a", "_b")
    both = F.array_intersect(one, two)
    shared = F.length(F.array_join(both, " "))
    ordered = lambda own: F.array_join(F.concat(both, F.array_except(own, both)), " ")
    joined = (200 * shared >= least * (shared + F.least(n, m)) - 1e-6) | alike(ordered(one), ordered(two))
    return F.when(F.col("_apart"), apart).otherwise(joined)


def near_pairs(one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    """_a, _b of all values _a of one and _b of two, as of words(), whose token_set_ratio is ``least`` or more."""
    asked = one.distinct().withColumns({"_an": F.length("_a"), "_abag": _bag("_a")}).select("*", F.explode(_keys_of(least, True)("_a")).alias("_k"))
    known = two.distinct().withColumns({"_bn": F.length("_b"), "_bbag": _bag("_b")}).select("*", F.explode(_keys_of(least, False)("_b")).alias("_k"))
    asked = asked.withColumn("_apart", F.contains("_k", F.lit(" ")))
    rows = asked.join(known, "_k").where(_may_score(least)).select("_a", "_b").distinct()
    return rows.where(token_set("_a", "_b") >= least)


@F.pandas_udf(T.DoubleType())
def _best(given: pd.Series, values: pd.Series) -> pd.Series:
    """The largest token_set_ratio of a value and any of a list, case aside."""
    known: dict[tuple[str, str], float] = {}

    def score(a: str, b: str) -> float:
        if (a, b) not in known:
            known[a, b] = token_set_ratio(a, b)
        return known[a, b]

    return pd.Series([max((score(a.upper(), b.upper()) for b in bs), default=0.0) for a, bs in zip(given, values, strict=True)])


def candidates(items: DataFrame, reports: DataFrame, thresholds: dict[str, int] | None = None, most: int = MOST) -> DataFrame:
    """item_id, report_id, score, rank, gap and a score for each field, of up to ``most`` reports a claim.

    items: item_id and the fields. reports: report_id, the fields as far as they have them, joints (array of structs with the
    rest). A report is a candidate if each field has a value on both sides that scores its threshold; a field's best joint
    counts, whichever it is. score is the fields' mean; ties go to the lesser report_id. Claims and reports meet by near
    welders and by a near key of the method; no pair that scores is passed over. Those of equal values have equal scores, so
    what meets is distinct values: of claims, and of reports, each with its first ``most`` + 1 ids.
    """
    thresholds = thresholds or THRESHOLDS
    own = {c.lower() for c in reports.columns}
    inner = {f.name for f in reports.schema["joints"].dataType.elementType.fields} if "joints" in own else set()

    def values(field: str):
        top = F.array(F.col(field)) if field in own else F.array().cast("array<string>")
        rows = F.transform("joints", lambda j: j[field]) if field in inner else F.array().cast("array<string>")
        given = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x.cast("string"))), lambda x: F.coalesce(x != "", F.lit(False))))
        return F.when(F.size(given(top)) > 0, given(top)).otherwise(given(F.coalesce(rows, F.array().cast("array<string>"))))

    fields = list(thresholds)
    near = "welder_id" if "welder_id" in fields else fields[0]
    place = Window.partitionBy(*[f"_{f}" for f in fields]).orderBy("report_id")
    left = items.select("item_id", *[F.trim(F.col(f).cast("string")).alias(f) for f in fields]).where(" AND ".join(f"{f} <> ''" for f in fields))
    right = reports.select("report_id", *[F.array_sort(values(f)).alias(f"_{f}") for f in fields]).where(" AND ".join(f"size(_{f}) > 0" for f in fields))
    right = right.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most + 1)
    right = right.groupBy(*[f"_{f}" for f in fields]).agg(F.array_sort(F.collect_list("report_id")).alias("_ids")).withColumn("_id", F.get("_ids", F.lit(0)))
    claims = left.select(*fields).distinct()
    by = lambda value, cut: F.explode(_keys_of(thresholds["ndt_method"], cut)(_words(value))) if "ndt_method" in fields else F.lit("")
    asked = claims.withColumn("_a", _words(near)).select("*", by(F.col("ndt_method"), True).alias("_m"))
    kinds = F.col("_ndt_method") if "ndt_method" in fields else F.array(F.lit(""))
    known = right.select("_id", F.explode(f"_{near}").alias("_v"), kinds.alias("_kinds")).withColumn("_b", _words("_v"))
    known = known.select("_id", "_b", F.explode("_kinds").alias("_v")).select("_id", "_b", by(F.col("_v"), False).alias("_m")).distinct()
    rows = near_pairs(asked.select("_a"), known.select("_b"), thresholds[near]).join(asked, "_a").join(known, ["_b", "_m"])
    rows = rows.select(*fields, "_id").distinct().join(right, "_id")
    for f in fields:
        rows = rows.withColumn(f"{f}_score", _best(F.col(f), F.col(f"_{f}")))
    rows = rows.where(" AND ".join(f"{f}_score >= {t}" for f, t in thresholds.items()))
    rows = rows.withColumn("score", sum((F.col(f"{f}_score") for f in fields), F.lit(0.0)) / len(fields))
    first = Window.partitionBy(*fields).orderBy(F.desc("score"), "_id")
    rows = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most + 1)
    scores = ["score", *[f"{f}_score" for f in fields]]
    each = F.transform("_ids", lambda i: F.struct((-F.col("score")).alias("_down"), i.alias("report_id"), *scores))
    best = rows.groupBy(*fields).agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, most + 1).alias("_best"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "report_id")
    rows = left.join(best, fields).select("item_id", F.inline("_best"))
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("gap", F.col("score") - F.lead("score").over(order))
    return rows.where(F.col("rank") <= most).select("item_id", "report_id", "score", "rank", "gap", *[f"{f}_score" for f in fields])
