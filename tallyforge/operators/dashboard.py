"""What a reviewer looks at: filters and orders of judged claims, drawings in force, samples and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(rows: DataFrame, least_risk: int = 30, review: bool | None = None, verdicts: list[str] | None = None, methods: list[str] | None = None, welder: str = "") -> DataFrame:
    """Judged claims of a risk of ``least_risk`` or more, and what else is asked for; the welder's name in any case.

    Claims that need a review come first, then the riskiest, then by item_id.
    """
    out = rows.where(F.coalesce("risk", F.lit(0)) >= least_risk)
    if review is not None:
        out = out.where(F.coalesce("needs_review", F.lit(False)) == review)
    if verdicts:
        out = out.where(F.col("verdict").isin(*verdicts))
    if methods:
        out = out.where(F.col("ndt_method").isin(*methods))
    if welder:
        out = out.where(F.contains(F.lower("welder_id"), F.lit(welder.lower())))
    return out.orderBy(F.desc("needs_review"), F.desc("risk"), "item_id")


def figures(rows: DataFrame) -> DataFrame:
    """One row: claims, noncompliant, suspect, without a report, of high risk."""
    n = lambda test: F.count(F.when(test, 1))
    return rows.agg(F.count("*").alias("n"), n(F.col("verdict") == "NONCOMPLIANT").alias("n_noncompliant"), n(F.col("verdict") == "SUSPECT").alias("n_suspect"), n(F.col("report_id").isNull()).alias("n_unmatched"), n(F.col("risk") >= 80).alias("n_high"))


def to_correct(rows: DataFrame, rules: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Claims with a finding among ``rules``, and labels: what the chosen findings are called, each once, sorted."""
    wanted = F.array(*map(F.lit, rules))
    table = F.create_map(*[F.lit(x) for r in rules for x in (r, (names or {}).get(r, r))])
    labels = F.array_sort(F.array_distinct(F.transform(F.filter("findings", lambda f: f.isin(*rules)), lambda f: F.element_at(table, f))))
    return rows.where(F.arrays_overlap("findings", wanted)).withColumn("labels", labels)


def shown_drawings(sets: DataFrame, part: str = "") -> DataFrame:
    """Sets in force whose number holds ``part``: drawing_no, set_revision, n_requirements, n_lines, n_reasons, by number.

    sets: drawing_no, set_revision, superseded_at, and the arrays requirements, kks_lines, review_reasons (null counts as none).
    """
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    rows = sets.where(F.col("superseded_at").isNull() & F.contains("drawing_no", F.lit(part)))
    return rows.select("drawing_no", "set_revision", F.greatest(count("requirements"), F.lit(0)).alias("n_requirements"), F.greatest(count("kks_lines"), F.lit(0)).alias("n_lines"), F.greatest(count("review_reasons"), F.lit(0)).alias("n_reasons")).orderBy("drawing_no", "set_revision")


def rounds(rows: DataFrame) -> DataFrame:
    """Rounds, the latest billing date first, then the highest id."""
    return rows.orderBy(F.desc_nulls_last("billing_date"), F.desc("round_no"))


def latest_round(rows: DataFrame) -> DataFrame:
    """The round of the highest id, as one row."""
    return rows.agg(F.max("round_no").alias("round_no"))


def samples(rows: DataFrame, by: list[Column | str], k: int = 20) -> DataFrame:
    """The first ``k`` rows in the given order: a report's excerpt."""
    return rows.orderBy(*by).limit(k)


def shortened(text: Column, reasons: Column, invented: Column, differences: Column) -> Column:
    """struct of what a report shows at most: 1500 characters, 5 reasons, 20 invented numbers, 50 differences."""
    return F.struct(F.substring(text, 1, 1500).alias("text"), F.slice(reasons, 1, 5).alias("reasons"), F.slice(invented, 1, 20).alias("invented"), F.slice(differences, 1, 50).alias("differences"))


def distribution(rows: DataFrame, column: str, none: str = "(unspecified)") -> DataFrame:
    """value, n: rows by the value of a column; null and blank under ``none``."""
    value = F.when(F.trim(column) != "", F.col(column)).otherwise(none)
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """value, n in the order of n, then of the value."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def ingested(files: DataFrame, sets: DataFrame, requirements: DataFrame) -> DataFrame:
    """One row of counters of an ingestion: files, unclassified, failed, sets, complete, partial, duplicates, requirements.

    files: drawing_no, type (null: unclassified), failed. sets: types (array), collisions (array). A set is complete with a DC, an
    SD and a BG.
    """
    n = lambda test: F.count(F.when(test, 1))
    whole = F.size(F.array_intersect("types", F.array(F.lit("DC"), F.lit("SD"), F.lit("BG")))) == 3
    one = files.agg(F.count("*").alias("files"), n(F.col("type").isNull() | F.col("drawing_no").isNull()).alias("unclassified"), n(F.col("failed")).alias("failed"))
    two = sets.agg(F.count("*").alias("sets"), n(whole).alias("complete"), n(~whole).alias("partial"), F.coalesce(F.sum(F.size("collisions").cast("long")), F.lit(0)).alias("duplicates"))
    return one.crossJoin(two).crossJoin(requirements.agg(F.count("*").alias("requirements")))


def table_differences(one: Column, two: Column) -> Column:
    """struct(rows, cells, differing, same_shape) of two tables (arrays of rows of texts); missing cells count as blank."""
    height = F.greatest(F.size(one), F.size(two))
    cell = lambda t, r, c: F.trim(F.coalesce(F.get(F.get(t, r), c), F.lit("")))
    width = lambda r: F.greatest(F.coalesce(F.size(F.get(one, r)), F.lit(0)), F.coalesce(F.size(F.get(two, r)), F.lit(0)))
    steps = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    rows = F.transform(steps(height), lambda r: F.struct(width(r).alias("n"), F.size(F.filter(steps(width(r)), lambda c: cell(one, r, c) != cell(two, r, c))).alias("d")))
    total = lambda f: F.aggregate(rows, F.lit(0), lambda a, x: a + x[f])
    shape = lambda t: F.transform(t, lambda r: F.size(r))
    return F.struct(height.alias("rows"), total("n").alias("cells"), total("d").alias("differing"), (shape(one) == shape(two)).alias("same_shape"))


def set_reasons(sets: DataFrame) -> DataFrame:
    """drawing_no, reasons of a set's review: conflicts between its files, joints without a requirement, and its files' own (five each at most).

    sets: drawing_no, conflicts, missing_joints, file_reasons (arrays; null counts as none).
    """
    none = F.array().cast("array<string>")
    given = lambda c: F.coalesce(F.col(c), none)
    counted = lambda c, word: F.when(F.size(given(c)) > 0, F.array(F.concat(F.size(given(c)).cast("string"), F.lit(f" {word}: "), F.array_join(F.slice(given(c), 1, 5), ", ")))).otherwise(none)
    return sets.select("drawing_no", F.concat(counted("conflicts", "conflicts"), counted("missing_joints", "joints without a requirement"), F.slice(given("file_reasons"), 1, 5)).alias("reasons"))
