"""Sinks: upserts with type checks, rows that failed, and result folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators import rules
from tallyforge.operators.ledger import upsert


def get_or_create(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new whose keys (null-safe) it lacks."""
    marked = new.alias("n")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return old.unionByName(marked.join(old.alias("o"), condition, "left_anti").select(*old.columns))


def upsert_standards(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by file_path that fails where a path is known under another type."""
    clash = new.select("file_path", F.col("type").alias("_new")).join(old.select("file_path", "type"), "file_path").where("type <> _new")
    if row := clash.orderBy("file_path").first():
        raise ValueError(f"{row['file_path']} is a {row['type']}, not a {row['_new']}")
    return upsert(old, new, ["file_path"])


def with_row_index(rows: DataFrame, ordinal: str) -> DataFrame:
    """row_index from 0 in the order of the source's own ordinal within each round."""
    return rows.withColumn("row_index", F.row_number().over(Window.partitionBy("round_no").orderBy(ordinal)) - 1)


def guarded(findings: Column, error: Column) -> Column:
    """findings, or the one that says that the row failed."""
    return F.when(error.isNotNull(), F.array(F.lit("pipeline_row_failed"))).otherwise(findings)


def with_errors(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with ``error``: the names of the checks that fail for the row, or null; a check that gives null fails.

    Rows that fail stay, so that guarded() can name them; one bad row never takes others with it.
    """
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(fine, F.lit(False)), F.lit(name)) for name, fine in checks.items()]))
    return rows.withColumn("error", F.when(F.size(failed) > 0, F.array_join(failed, ", ")))


def by_set(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(good, failed): rows of sets without an error, and all rows of sets with one, with the set's first error."""
    bad = rows.groupBy(key).agg(F.min("error").alias("_error")).where("_error IS NOT NULL")
    good = rows.join(bad, key, "left_anti").drop("error")
    return good, rows.drop("error").join(bad.withColumnRenamed("_error", "error"), key)


def appended(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Results (matches, findings, notes) of a round put in place of those it had, so that a second run changes nothing."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new, allowMissingColumns=True)


def colour(needs_review: Column, risk: Column, limit: int = 60) -> Column:
    """Review before risk: blue; red from 80, orange from ``limit``; else none."""
    return F.when(needs_review, "blue").when(risk >= 80, "red").when(risk >= limit, "orange").otherwise("none")


# The columns that a review sheet adds, in their order.
REVIEW_COLUMNS = (
    "매칭_성적서번호", "매칭_방법", "매칭_점수", "도면_요구NDT", "타행_요구NDT", "과다_검사", "적합성_판정", "근거_상태",
    "위험도", "재확인_필요", "재확인_사유", "LLM_설명", "근거_문서", "근거_조항/페이지", "권장_조치", "검토자_메모",
)


def review_sheet(source: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """The source's rows, all of them and in all their columns, with REVIEW_COLUMNS.

    judged: ``key`` and report_no, how, score, required, still_required, extra_method, verdict, basis_state, risk, reasons
    (array), summary, refs (for rules.citations), action. A row without a judgement has blanks; the last column is the
    reviewer's own.
    """
    text = lambda x: F.nullif(F.array_join(F.array_sort(x), ", "), F.lit(""))
    accused = F.coalesce(F.col("basis_state") == "no_basis_found", F.lit(False))
    cited = rules.citations(F.col("refs"), accused)
    values = (
        F.col("report_no"), F.col("how"), F.round("score", 1), text(F.col("required")), text(F.col("still_required")), F.col("extra_method"), F.col("verdict"),
        rules.basis_label(F.col("basis_state")), F.col("risk"), F.when(F.size("reasons") > 0, "필요"),
        F.when(F.size("reasons") > 0, F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("- "), r)), "\n")), F.col("summary"),
        cited["docs"], cited["places"], F.col("action"), F.lit(None).cast("string"),
    )
    return source.join(judged.select(key, *[v.alias(n) for v, n in zip(values, REVIEW_COLUMNS, strict=True)]), key, "left")


def label_sheet(items: DataFrame, matches: DataFrame, findings: DataFrame, reports: DataFrame) -> DataFrame:
    """What a person labels: item_id, the claim, its match and verdict, with blank columns for the answers."""
    rows = items.join(matches, "item_id", "left").join(findings, "item_id", "left").join(reports, "report_id", "left")
    blank = [F.lit(None).cast("string").alias(c) for c in ("answer_report_no", "answer_verdict", "comment")]
    return rows.select("item_id", *[c for c in items.columns if c != "item_id"], "report_id", *[c for c in findings.columns if c != "item_id"], *[c for c in reports.columns if c != "report_id"], *blank)


def guide(sheets: dict[str, DataFrame], path: str) -> None:
    """One snapshot of several sheets: a folder of CSV for each."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").option("header", "true").csv(f"{path.rstrip('/')}/{name}")


def write_review(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_vectors(rows: DataFrame, path: str, size: int) -> None:
    """Vectors (doc, vec) of the right size only, by document."""
    rows.where(F.size("vec") == size).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Vectors of documents all of whose vectors have the right size and only finite components; other documents are left out."""
    rows = spark.read.parquet(path)
    good = (F.size("vec") == size) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = rows.groupBy("doc").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_good")).where("NOT _good")
    return rows.join(bad, "doc", "left_anti")
