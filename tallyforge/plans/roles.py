"""The audit's tables played by the driver's: pure projections, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item_id() -> str:
    return "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd'), cast(round(l_extendedprice * 100) AS bigint))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line as a claim: item_id, round_no, report_no, joint_no, ndt_method, welder_id, part, quantity, amount, side."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return line.join(order, line.l_orderkey == order.o_orderkey).selectExpr(
        f"{_item_id()} AS item_id",
        "year(o_orderdate) AS round_no",
        "concat('No. ', l_orderkey, '-', l_returnflag) AS full_no",
        "CASE WHEN l_linenumber % 3 <> 0 THEN concat('No. ', l_orderkey, '-', l_returnflag) END AS report_no",
        "concat('FW-', l_linenumber, '_', l_partkey) AS joint_no",
        "CASE l_returnflag WHEN 'A' THEN 'PT' WHEN 'N' THEN 'VT' ELSE 'UT' END AS ndt_method",
        "concat('W', l_suppkey) AS welder_id",
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity AS quantity",
        "cast(l_extendedprice AS decimal(18,2)) AS amount",
        "l_linestatus AS side",
        "to_date(l_shipdate) AS day",
    )


LINES_SQL = """lines AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(round(l_extendedprice * 100) AS BIGINT)) AS item_id,
  CAST(year(o_orderdate) AS INT) AS round_no, concat('No. ', l_orderkey, '-', l_returnflag) AS full_no,
  CASE WHEN l_linenumber % 3 <> 0 THEN concat('No. ', l_orderkey, '-', l_returnflag) END AS report_no,
  concat('FW-', l_linenumber, '_', l_partkey) AS joint_no, CASE l_returnflag WHEN 'A' THEN 'PT' WHEN 'N' THEN 'VT' ELSE 'UT' END AS ndt_method,
  concat('W', l_suppkey) AS welder_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS quantity,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_linestatus AS side, CAST(l_shipdate AS DATE) AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims: lines of status O."""
    return lines(spark, sf_dir).where("side = 'O'")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspection reports with joints: lines of status F by order and flag."""
    rows = lines(spark, sf_dir).where("side = 'F'")
    joint = F.struct("joint_no", "welder_id")
    return rows.groupBy(F.col("full_no").alias("report_no"), "ndt_method").agg(F.array_sort(F.collect_list(joint)).alias("joints")).withColumn("report_id", F.col("report_no"))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_partkey, required: the methods that a part's drawing asks for; null where extraction failed."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS l_partkey",
        """CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN cast(array() AS array<string>)
           ELSE filter(array(if(p_size % 2 = 0, 'PT', ''), if(p_size % 3 = 0, 'UT', ''), if(p_size % 5 < 3, 'VT', '')), x -> x <> '') END AS required""",
        "p_size % 7 = 0 AS set_flagged",
    )


REQUIRED_SQL = """requirements AS (SELECT p_partkey AS l_partkey, p_size % 7 = 0 AS set_flagged,
  CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN CAST([] AS VARCHAR[])
  ELSE list_filter([CASE WHEN p_size % 2 = 0 THEN 'PT' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN 'UT' ELSE '' END, CASE WHEN p_size % 5 < 3 THEN 'VT' ELSE '' END], lambda x: x <> '') END AS required FROM part)"""
