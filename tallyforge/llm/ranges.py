"""Global order over range partitions: each partition's rows, and what lies before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.store import cut


def totals_before(parts: DataFrame, part: str, amount: str) -> DataFrame:
    """(part, before): the sum of ``amount`` over all smaller parts. One row a part is collected, never one a document."""
    rows = sorted(tuple(r) for r in parts.groupBy(part).agg(F.sum(amount)).collect())
    out, before = [], 0
    for number, total in rows:
        out.append((number, before))
        before += total or 0
    return parts.sparkSession.createDataFrame(out, f"{part} int, before long")


def sorted_parts(df: DataFrame, *order) -> DataFrame:
    """df in range partitions, sorted within each, with its partition's number in ``part``; cut, so that it stays so."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return cut(out)
