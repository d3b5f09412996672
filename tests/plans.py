"""What the nodes of an executed plan made."""

from pyspark.sql import DataFrame


def nodes(df: DataFrame) -> list[tuple[str, int]]:
    """Name and rows of each node that ran."""
    df.collect()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        name, rows = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
        found.append((name, rows.get().value() if rows.isDefined() else 0))
        inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
        left += [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def most_rows(df: DataFrame) -> int:
    return max(rows for _, rows in nodes(df))
