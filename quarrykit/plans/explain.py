"""Plans as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def explained(df: DataFrame) -> str:
    plans = df._jdf.queryExecution()
    return f"*** logical_plan ***\n{plans.optimizedPlan().toString()}\n*** physical_plan ***\n{plans.executedPlan().toString()}"
