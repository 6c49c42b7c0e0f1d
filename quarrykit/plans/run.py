"""SQL over a DataFrame that the text calls ``bundle``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import sqltext


def run_sql(df: DataFrame | None, sql: str, parameters: list | None = None, session=None) -> DataFrame:
    """Analyses at once, against df as it is now: a later ``bundle`` doesn't change the result."""
    spark = session or df.sparkSession
    if df is not None:
        df.createOrReplaceTempView("bundle")
    text, values = sqltext.bind(sql, parameters or [])
    parts = sqltext.union_by_name(text)
    if parts:
        out = None
        for part, keep in parts:
            one = spark.sql(sqltext.translate(part), values)
            out = one if out is None else out.unionByName(one)
            out = out if keep else out.distinct()
        return out
    return spark.sql(sqltext.translate(text), values)
