"""The Spark session that datasets run in."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sources.files import use_scratch

#: Case-sensitive names, and "double quotes" for names.
DIALECT = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Settings of the caller's session that its dataset session follows.
FOLLOWED = (
    "spark.sql.shuffle.partitions",
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.files.openCostInBytes",
    "spark.sql.autoBroadcastJoinThreshold",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "spark.sql.adaptive.coalescePartitions.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
)
_made: dict[int, tuple[SparkSession, SparkSession]] = {}


def dataset_session(spark: SparkSession | None = None) -> SparkSession:
    """A session of the same application with the dialect's settings; the caller's own is left alone."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.appName("quarrykit").getOrCreate()
    use_scratch(spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master.startswith("local"))
    held = _made.get(id(spark))
    if held is None or held[0] is not spark or spark.sparkContext._jsc is None:
        _made[id(spark)] = held = (spark, spark.newSession())
        _made[id(held[1])] = (held[1], held[1])
        for key, value in DIALECT.items():
            held[1].conf.set(key, value)
    if held[0] is not held[1]:
        for key in FOLLOWED:
            value = spark.conf.get(key, None)
            if value is not None and held[1].conf.get(key, None) != value:
                held[1].conf.set(key, value)
    return held[1]
