"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession


def tune(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adaptive execution splits skewed joins and merges small partitions at run time."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
