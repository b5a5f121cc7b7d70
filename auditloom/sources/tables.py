"""Reading the input tables."""

from pyspark.sql import DataFrame, SparkSession

from auditloom.sources.work import ship_package


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` of a directory with one Parquet file (or folder) per table."""
    ship_package(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")
