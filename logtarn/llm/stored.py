"""Intermediate tables in the folder that all executors reach."""

from pyspark.sql import DataFrame

from logtarn.session import work_area


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, written once and read again.

    Cuts the lineage: a lost executor costs its running tasks, not the steps before.
    """
    spark = frame.sparkSession
    path = work_area(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """The name, or a longer one if a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
