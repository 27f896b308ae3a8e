"""Names for micro-batches."""

from pyspark.sql import DataFrame


def batch_name(batch: DataFrame, number: int) -> str:
    """A name that is the same each time a micro-batch is attempted, and never used by another.

    Numbers start over with a new checkpoint; the query id, which lives in the checkpoint, does
    not.
    """
    query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query_id}-{number}"
