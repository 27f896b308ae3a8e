"""What is in the lake: columns, types, dates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtarn.functions.json_text import is_object, only_value
from logtarn.functions.times import event_date


def dataset_schema(records: DataFrame) -> DataFrame:
    """Name, type and nullability of each column. Takes no look at the data."""
    rows = [
        (f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO")
        for f in records.schema.fields
    ]
    return records.sparkSession.createDataFrame(
        rows, "column_name string, column_type string, is_nullable string"
    )


def schema_profile(lines: DataFrame, line: str = "value") -> DataFrame:
    """The fields that occur in JSON lines: types seen, records with the field, null values.

    Shows where the data has drifted from the declared schema. Lines that are not JSON objects
    contribute nothing.
    """
    spark = lines.sparkSession
    checked = lines.select(only_value(F.col(line)).alias("text"))
    records = checked.where(is_object(F.col("text"))).select(
        F.try_parse_json("text").alias("record")
    )
    members = records.lateralJoin(spark.tvf.variant_explode(F.col("record").outer())).select(
        F.col("key").alias("field"),
        # The outermost type only: STRING, OBJECT, DECIMAL, ...
        F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z ]+", 0).alias("type"),
    )
    counted = (
        members.where(F.col("field").isNotNull())
        .groupBy("field", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most one row per field and type is left: a handful to collect for each field.
    return counted.groupBy("field").agg(
        F.concat_ws(
            ",", F.array_sort(F.collect_list(F.when(F.col("type") != "VOID", F.col("type"))))
        ).alias("types"),
        F.sum("n").alias("records"),
        F.sum(F.when(F.col("type") == "VOID", F.col("n")).otherwise(F.lit(0))).alias("nulls"),
    )


def available_dates(records: DataFrame, from_folders: bool = True) -> DataFrame:
    """The days that there are records of, in order.

    They are those of the folders, so hardly a column is read. With ``from_folders`` off they come
    from ``ts`` instead: the same in a lake written by this package, but for records without a
    time, which lie in the folder of the day they were received.
    """
    day = F.col("date") if from_folders else event_date(F.col("ts"))
    return records.select(day.alias("date")).distinct().orderBy("date")
