"""Queries over the lake."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.functions.json_text import only_value, register_json_functions, with_members
from logtarn.schemas import PAYLOAD_COLUMN, check_stream
from logtarn.sources.lake import Lake, sources

SOURCES = "SOURCES"


def query_sources(records: DataFrame, text: str, args: dict | None = None) -> DataFrame:
    """Run SQL over a relation named ``SOURCES``, as often as the text mentions it.

    ``json_extract_string(column, path)`` reads into the payload columns. Values go in as named
    parameters (``:name``).
    """
    spark = records.sparkSession
    register_json_functions(spark)
    records.createOrReplaceTempView(SOURCES)
    return spark.sql(text.strip().rstrip(";"), args=args or {})


def query(
    spark: SparkSession,
    lake: Lake,
    text: str,
    stream: str = "logs",
    scope: str = "all",
    args: dict | None = None,
    extra_fields: tuple[str, ...] | str = (),
) -> DataFrame:
    """Run SQL over the chosen tiers of a stream."""
    return query_sources(sources(spark, lake, stream, scope, extra_fields), text, args)


def dump(
    spark: SparkSession,
    lake: Lake,
    stream: str = "logs",
    scope: str = "all",
    nested: bool = True,
    extra_fields: tuple[str, ...] | str = (),
) -> DataFrame:
    """Every record of the chosen tiers, the payload as nested data or else as JSON text."""
    found = query(spark, lake, f"SELECT * FROM {SOURCES}", stream, scope, extra_fields=extra_fields)
    return expand_payload(found, stream) if nested else found


def payload(text: Column) -> Column:
    """JSON text as a VARIANT, so that it nests in JSON output; other text stays text, whole."""
    return F.coalesce(F.try_parse_json(only_value(text)), text.cast("variant"))


def expand_payload(records: DataFrame, stream: str) -> DataFrame:
    """Turn the stream's payload column from JSON text into a VARIANT, if it is there."""
    name = PAYLOAD_COLUMN[check_stream(stream)]
    if name not in records.columns:
        return records
    return records.withColumn(name, payload(F.col(name)))


def json_rows(records: DataFrame, stream: str | None = "logs") -> DataFrame:
    """Each row as one JSON object in column ``json``, nulls included.

    The stream's payload nests, by splicing its checked text into the row; other text stays a
    string. With ``stream`` None every column is written as it is.
    """
    keep_nulls = {"ignoreNullFields": "false"}
    name = PAYLOAD_COLUMN[check_stream(stream)] if stream else None
    kinds = dict(records.dtypes)
    if kinds.get(name) != "string":
        return records.select(F.to_json(F.struct(*records.columns), keep_nulls).alias("json"))
    others = F.to_json(F.struct(*[c for c in records.columns if c != name]), keep_nulls)
    as_text = F.to_json(F.struct(F.col(name).alias("t")), keep_nulls)
    value = F.coalesce(
        only_value(F.col(name)), F.substring(as_text, F.lit(6), F.length(as_text) - 6)
    )
    member = F.concat(F.lit(f'"{name}":'), value)
    return records.select(with_members(others, member).alias("json"))


def between_dates(records: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Records whose folder date lies in the range, both ends included; prunes folders."""
    day = F.col("date")
    if first is not None:
        records = records.where(day >= F.lit(first).cast("date"))
    if last is not None:
        records = records.where(day <= F.lit(last).cast("date"))
    return records
