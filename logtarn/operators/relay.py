"""Which syslog programs are let into the lake."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The programs whose records are kept.
ALLOWED_SERVICES = (
    "acme-deploy",
    "acme-register",
    "bss-init",
    "bss",
    "cloud-init-server",
    "coresmd-coredhcp",
    "coresmd-coredns",
    "haproxy",
    "hydra-gen-jwks",
    "hydra-migrate",
    "hydra",
    "opaal-idp",
    "opaal",
    "postgres",
    "smd-init",
    "smd",
    "step-ca",
    "versitygw",
    "registry",
)


def allow_listed(
    records: DataFrame, program: str = "appname", services: Iterable[str] = ALLOWED_SERVICES
) -> DataFrame:
    """Keep the records of the listed programs.

    The list is a constant of the plan, not a joined table: the test is a set lookup inside the
    scan's own stage and is pushed down to columnar sources.
    """
    return records.where(F.col(program).isin(*services))


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    """The programs of a lookup table: JSON with a ``table`` of ``index`` and ``value``, of which
    those with the value ``"1"`` are let in. Read anew each time it is called.

    A program that is listed twice is let in if its first entry says so.
    """
    entry = "array<struct<index: string, value: string>>"
    table = spark.read.schema(f"table {entry}").json(path, multiLine=True)
    listed = table.select(F.posexplode("table").alias("place", "entry"))
    first = listed.groupBy(F.col("entry.index").alias("program")).agg(F.min_by("entry.value", "place").alias("value"))
    return first.where("value = '1'").select("program")


def allow_listed_by(records: DataFrame, allowed: DataFrame, program: str = "service") -> DataFrame:
    """Keep the records of the programs in a table, by a semi join whose form follows its size."""
    listed = allowed.select(F.col("program").alias("_program")).distinct()
    return records.join(listed, F.col(program) == F.col("_program"), "left_semi")
