"""A training corpus from raw documents, stage by stage.

Each stage takes what its predecessor kept, as a written table, and its decisions take effect:
repetitive texts go, one of each group of near copies stays, texts with benchmark passages go,
personal data is replaced, and documents are drawn by their raked weights. All stages but the last
return the columns of the documents; the last adds ``weight`` and ``copies``. Each is a function of
documents and settings alone, so a stage that fails can be run again on its input.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.llm import pii, raking, repetition, simhash, winnowing
from logtarn.llm.registry import table
from logtarn.llm.stored import stored, unused
from logtarn.session import configure


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    configure(spark)
    return repetition.without_repetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies."""
    configure(spark)
    return simhash.without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    configure(spark)
    return winnowing.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    configure(spark)
    return pii.redacted(docs, pii.train(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn at least once, with their raked weight and number of copies.

    A document may have columns of these names; those added get longer names then.
    """
    configure(spark)
    names = [unused("weight", docs.columns), unused("copies", docs.columns)]
    drawn = raking.mixed_to(docs).where("copies > 0")
    return drawn.select("documents.*", F.col("weight").alias(names[0]), F.col("copies").alias(names[1]))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: SQL has neither the fingerprints' hash nor boosted trees; a test runs each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
