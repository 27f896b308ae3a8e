"""Connected components of a graph of links, as Spark jobs over tables of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtarn.llm.stored import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for each node of the links ``a``, ``b`` (equal roots: one component).

    In a round each node points to its smallest neighbour, pointers are followed to their ends, and
    the links between the ends are left for the next round. Minima are taken before the shuffle;
    the other steps are joins whose hot keys adaptive execution divides.
    """
    links = stored(links.where("a <> b"), "links")
    rounds = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        parents = parents.select("node", F.least("node", "parent").alias("parent"))
        parents = _to_the_end(stored(parents, "parents"))
        rounds.append(parents)
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        links = stored(
            links.join(a, "a").join(b, "b").where("root_a <> root_b")
            .select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(),
            "links",
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root"))
    found = rounds[0]
    for later in rounds[1:]:
        found = _followed(found, later)
    return found.select("node", F.col("parent").alias("root"))


def _followed(pointers: DataFrame, later: DataFrame) -> DataFrame:
    onward = later.select(F.col("node").alias("parent"), F.col("parent").alias("onward"))
    return pointers.join(onward, "parent", "left").select(
        "node", F.coalesce("onward", "parent").alias("parent")
    )


def _to_the_end(pointers: DataFrame) -> DataFrame:
    """Each pointer set to the end of its chain, doubling the distance each time."""
    while True:
        onward = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("onward"))
        moved = stored(
            pointers.join(onward, "parent").select(
                "node", F.col("onward").alias("parent"), (F.col("onward") != F.col("parent")).alias("moved")
            ),
            "pointers",
        )
        pointers = moved.select("node", "parent")
        if moved.where("moved").isEmpty():
            return pointers
