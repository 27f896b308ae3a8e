"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions.

Token counts per cell of source, language and topic are raked to the target totals of each margin.
A cell's weight is the product of one factor per margin; a sweep sets the factors of each margin
in turn so that its totals hold. Documents are then sampled: a weight of 2.3 keeps two copies of
each document and a third with probability 0.3, drawn from a hash of its id, so a run can be
repeated and each document is decided alone.

Targets are data or, by default, the actual shares raised to a power below one, which lifts rare
values. Null in a margin is a value of its own. Null or empty texts have no tokens; they weigh
nothing and get the weight of their cell. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored

MARGINS = ("source", "lang", "topic")
#: Default targets are shares to this power.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.8}
SWEEPS = 8
CHARS_PER_TOKEN = 4


def topic_of(text: Column) -> Column:
    """A coarse topic by content: contact data, figures, prose."""
    return (
        F.when(text.contains("@"), "contact").when(text.rlike("[0-9]"), "figures").otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """About how many tokens a text has."""
    return F.floor((F.coalesce(F.char_length(text), F.lit(0)) + CHARS_PER_TOKEN - 1) / CHARS_PER_TOKEN)


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """``value`` and ``target`` tokens: shares to a power, adding up to the tokens there are."""
    actual = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
    powered = actual.select(
        "value", "tokens", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(power))).otherwise(0.0).alias("p")
    )
    every = powered.agg(F.sum("tokens").alias("tokens"), F.sum("p").alias("p")).first()
    return powered.select("value", (F.col("p") * ((every.tokens or 0.0) / (every.p or 1.0))).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> dict[str, DataFrame]:
    """``value`` and ``factor`` of each margin. ``cells`` has the margins and ``tokens``."""
    factors = {
        margin: stored(target.select("value", F.lit(1.0).alias("factor")), "factors")
        for margin, target in targets.items()
    }
    for _ in range(sweeps):
        for margin, target in targets.items():
            weighted = cells
            for other in targets:
                if other != margin:
                    weighted = with_factor(weighted, other, factors[other], f"f_{other}")
            product = F.col("tokens")
            for other in targets:
                if other != margin:
                    product = product * F.col(f"f_{other}")
            sums = weighted.groupBy(F.col(margin).alias("value")).agg(F.sum(product).alias("now"))
            sums = sums.withColumnRenamed("value", "of")
            factors[margin] = stored(
                target.join(sums, F.col("value").eqNullSafe(F.col("of"))).select(
                    "value",
                    F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(1.0).alias("factor"),
                ),
                "factors",
            )
    return factors


def with_factor(frame: DataFrame, margin: str, factor: DataFrame, name: str) -> DataFrame:
    factor = factor.select(F.col("value").alias("of"), F.col("factor").alias(name))
    return frame.join(factor, F.col(margin).eqNullSafe(F.col("of")), "left").drop("of")


def mixed_to(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS
) -> DataFrame:
    """``documents`` (a struct of their columns), ``topic``, ``tokens``, ``weight``, ``copies``."""
    work = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("documents"),
        F.col("source").alias("source"),
        F.col("lang").alias("lang"),
        topic_of(F.col("text")).alias("topic"),
        tokens_of(F.col("text")).alias("tokens"),
    )
    cells = stored(work.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    if targets is None:
        targets = {m: stored(tempered(cells, m, TEMPER[m]), "targets") for m in MARGINS}
    factors = rake(cells, targets, sweeps)
    # The weights of the cells first: one join with the documents instead of three.
    weight = F.lit(1.0)
    for margin in targets:
        cells = with_factor(cells, margin, factors[margin], f"f_{margin}")
        weight = weight * F.coalesce(f"f_{margin}", F.lit(1.0))
    cells = stored(cells.select(*[F.col(m).alias(f"of_{m}") for m in MARGINS], weight.alias("weight")), "weights")
    same = F.lit(True)
    for margin in MARGINS:
        same &= F.col(margin).eqNullSafe(F.col(f"of_{margin}"))
    drawn = F.md5(F.coalesce(F.col("documents.doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") / float(1 << 32)
    whole = F.floor("weight")
    copies = whole + (drawn < F.col("weight") - whole).cast("long")
    return work.join(cells, same).select(
        "documents", "topic", "tokens", "weight", copies.alias("copies")
    )


def _oracle() -> str:
    """The sweeps written out as common table expressions."""
    select = {m: f"SELECT {m} AS v, sum(tokens) AS t FROM cells GROUP BY 1" for m in MARGINS}
    parts = [
        "doc AS (SELECT doc_id, source, lang, CASE WHEN contains(text, '@') THEN 'contact' "
        "WHEN regexp_matches(text, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic, "
        f"CAST(floor((coalesce(length(text), 0) + {CHARS_PER_TOKEN - 1}) / {CHARS_PER_TOKEN}) AS BIGINT) AS tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM doc GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(
            f"t_{m} AS MATERIALIZED (SELECT v, pow(t, {TEMPER[m]}) / sum(pow(t, {TEMPER[m]})) OVER () * sum(t) OVER () AS target "
            f"FROM ({select[m]}))"
        )
        parts.append(f"{m}_0 AS MATERIALIZED (SELECT v, CAST(1 AS DOUBLE) AS f FROM t_{m})")
    last = {m: f"{m}_0" for m in MARGINS}
    for k in range(1, SWEEPS + 1):
        for m in MARGINS:
            a, b = [x for x in MARGINS if x != m]
            parts.append(
                f"{m}_{k} AS MATERIALIZED (SELECT t.v, target / now AS f FROM t_{m} t JOIN ("
                f"SELECT c.{m} AS v, sum(tokens * a.f * b.f) AS now FROM cells c "
                f"JOIN {last[a]} a ON c.{a} IS NOT DISTINCT FROM a.v "
                f"JOIN {last[b]} b ON c.{b} IS NOT DISTINCT FROM b.v GROUP BY 1) n "
                "ON t.v IS NOT DISTINCT FROM n.v)"
            )
            last[m] = f"{m}_{k}"
    joins = " ".join(f"JOIN {last[m]} {m}f ON doc.{m} IS NOT DISTINCT FROM {m}f.v" for m in MARGINS)
    drawn = "CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"
    weight = " * ".join(f"{m}f.f" for m in MARGINS)
    return (
        f"WITH {', '.join(parts)}, w AS (SELECT doc.*, {weight} AS x FROM doc {joins}) "
        "SELECT doc_id, source, lang, topic, tokens, round(x, 4) AS weight, "
        f"CAST(floor(x) AS BIGINT) + CASE WHEN {drawn} < x - floor(x) THEN 1 ELSE 0 END AS copies FROM w"
    )


@registered(_oracle())
def op3_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight and sampled copies of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixed_to(docs).select(
        "documents.doc_id", "documents.source", "documents.lang", "topic", "tokens",
        F.round("weight", 4).alias("weight"), "copies",
    )
